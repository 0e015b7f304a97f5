"""Plan inspection for tests and tuning: what the physical plan scans and shuffles."""

from __future__ import annotations

import io
import re
from contextlib import redirect_stdout

from pyspark.sql import DataFrame


def plan_text(df: DataFrame, mode: str = "formatted") -> str:
    """The text ``df.explain(mode)`` prints."""
    buf = io.StringIO()
    with redirect_stdout(buf):
        df.explain(mode)
    return buf.getvalue()


def plan_tree(df: DataFrame) -> str:
    """Only the operator tree of the formatted plan (before the node details)."""
    text = plan_text(df, "formatted")
    return text.split("\n\n\n", 1)[0]


def count_nodes(df: DataFrame, pattern: str) -> int:
    return len(re.findall(pattern, plan_tree(df)))


def file_scans(df: DataFrame) -> int:
    return count_nodes(df, r"Scan (parquet|csv|json|orc)")


def shuffles(df: DataFrame) -> int:
    """Shuffle exchanges (broadcasts and reused exchanges excluded)."""
    return count_nodes(df, r"(?<![A-Za-z])Exchange \(")


def pushed_filters(df: DataFrame) -> list[str]:
    return re.findall(r"PushedFilters: \[(.*)\]", plan_text(df, "formatted"))


def python_evals(df: DataFrame) -> int:
    """Python UDF / Pandas UDF evaluation nodes (should be zero here)."""
    return count_nodes(df, r"(BatchEvalPython|ArrowEvalPython|FlatMapGroupsInPandas|PythonMapInArrow|MapInArrow|MapInPandas)")
