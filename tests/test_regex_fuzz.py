"""Regex dialect parity: Spark ``rlike(to_java_regex(p))`` vs DuckDB (RE2) ``regexp_matches(s, p)``."""

import duckdb
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from eventlens.functions.regex import to_java_regex

SUBJECTS = [
    "a.py", "a.py\n", "a.py\r\n", "A.PY", "a\rb", "a\nb", "a b", "ab", "", "abc$", "x$y",
    "/home/u/data/f.csv", "test_1.ipynb", "demofile12.py", "a b", "a\tb", "[x]", "\\", "a.b.c",
]

ATOMS = ["a", "b", "c", "x", ".", "\\.", "\\d", "\\w", "[ab]", "[^a]", "[.$]", "\\$", "py", "/", "_", " ",
         "[[:digit:]]", "[[:alpha:]]", "[^[:space:]]", "[[:punct:]]", "(?P<g>a.)"]


@st.composite
def patterns(draw):
    parts = []
    if draw(st.booleans()):
        parts.append("^")
    for _ in range(draw(st.integers(1, 4))):
        atom = draw(st.sampled_from(ATOMS))
        q = draw(st.sampled_from(["", "", "*", "+", "?", "{1,2}"]))
        parts.append(atom + q)
    body = "".join(parts)
    if draw(st.booleans()):
        body = f"({body}|{draw(st.sampled_from(ATOMS))})"
    if draw(st.booleans()):
        body += "$"
    # group names must be unique in both dialects
    parts = body.split("(?P<g>")
    return parts[0] + "".join(f"(?P<g{i}>{p}" for i, p in enumerate(parts[1:]))


@pytest.fixture(scope="module")
def subjects(spark):
    return spark.createDataFrame([(i, s) for i, s in enumerate(SUBJECTS)], "i int, s string")


@settings(max_examples=40, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(pattern=patterns())
def test_rewritten_java_regex_matches_like_re2(subjects, pattern):
    got = {r.i for r in subjects.where(F.col("s").rlike(to_java_regex(pattern))).select("i").collect()}
    con = duckdb.connect()
    want = {
        i for i, s in enumerate(SUBJECTS)
        if con.execute("SELECT regexp_matches(?, ?)", [s, pattern]).fetchone()[0]
    }
    assert got == want, (pattern, sorted(got ^ want))
