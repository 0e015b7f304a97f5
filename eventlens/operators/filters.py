"""Three-mode facet filters (P2-P10): exact values, substrings, regexes.

Within a column the modes are ORed; across columns they are ANDed, and the
date range (applied by the source, P1) is ANDed on top. Everything becomes
one Catalyst ``Column``: exact values push down to Parquet as ``In``,
plain substrings as ``StringContains``.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from eventlens.functions.regex import (
    is_regex_term,
    strip_marker,
    to_java_regex,
    validate_patterns,
)

LIKE_WILDCARDS = ("%", "_")


def _clean(mapping: Mapping[str, Iterable] | None) -> dict[str, tuple]:
    """Drop columns whose value list is empty (an empty list is no constraint)."""
    out: dict[str, tuple] = {}
    for key, values in (mapping or {}).items():
        if values is None:
            continue
        if isinstance(values, (str, bytes)) or not isinstance(values, Iterable):
            values = [values]
        values = tuple(values)
        if values:
            out[str(key)] = values
    return out


def qcol(name: str) -> Column:
    """Column by exact name (names may hold dots or spaces)."""
    return F.col("`" + name.replace("`", "``") + "`")


@dataclass(frozen=True)
class FilterSpec:
    """Per-column filter terms. Keys are column names; empty lists are dropped."""

    exact: Mapping[str, tuple] = field(default_factory=dict)
    substring: Mapping[str, tuple] = field(default_factory=dict)
    regex: Mapping[str, tuple] = field(default_factory=dict)

    def __post_init__(self):
        object.__setattr__(self, "exact", _clean(self.exact))
        object.__setattr__(self, "substring", _clean(self.substring))
        object.__setattr__(self, "regex", _clean(self.regex))

    @classmethod
    def from_request(cls, body: Mapping | None) -> FilterSpec:
        """From a request body with ``filters`` / ``substringFilters`` / ``regexFilters``."""
        body = body or {}
        return cls(
            exact=body.get("filters") or {},
            substring=body.get("substringFilters") or {},
            regex=body.get("regexFilters") or {},
        )

    @classmethod
    def from_terms(
        cls,
        selected: Mapping[str, Iterable] | None = None,
        typed: Mapping[str, Iterable[str]] | None = None,
    ) -> FilterSpec:
        """Chosen options become exact values; typed terms starting with ``/`` are regexes,
        any other typed term is a substring."""
        substring: dict[str, list[str]] = {}
        regex: dict[str, list[str]] = {}
        for column, terms in (typed or {}).items():
            for term in terms:
                (regex if is_regex_term(term) else substring).setdefault(column, []).append(term)
        return cls(exact=dict(selected or {}), substring=substring, regex=regex)

    @property
    def columns(self) -> list[str]:
        seen: dict[str, None] = {}
        for mapping in (self.exact, self.substring, self.regex):
            for key in mapping:
                seen.setdefault(key, None)
        return list(seen)

    @property
    def is_empty(self) -> bool:
        return not self.columns

    def without(self, column: str) -> FilterSpec:
        """The same spec minus every term on ``column``."""
        return FilterSpec(
            exact={k: v for k, v in self.exact.items() if k != column},
            substring={k: v for k, v in self.substring.items() if k != column},
            regex={k: v for k, v in self.regex.items() if k != column},
        )

    def to_request(self) -> dict:
        return {
            "filters": {k: list(v) for k, v in self.exact.items()},
            "substringFilters": {k: list(v) for k, v in self.substring.items()},
            "regexFilters": {k: list(v) for k, v in self.regex.items()},
        }


def like_pattern(term: str) -> str:
    """``%term%`` for Spark LIKE with ``%``/``_`` kept as wildcards and ``\\`` literal."""
    return "%" + term.replace("\\", "\\\\") + "%"


def substring_predicate(c: Column, term: str) -> Column:
    """Case-sensitive substring test; ``%`` and ``_`` inside the term are wildcards."""
    if any(w in term for w in LIKE_WILDCARDS):
        return c.like(like_pattern(term))
    return c.contains(term)


def regex_predicate(c: Column, pattern: str) -> Column:
    """Unanchored match with RE2 semantics adjusted for Java (leading ``/`` stripped)."""
    return c.rlike(to_java_regex(strip_marker(pattern)))


def _as_string(c: Column, dtype) -> Column:
    return c if isinstance(dtype, StringType) else c.cast("string")


def column_predicate(schema: StructType, column: str, spec: FilterSpec) -> Column | None:
    """OR of every exact / substring / regex term on one column."""
    dtype = schema[column].dataType
    c = qcol(column)
    parts: list[Column] = []
    values = spec.exact.get(column)
    if values:
        if isinstance(dtype, StringType):
            parts.append(c.isin([v if isinstance(v, str) else str(v) for v in values]))
        else:
            # Cast the literals, never the column, so the predicate still pushes down.
            parts.append(c.isin([F.lit(v).cast(dtype) for v in values]))
    text = _as_string(c, dtype)
    for term in spec.substring.get(column, ()):
        parts.append(substring_predicate(text, str(term)))
    for pattern in spec.regex.get(column, ()):
        parts.append(regex_predicate(text, str(pattern)))
    if not parts:
        return None
    return reduce(or_, parts)


def check_columns(schema: StructType, spec: FilterSpec) -> None:
    missing = [c for c in spec.columns if c not in schema.names]
    if missing:
        raise ValueError(f"unknown filter column(s) {missing}; available: {schema.names}")


def column_predicates(df: DataFrame, spec: FilterSpec, validate: bool = True) -> dict[str, Column]:
    """One predicate per filtered column (unknown columns and bad regexes raise)."""
    check_columns(df.schema, spec)
    if validate:
        patterns = [to_java_regex(strip_marker(str(p))) for ps in spec.regex.values() for p in ps]
        if patterns:
            validate_patterns(df.sparkSession, patterns)
    preds: dict[str, Column] = {}
    for column in spec.columns:
        p = column_predicate(df.schema, column, spec)
        if p is not None:
            preds[column] = p
    return preds


def build_predicate(df: DataFrame, spec: FilterSpec, validate: bool = True) -> Column | None:
    """AND of all column predicates, or ``None`` when the spec is empty."""
    preds = list(column_predicates(df, spec, validate).values())
    return reduce(and_, preds) if preds else None


def apply_filters(df: DataFrame, spec: FilterSpec | None, validate: bool = True) -> DataFrame:
    """``df`` restricted to rows passing ``spec`` (a null predicate drops the row)."""
    if spec is None or spec.is_empty:
        return df
    pred = build_predicate(df, spec, validate)
    return df if pred is None else df.where(pred)
