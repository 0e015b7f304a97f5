"""Total, sort and page.

A page is ``orderBy(...).offset(o).limit(n)``, which Spark plans as one
``TakeOrderedAndProject``: every partition keeps its best ``o + n`` rows
and only those reach the final merge. Sorting always ends in a unique
tie-break so consecutive pages neither overlap nor skip rows.
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    DateType,
    IntegralType,
    MapType,
    TimestampNTZType,
    TimestampType,
)

from eventlens.operators.filters import qcol
from eventlens.schema import DEFAULT_PAGE_SIZE, DEFAULT_SORT_COLUMN, DEFAULT_SORT_ORDER, TIME_COLUMN

SORT_ORDERS = ("ASC", "DESC")
TIE_BREAK = ((TIME_COLUMN, "DESC"), ("uuid", "ASC"))


def normalize_order(order: str | None) -> str:
    """ASC or DESC; anything else is DESC."""
    order = (order or DEFAULT_SORT_ORDER).upper()
    return order if order in SORT_ORDERS else "DESC"


def _key(name: str, order: str) -> Column:
    c = qcol(name)
    return c.asc_nulls_last() if order == "ASC" else c.desc_nulls_last()


def sort_spec(df: DataFrame, column: str | None, order: str | None) -> list[tuple[str, str]]:
    """Requested key + a deterministic tie-break, as ``(column, ASC|DESC)`` pairs.

    The tie-break is ``timestamp DESC, uuid ASC`` when those columns exist,
    then every remaining sortable column ascending: rows that still tie are
    equal, so every strategy shows the same pages.
    """
    column = column or DEFAULT_SORT_COLUMN
    if column not in df.columns:
        raise ValueError(f"unknown sort column {column!r}; available: {df.columns}")
    spec = [(column, normalize_order(order))]
    used = {column}
    for name, o in TIE_BREAK:
        if name in df.columns and name not in used:
            spec.append((name, o))
            used.add(name)
    spec += [(name, "ASC") for name in sortable_columns(df) if name not in used]
    return spec


def sortable_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if not isinstance(f.dataType, MapType)]


def sort_keys(df: DataFrame, column: str | None, order: str | None) -> list[Column]:
    """Sort expressions (nulls last either way) of :func:`sort_spec`."""
    return [_key(name, o) for name, o in sort_spec(df, column, order)]


def _literal(value) -> Column:
    """A collected value as a literal, arrays and structs included."""
    if isinstance(value, Row):
        return F.struct(*[_literal(v).alias(n) for n, v in value.asDict().items()])
    if isinstance(value, list):
        return F.array(*[_literal(v) for v in value])
    return F.lit(value)


def seek_predicate(spec: list[tuple[str, str]], last: Mapping, equal: bool = False) -> Column:
    """Rows strictly after ``last`` in the order ``spec`` (nulls last), with ``equal`` also its equals.

    A redundant one-sided bound on the leading key (``key <= v`` for DESC,
    ``>=`` for ASC) is ANDed in front: it is implied by the exact condition
    but simple enough for Parquet statistics to skip row groups with it.
    """
    pred = F.lit(equal)
    for name, order in reversed(spec):
        c, v = qcol(name), last[name]
        if v is None:
            beyond = F.lit(False)  # nothing sorts after a null key
        else:
            beyond = ((c > _literal(v)) if order == "ASC" else (c < _literal(v))) | c.isNull()
        pred = beyond | (c.eqNullSafe(_literal(v)) & pred)
    lead, order = spec[0]
    c, v = qcol(lead), last[lead]
    if v is None:
        bound = c.isNull()
    else:
        bound = ((c >= _literal(v)) if order == "ASC" else (c <= _literal(v))) | c.isNull()
    return bound & pred


def page_after(
    rows: DataFrame,
    last: Mapping | None,
    page_size: int = DEFAULT_PAGE_SIZE,
    sort_column: str | None = None,
    sort_order: str | None = None,
    seen: int = 0,
) -> DataFrame:
    """Keyset page: the ``page_size`` rows following ``last`` (the previous page's
    last row; ``None`` for the first page).

    ``last`` may leave out tie-break columns past ``timestamp`` and ``uuid``;
    rows that equal it in the columns it has are then taken as shown. With
    ``seen`` (see :func:`next_cursor`) it has all of them, and so many of its
    equals have been shown; the page begins with the next one.

    Its cost does not grow with the page number, and when the first key is
    ``timestamp`` the seek condition is a range that reaches the Parquet scan.
    """
    spec = sort_spec(rows, sort_column, sort_order)
    if last is not None:
        needed = spec if seen else [s for s in spec if s[0] in (spec[0][0], TIME_COLUMN, "uuid")] or spec
        missing = [name for name, _ in needed if name not in last]
        if missing:
            raise ValueError(f"last row lacks sort key(s) {missing}")
        known = [s for s in spec if s[0] in last]
        rows = rows.where(seek_predicate(known, last, equal=seen > 0))
        if seen:
            return rows.orderBy(*[_key(name, o) for name, o in spec]).offset(seen).limit(page_size)
    return rows.orderBy(*[_key(name, o) for name, o in spec]).limit(page_size)


def next_cursor(page: list, previous: tuple[Mapping, int] | None = None) -> tuple[dict, int] | None:
    """``last, seen`` for the page after the collected rows ``page``; ``previous``: the cursor it was read with."""
    if not page:
        return None
    last = page[-1].asDict()
    seen = 0
    for row in reversed(page):
        if row.asDict() != last:
            break
        seen += 1
    if previous is not None and seen == len(page) and dict(previous[0]) == last:
        seen += previous[1]
    return last, seen


def total_frame(rows: DataFrame) -> DataFrame:
    """One row: ``total`` = number of rows (no sort is planned under the count)."""
    return rows.agg(F.count(F.lit(1)).alias("total"))


def page_rows(
    rows: DataFrame,
    page: int = 1,
    page_size: int = DEFAULT_PAGE_SIZE,
    sort_column: str | None = None,
    sort_order: str | None = None,
) -> DataFrame:
    """Rows of page ``page`` (1-based) in the requested order."""
    if page_size <= 0:
        raise ValueError("page_size must be positive")
    page = max(1, int(page))
    return offset_rows(rows, (page - 1) * page_size, page_size, sort_column, sort_order)


def offset_rows(rows: DataFrame, offset: int, n: int, column: str | None, order: str | None) -> DataFrame:
    """``n`` rows from position ``offset`` of the sorted rows (one TakeOrderedAndProject)."""
    ordered = rows.orderBy(*sort_keys(rows, column, order))
    return (ordered.offset(offset) if offset else ordered).limit(n)


# Offsets past this, under a time sort, seek with a histogram instead of
# making every task keep offset + n rows for one final merge.
DEEP_OFFSET = 10_000
SEEK_FANOUT = 1024
# Splits of the keys that a seek under another sort counts rows between, and sampled rows for each.
SPLITS = 1000
SAMPLE_A_SPLIT = 4


def _int_div(x: Column, d: int) -> Column:
    """Exact ``x div d`` for non-negative int64 ``x`` (Spark's ``/`` is double and
    rounds past 2^53, which would misplace rows at bucket edges)."""
    return (x.cast("decimal(20,0)") / F.lit(d).cast("decimal(20,0)")).cast("long")


def seek_time_window(
    rows: DataFrame,
    offset: int,
    order: str,
    lo_ns: int,
    hi_ns: int,
    small: int = DEEP_OFFSET,
    fanout: int = SEEK_FANOUT,
) -> tuple[int, int, int] | None:
    """Find a time window ``[w_lo, w_hi]`` holding the row at ``offset`` of the
    time order, and the number of rows that precede the window.

    Each step is one aggregate over at most ``fanout`` + 1 buckets (collected;
    bounded), restricted to the current window so the range reaches the
    scan. A bucket holding more than ``small`` rows is split again, so a hot
    period (even a third of all rows) is narrowed down instead of sorted.
    Returns ``None`` when ``offset`` is past the last row.
    """
    ts = qcol(TIME_COLUMN)
    before = 0
    lo, hi = lo_ns, hi_ns
    while True:
        width = max(1, -(-(hi - lo + 1) // fanout))
        hist = (
            rows.where((ts >= F.lit(lo)) & (ts <= F.lit(hi)))
            .groupBy(_int_div(ts - F.lit(lo), width).alias("b"))
            .count()
            .collect()
        )
        found = None
        for r in sorted(hist, key=lambda r: r["b"], reverse=(order == "DESC")):
            if before + r["count"] > offset:
                found = r
                break
            before += r["count"]
        if found is None:
            return None
        w_lo = lo + found["b"] * width
        w_hi = min(hi, w_lo + width - 1)
        if found["count"] <= small or width == 1:
            return w_lo, w_hi, before
        lo, hi = w_lo, w_hi


def deep_page_rows(
    rows: DataFrame,
    page: int,
    page_size: int,
    sort_order: str | None,
    lo_ns: int,
    hi_ns: int,
    small: int = DEEP_OFFSET,
) -> DataFrame:
    """Page ``page`` of ``rows`` sorted by time, for any depth, at bounded cost.

    Rows before the located window are skipped by count, not by sorting;
    the final ``TakeOrderedAndProject`` keeps at most ``small + page_size``
    rows per task, also if one instant holds most rows. Identical to :func:`page_rows` with ``sort_column='timestamp'``.
    """
    order = normalize_order(sort_order)
    offset = (max(1, int(page)) - 1) * page_size
    window = seek_time_window(rows, offset, order, lo_ns, hi_ns, small)
    if window is None:
        return rows.where(F.lit(False)).limit(0)
    w_lo, w_hi, before = window
    ts = qcol(TIME_COLUMN)
    if w_lo == w_hi and offset - before > small:
        # One instant holds more rows than a task should sort: go on with the next keys.
        spec = sort_spec(rows, TIME_COLUMN, order)
        pred, local = seek_window(rows.where(ts == F.lit(w_lo)), spec[1:], offset - before, small)
        beyond = (ts < F.lit(w_lo)) if order == "DESC" else (ts > F.lit(w_lo))
        ordered = rows.where(((ts == F.lit(w_lo)) & pred) | beyond).orderBy(*[_key(c, o) for c, o in spec])
        return (ordered.offset(local) if local else ordered).limit(page_size)
    rest = rows.where(ts <= F.lit(w_hi)) if order == "DESC" else rows.where(ts >= F.lit(w_lo))
    return offset_rows(rest, offset - before, page_size, TIME_COLUMN, order)


def max_page(total: int, page_size: int) -> int:
    return max(1, math.ceil(total / page_size))


def clamp_page(total: int, page: int, page_size: int) -> int:
    """A page past the last one falls back to page 1."""
    return 1 if page > max_page(total, page_size) else max(1, page)


def page_bounds(total: int, page: int, page_size: int) -> tuple[int, int]:
    """1-based record numbers shown on a page (0, 0 when there are none)."""
    if total <= 0:
        return 0, 0
    start = (page - 1) * page_size + 1
    return start, min(page * page_size, total)


def page_info_frame(rows: DataFrame, page: int = 1, page_size: int = DEFAULT_PAGE_SIZE) -> DataFrame:
    """Lazy one-row page summary: total, clamped page, first and last record."""
    total = F.col("total")
    last_page = F.greatest(F.lit(1), F.ceil(total / F.lit(page_size)).cast("long"))
    clamped = F.when(F.lit(page) > last_page, F.lit(1)).otherwise(F.greatest(F.lit(page), F.lit(1))).cast("long")
    start = F.when(total > 0, (F.col("page") - 1) * page_size + 1).otherwise(F.lit(0)).cast("long")
    end = F.when(total > 0, F.least(F.col("page") * page_size, total)).otherwise(F.lit(0)).cast("long")
    return (
        total_frame(rows)
        .withColumn("page", clamped)
        .withColumn("page_size", F.lit(page_size).cast("long"))
        .withColumn("start_row", start)
        .withColumn("end_row", end)
        .select("total", "page", "page_size", "start_row", "end_row")
    )


@dataclass(frozen=True)
class PageResult:
    """A page of a sorted result: the total, the (clamped) page, record range, lazy rows."""

    total: int
    page: int
    page_size: int
    start: int
    end: int
    rows: DataFrame  # lazy; at most page_size rows when collected

    def collect(self) -> list:
        return self.rows.collect()


def fetch_page(
    rows: DataFrame,
    page: int = 1,
    page_size: int = DEFAULT_PAGE_SIZE,
    sort_column: str | None = None,
    sort_order: str | None = None,
    time_range: tuple[int, int] | None = None,
) -> PageResult:
    """Count once, clamp the page, and return the page's lazy rows."""
    total = rows.count()
    return page_result(rows, total, page, page_size, sort_column, sort_order, time_range)


def _view(c: Column, dtype, order: str) -> tuple[Column, str]:
    """A key as JSON holds it exactly, and its direction; whole numbers are turned round to ascend."""
    if isinstance(dtype, DateType):
        c = F.unix_date(c)
    elif isinstance(dtype, (TimestampType, TimestampNTZType)):
        c = F.unix_micros(c.cast("timestamp"))
    elif not isinstance(dtype, IntegralType):
        return c, order
    return (c, "ASC") if order == "ASC" else (F.bitwise_not(c), "ASC")


class _Order:
    """A row's place in an order, as expressions over its keys.

    Neighbouring keys of one direction form a struct, which Spark compares
    field by field; a null is the least value of a field, so in ascending
    structs a flag puts it last.
    """

    def __init__(self, rows: DataFrame, spec: list[tuple[str, str]]) -> None:
        self.spec = spec
        groups: list[tuple[str, list[Column]]] = []
        for name, wanted in spec:
            c, order = _view(qcol(name), rows.schema[name].dataType, wanted)
            if not groups or groups[-1][0] != order:
                groups.append((order, []))
            groups[-1][1].extend([c.isNull(), c] if order == "ASC" else [c])
        self.orders = [order for order, _ in groups]
        structs = [F.struct(*[c.alias(f"k{i}") for i, c in enumerate(cs)]) for _, cs in groups]
        self.key = F.struct(*[g.alias(f"g{i}") for i, g in enumerate(structs)])
        self.key_type = rows.select(self.key.alias("key")).schema["key"].dataType

    def sample(self, rows: DataFrame, total: int, most: int) -> list:
        """About ``most`` rows' keys in order (all of a small table), each with its JSON; at least one."""
        keys = rows.select(F.to_json(self.key).alias("json"), *[qcol(name) for name, _ in self.spec])
        share = most / max(total, 1)
        while True:
            drawn = keys if share >= 1 else keys.sample(share, seed=7)
            found = drawn.orderBy(*[_key(name, o) for name, o in self.spec]).collect()
            if found or share >= 1:
                return found
            share *= 8

    def _not_before(self, key: Column, split: Column) -> Column:
        """Whether a key is the split or comes after it."""
        found = F.lit(True)
        for i, order in reversed(list(enumerate(self.orders))):
            c, v = key[f"g{i}"], split[f"g{i}"]
            beyond = (c > v) if order == "ASC" else (c < v)
            found = beyond | ((c == v) & found)
        return found

    def places(self, rows: DataFrame, splits: list) -> DataFrame:
        """``b`` of each row: twice the number of splits at or before it, less one if the last of them equals it."""
        table = F.from_json(F.lit("[" + ",".join(s["json"] for s in splits) + "]"), ArrayType(self.key_type))
        steps = F.lit([1 << k for k in range(len(splits).bit_length() - 1, -1, -1)]).cast("array<int>")

        def search(key: Column) -> Column:
            def step(at: Column, more: Column) -> Column:
                inside = (at + more <= len(splits)) & self._not_before(key, F.get(table, at + more - 1))
                return at + F.when(inside, more).otherwise(0)

            return F.aggregate(steps, F.lit(0), step)

        # An array of one element binds the key, so that it is made once a row.
        found = rows.select(self.key.alias("key"), F.transform(F.array(self.key), search)[0].alias("at"))
        equal = F.coalesce(F.col("key") == F.get(table, F.col("at") - 1), F.lit(False))
        return found.select((2 * F.col("at") - equal.cast("int")).alias("b"))


def seek_window(
    rows: DataFrame,
    spec: list[tuple[str, str]],
    offset: int,
    small: int = DEEP_OFFSET,
    total: int | None = None,
    splits: int = SPLITS,
) -> tuple[Column, int]:
    """Locate row ``offset`` of the order ``spec`` (nulls last) without sorting.

    Returns ``(pred, local)``: ``pred`` keeps a suffix of the order that
    starts at most ``small`` rows before the target, so
    ``rows.where(pred).orderBy(spec).offset(local)`` starts at the target.

    A sample of about ``SAMPLE_A_SPLIT * splits`` rows gives the splits, tuples
    of all keys, and one aggregate counts the rows between them and equal to
    them (at most ``2 * splits + 1`` rows are collected): two scans of the keys,
    whatever their types. If more than ``small`` rows still lie before the
    target in its interval, the interval is searched again; its bounds on the
    leading key reach the scan. Rows that equal a split in every key are one
    block; a target inside it is reached by its offset in the block.
    """
    if not spec:
        return F.lit(True), offset
    total = rows.count() if total is None else total
    if offset >= total:
        return F.lit(False), 0
    order = _Order(rows, spec)
    left, pred, before = rows, F.lit(True), 0
    while offset - before > small:
        drawn = order.sample(left, total, SAMPLE_A_SPLIT * splits)
        every = max(1, len(drawn) // splits)
        bounds = list({r["json"]: r for r in drawn[every - 1 :: every]}.values())
        counted = order.places(left, bounds).groupBy("b").count().collect()
        for r in sorted(counted, key=lambda r: r["b"]):
            if before + r["count"] > offset:
                break
            before += r["count"]
        else:
            return F.lit(False), 0  # the rows are fewer than their total
        at, equal = (r["b"] + 1) // 2, r["b"] % 2 == 1
        if at:
            pred = seek_predicate(spec, bounds[at - 1].asDict(), equal=equal)
        if equal:
            break
        left, total = rows.where(pred), r["count"]
        if at < len(bounds):
            left = left.where(_before(spec, bounds[at].asDict()))
    return pred, offset - before


def _before(spec: list[tuple[str, str]], last: Mapping) -> Column:
    """Rows before ``last`` in the order, with a bound on the leading key for the scan."""
    lead, order = spec[0]
    c, v = qcol(lead), last[lead]
    strictly = ~seek_predicate(spec, last, equal=True)
    if v is None:
        return strictly
    return ((c <= _literal(v)) if order == "ASC" else (c >= _literal(v))) & strictly


def seek_page_rows(
    rows: DataFrame,
    page: int,
    page_size: int,
    sort_column: str | None,
    sort_order: str | None,
    small: int = DEEP_OFFSET,
    total: int | None = None,
) -> DataFrame:
    """Page ``page`` for any sort, at bounded cost."""
    spec = sort_spec(rows, sort_column, sort_order)
    offset = (max(1, int(page)) - 1) * page_size
    pred, local = seek_window(rows, spec, offset, small, total)
    ordered = rows.where(pred).orderBy(*[_key(c, o) for c, o in spec])
    return (ordered.offset(local) if local else ordered).limit(page_size)


def _reverse_key(name: str, order: str) -> Column:
    """Exact reverse of ``_key``: ASC NULLS LAST <-> DESC NULLS FIRST."""
    c = qcol(name)
    return c.desc_nulls_first() if order == "ASC" else c.asc_nulls_first()


def tail_page_rows(
    rows: DataFrame, total: int, offset: int, n: int, column: str | None, order: str | None
) -> DataFrame:
    """Rows ``[offset, offset + n)`` of the order, read from its far end.

    The reverse order keeps only ``total - offset`` rows per task, so a page
    near the end (the last page) is as cheap as the first, for any sort.
    """
    spec = sort_spec(rows, column, order)
    end = min(total, offset + n)
    skip = total - end
    reverse = rows.orderBy(*[_reverse_key(c, o) for c, o in spec])
    window = (reverse.offset(skip) if skip else reverse).limit(max(0, end - offset))
    return window.orderBy(*[_key(c, o) for c, o in spec])


def page_result(
    rows: DataFrame,
    total: int,
    page: int,
    page_size: int,
    sort_column: str | None,
    sort_order: str | None,
    time_range: tuple[int, int] | None = None,
) -> PageResult:
    """Clamp the page against a known total and plan its rows.

    Deep pages (offset past ``DEEP_OFFSET``) near the end of the order are
    read from its far end; elsewhere they are located by histogram seeks
    (time ranges for the time sort, key buckets for other sorts).
    """
    page = clamp_page(total, page, page_size)
    start, end = page_bounds(total, page, page_size)
    offset = (page - 1) * page_size
    if offset <= DEEP_OFFSET:
        df = page_rows(rows, page, page_size, sort_column, sort_order)
    elif total - offset <= DEEP_OFFSET:
        df = tail_page_rows(rows, total, offset, page_size, sort_column, sort_order)
    elif time_range is not None and (sort_column or DEFAULT_SORT_COLUMN) == TIME_COLUMN:
        df = deep_page_rows(rows, page, page_size, sort_order, *time_range)
    else:
        df = seek_page_rows(rows, page, page_size, sort_column, sort_order, total=total)
    return PageResult(total, page, page_size, start, end, df)
