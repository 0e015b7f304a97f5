"""Breakdown over time (A3-A6, N2, F8): top-N labels of a field + "Other", zero-filled.

Plan (two scans, no shuffle that grows with the number of labels x buckets):

1. label totals -> top N by count desc, label asc (``TakeOrderedAndProject``;
   exactly N rows, safe to broadcast).
2. rows -> series (their label if it is in the top N, else "Other") and bucket
   -> partial + final count, stored once: at most (N + 1) x buckets rows.
3. each series row generates its own axis, so the zero-filled grid needs no
   cross join, then left-joins the counts.

"Other" exists only when there are more than N distinct labels, which
is exactly when some row misses the top N. A real value spelled "Other"
stays a separate series (``is_other`` = false).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventlens.functions.text import series_label
from eventlens.operators.filters import qcol
from eventlens.operators.timeseries import Spine, finish_buckets, maybe_broadcast, with_bucket
from eventlens.schema import OTHER_LABEL, TIME_COLUMN, TOP_N_VALUES
from eventlens.session import materialize


def labelled(rows: DataFrame, field: str) -> DataFrame:
    if field not in rows.columns:
        raise ValueError(f"unknown breakdown field {field!r}; available: {rows.columns}")
    if field == TIME_COLUMN:
        raise ValueError("cannot break down by the time column")
    dtype = rows.schema[field].dataType
    return rows.select(TIME_COLUMN, series_label(qcol(field), dtype).alias("label"))


def label_totals(rows: DataFrame, field: str) -> DataFrame:
    """``label, event_count`` over all rows (null / '' -> 'Unknown')."""
    return labelled(rows, field).groupBy("label").agg(F.count(F.lit(1)).alias("event_count"))


def top_labels(totals: DataFrame, n: int) -> DataFrame:
    """N most frequent labels (count desc, then label asc) with their 1-based rank."""
    top = totals.orderBy(F.col("event_count").desc(), F.col("label").asc()).limit(n)
    rank = Window.orderBy(F.col("event_count").desc(), F.col("label").asc())
    return top.withColumn("series_rank", F.row_number().over(rank).cast("long"))


def top_values(rows: DataFrame, field: str, n: int = TOP_N_VALUES) -> DataFrame:
    """``label, event_count, series_rank`` of the top N labels of ``field``."""
    return top_labels(label_totals(rows, field), n).select("label", "event_count", "series_rank")


def distinct_labels(rows: DataFrame, field: str) -> DataFrame:
    """One row: number of distinct labels (after null / '' -> 'Unknown')."""
    return label_totals(rows, field).agg(F.count(F.lit(1)).alias("distinct_labels"))


def series_counts(rows: DataFrame, field: str, spine: Spine, top_n: int = TOP_N_VALUES) -> DataFrame:
    """``bucket_start, series, is_other, series_rank, event_count``, stored once.

    The only part of a breakdown that reads the rows, twice: for the top
    labels, and for the counts. Labels are mapped to their series (a broadcast
    of ``top_n`` rows) before rows are counted, so a task sends at most
    ``top_n + 1`` rows a bucket, and the stored result is as small.
    """
    if top_n <= 0:
        raise ValueError("top_n must be positive")
    top = top_labels(label_totals(rows, field), top_n).select("label", "series_rank")
    mapped = with_bucket(labelled(rows, field), spine.unit).join(F.broadcast(top), "label", "left")
    other = F.col("series_rank").isNull()
    return materialize(
        mapped.groupBy(
            "bucket_start",
            F.when(other, F.lit(OTHER_LABEL)).otherwise(F.col("label")).alias("series"),
            other.alias("is_other"),
            F.coalesce("series_rank", F.lit(top_n + 1).cast("long")).alias("series_rank"),
        ).agg(F.count(F.lit(1)).alias("event_count"))
    )


def breakdown_from_counts(counts: DataFrame, spine: Spine, top_n: int = TOP_N_VALUES) -> DataFrame:
    """Top-N + Other series, zero-filled over the axis, from :func:`series_counts`."""
    keys = ["bucket_start", "series", "is_other", "series_rank"]
    grid = spine.axis(counts.select(*keys[1:]).distinct())
    bound = (spine.size + 1) * (top_n + 1)
    joined = grid.join(maybe_broadcast(counts, bound), keys, "left")
    return finish_buckets(joined, spine.unit).select(
        "bucket",
        "bucket_ms",
        "series",
        "is_other",
        "series_rank",
        F.coalesce(F.col("event_count"), F.lit(0)).cast("long").alias("event_count"),
    )


def breakdown(
    rows: DataFrame,
    field: str,
    start,
    end,
    unit: str | None = None,
    top_n: int = TOP_N_VALUES,
) -> DataFrame:
    """``bucket, bucket_ms, series, is_other, series_rank, event_count`` (zero-filled).

    Eager in one respect: the counts are computed and stored when this is
    called; the returned DataFrame reads those, at most ``top_n + 1`` rows a
    bucket.
    """
    spine = Spine.for_range(start, end, unit)
    return breakdown_from_counts(series_counts(rows, field, spine, top_n), spine, top_n)
