"""Events over time (A2, N1): counts per time bucket, zero-filled over the range.

The rows are reduced to ``(bucket_start, count)`` with a partial (map-side)
aggregate, so the shuffle carries one row per bucket per task no matter
how skewed the data. The axis (spine) is generated from the range, and its
size is known before anything runs; the counts joined to it can only hold
buckets of the range (+1 for the inclusive end instant), so broadcasting
them is bounded by the same number.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlens.functions.time import (
    auto_bucket,
    bucket_label,
    bucket_start,
    event_time,
    spine_bounds,
)
from eventlens.schema import TIME_COLUMN

# Buckets of an axis that one generated row expands to.
AXIS_BLOCK = 4096
# Aggregated bucket counts up to this many rows are broadcast to the axis join.
BROADCAST_MAX_ROWS = 200_000


@dataclass(frozen=True)
class Spine:
    """The chart axis of a range: bucket width, first and last bucket start, count."""

    unit: str
    first: object
    last: object
    size: int

    @classmethod
    def for_range(cls, start, end, unit: str | None = None) -> Spine:
        unit = unit or auto_bucket(start, end)
        first, last, n = spine_bounds(start, end, unit)
        return cls(unit, first, last, n)

    def axis(self, df: DataFrame, name: str = "bucket_start") -> DataFrame:
        """Each row of ``df`` once for each bucket, in two steps of generated rows, so an
        axis of any length needs no array of its length."""
        block, at = F.explode(F.sequence(F.lit(0), F.lit((self.size - 1) // AXIS_BLOCK))), "__bucket"
        blocks = df.select(*df.columns, block.alias(at))
        first = F.col(at) * AXIS_BLOCK
        last = F.least(first + (AXIS_BLOCK - 1), F.lit(self.size - 1))
        numbered = blocks.select(*df.columns, F.explode(F.sequence(first, last)).alias(at))
        return numbered.select(*df.columns, F.timestamp_add(self.unit.upper(), F.col(at), F.lit(self.first)).alias(name))


def with_bucket(rows: DataFrame, unit: str, name: str = "bucket_start") -> DataFrame:
    return rows.withColumn(name, bucket_start(event_time(TIME_COLUMN), unit))


def maybe_broadcast(df: DataFrame, bound: int) -> DataFrame:
    """Broadcast hint only when ``bound`` (a proven row bound) is small."""
    return F.broadcast(df) if bound <= BROADCAST_MAX_ROWS else df


def finish_buckets(df: DataFrame, unit: str) -> DataFrame:
    """Bucket label and chart x (epoch ms) from ``bucket_start``."""
    return df.withColumn("bucket", bucket_label(F.col("bucket_start"), unit)).withColumn(
        "bucket_ms", F.unix_millis(F.col("bucket_start"))
    )


def bucket_counts(rows: DataFrame, spine: Spine) -> DataFrame:
    """``bucket_start, event_count``: the only part of a chart that reads the rows."""
    return (
        with_bucket(rows.select(TIME_COLUMN), spine.unit)
        .groupBy("bucket_start")
        .agg(F.count(F.lit(1)).alias("event_count"))
    )


def over_time_from_counts(counts: DataFrame, spine: Spine) -> DataFrame:
    """Zero-filled axis joined to bucket counts (at most axis + 1 rows, so broadcast-safe)."""
    axis = spine.axis(counts.sparkSession.range(1)).select("bucket_start")
    joined = axis.join(maybe_broadcast(counts, spine.size + 1), "bucket_start", "left")
    return finish_buckets(joined, spine.unit).select(
        "bucket", "bucket_ms", F.coalesce(F.col("event_count"), F.lit(0)).alias("event_count")
    )


def events_over_time(rows: DataFrame, start, end, unit: str | None = None) -> DataFrame:
    """``bucket, bucket_ms, event_count`` for every bucket of the axis (0 when empty).

    Events outside the axis (only the inclusive end instant can be) are
    counted by ``total`` but not drawn.
    """
    spine = Spine.for_range(start, end, unit)
    return over_time_from_counts(bucket_counts(rows, spine), spine)
