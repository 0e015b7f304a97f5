"""Event sources (S1-S5): Parquet files -> canonical audit-event rows for a date range.

An ``EventSource`` pairs the physical DataFrame with the column that
carries event time and the projection to the canonical schema. The date
range is always written against the physical time column (and a date
partition column when present), so Parquet row-group statistics and
partition directories prune the scan before any row is decoded.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.types import DateType

from eventlens.functions.time import ns_from_physical, ns_range_predicate
from eventlens.operators.filters import qcol
from eventlens.schema import COLUMN_LABELS, TIME_COLUMN
from eventlens.session import ensure_conf

# Folder column of tables that the refresh job writes: the UTC day of each event.
# Only that job uses the name, so a user's own date column never prunes rows.
PARTITION_DATE_COLUMN = "eventlens_utc_day"


def read_parquet(spark: SparkSession, paths: str | Sequence[str], merge_schema: bool = False) -> DataFrame:
    """Scan one or many Parquet files/directories as one relation (implicit union)."""
    if isinstance(paths, str):
        paths = [paths]
    paths = [p for p in paths if p]
    if not paths:
        raise ValueError("no data loaded: no Parquet paths given")
    ensure_conf(spark)
    reader = spark.read
    if merge_schema:
        reader = reader.option("mergeSchema", "true")
    return reader.parquet(*paths)


@dataclass(frozen=True)
class EventSource:
    """Physical rows + how to reach canonical columns and the time range."""

    frame: DataFrame
    time_column: str
    projection: tuple[tuple[str, Column], ...]

    @property
    def columns(self) -> list[str]:
        return [name for name, _ in self.projection]

    def range_predicate(self, lo_ns: int, hi_ns: int) -> Column:
        dtype = self.frame.schema[self.time_column].dataType
        pred = ns_range_predicate(self.time_column, dtype, lo_ns, hi_ns)
        if (
            PARTITION_DATE_COLUMN in self.frame.columns
            and PARTITION_DATE_COLUMN != self.time_column
            and isinstance(self.frame.schema[PARTITION_DATE_COLUMN].dataType, DateType)
        ):
            # Redundant day predicate: prunes date partitions before any file is opened.
            day = self.frame.schema[PARTITION_DATE_COLUMN].dataType
            pred = pred & ns_range_predicate(PARTITION_DATE_COLUMN, day, lo_ns, hi_ns)
        return pred

    def canonical(self) -> DataFrame:
        return self.frame.select(*[c.alias(name) for name, c in self.projection])

    def in_range(self, lo_ns: int, hi_ns: int) -> DataFrame:
        return self.frame.where(self.range_predicate(lo_ns, hi_ns)).select(
            *[c.alias(name) for name, c in self.projection]
        )


def frame_source(frame: DataFrame, time_column: str = TIME_COLUMN) -> EventSource:
    """Source over a DataFrame whose columns are already canonical.

    The time column may be int64 ns (canonical), or a TIMESTAMP /
    TIMESTAMP_NTZ (converted to ns exactly). A date partition column is
    used for pruning only and not exposed.
    """
    if time_column not in frame.columns:
        raise ValueError(f"time column {time_column!r} not found in {frame.columns}")
    dtype = frame.schema[time_column].dataType
    projection = []
    for name in frame.columns:
        if name == PARTITION_DATE_COLUMN:
            continue
        if name == time_column:
            projection.append((TIME_COLUMN, ns_from_physical(name, dtype)))
        else:
            projection.append((name, qcol(name)))
    return EventSource(frame, time_column, tuple(projection))


def parquet_source(
    spark: SparkSession, paths: str | Sequence[str], merge_schema: bool = False
) -> EventSource:
    """Canonical audit-event Parquet files (``timestamp`` int64 ns, or a NANOS timestamp)."""
    return frame_source(read_parquet(spark, paths, merge_schema))


def column_metadata(df: DataFrame, labels: dict[str, str] | None = None) -> list[dict]:
    """Name, Spark type and label of each column except ``timestamp`` (no job runs)."""
    labels = labels or COLUMN_LABELS
    return [
        {
            "name": f.name,
            "type": f.dataType.simpleString(),
            "label": labels.get(f.name, f.name),
        }
        for f in df.schema.fields
        if f.name != TIME_COLUMN
    ]


def filterable_columns(df: DataFrame) -> list[str]:
    """All columns except ``timestamp`` (free: read from the schema)."""
    return [c for c in df.columns if c != TIME_COLUMN]
