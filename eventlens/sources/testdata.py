"""The ``audit`` view: canonical audit events derived from the driver's ``events`` table.

``events`` (event_id, ts TIMESTAMP_NTZ, user_id, event_type, value, props)
is mapped column by column to the audit schema; the same mapping is
written as SQL in ``AUDIT_VIEW_SQL`` for the DuckDB oracle. ``timestamp``
is computed, so the date range is pushed onto ``ts`` instead (exact, since
``timestamp = micros(ts) * 1000``).
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlens.functions.time import ns_from_physical
from eventlens.sources.parquet import EventSource, read_parquet

AUDIT_COLUMNS = [
    "uuid",
    "timestamp",
    "filename",
    "projectName",
    "userId",
    "username",
    "environmentName",
    "workspaceName",
    "action",
]


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def _s(c) -> F.Column:
    return c.cast("string")


def audit_source(spark: SparkSession, sf_dir: str) -> EventSource:
    """Event source over ``{sf_dir}/events.parquet`` with the audit mapping."""
    events = read_parquet(spark, table_path(sf_dir, "events"))
    return audit_source_from(events)


def audit_source_from(events: DataFrame) -> EventSource:
    eid, uid = F.col("event_id"), F.col("user_id")
    project = F.concat(F.lit("proj"), _s(uid % 7))
    ext = F.when(eid % 3 == 0, ".py").when(eid % 3 == 1, ".csv").otherwise(".ipynb")
    projection = (
        ("uuid", _s(eid)),
        ("timestamp", ns_from_physical("ts", events.schema["ts"].dataType)),
        ("filename", F.concat(F.lit("/mnt/data/"), project, F.lit("/demofile"), _s(eid % 50), ext)),
        ("projectName", project),
        ("userId", _s(uid)),
        ("username", F.concat(F.lit("user_"), _s(uid))),
        ("environmentName", F.when(eid % 10 == 0, F.lit(None).cast("string")).otherwise(F.concat(F.lit("env"), _s(eid % 4)))),
        ("workspaceName", F.when(eid % 11 == 0, F.lit("")).otherwise(F.concat(F.lit("ws"), _s(eid % 13)))),
        ("action", F.col("event_type")),
    )
    return EventSource(events, "ts", projection)


def audit_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All audit rows (no date range)."""
    return audit_source(spark, sf_dir).canonical()


# The same mapping for DuckDB (tables are pre-registered views there).
AUDIT_VIEW_SQL = """SELECT CAST(event_id AS VARCHAR) AS uuid,
       epoch_us(ts) * 1000 AS "timestamp",
       '/mnt/data/proj' || CAST(user_id % 7 AS VARCHAR)
         || '/demofile' || CAST(event_id % 50 AS VARCHAR)
         || CASE event_id % 3 WHEN 0 THEN '.py' WHEN 1 THEN '.csv' ELSE '.ipynb' END AS filename,
       'proj' || CAST(user_id % 7 AS VARCHAR) AS projectName,
       CAST(user_id AS VARCHAR) AS userId,
       'user_' || CAST(user_id AS VARCHAR) AS username,
       CASE WHEN event_id % 10 = 0 THEN NULL
            ELSE 'env' || CAST(event_id % 4 AS VARCHAR) END AS environmentName,
       CASE WHEN event_id % 11 = 0 THEN ''
            ELSE 'ws' || CAST(event_id % 13 AS VARCHAR) END AS workspaceName,
       event_type AS action
FROM events"""
