"""Session settings the library relies on, and the shared scratch location."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every entry point needs: bucket labels and ISO strings are UTC, and
# Parquet TIMESTAMP(NANOS) columns are read as raw int64 nanoseconds.
REQUIRED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.legacy.parquet.nanosAsLong": "true",
}

# Runtime re-planning: coalesce small shuffles, split skewed partitions.
RECOMMENDED_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Delete checkpoint files once their DataFrame is garbage collected.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def ensure_conf(spark: SparkSession) -> SparkSession:
    """Apply REQUIRED_CONF to a session (runtime SQL confs, no restart)."""
    for key, value in REQUIRED_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def build_session(
    master: str = "local[*]",
    app_name: str = "eventlens",
    shuffle_partitions: int | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """Create (or reuse) a session configured for this library.

    On a cluster leave ``master`` to spark-submit and size
    ``shuffle_partitions`` to roughly 2-3x the total executor cores.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = {**REQUIRED_CONF, **RECOMMENDED_CONF, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"}
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return ensure_conf(spark)


def shared_dir(spark: SparkSession) -> str:
    """The cluster-shared folder named by ``spark.checkpoint.dir``.

    When a *local* session leaves it unset (tests) a private folder is
    created and registered as the checkpoint dir, so later calls agree; a
    cluster session without it is an error (a machine-local folder would
    not survive the loss of that machine).
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    try:
        sc = spark.sparkContext
    except Exception as exc:  # noqa: BLE001 - e.g. a Spark Connect session has no context
        raise ValueError("spark.checkpoint.dir is not set: point it at a shared folder") from exc
    current = sc.getCheckpointDir()
    if current:
        return current
    if not sc.master.startswith("local"):
        raise ValueError(
            "spark.checkpoint.dir is not set: point it at a folder every executor can reach"
        )
    local = tempfile.mkdtemp(prefix="eventlens-")
    sc.setCheckpointDir(local)
    return sc.getCheckpointDir() or local


def scratch_path(spark: SparkSession, purpose: str) -> str:
    """A fresh, unique path under the shared folder (never reused)."""
    base = shared_dir(spark)
    sep = "" if base.endswith("/") else "/"
    path = f"{base}{sep}{purpose}-{uuid.uuid4().hex}"
    if not re.match(r"^[A-Za-z][A-Za-z0-9+.-]*:", path):
        path = os.path.abspath(path)
    return path


def materialize(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and cut its lineage (reliable checkpoint, shared folder).

    Used for small aggregates that several branches of a plan read: without
    it Catalyst re-derives (and re-scans) the aggregate in every branch.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
