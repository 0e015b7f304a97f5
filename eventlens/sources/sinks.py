"""Export sinks (K2-K4): CSV and Parquet directories written in parallel.

Spark writes one part file per task, so an export scales with the cluster;
``single_file=True`` is for downloads: CSV parts are written in parallel and
joined through the file system; Parquet has no such joint and goes through one
task.
"""

from __future__ import annotations

import os
from datetime import datetime, timezone

from pyspark.sql import DataFrame

from eventlens.schema import EXPORT_PREFIX


def export_name(fmt: str, now: datetime | None = None) -> str:
    """``workspace_audit_events_YYYYmmdd_HHMMSS.<fmt>``."""
    now = now or datetime.now(timezone.utc)
    return f"{EXPORT_PREFIX}_{now.strftime('%Y%m%d_%H%M%S')}.{fmt}"


def export_path(base_dir: str, fmt: str, now: datetime | None = None) -> str:
    return os.path.join(base_dir, export_name(fmt, now))


def _join_parts(df: DataFrame, path: str) -> None:
    """Join the CSV parts under ``path`` into one file, with the header of the first.

    The parts were written by many tasks; their bytes pass through one stream
    of the file system, a buffer at a time.
    """
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(conf)
    parts = sorted(f.getPath().getName() for f in fs.listStatus(folder) if f.getPath().getName().startswith("part-"))
    if len(parts) < 2:
        return
    joined = jvm.org.apache.hadoop.fs.Path(folder, "_joined")  # readers skip names with an underscore
    out = fs.create(joined, True)
    try:
        for i, name in enumerate(parts):
            part = fs.open(jvm.org.apache.hadoop.fs.Path(folder, name))
            try:
                if i:
                    part.readLine()
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, 1 << 20, False)
            finally:
                part.close()
    finally:
        out.close()
    for name in parts:
        fs.delete(jvm.org.apache.hadoop.fs.Path(folder, name), False)
    fs.rename(joined, jvm.org.apache.hadoop.fs.Path(folder, "part-00000.csv"))


def _prepare(df: DataFrame, single_file: bool) -> DataFrame:
    return df.repartition(1) if single_file else df  # coalesce would pull the scan into one task


def write_csv(df: DataFrame, path: str, single_file: bool = False, mode: str = "errorifexists") -> str:
    """Header row, ``"`` quoting with doubled quotes, null and '' both written empty.

    With ``single_file`` the parts, still written in parallel, are joined into
    one file under ``path``.
    """
    lines_in_names = any("\n" in c or "\r" in c for c in df.columns)  # a header of several lines is not skipped
    (
        _prepare(df, single_file and lines_in_names)
        .write.mode(mode)
        .option("header", "true")
        .option("quote", '"')
        .option("escape", '"')
        .option("emptyValue", "")
        .option("nullValue", "")
        .option("encoding", "UTF-8")
        .option("ignoreLeadingWhiteSpace", "false")  # the writer's defaults strip values
        .option("ignoreTrailingWhiteSpace", "false")
        .csv(path)
    )
    if single_file:
        _join_parts(df, path)
    return path


def write_parquet(df: DataFrame, path: str, single_file: bool = False, mode: str = "errorifexists") -> str:
    _prepare(df, single_file).write.mode(mode).parquet(path)
    return path


def read_csv_export(spark, path: str, schema) -> DataFrame:
    """Read an export back with a declared schema (CSV cannot tell null from '')."""
    return (
        spark.read.option("header", "true")
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", "true")
        .schema(schema)
        .csv(path)
    )
