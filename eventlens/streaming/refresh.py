"""Incremental refresh (R1, R2) with Structured Streaming.

New Parquet files arriving in a landing folder are appended to the
queryable event table exactly once: the file source remembers processed
files in the checkpoint, the Parquet sink commits each batch atomically,
and ``availableNow`` processes everything pending then stops, so the job
can be re-run on a schedule (the audited app's refresh ran hourly). The
sink is partitioned by the UTC day so date-range reads prune folders.

There is no state: the stream is a stateless projection, so a lost
executor only re-runs its task and a lost driver resumes from the
checkpoint.

What has been appended is counted batch by batch while a query runs, and the
totals lie in a small file beside the checkpoint. Spark's last progress
reports are read often enough that none is missed; where one is (the driver
was lost after a batch, before its report was counted), the table itself is
counted, which reads the footers of its files.
"""

from __future__ import annotations

import json
import threading
from collections.abc import Callable
from dataclasses import asdict, dataclass
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from eventlens.functions.text import camel_words_text, refresh_text
from eventlens.functions.time import event_time, parse_instant
from eventlens.schema import EVENT_SCHEMA, TIME_COLUMN
from eventlens.session import ensure_conf
from eventlens.sources.parquet import PARTITION_DATE_COLUMN


# Seconds between two looks at a running query's reports; Spark keeps its last 100.
POLL_SECONDS = 0.5
TOTALS_FILE = "eventlens-totals.json"


@dataclass(frozen=True)
class RefreshStatus:
    """What a refresh run did, in the shape of the app's status response."""

    status: str          # e.g. "Completed"
    status_text: str     # e.g. "Completed" / "In Progress"
    updated_at: str      # ISO time of the last progress report
    rows: int            # rows appended by this run
    batches: int         # batches of this run that had rows
    total_rows: int = 0  # rows appended by all runs of the checkpoint

    @property
    def updated_text(self) -> str:
        """``MMM D, YYYY - h:mm AM/PM`` (UTC) of ``updated_at``."""
        return refresh_text(parse_instant(self.updated_at))

    def as_dict(self) -> dict:
        return {"status": self.status, "statusText": self.status_text, "updatedAt": self.updated_at,
                "updatedText": self.updated_text, "rows": self.rows, "batches": self.batches,
                "totalRows": self.total_rows}


@dataclass
class Totals:
    """Rows appended by all batches up to ``batch``."""

    batch: int = -1
    rows: int = 0


def _path(spark: SparkSession, *parts: str):
    path = spark._jvm.org.apache.hadoop.fs.Path("/".join(p.rstrip("/") for p in parts))
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def read_totals(spark: SparkSession, checkpoint: str) -> Totals:
    """The totals beside a checkpoint; none counted if there is no file, or one that was cut off."""
    path, fs = _path(spark, checkpoint, TOTALS_FILE)
    if not fs.exists(path):
        return Totals()
    stream = fs.open(path)
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    try:
        return Totals(**json.loads(text))
    except (ValueError, TypeError):
        return Totals()


def write_totals(spark: SparkSession, checkpoint: str, totals: Totals) -> None:
    path, fs = _path(spark, checkpoint, TOTALS_FILE)
    stream = fs.create(path, True)
    try:
        stream.write(bytearray(json.dumps(asdict(totals)).encode()))
    finally:
        stream.close()


def last_batch(spark: SparkSession, table: str) -> int:
    """The last batch that the sink has committed; -1 before the first."""
    path, fs = _path(spark, table, "_spark_metadata")
    if not fs.exists(path):
        return -1
    names = [f.getPath().getName().removesuffix(".compact") for f in fs.listStatus(path)]
    return max((int(n) for n in names if n.isdigit()), default=-1)


class RowCounter(threading.Thread):
    """Counts the rows of a query's batches while it runs; one number a run and one for all."""

    def __init__(self, spark: SparkSession, query, table: str, checkpoint: str, totals: Totals) -> None:
        super().__init__(daemon=True, name=f"refresh-rows-{query.runId}")
        self.spark, self.query, self.table, self.checkpoint = spark, query, table, checkpoint
        self.totals = totals
        self.rows = self.batches = 0
        self.updated: str | None = None
        self.lock = threading.Lock()

    def look(self) -> None:
        """Count the reports that are new since the last look."""
        with self.lock:
            reports = [p if isinstance(p, dict) else json.loads(p.json) for p in self.query.recentProgress]
            if reports:
                self.updated = reports[-1]["timestamp"]
            new = {p["batchId"]: int(p["numInputRows"]) for p in reports if p["batchId"] > self.totals.batch and p["numInputRows"]}
            if not new:
                return
            if min(new) > self.totals.batch + 1:  # a report was missed
                self._recount(max(new), sum(new.values()), len(new))
            else:
                self._add(max(new), sum(new.values()), len(new))
            write_totals(self.spark, self.checkpoint, self.totals)

    def _add(self, batch: int, rows: int, batches: int) -> None:
        self.totals = Totals(batch, self.totals.rows + rows)
        self.rows += rows
        self.batches += batches

    def _recount(self, batch: int, rows: int, batches: int) -> None:
        """Batches were not all seen: the table says how many rows there are up to the last one committed."""
        last = max(batch, last_batch(self.spark, self.table))
        total = self.spark.read.parquet(self.table).count()
        missed = last - self.totals.batch - batches
        self._add(last, max(rows, total - self.totals.rows), batches + missed)

    def run(self) -> None:
        while self.query.isActive:
            self.look()
            self.query.awaitTermination(POLL_SECONDS)


def _counted(spark: SparkSession, query, table: str, checkpoint: str, totals: Totals):
    """The query with a counter that runs along."""
    query.row_counter = RowCounter(spark, query, table, checkpoint, totals)
    query.row_counter.start()
    return query


def _totals_before(spark: SparkSession, table: str, checkpoint: str) -> Totals:
    """Totals of the runs before; if a committed batch was never counted, the table is."""
    totals, last = read_totals(spark, checkpoint), last_batch(spark, table)
    if last > totals.batch:
        totals = Totals(last, spark.read.parquet(table).count())
        write_totals(spark, checkpoint, totals)
    return totals


def landing_schema(spark: SparkSession, landing: str, recursive: bool = False) -> StructType:
    """All columns of the files under ``landing``, optional ones included; the
    canonical ones while there is no file."""
    reader = ensure_conf(spark).read.option("mergeSchema", "true")
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    try:
        return reader.parquet(landing).schema
    except AnalysisException:  # nothing there yet
        return EVENT_SCHEMA


def _stream(spark, landing, schema, transform, file_glob, max_files_per_trigger, recursive=False) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    if file_glob:
        reader = reader.option("pathGlobFilter", file_glob)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    stream = reader.parquet(landing)
    if transform is not None:
        stream = transform(stream)
    return stream.withColumn(PARTITION_DATE_COLUMN, F.to_date(event_time(TIME_COLUMN)))


def refresh(
    spark: SparkSession,
    landing: str,
    table: str,
    checkpoint: str,
    schema: StructType,
    transform: Callable[[DataFrame], DataFrame] | None = None,
    file_glob: str | None = None,
    max_files_per_trigger: int | None = None,
    recursive: bool = False,
) -> RefreshStatus:
    """Append every not-yet-seen Parquet file under ``landing`` to ``table``.

    Files are picked up directly under ``landing`` or in ``key=value``
    partition folders; ``recursive=True`` also descends into plain folders.
    """
    ensure_conf(spark)
    before = _totals_before(spark, table, checkpoint)
    query = (
        _stream(spark, landing, schema, transform, file_glob, max_files_per_trigger, recursive)
        .writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .partitionBy(PARTITION_DATE_COLUMN)
        .outputMode("append")
        .trigger(availableNow=True)
        .start(table)
    )
    _counted(spark, query, table, checkpoint, before)
    query.awaitTermination()
    return status_of(query)


def start_refresh(
    spark: SparkSession,
    landing: str,
    table: str,
    checkpoint: str,
    schema: StructType,
    every: str = "1 hour",
    transform: Callable[[DataFrame], DataFrame] | None = None,
    file_glob: str | None = None,
    max_files_per_trigger: int | None = None,
    recursive: bool = False,
):
    """Long-running variant of :func:`refresh`: picks up new files every ``every``.

    Returns the ``StreamingQuery``; poll it with :func:`status_of` and end it
    with ``query.stop()``. The checkpoint is shared with :func:`refresh`, so
    the two can be mixed without re-appending a file.
    """
    ensure_conf(spark)
    before = _totals_before(spark, table, checkpoint)
    query = (
        _stream(spark, landing, schema, transform, file_glob, max_files_per_trigger, recursive)
        .writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .partitionBy(PARTITION_DATE_COLUMN)
        .outputMode("append")
        .trigger(processingTime=every)
        .start(table)
    )
    return _counted(spark, query, table, checkpoint, before)


def status_of(query) -> RefreshStatus:
    """Status of a refresh query (running or finished) that :func:`start_refresh` returned."""
    counter: RowCounter = query.row_counter
    if query.isActive is False:
        counter.join()
    counter.look()
    updated = counter.updated or datetime.now(timezone.utc).isoformat()
    if query.exception() is not None:
        status = "Failed"
    elif query.isActive:
        status = "InProgress"
    else:
        status = "Completed"
    return RefreshStatus(status, camel_words_text(status), updated, counter.rows, counter.batches, counter.totals.rows)
