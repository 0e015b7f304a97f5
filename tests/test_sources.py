import pytest
from pyspark.sql import functions as F

from eventlens.dataset import EventSet
from eventlens.sources.parquet import column_metadata, filterable_columns, read_parquet
from tests.conftest import make_events, ns

RANGE = ("2025-11-10", "2025-11-10")


def test_many_files_are_one_relation_with_optional_columns(spark, tmp_dir):
    make_events(spark, [{"uuid": "a"}]).write.parquet(f"{tmp_dir}/events_0.parquet")
    make_events(spark, [{"uuid": "b"}]).withColumn("workspaceId", F.lit("w1")).write.parquet(
        f"{tmp_dir}/events_1.parquet"
    )
    paths = [f"{tmp_dir}/events_0.parquet", f"{tmp_dir}/events_1.parquet"]
    ev = EventSet.load(spark, paths, *RANGE, merge_schema=True)
    rows = {r.uuid: r.workspaceId for r in ev.rows.collect()}
    assert rows == {"a": None, "b": "w1"}
    meta = {m["name"]: m for m in ev.column_metadata()}
    assert meta["workspaceId"]["label"] == "Workspace ID"
    assert "timestamp" not in meta
    assert "timestamp" not in filterable_columns(ev.rows)


def test_no_paths_is_an_error(spark):
    with pytest.raises(ValueError, match="no data loaded"):
        read_parquet(spark, [])
    with pytest.raises(ValueError, match="start and end"):
        EventSet.from_frame(make_events(spark, [{}]), None, "2025-11-10")


def test_metadata_types(spark):
    df = make_events(spark, [{}])
    types = {m["name"]: m["type"] for m in column_metadata(df)}
    assert types["uuid"] == "string"


def test_refresh_status_text():
    from eventlens.streaming.refresh import RefreshStatus

    s = RefreshStatus("InProgress", "In Progress", "2025-11-10T13:05:00.000Z", 5, 1)
    assert s.as_dict()["updatedText"] == "Nov 10, 2025 - 1:05 PM"
    assert ns("2025-11-10") > 0


def test_scratch_paths_live_in_the_shared_folder(spark):
    from eventlens.session import scratch_path, shared_dir

    base = shared_dir(spark)
    a, b = scratch_path(spark, "x"), scratch_path(spark, "x")
    assert a != b
    assert base.split(":")[-1].rstrip("/") in a


def test_persisted_eventset_answers_the_same(spark):
    ev = EventSet.from_frame(make_events(spark, [{"action": "Read"}, {"action": "Write"}]), *RANGE)
    before = ev.total()
    assert ev.persist() is ev
    try:
        assert ev.rows.storageLevel.useMemory
        assert ev.total() == before == 2
    finally:
        ev.unpersist()
    assert not ev.rows.storageLevel.useMemory


def test_timestamp_ltz_time_column_maps_and_pushes(spark, tmp_dir):
    from pyspark.sql import functions as F

    from eventlens.plans.inspect import pushed_filters
    from tests.conftest import ns

    df = spark.createDataFrame(
        [("a", "2025-11-10 00:00:00"), ("b", "2025-11-10 23:59:59.999999"), ("c", "2025-11-11 00:00:00"),
         ("d", "2025-11-11 00:00:00.000001"), ("e", "2025-11-09 23:59:59.999999")],
        "uuid string, t string",
    ).select("uuid", F.col("t").cast("timestamp").alias("timestamp"))
    df.write.parquet(f"{tmp_dir}/ltz")
    ev = EventSet.load(spark, f"{tmp_dir}/ltz", *RANGE)
    got = {r.uuid: r.timestamp for r in ev.rows.collect()}
    assert got == {"a": ns("2025-11-10"), "b": ns("2025-11-10T23:59:59.999999"), "c": ns("2025-11-11")}
    pushed = " ".join(pushed_filters(ev.rows))
    assert "GreaterThanOrEqual(timestamp" in pushed and "LessThanOrEqual(timestamp" in pushed
