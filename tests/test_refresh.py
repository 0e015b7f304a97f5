from eventlens.dataset import EventSet
from eventlens.schema import EVENT_SCHEMA
from eventlens.plans.inspect import plan_text
from eventlens.streaming.refresh import refresh
from tests.conftest import make_events, ns


def test_refresh_is_incremental_and_exactly_once(spark, tmp_dir):
    landing, table, ckpt = f"{tmp_dir}/landing", f"{tmp_dir}/table", f"{tmp_dir}/ckpt"
    first = [{"uuid": f"a{i}", "timestamp": ns("2025-11-10") + i * 3_600_000_000_000} for i in range(100)]
    make_events(spark, first).write.parquet(f"{landing}/batch=1")
    s1 = refresh(spark, landing, table, ckpt, EVENT_SCHEMA)
    assert (s1.status, s1.rows) == ("Completed", 100)
    assert spark.read.parquet(table).count() == 100

    second = [{"uuid": f"b{i}", "timestamp": ns("2025-11-20") + i} for i in range(50)]
    make_events(spark, second).write.parquet(f"{landing}/batch=2")
    s2 = refresh(spark, landing, table, ckpt, EVENT_SCHEMA)
    assert s2.rows == 50
    assert spark.read.parquet(table).count() == 150

    s3 = refresh(spark, landing, table, ckpt, EVENT_SCHEMA)
    assert s3.rows == 0
    assert spark.read.parquet(table).count() == 150
    assert s3.as_dict()["statusText"] == "Completed"


def test_refreshed_table_prunes_date_partitions(spark, tmp_dir):
    landing, table, ckpt = f"{tmp_dir}/landing", f"{tmp_dir}/table", f"{tmp_dir}/ckpt"
    rows = [{"uuid": f"a{i}", "timestamp": ns("2025-11-01") + i * 86_400_000_000_000} for i in range(20)]
    make_events(spark, rows).write.parquet(landing)
    refresh(spark, landing, table, ckpt, EVENT_SCHEMA)
    ev = EventSet.load(spark, table, "2025-11-05", "2025-11-06")
    assert "eventlens_utc_day" not in ev.rows.columns
    assert sorted(r.uuid for r in ev.rows.collect()) == ["a4", "a5", "a6"]  # a6 = end + 1 day, 00:00
    assert "PartitionFilters: [isnotnull(eventlens_utc_day" in plan_text(ev.rows)


def test_long_running_refresh_reports_progress(spark, tmp_dir):
    from eventlens.streaming.refresh import start_refresh, status_of

    landing, table, ckpt = f"{tmp_dir}/landing", f"{tmp_dir}/table", f"{tmp_dir}/ckpt"
    make_events(spark, [{"uuid": f"a{i}"} for i in range(30)]).write.parquet(f"{landing}/b1")
    q = start_refresh(spark, landing, table, ckpt, EVENT_SCHEMA, every="1 second", recursive=True)
    try:
        q.processAllAvailable()
        assert status_of(q).status == "InProgress"
        make_events(spark, [{"uuid": f"b{i}"} for i in range(5)]).write.parquet(f"{landing}/b2")
        q.processAllAvailable()
        assert spark.read.parquet(table).count() == 35
    finally:
        q.stop()
    s = status_of(q)
    assert s.status == "Completed" and s.rows == 35 and s.total_rows == 35 and s.as_dict()["totalRows"] == 35
    # the batch refresh continues from the same checkpoint without re-appending
    assert refresh(spark, landing, table, ckpt, EVENT_SCHEMA, recursive=True).rows == 0


def test_rows_are_counted_past_the_reports_spark_keeps_and_after_a_lost_driver(spark, tmp_dir, monkeypatch):
    from eventlens.streaming import refresh as r

    landing, table, ckpt = f"{tmp_dir}/landing", f"{tmp_dir}/table", f"{tmp_dir}/ckpt"
    many = [{"uuid": f"a{i}", "timestamp": ns("2025-11-10") + i} for i in range(24)]
    make_events(spark, many).repartition(12).write.parquet(landing)
    kept = "spark.sql.streaming.numRecentProgressUpdates"
    before = spark.conf.get(kept)
    spark.conf.set(kept, "2")
    monkeypatch.setattr(r, "POLL_SECONDS", 60)  # reports are missed
    try:
        first = refresh(spark, landing, table, ckpt, EVENT_SCHEMA, max_files_per_trigger=1)
    finally:
        spark.conf.set(kept, before)
    monkeypatch.undo()
    assert (first.rows, first.batches, first.total_rows) == (24, 12, 24)
    assert r.read_totals(spark, ckpt) == r.Totals(11, 24) and r.last_batch(spark, table) == 11

    make_events(spark, [{"uuid": f"b{i}"} for i in range(5)]).coalesce(1).write.mode("append").parquet(landing)
    second = refresh(spark, landing, table, ckpt, EVENT_SCHEMA)
    assert (second.rows, second.batches, second.total_rows) == (5, 1, 29)

    for lost in (r.Totals(3, 8), None):  # the driver was lost before it wrote the totals, or while it did
        path, fs = r._path(spark, ckpt, r.TOTALS_FILE)
        if lost:
            r.write_totals(spark, ckpt, lost)
        else:
            fs.create(path, True).close()
        again = refresh(spark, landing, table, ckpt, EVENT_SCHEMA)
        assert (again.rows, again.total_rows) == (0, 29) and r.read_totals(spark, ckpt).rows == 29
    assert spark.conf.get(kept) == before
