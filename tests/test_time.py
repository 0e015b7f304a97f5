from datetime import date, datetime, timedelta, timezone

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from eventlens.dataset import EventSet
from eventlens.functions.time import (
    auto_bucket,
    bucket_label,
    bucket_start,
    epoch_ns,
    event_time,
    iso_string,
    parse_instant,
    range_bounds_ns,
    spine_bounds,
)
from tests.conftest import make_events, ns


def test_parse_instant_naive_is_utc_and_offsets_honoured():
    assert parse_instant("2024-01-03") == datetime(2024, 1, 3, tzinfo=timezone.utc)
    assert parse_instant("2024-01-03T05:00:00Z") == datetime(2024, 1, 3, 5, tzinfo=timezone.utc)
    assert parse_instant("2024-01-03T05:00:00+02:00") == datetime(2024, 1, 3, 3, tzinfo=timezone.utc)


def test_epoch_ns_is_exact():
    assert epoch_ns(parse_instant("2025-11-11T12:57:14.062068")) == 1762865834062068000
    assert epoch_ns(parse_instant("1970-01-01")) == 0


def test_range_end_is_next_midnight_inclusive():
    lo, hi = range_bounds_ns("2025-11-10", "2025-11-11")
    assert lo == ns("2025-11-10")
    assert hi == ns("2025-11-12")
    with pytest.raises(ValueError):
        range_bounds_ns("2025-11-12", "2025-11-10")


@pytest.mark.parametrize(
    "start,end,unit",
    [
        ("2025-11-10", "2025-11-10", "hour"),
        ("2025-11-10", "2025-11-11", "hour"),
        ("2025-11-10", "2025-11-12", "day"),
        ("2025-01-01", "2025-03-02", "day"),  # 60 days
        ("2025-01-01", "2025-03-03", "week"),  # 61 days
        ("2025-01-01", "2026-01-01", "week"),  # 365 days
        ("2025-01-01", "2026-01-02", "month"),
        (None, None, "day"),
    ],
)
def test_auto_bucket(start, end, unit):
    assert auto_bucket(start, end) == unit


def test_spine_bounds():
    first, last, n = spine_bounds("2025-11-10", "2025-11-10", "hour")
    assert (first.hour, last.hour, n) == (0, 23, 24)
    first, last, n = spine_bounds("2025-01-31", "2025-03-01", "month")
    assert (first.month, last.month, n) == (1, 3, 3)
    first, last, n = spine_bounds("2025-11-08", "2025-11-10", "week")  # Sat .. Mon
    assert first.date().isoformat() == "2025-11-02"
    assert last.date().isoformat() == "2025-11-09"
    assert n == 2


def test_iso_string_and_week_buckets(spark):
    values = [
        1762865834062068277,  # documented sample: fraction kept, nanos truncated
        ns("2025-11-08T10:00:00"),  # Saturday
        ns("2025-11-09T00:00:00"),  # Sunday
        ns("2025-11-10T23:59:59.000001"),  # Monday
    ]
    df = spark.createDataFrame([(v,) for v in values], "timestamp long")
    out = df.select(
        iso_string("timestamp").alias("iso"),
        bucket_label(bucket_start(event_time("timestamp"), "week"), "week").alias("week"),
        bucket_label(bucket_start(event_time("timestamp"), "hour"), "hour").alias("hour"),
        bucket_label(bucket_start(event_time("timestamp"), "month"), "month").alias("month"),
    ).collect()
    assert [r.iso for r in out] == [
        "2025-11-11T12:57:14.062068",
        "2025-11-08T10:00:00",
        "2025-11-09T00:00:00",
        "2025-11-10T23:59:59.000001",
    ]
    assert [r.week for r in out] == ["2025-11-09", "2025-11-02", "2025-11-09", "2025-11-09"]
    assert out[0].hour == "2025-11-11 12:00"
    assert out[0].month == "2025-11"


def test_range_end_instant_counted_but_not_drawn(spark):
    start, end = "2025-11-10", "2025-11-10"
    rows = [
        {"timestamp": ns("2025-11-10") - 1},
        {"timestamp": ns("2025-11-10")},
        {"timestamp": ns("2025-11-11")},  # end + 1 day exactly: inside the range
        {"timestamp": ns("2025-11-11") + 1},
    ]
    ev = EventSet.from_frame(make_events(spark, rows), start, end)
    assert ev.total() == 2
    series = ev.events_over_time().collect()
    assert len(series) == 24
    assert sum(r.event_count for r in series) == 1
    assert series[0].bucket == "2025-11-10 00:00" and series[0].event_count == 1


def test_nanos_parquet_file_reads_as_long(spark, tmp_dir):
    pa = pytest.importorskip("pyarrow")
    import pyarrow.parquet as pq

    path = f"{tmp_dir}/nanos.parquet"
    t = pa.table(
        {
            "uuid": ["a", "b"],
            "timestamp": pa.array([ns("2025-11-10T01:00:00") + 7, ns("2025-11-20")], pa.timestamp("ns")),
            "action": ["Read", "Write"],
        }
    )
    pq.write_table(t, path)
    ev = EventSet.load(spark, [path], "2025-11-10", "2025-11-10")
    assert dict(ev.rows.dtypes)["timestamp"] == "bigint"
    rows = ev.rows.collect()
    assert [(r.uuid, r.timestamp) for r in rows] == [("a", ns("2025-11-10T01:00:00") + 7)]


def test_timestamp_ntz_source_maps_to_ns(spark):
    df = spark.createDataFrame([("x", "2024-01-02 03:04:05.123456")], "uuid string, t string").select(
        "uuid", F.col("t").cast("timestamp_ntz").alias("timestamp")
    )
    ev = EventSet.from_frame(df, "2024-01-02", "2024-01-02")
    assert ev.rows.collect()[0].timestamp == ns("2024-01-02T03:04:05.123456")


def test_request_total_counts_the_end_instant(spark):
    from eventlens.plans.request import QueryRequest, run_request

    rows = [{"timestamp": ns("2025-11-10T05:00:00")}, {"timestamp": ns("2025-11-11")}]
    ev = EventSet.from_frame(make_events(spark, rows), "2025-11-10", "2025-11-10")
    res = run_request(ev, QueryRequest())
    assert res.page.total == 2
    assert sum(r.event_count for r in res.chart.collect()) == 1


def test_default_range_is_last_seven_days():
    from datetime import date

    from eventlens.functions.time import default_range

    assert default_range(date(2025, 11, 10)) == ("2025-11-03", "2025-11-10")
    assert auto_bucket(*default_range(date(2025, 11, 10))) == "day"


def test_pre_epoch_nanos_floor_to_the_earlier_microsecond(spark):
    values = [-1, -1_000, -1_001, 999, 1_000]
    df = spark.createDataFrame([(v,) for v in values], "timestamp long")
    out = [r[0] for r in df.select(iso_string("timestamp")).collect()]
    assert out == [
        "1969-12-31T23:59:59.999999",
        "1969-12-31T23:59:59.999999",
        "1969-12-31T23:59:59.999998",
        "1970-01-01T00:00:00",
        "1970-01-01T00:00:00.000001",
    ]


def _walk_axis(start, end, unit):
    """Brute force: step from the start day's midnight one unit at a time while
    before the end day's last instant or in the same bucket as it."""
    import calendar
    from datetime import timedelta as td

    from eventlens.functions.time import bucket_floor

    cur = parse_instant(start).replace(hour=0, minute=0, second=0, microsecond=0)
    last = parse_instant(end).replace(hour=23, minute=59, second=59, microsecond=999999)
    out = []
    while cur < last or bucket_floor(cur, unit) == bucket_floor(last, unit):
        out.append(bucket_floor(cur, unit))
        if unit == "month":
            y, m = cur.year + (cur.month // 12), cur.month % 12 + 1
            cur = cur.replace(year=y, month=m, day=min(cur.day, calendar.monthrange(y, m)[1]))
        else:
            cur = cur + {"hour": td(hours=1), "day": td(days=1), "week": td(days=7)}[unit]
    return sorted(set(out))


@settings(max_examples=25, deadline=None)
@given(
    start=st.dates(min_value=date(2023, 1, 1), max_value=date(2025, 12, 31)),
    days=st.integers(min_value=0, max_value=800),
    unit=st.sampled_from(["hour", "day", "week", "month"]),
)
def test_axis_equals_brute_force_walk(start, days, unit):
    end = start + timedelta(days=days if unit != "hour" else min(days, 3))
    first, last, n = spine_bounds(start.isoformat(), end.isoformat(), unit)
    walk = _walk_axis(start.isoformat(), end.isoformat(), unit)
    assert (walk[0], walk[-1], len(walk)) == (first, last, n)
