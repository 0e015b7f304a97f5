import pytest

from eventlens.dataset import EventSet
from eventlens.operators.paging import clamp_page, normalize_order, page_bounds, page_info_frame, page_rows
from tests.conftest import make_events, ns

RANGE = ("2025-11-10", "2025-11-10")


@pytest.fixture()
def ev(spark):
    envs = [None, "b", "a", "b", None, "c", "a", "b"] * 5
    rows = [
        {"uuid": f"u{i:03d}", "timestamp": ns("2025-11-10T10:00:00") + (i // 3), "environmentName": e}
        for i, e in enumerate(envs)
    ]
    return EventSet.from_frame(make_events(spark, rows), *RANGE)


def test_nulls_last_both_directions(ev):
    asc = [r.environmentName for r in page_rows(ev.rows, 1, 100, "environmentName", "ASC").collect()]
    desc = [r.environmentName for r in page_rows(ev.rows, 1, 100, "environmentName", "DESC").collect()]
    assert asc[-10:] == [None] * 10 and asc[0] == "a"
    assert desc[-10:] == [None] * 10 and desc[0] == "c"


def test_pages_partition_the_sorted_result(ev):
    full = [r.uuid for r in page_rows(ev.rows, 1, 1000, "environmentName", "ASC").collect()]
    paged = []
    for p in range(1, 6):
        paged += [r.uuid for r in page_rows(ev.rows, p, 9, "environmentName", "ASC").collect()]
    assert paged == full
    assert len(set(paged)) == 40


def test_default_sort_is_timestamp_desc_with_uuid_tiebreak(ev):
    rows = page_rows(ev.rows, 1, 4).collect()
    assert [r.uuid for r in rows] == ["u039", "u036", "u037", "u038"]


def test_fetch_page_clamps_and_reports_bounds(ev):
    res = ev.page(page=7, page_size=10)
    assert (res.total, res.page, res.start, res.end) == (40, 1, 1, 10)
    res = ev.page(page=4, page_size=15)
    assert (res.total, res.page, res.start, res.end) == (40, 1, 1, 15)
    res = ev.page(page=3, page_size=15)
    assert (res.page, res.start, res.end) == (3, 31, 40)
    assert len(res.collect()) == 10


def test_page_info_frame_matches_driver_arithmetic(ev):
    info = page_info_frame(ev.rows, page=3, page_size=15).collect()[0]
    assert (info.total, info.page, info.start_row, info.end_row) == (40, 3, 31, 40)
    info = page_info_frame(ev.rows, page=99, page_size=15).collect()[0]
    assert (info.page, info.start_row, info.end_row) == (1, 1, 15)


def test_helpers():
    assert normalize_order("asc") == "ASC"
    assert normalize_order("sideways") == "DESC"
    assert clamp_page(0, 1, 100) == 1
    assert page_bounds(0, 1, 100) == (0, 0)
    assert page_bounds(250, 3, 100) == (201, 250)


def test_unknown_sort_column(ev):
    with pytest.raises(ValueError, match="unknown sort column"):
        page_rows(ev.rows, 1, 10, "nope")


@pytest.mark.parametrize("column,order", [("timestamp", "DESC"), ("environmentName", "ASC"), ("environmentName", "DESC")])
def test_keyset_pages_equal_offset_pages(ev, column, order):
    from eventlens.operators.paging import page_after

    full = [r.uuid for r in page_rows(ev.rows, 1, 1000, column, order).collect()]
    got, last = [], None
    while True:
        page = page_after(ev.rows, last, 7, column, order).collect()
        if not page:
            break
        got += [r.uuid for r in page]
        last = page[-1].asDict()
    assert got == full


def test_deep_time_pages_equal_offset_pages(spark):
    from eventlens.operators.paging import deep_page_rows, page_rows

    # a hot second holding a third of the rows, with exact-timestamp ties inside it
    base = ns("2025-11-10T08:00:00")
    rows = [{"uuid": f"a{i:04d}", "timestamp": base + i * 7_000_000_000} for i in range(600)]
    rows += [{"uuid": f"h{i:04d}", "timestamp": base + 3_600_000_000_000 + (i % 40)} for i in range(300)]
    ev = EventSet.from_frame(make_events(spark, rows), "2025-11-10", "2025-11-10")
    for order in ["DESC", "ASC"]:
        full = [r.uuid for r in page_rows(ev.rows, 1, 10_000, "timestamp", order).collect()]
        for page in [1, 3, 7, 12, 19]:
            got = [r.uuid for r in deep_page_rows(ev.rows, page, 50, order, ev.lo_ns, ev.hi_ns, small=20).collect()]
            assert got == full[(page - 1) * 50: page * 50], (order, page)
        assert deep_page_rows(ev.rows, 99, 50, order, ev.lo_ns, ev.hi_ns, small=20).collect() == []


@pytest.mark.parametrize("column,order", [("environmentName", "ASC"), ("environmentName", "DESC"), ("timestamp", "DESC")])
def test_tail_pages_equal_offset_pages(ev, column, order):
    from eventlens.operators.paging import tail_page_rows

    full = [r.uuid for r in page_rows(ev.rows, 1, 1000, column, order).collect()]
    total = len(full)
    for offset, n in [(35, 10), (30, 7), (0, 40), (39, 3)]:
        got = [r.uuid for r in tail_page_rows(ev.rows, total, offset, n, column, order).collect()]
        assert got == full[offset: offset + n], (offset, n)


def hot_events(spark):
    # a hot value holding a third of the rows, nulls, shared path prefixes, tied timestamps
    base = ns("2025-11-10T08:00:00")
    rows = []
    for i in range(900):
        env = "env-hot" if i % 3 == 0 else (None if i % 7 == 0 else f"env-{i % 23:02d}")
        rows.append({"uuid": f"u{i:04d}", "timestamp": base + (i % 250) * 1_000_000_000,
                     "environmentName": env, "filename": f"/mnt/data/p{i % 5}/f{i:04d}.py"})
    return EventSet.from_frame(make_events(spark, rows), "2025-11-10", "2025-11-10")


@pytest.mark.parametrize("column,order", [("environmentName", "ASC"), ("environmentName", "DESC"),
                                          ("filename", "ASC"), ("filename", "DESC"), ("uuid", "DESC")])
def test_seek_pages_equal_offset_pages(spark, column, order):
    from eventlens.operators.paging import seek_page_rows

    ev = hot_events(spark)
    full = [r.uuid for r in page_rows(ev.rows, 1, 10_000, column, order).collect()]
    for page in [1, 4, 9, 13, 18]:
        got = [r.uuid for r in seek_page_rows(ev.rows, page, 50, column, order, small=30).collect()]
        assert got == full[(page - 1) * 50: page * 50], (column, order, page)


def test_seek_handles_unicode_and_prefix_values(spark):
    from eventlens.operators.paging import seek_page_rows

    names = ["a", "ab", "abc", "é", "éa", "日本", "日", "z", "", "a\u0001", "\U0001F600x", "\U0001F600"]
    rows = [{"uuid": f"u{i:04d}", "filename": names[i % len(names)] + (str(i % 3) if i % 2 else "")}
            for i in range(400)]
    ev = EventSet.from_frame(make_events(spark, rows), "2025-11-10", "2025-11-10")
    for order in ["ASC", "DESC"]:
        full = [r.uuid for r in page_rows(ev.rows, 1, 10_000, "filename", order).collect()]
        for page in [2, 5, 7]:
            got = [r.uuid for r in seek_page_rows(ev.rows, page, 40, "filename", order, small=10).collect()]
            assert got == full[(page - 1) * 40: page * 40], (order, page)


@pytest.mark.parametrize("order", ["ASC", "DESC"])
def test_seek_on_fractional_keys_with_specials(spark, order):
    from pyspark.sql import functions as F

    from eventlens.operators.paging import seek_page_rows

    specials = [float("nan"), float("inf"), float("-inf"), -0.0, 0.0, None, 2.5]
    rows = [{"uuid": f"u{i:04d}", "timestamp": ns("2025-11-10T01:00:00") + i % 97} for i in range(600)]
    df = make_events(spark, rows).withColumn(
        "score",
        F.when(F.col("uuid").substr(2, 4).cast("int") % 5 == 0,
               F.element_at(F.array(*[F.lit(v).cast("double") for v in specials]),
                            (F.col("uuid").substr(2, 4).cast("int") % 7 + 1).cast("int")))
        .otherwise(F.col("uuid").substr(2, 4).cast("double") / 7.0),
    )
    ev = EventSet.from_frame(df, "2025-11-10", "2025-11-10")
    full = [r.uuid for r in page_rows(ev.rows, 1, 10_000, "score", order).collect()]
    for page in [1, 3, 6, 9, 12]:
        got = [r.uuid for r in seek_page_rows(ev.rows, page, 50, "score", order, small=20).collect()]
        assert got == full[(page - 1) * 50: page * 50], (order, page)


@pytest.mark.parametrize("column,order", [("timestamp", "DESC"), ("timestamp", "ASC"),
                                          ("environmentName", "ASC"), ("filename", "DESC")])
def test_page_dispatch_matches_plain_offset_pages(spark, monkeypatch, column, order):
    from eventlens.operators import paging

    monkeypatch.setattr(paging, "DEEP_OFFSET", 60)
    ev = hot_events(spark)
    full = [r.uuid for r in page_rows(ev.rows, 1, 10_000, column, order).collect()]
    total = len(full)
    for page in range(1, total // 50 + 2):
        res = ev.page(page=page, page_size=50, sort_column=column, sort_order=order)
        want = full[(res.page - 1) * 50: res.page * 50]
        assert [r.uuid for r in res.collect()] == want, (column, order, page)
    res = ev.sql_page("SELECT * FROM events", page=10, page_size=50, sort_column=column, sort_order=order)
    assert [r.uuid for r in res.collect()] == full[450:500]


def test_time_seek_is_exact_over_long_ranges(spark):
    from eventlens.functions.time import range_bounds_ns
    from eventlens.operators.paging import SEEK_FANOUT, deep_page_rows

    # ~3 years in ns: offsets from the range start pass 2^53, where a double
    # division rounds. Put rows exactly on bucket edges where it rounds down.
    lo, hi = range_bounds_ns("2022-01-01", "2024-12-31")
    width = -(-(hi - lo + 1) // SEEK_FANOUT)
    edges = [k for k in range(1, SEEK_FANOUT) if int(float(k * width) / width) < k]
    assert edges
    stamps = sorted({lo + k * width + d for k in edges for d in (-1, 0, 1)})
    rows = [{"uuid": f"u{i:04d}", "timestamp": t} for i, t in enumerate(stamps)]
    ev = EventSet.from_frame(make_events(spark, rows), "2022-01-01", "2024-12-31")
    for order in ["DESC", "ASC"]:
        full = [r.uuid for r in page_rows(ev.rows, 1, 10_000, "timestamp", order).collect()]
        for page in range(1, len(full) // 7 + 1, 3):
            got = [r.uuid for r in deep_page_rows(ev.rows, page, 7, order, ev.lo_ns, ev.hi_ns, small=5).collect()]
            assert got == full[(page - 1) * 7: page * 7], (order, page)


def test_seek_on_any_sortable_type(spark):
    """Decimals beyond a double, dates, timestamps, booleans, binaries, arrays and structs, with nulls and ties."""
    import datetime as dt
    import random
    from decimal import Decimal

    from eventlens.operators.paging import page_rows, seek_page_rows

    rng = random.Random(8)
    rows = []
    for i in range(160):
        n = rng.randint(0, 12)
        values = [
            Decimal(98765432109876543) + Decimal(n) / 10**15, dt.date(2024, 1, 1 + n), dt.datetime(2024, 1, 1, 0, 0, 0, n), n % 2 == 0,
            bytes([n, 255 - n]), [n % 3, None, n], (n % 4, f"x{n}" if n % 3 else None), float("nan") if n == 5 else n / 7, f"é{n}'\n",
        ]
        rows.append((i % 150, *[None if rng.random() < 0.1 else v for v in values]))
    schema = ("uuid bigint, dec decimal(38,15), d date, t timestamp, b boolean, bin binary, arr array<bigint>, "
              "st struct<a: int, s: string>, f double, s string")  # fmt: skip
    df = spark.createDataFrame(rows, schema).repartition(3).cache()
    for column in schema.split(", ")[1:]:
        name = column.split()[0]
        if name not in df.columns:
            continue
        for order, page in (("ASC", 4), ("DESC", 13)):
            got = seek_page_rows(df, page, 10, name, order, small=25).collect()
            assert list(map(str, got)) == list(map(str, page_rows(df, page, 10, name, order).collect())), (name, order)


def test_seek_searches_an_interval_again_and_stops_at_equal_rows(spark):
    from pyspark.sql import functions as F

    from eventlens.operators import paging

    df = spark.range(3000).select((F.col("id") % 3 == 0).alias("hot"), F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("uuid"))
    spec = paging.sort_spec(df, "hot", "DESC")
    for offset in (0, 999, 1500, 2990):
        pred, local = paging.seek_window(df, spec, offset, small=10, splits=4)
        assert df.where(~pred).count() + local == offset
        assert local <= 10 or df.where(pred).orderBy(*paging.sort_keys(df, "hot", "DESC")).offset(local).first() is not None
    pred, local = paging.seek_window(df, spec, 5000, small=10)
    assert df.where(pred).count() == 0
