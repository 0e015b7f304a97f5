"""Physical plan shape of the main operators (what would matter at scale)."""

from eventlens.dataset import EventSet
from eventlens.operators.filters import FilterSpec
from eventlens.operators.paging import page_after, page_rows
from eventlens.plans.inspect import file_scans, plan_tree, pushed_filters, python_evals, shuffles
from tests.conftest import make_events, ns

RANGE = ("2025-11-10", "2025-11-12")


def canonical(spark, tmp_dir):
    rows = [
        {"timestamp": ns("2025-11-10") + i * 3_600_000_000_000, "action": ["Read", "Write"][i % 2],
         "filename": f"/d/f{i % 7}.py", "username": f"user{i % 5}"}
        for i in range(60)
    ]
    make_events(spark, rows).write.parquet(f"{tmp_dir}/ev")
    return EventSet.load(spark, f"{tmp_dir}/ev", *RANGE)


def test_page_is_one_take_ordered(spark, tmp_dir):
    ev = canonical(spark, tmp_dir)
    df = page_rows(ev.filtered(FilterSpec(exact={"action": ["Read"]})), 3, 10)
    tree = plan_tree(df)
    assert "TakeOrderedAndProject" in tree and file_scans(df) == 1
    assert shuffles(df) == 0


def test_keyset_page_pushes_its_seek_range(spark, tmp_dir):
    ev = canonical(spark, tmp_dir)
    first = page_after(ev.rows, None, 10).collect()
    df = page_after(ev.rows, first[-1].asDict(), 10)
    pushed = " ".join(pushed_filters(df))
    assert f"LessThanOrEqual(timestamp,{first[-1].timestamp})" in pushed
    assert [r.timestamp for r in df.collect()][0] < first[-1].timestamp


def test_events_over_time_is_one_scan_one_shuffle_broadcast_join(spark, tmp_dir):
    ev = canonical(spark, tmp_dir)
    df = ev.events_over_time(FilterSpec(exact={"action": ["Read"]}))
    assert file_scans(df) == 1
    assert shuffles(df) == 1
    assert "BroadcastHashJoin" in plan_tree(df)
    assert python_evals(df) == 0


def test_top_values_is_take_ordered(spark, tmp_dir):
    ev = canonical(spark, tmp_dir)
    df = ev.top_values("username", n=3)
    assert "TakeOrderedAndProject" in plan_tree(df) and file_scans(df) == 1


def test_export_is_narrow(spark, tmp_dir):
    ev = canonical(spark, tmp_dir)
    df = ev.export_frame(FilterSpec(substring={"filename": ["f1"]}))
    assert shuffles(df) == 0 and file_scans(df) == 1
    assert "StringContains(filename,f1)" in " ".join(pushed_filters(df))


def test_deep_string_seek_page_on_parquet(spark, tmp_dir):
    from eventlens.operators.paging import seek_page_rows

    ev = canonical(spark, tmp_dir)
    df = seek_page_rows(ev.rows, page=3, page_size=5, sort_column="filename", sort_order="ASC", small=4)
    full = [r.uuid for r in page_rows(ev.rows, 1, 1000, "filename", "ASC").collect()]
    assert [r.uuid for r in df.collect()] == full[10:15]
    assert python_evals(df) == 0
