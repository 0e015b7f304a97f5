from eventlens.dataset import EventSet
from eventlens.operators.breakdown import distinct_labels
from eventlens.operators.filters import FilterSpec
from eventlens.plans.inspect import file_scans, python_evals
from tests.conftest import make_events, ns

RANGE = ("2025-11-08", "2025-11-10")  # 2 days -> day buckets


def labelled_events(spark):
    rows = []
    t = ns("2025-11-08T06:00:00")
    specs = [(None, 1), ("", 1), ("Unknown", 1), ("Other", 5)]
    specs += [(f"w{i:02d}", c) for i, c in enumerate([9, 8, 7, 6, 4, 4, 3, 2, 2, 2, 1, 1], 1)]
    for value, count in specs:
        for k in range(count):
            rows.append({"workspaceName": value, "timestamp": t + k * 4 * 3_600_000_000_000})
    return EventSet.from_frame(make_events(spark, rows), *RANGE)


def test_top_values_and_labels(spark):
    ev = labelled_events(spark)
    top = [(r.label, r.event_count) for r in ev.top_values("workspaceName").collect()]
    # null, '' and the literal 'Unknown' share one label; ties break by label
    assert top == [("w01", 9), ("w02", 8), ("w03", 7), ("w04", 6), ("Other", 5),
                   ("w05", 4), ("w06", 4), ("Unknown", 3), ("w07", 3), ("w08", 2)]
    assert distinct_labels(ev.rows, "workspaceName").collect()[0][0] == 14


def test_breakdown_other_kept_apart_from_value_other(spark):
    ev = labelled_events(spark)
    out = ev.breakdown("workspaceName").collect()
    series = {(r.series, r.is_other) for r in out}
    assert ("Other", False) in series and ("Other", True) in series
    assert len(series) == 11
    assert {r.bucket for r in out} == {"2025-11-08", "2025-11-09", "2025-11-10"}
    rollup = sum(r.event_count for r in out if r.is_other)
    assert rollup == 2 + 2 + 1 + 1  # w09..w12
    total = ev.total()
    assert sum(r.event_count for r in out) == total
    assert sum(r.event_count for r in ev.events_over_time().collect()) == total


def test_no_other_series_with_n_or_fewer_labels(spark):
    ev = labelled_events(spark)
    spec = FilterSpec(exact={"workspaceName": ["w01", "w02", "w03"]})
    out = ev.breakdown("workspaceName", spec, top_n=3).collect()
    assert {r.series for r in out} == {"w01", "w02", "w03"}
    assert not any(r.is_other for r in out)
    out = ev.breakdown("workspaceName", spec, top_n=2).collect()
    assert {(r.series, r.is_other) for r in out} == {("w01", False), ("w02", False), ("Other", True)}


def test_empty_input_gives_no_series(spark):
    ev = labelled_events(spark)
    out = ev.breakdown("workspaceName", FilterSpec(exact={"action": ["nothing"]})).collect()
    assert out == []
    zero = ev.events_over_time(FilterSpec(exact={"action": ["nothing"]})).collect()
    assert len(zero) == 3 and all(r.event_count == 0 for r in zero)


def test_breakdown_reads_events_once(spark, tmp_dir):
    labelled_events(spark).rows.write.parquet(f"{tmp_dir}/ev")
    ev = EventSet.load(spark, f"{tmp_dir}/ev", *RANGE)
    out = ev.breakdown("workspaceName")
    # the (bucket, label) aggregate is checkpointed; the returned plan no longer scans files
    assert file_scans(out) == 0
    assert python_evals(out) == 0
    assert sum(r.event_count for r in out.collect()) == ev.total()
