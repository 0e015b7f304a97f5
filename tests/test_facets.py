import pytest
from pyspark.sql import functions as F

from eventlens.dataset import EventSet
from eventlens.operators.facets import facet_counts, facet_panel, facet_values
from eventlens.operators.filters import FilterSpec, apply_filters
from eventlens.plans.inspect import file_scans, plan_tree, python_evals
from eventlens.sources.testdata import audit_source
from tests.conftest import SF001, make_events

RANGE = ("2025-11-10", "2025-11-10")


def test_cap_and_exact_counts(spark):
    rows = [{"filename": f"f{i:04d}", "action": "Read"} for i in range(1500)]
    ev = EventSet.from_frame(make_events(spark, rows), *RANGE)
    vals = ev.facets(columns=["filename", "action"]).collect()
    fnames = sorted((r.value_rank, r.value) for r in vals if r.column_name == "filename")
    assert len(fnames) == 1000 and fnames[0] == (1, "f0000") and fnames[-1] == (1000, "f0999")
    counts = {r.column_name: r for r in ev.facet_counts(columns=["filename", "action"]).collect()}
    assert counts["filename"].total_values == 1500 and counts["filename"].count_label == "(1000)"
    spec = FilterSpec(exact={"action": ["Read"], "filename": ["f0001"]})
    counts = {r.column_name: r for r in ev.facet_counts(spec, columns=["filename", "action"]).collect()}
    assert counts["action"].available_values == 1 and counts["action"].count_label == "(1)"
    assert counts["filename"].available_values == 1500


def test_typed_sort_for_integer_columns(spark):
    df = make_events(spark, [{"filename": str(i)} for i in range(3)]).withColumn(
        "environmentRevisionNumber", F.element_at(F.array(F.lit(10), F.lit(9), F.lit(100)), F.col("filename").cast("int") + 1)
    )
    out = facet_values(df, columns=["environmentRevisionNumber"]).orderBy("value_rank").collect()
    assert [r.value for r in out] == ["9", "10", "100"]


def naive_facets(rows, spec, columns, cap=1000):
    result = set()
    for c in columns:
        sub = apply_filters(rows, spec.without(c)).where(F.col(c).isNotNull())
        values = sorted({r[0] for r in sub.select(F.col(c).cast("string")).distinct().collect()})[:cap]
        result |= {(c, v, i + 1) for i, v in enumerate(values)}
    return result


TERMS = {
    "action": ("exact", ["click", "view"]),
    "filename": ("substring", ["demofile1"]),
    "username": ("substring", ["user_1"]),
    "environmentName": ("regex", ["/^env[12]$"]),
    "workspaceName": ("exact", ["ws3", ""]),
}


COMBOS = [(), ("action",), ("environmentName", "workspaceName"), ("action", "filename", "username"),
          tuple(sorted(TERMS))]


@pytest.mark.parametrize("combo", COMBOS)
def test_one_pass_facets_equal_per_column_queries(spark, combo):
    rows = audit_source(spark, SF001).in_range(0, 2**62)
    cols = ["action", "filename", "username", "environmentName", "workspaceName", "projectName"]
    if True:
        parts = {"exact": {}, "substring": {}, "regex": {}}
        for c in combo:
            kind, vals = TERMS[c]
            parts[kind][c] = vals
        spec = FilterSpec(**parts)
        got = {(r.column_name, r.value, r.value_rank) for r in facet_values(rows, spec, cols, cap=50).collect()}
        assert got == naive_facets(rows, spec, cols, cap=50), combo


def test_facet_plan_is_one_scan_without_python(spark):
    rows = audit_source(spark, SF001).in_range(0, 2**62)
    spec = FilterSpec(exact={"action": ["click"]}, regex={"filename": ["/\\.py$"]})
    df = facet_values(rows, spec)
    assert file_scans(df) == 1
    assert "WindowGroupLimit" in plan_tree(df)
    assert python_evals(df) == 0
    assert file_scans(facet_counts(rows, spec)) == 1


def test_value_search_is_case_insensitive(spark):
    ev = EventSet.from_frame(make_events(spark, [{"filename": n} for n in ["A.PY", "b.py", "c.csv"]]), *RANGE)
    out = {r.value for r in ev.value_search("filename", ".Py").collect()}
    assert out == {"A.PY", "b.py"}


def test_facet_panel_equals_separate_calls(spark):
    rows = audit_source(spark, SF001).in_range(0, 2**62)
    spec = FilterSpec(exact={"action": ["click", "view"]}, regex={"environmentName": ["/^env[12]$"]},
                      substring={"filename": ["demofile1"]})
    panel = facet_panel(rows, spec)
    assert sorted(map(tuple, panel.values.collect())) == sorted(map(tuple, facet_values(rows, spec).collect()))
    assert sorted(map(tuple, panel.counts.collect())) == sorted(map(tuple, facet_counts(rows, spec).collect()))
    # Each reads the rows itself: the distinct values are not stored in between.
    assert file_scans(panel.values) > 0 and file_scans(panel.counts) > 0


def test_eventset_defaults_to_panel_columns(spark):
    ev = EventSet(audit_source(spark, SF001), "2024-01-01", "2024-01-31")
    assert ev.facet_columns() == ["action", "username", "projectName", "filename"]
    cols = {r.column_name for r in ev.facet_counts().collect()}
    assert cols == {"action", "username", "projectName", "filename"}
    assert ev.facet_columns(["uuid"]) == ["uuid"]


@pytest.mark.parametrize("combo", COMBOS[:3])
def test_prelimit_equals_plain_facets(spark, combo):
    from eventlens.plans.inspect import python_evals

    rows = audit_source(spark, SF001).in_range(0, 2**62)
    parts = {"exact": {}, "substring": {}, "regex": {}}
    for c in combo:
        kind, vals = TERMS[c]
        parts[kind][c] = vals
    spec = FilterSpec(**parts)
    for cap in (3, 50):
        plain = sorted(map(tuple, facet_values(rows, spec, cap=cap).collect()))
        cut = facet_values(rows, spec, cap=cap, prelimit=True)
        assert python_evals(cut) == 1
        assert sorted(map(tuple, cut.collect())) == plain


def test_approximate_counts_are_close(spark):
    rows = audit_source(spark, SF001).in_range(0, 2**62)
    spec = FilterSpec(exact={"action": ["click", "view"]})
    exact = {r.column_name: r for r in facet_counts(rows, spec).collect()}
    approx = {r.column_name: r for r in facet_counts(rows, spec, approx=True).collect()}
    assert set(exact) == set(approx)
    for c, e in exact.items():
        a = approx[c]
        assert abs(a.total_values - e.total_values) <= max(2, 0.05 * e.total_values), c
        assert abs(a.available_values - e.available_values) <= max(2, 0.05 * e.available_values), c


def test_approx_panel_has_exact_values(spark):
    rows = audit_source(spark, SF001).in_range(0, 2**62)
    spec = FilterSpec(exact={"action": ["click", "view"]}, substring={"filename": ["demofile1"]})
    panel = facet_panel(rows, spec, approx=True)
    assert sorted(map(tuple, panel.values.collect())) == sorted(map(tuple, facet_values(rows, spec).collect()))
    assert {r.column_name for r in panel.counts.collect()} == {r.column_name for r in facet_counts(rows, spec).collect()}


def test_repeated_facet_columns_are_deduplicated(spark):
    ev = EventSet.from_frame(make_events(spark, [{"action": "Read"}, {"action": "Write"}]), *RANGE)
    out = ev.facets(columns=["action", "action"]).collect()
    assert sorted(r.value for r in out) == ["Read", "Write"]
