import pytest
from pyspark.sql import functions as F

from eventlens.dataset import EventSet
from eventlens.functions.regex import to_java_regex
from eventlens.operators.filters import FilterSpec, apply_filters
from eventlens.plans.inspect import pushed_filters
from tests.conftest import make_events

RANGE = ("2025-11-10", "2025-11-10")


def events(spark, names, column="filename"):
    return EventSet.from_frame(make_events(spark, [{column: n} for n in names]), *RANGE)


def matched(ev, spec, column="filename"):
    return sorted(r[column] for r in ev.filtered(spec).select(column).collect())


SUBSTRING_ROWS = ["axb", "a_b", "a%b", "a\\b", "it's"]


@pytest.mark.parametrize(
    "term,expected",
    [
        ("a_b", ["a%b", "a\\b", "a_b", "axb"]),  # '_' is a wildcard
        ("a%b", ["a%b", "a\\b", "a_b", "axb"]),  # '%' is a wildcard
        ("a\\b", ["a\\b"]),  # backslash is literal
        ("a\\_", ["a\\b"]),  # literal backslash, then a wildcard
        ("it's", ["it's"]),  # quotes need no escaping
        ("x", ["axb"]),
        ("X", []),  # case-sensitive
    ],
)
def test_substring_semantics(spark, term, expected):
    ev = events(spark, SUBSTRING_ROWS)
    assert matched(ev, FilterSpec(substring={"filename": [term]})) == sorted(expected)


REGEX_CASES = [
    ("/demofile\\d*\\.[^/]+$", ["demofile.txt", "demofile123.py", "/path/to/demofile99.csv"],
     ["demofile_backup.txt", "demo.txt"]),
    ("/\\.py$", ["script.py", "/code/main.py"], ["script.pyc", "python.txt"]),
    ("/^/home/[^/]+/data/", ["/home/user1/data/file.csv", "/home/admin/data/report.xlsx"],
     ["/home/user1/documents/file.csv"]),
    ("/test.*\\.ipynb$", ["test.ipynb", "test_analysis.ipynb", "testing.ipynb"], ["main.ipynb", "test.py"]),
]


@pytest.mark.parametrize("pattern,yes,no", REGEX_CASES)
def test_documented_regex_cases(spark, pattern, yes, no):
    ev = events(spark, yes + no)
    assert matched(ev, FilterSpec(regex={"filename": [pattern]})) == sorted(yes)


def test_regex_dialect_adjustments(spark):
    ev = events(spark, ["a.py", "a.py\n", "A.PY", "a\rb", None])
    assert matched(ev, FilterSpec(regex={"filename": ["/\\.py$"]})) == ["a.py"]
    assert matched(ev, FilterSpec(regex={"filename": ["/a.b"]})) == ["a\rb"]
    # a trailing slash is part of the pattern, so this never matches
    assert matched(ev, FilterSpec(regex={"filename": ["/\\.py$/"]})) == []


def test_to_java_regex_rewrites_only_bare_dollar():
    assert to_java_regex("a$") == "(?d)a\\z"
    assert to_java_regex("a\\$") == "(?d)a\\$"
    assert to_java_regex("[$]x") == "(?d)[$]x"
    assert to_java_regex("[]$]") == "(?d)[]$]"
    assert to_java_regex("(?m)^a$") == "(?d)(?:^|(?<=\\n))a(?:\\z|(?=\\n))"
    assert to_java_regex("[[:digit:]]+(?P<n>x)") == "(?d)[\\p{Digit}]+(?<n>x)"
    assert to_java_regex("[^[:space:]]") == "(?d)[^\\s]"
    assert to_java_regex("\\Qa$\\E$") == "(?d)\\Qa$\\E\\z"


def test_or_within_and_across_columns_null_excluded(spark):
    rows = [
        {"filename": "a.py", "action": "Read", "environmentName": "e1"},
        {"filename": "b.csv", "action": "Read", "environmentName": "e1"},
        {"filename": "c.ipynb", "action": "Write", "environmentName": "e1"},
        {"filename": "d.py", "action": "Write", "environmentName": None},
    ]
    ev = EventSet.from_frame(make_events(spark, rows), *RANGE)
    spec = FilterSpec(
        exact={"action": ["Read", "Write"], "environmentName": ["e1"]},
        substring={"filename": [".csv"]},
        regex={"filename": ["/\\.py$"]},
    )
    assert matched(ev, spec) == ["a.py", "b.csv"]


def test_exact_filter_casts_literals_to_column_type(spark):
    df = make_events(spark, [{"filename": "a"}, {"filename": "b"}]).withColumn(
        "environmentRevisionNumber", F.when(F.col("filename") == "a", 9).otherwise(10)
    )
    out = apply_filters(df, FilterSpec(exact={"environmentRevisionNumber": ["10"]}))
    assert [r.filename for r in out.collect()] == ["b"]
    with pytest.raises(Exception):
        apply_filters(df, FilterSpec(exact={"environmentRevisionNumber": ["ten"]})).collect()


def test_substring_on_non_string_column_casts_column(spark):
    df = make_events(spark, [{"filename": "a"}]).withColumn("n", F.lit(12345))
    assert apply_filters(df, FilterSpec(substring={"n": ["234"]})).count() == 1


def test_unknown_column_and_bad_regex_raise(spark):
    ev = events(spark, ["a"])
    with pytest.raises(ValueError, match="unknown filter column"):
        ev.filtered(FilterSpec(exact={"nope": ["x"]}))
    with pytest.raises(ValueError, match="invalid regular expression"):
        ev.filtered(FilterSpec(regex={"filename": ["/[a-"]}))


def test_spec_cleaning_and_term_classification():
    spec = FilterSpec(exact={"a": [], "b": ["x"]}, substring={"c": []})
    assert spec.columns == ["b"]
    spec = FilterSpec.from_terms(selected={"action": ["Read"]}, typed={"filename": ["/\\.py$", "/", "abc"]})
    assert spec.regex == {"filename": ("/\\.py$",)}
    assert spec.substring == {"filename": ("/", "abc")}
    assert spec.exact == {"action": ("Read",)}
    assert spec.without("filename").columns == ["action"]
    body = {"filters": {"action": ["Read"]}, "substringFilters": {}, "regexFilters": {"filename": ["/x"]}}
    assert FilterSpec.from_request(body).to_request()["regexFilters"] == {"filename": ["/x"]}


def test_filters_push_down_on_canonical_parquet(spark, tmp_dir):
    rows = [{"filename": f"/a/{i}.py", "action": "Read" if i % 2 else "Write"} for i in range(20)]
    make_events(spark, rows).write.parquet(f"{tmp_dir}/ev")
    ev = EventSet.load(spark, f"{tmp_dir}/ev", *RANGE)
    df = ev.filtered(FilterSpec(exact={"action": ["Read"]}, substring={"filename": ["1"]}))
    pushed = " ".join(pushed_filters(df))
    assert "GreaterThanOrEqual(timestamp" in pushed and "LessThanOrEqual(timestamp" in pushed
    assert "In(action" in pushed or "EqualTo(action" in pushed
    assert "StringContains(filename,1)" in pushed
    assert df.count() == 6  # odd i containing "1": 1, 11, 13, 15, 17, 19
