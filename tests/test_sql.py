import pytest

from eventlens.dataset import EventSet
from tests.conftest import make_events, ns

RANGE = ("2025-11-10", "2025-11-10")


@pytest.fixture()
def ev(spark):
    rows = [
        {"username": "ann", "action": "Write", "filename": "/a/x.py"},
        {"username": "ann", "action": "Read", "filename": "/a/y.py"},
        {"username": "bob", "action": "Read", "filename": "/b/z.csv"},
        {"username": "bob", "action": "Read", "filename": "/b/w.py", "timestamp": ns("2025-12-01")},
    ]
    return EventSet.from_frame(make_events(spark, rows), *RANGE)


def test_documented_queries(ev):
    assert ev.sql("SELECT * FROM events WHERE action='Write'").count() == 1
    grouped = ev.sql("SELECT username, COUNT(*) as count FROM events GROUP BY username ORDER BY count DESC")
    assert [tuple(r) for r in grouped.collect()] == [("ann", 2), ("bob", 1)]
    assert ev.sql("SELECT * FROM events WHERE filename LIKE '%.py' AND action='Read'").count() == 1
    assert ev.sql("SELECT * FROM events WHERE regexp_matches(filename, '^/a/')").count() == 2


def test_sql_is_read_only(ev):
    for text in ["DROP TABLE events", "SELECT 1; DROP TABLE events", "CREATE TABLE t AS SELECT 1",
                 "INSERT INTO events SELECT * FROM events"]:
        with pytest.raises(Exception):
            ev.sql(text).collect()


def test_trailing_semicolon_is_accepted(ev):
    assert ev.sql("SELECT * FROM events WHERE action = 'Read';  ").count() == 2
    with pytest.raises(Exception):
        ev.sql("SELECT 1; SELECT 2;").collect()


def test_sql_text_is_not_rewritten(ev):
    row = ev.sql("SELECT 'events' AS word, count(*) AS n FROM events -- trailing comment").collect()[0]
    assert (row.word, row.n) == ("events", 3)
    assert ev.sql("SELECT * FROM events WHERE filename RLIKE '^/[a-z]{1}/x'").count() == 1


def test_range_and_raw(ev):
    assert ev.sql("SELECT * FROM events").count() == 3
    assert ev.sql("SELECT * FROM events", raw=True).count() == 4


def test_sql_page_keeps_user_order(ev):
    res = ev.sql_page("SELECT filename FROM events ORDER BY filename DESC", page=1, page_size=2)
    assert res.total == 3
    assert [r.filename for r in res.collect()] == ["/b/z.csv", "/a/y.py"]
    res = ev.sql_page("SELECT filename FROM events", page=2, page_size=2, sort_column="filename", sort_order="ASC")
    assert [r.filename for r in res.collect()] == ["/b/z.csv"]


def test_request_plan(ev):
    from eventlens.plans.request import QueryRequest, run_request

    req = QueryRequest.from_body({"filters": {"action": ["Read"]}, "page": 1, "pageSize": 10, "sortOrder": "bogus"})
    assert req.sort_order == "DESC"
    res = run_request(ev, req)
    assert res.page.total == 2
    assert sum(r.event_count for r in res.chart.collect()) == 2
    res = run_request(ev, req, chart_field="username")
    assert {r.series for r in res.chart.collect()} == {"ann", "bob"}
    res = run_request(ev, QueryRequest.from_body({"query": "SELECT username FROM events"}))
    assert res.page.total == 3 and res.chart is None
    res = run_request(ev, QueryRequest.from_body({"query": "SELECT * FROM events WHERE action = 'Read'"}))
    assert sum(r.event_count for r in res.chart.collect()) == res.page.total == 2
    res = run_request(ev, QueryRequest.from_body({"query": "SELECT * FROM events"}), chart_field="username")
    assert {(r.series, sum(x.event_count for x in res.chart.collect() if x.series == r.series))
            for r in res.chart.collect()} == {("ann", 2), ("bob", 1)}


def test_sql_regexp_matches_has_re2_end_anchor(spark):
    from eventlens.plans.sql import sql_frame

    df = spark.createDataFrame([("a.py",), ("a.py\n",), ("x$",), ("a\rb",)], "s string")
    def hits(pattern):
        q = f"SELECT s FROM events WHERE regexp_matches(s, '{pattern}')"
        return sorted(r.s for r in sql_frame(df, q).collect())
    assert hits("\\.py$") == ["a.py"]
    assert hits("x\\$") == ["x$"]
    assert hits("a.b") == ["a\rb"]


def test_literals_and_names_are_read_as_users_write_them(spark):
    from eventlens.plans.sql import has_order_by, spark_text, sql_frame

    df = spark.createDataFrame([("a\\b", "it's"), ("ab", "x")], "s string, `odd name` string")
    def rows(sql):
        return [tuple(r) for r in sql_frame(df, sql).collect()]
    assert rows(r"SELECT s FROM events WHERE s = 'a\b'") == [("a\\b",)]
    assert rows("SELECT s FROM events WHERE \"odd name\" = 'it''s' -- it's") == [("a\\b",)]
    assert rows(r"SELECT s FROM events WHERE regexp_matches(s, '^a(\\|$|x)b$') /* ' */") == [("a\\b",)]
    assert rows(r"SELECT s FROM events WHERE regexp_matches(s, '^\wb$')") == [("ab",)]
    assert spark_text("select \"a\\b\" -- 'x\\'") == "select `a\\b` -- 'x\\'"
    assert spark_text("select \"a`b\"\"c\"") == "select `a``b\"c`"
    assert has_order_by("SELECT 1 ORDER\n BY 1") and not has_order_by("SELECT * FROM (SELECT 1 ORDER BY 1) -- order by")
    assert not has_order_by("SELECT 'order by' AS \"order by\"")


ROWS = [("C:\\tmp\\a.py", "é", 7, None), ("C:%", "a", -7, "x"), ("a_b", "b", 5, "y"), ("a\\%b", None, None, "z"), (None, "É", 0, "x")]
TEXTS = [
    r"SELECT s FROM events WHERE s LIKE 'C:\%'",
    r"SELECT s FROM events WHERE s LIKE '%\a%' OR s NOT LIKE '%' || '\' || '%'",
    r"SELECT s FROM events WHERE s LIKE '%!%%' ESCAPE '!' OR s LIKE '%\%b' ESCAPE '\'",
    r"SELECT s FROM events WHERE (s LIKE CASE WHEN n > 0 THEN '%\%' ELSE 'C:%' END) = true",
    r"SELECT s FROM events WHERE s ILIKE 'c:\%' AND NOT (s LIKE concat('a', '_b'))",
    "SELECT s, n FROM events ORDER BY n, s LIMIT 3",
    "SELECT s, n FROM events ORDER BY n DESC, lower(s) DESC LIMIT 3",
    "SELECT k, count(*) AS c FROM events GROUP BY 1 ORDER BY 1 LIMIT 2",
    "SELECT s, row_number() OVER (PARTITION BY s IS NULL ORDER BY k, n) AS r, sum(n) OVER (ORDER BY n ROWS UNBOUNDED PRECEDING) AS t FROM events",
    "SELECT * FROM (SELECT k FROM events ORDER BY k LIMIT 2) a UNION ALL SELECT * FROM (SELECT k FROM events ORDER BY k DESC NULLS FIRST LIMIT 1) b",
    "SELECT n // 2 AS a, n//-2 AS b, (n + 1) // (1 + 1) * 3 AS c, -n // 2 // 2 AS d, n / 2 AS e FROM events",
    "SELECT s FROM events WHERE regexp_matches(t, 'é', 'i') OR regexp_matches(s, '.', 'l') OR regexp_matches(s, t || '_B', 'i')",
    "SELECT s, regexp_matches(s, '^a') AS m, regexp_matches(s, 'a*' || k) = true AS q FROM events /* ORDER BY */ -- LIKE '",
    "SELECT s FROM events WHERE s IN (SELECT s FROM events WHERE s LIKE '%\\%' ORDER BY n LIMIT 1)",
]


@pytest.mark.parametrize("text", TEXTS)
def test_queries_mean_what_they_mean_in_the_app(spark, text):
    import duckdb
    import pyarrow as pa

    from eventlens.plans.sql import sql_frame

    names = ["s", "t", "n", "k"]
    events = pa.table({c: pa.array([r[i] for r in ROWS], pa.int64() if c == "n" else pa.string()) for i, c in enumerate(names)})
    con = duckdb.connect()
    con.register("events", events)
    df = spark.createDataFrame(ROWS, "s string, t string, n bigint, k string")
    got, want = [tuple(r) for r in sql_frame(df, text).collect()], con.execute(text).fetchall()
    assert sorted(map(str, got)) == sorted(map(str, want))
    if "ORDER BY" in text and "(" not in text.replace("count(*)", "").replace("lower(s)", ""):
        assert got == want


def test_division_by_zero_is_null_and_sessions_stay_as_they_are(spark):
    from eventlens.plans.sql import SqlText, spark_text, sql_frame

    df = spark.createDataFrame([(7, 0)], "a bigint, b bigint")
    before = spark.conf.get("spark.sql.ansi.doubleQuotedIdentifiers", "false")
    assert sql_frame(df, 'SELECT "a" // b AS q FROM events').first().q is None
    assert spark.conf.get("spark.sql.ansi.doubleQuotedIdentifiers", "false") == before
    assert not spark.catalog.functionExists("regexp_matches")
    for bad in ["SELECT regexp_matches(a)", "SELECT regexp_matches(a, 'x', b)", "SELECT regexp_matches(a, 'x', 'q')", "SELECT regexp_matches(a, b, 'l')"]:
        with pytest.raises(ValueError):
            spark_text(bad)
    assert SqlText("f(a, (b, c), d)").arguments(1) == [(2, 2), (4, 8), (10, 10)]
    assert "\x02" in spark_text("SELECT 'a\x01' LIKE 'b'")
