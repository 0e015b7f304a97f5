"""Registered queries over the driver's tables, each with an independent DuckDB oracle.

Every query reads the whole ``events`` table through the ``audit`` mapping
(``eventlens.sources.testdata``) and exercises one operator family of the
library. The oracle SQL re-derives the same answer in plain SQL (the
``audit`` mapping, range bounds and chart axes are computed in SQL from the
literal dates, not by this library).
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlens.dataset import EventSet
from eventlens.functions import text as T
from eventlens.functions.time import event_time
from eventlens.operators.breakdown import distinct_labels
from eventlens.operators.facets import column_metadata_values, column_values, facet_counts
from eventlens.operators.filters import FilterSpec, apply_filters
from eventlens.operators.paging import (
    deep_page_rows,
    next_cursor,
    page_after,
    page_info_frame,
    page_rows,
    seek_page_rows,
    tail_page_rows,
    total_frame,
)
from eventlens.session import ensure_conf, scratch_path
from eventlens.sources import sinks
from eventlens.sources.parquet import parquet_source
from eventlens.sources.testdata import AUDIT_COLUMNS, AUDIT_VIEW_SQL, audit_source, table_path

# ---------------------------------------------------------------------------
# Parameters of the registered queries.
# ---------------------------------------------------------------------------

FULL = ("2024-01-01", "2024-01-31")        # 30 days -> day buckets; all events
PART = ("2024-01-05", "2024-01-20")        # a partial range
HOUR = ("2024-01-15", "2024-01-16")        # 1 day  -> hour buckets
WEEK = ("2023-12-01", "2024-03-01")        # 91 days -> week buckets
MONTH = ("2023-06-01", "2024-08-31")       # 457 days -> month buckets

EXACT = FilterSpec(exact={"action": ["click", "purchase"]})
SUBSTRING = FilterSpec(substring={"filename": ["demofile1"]})
WILDCARD = FilterSpec(substring={"filename": ["proj_/demofile1_.py"]})
REGEX = FilterSpec(regex={"filename": ["/demofile4\\d\\.py$"]})
COMBINED = FilterSpec(
    exact={"action": ["click", "view"]},
    substring={"filename": ["demofile1"], "username": ["user_1"]},
    regex={"filename": ["/\\.ipynb$"], "environmentName": ["/^env[12]$"]},
)

REGEX_CLASS = FilterSpec(regex={"filename": ["/demofile[[4&&5]\\d\\.py$"]})

# Facet queries cover every column but the time (the app's columns endpoints do).
FACET_COLUMNS = [c for c in AUDIT_COLUMNS if c != "timestamp"]

SQL_EQUALITY = "SELECT * FROM events WHERE action = 'click'"
SQL_GROUP_COUNT = (
    "SELECT username, COUNT(*) AS count FROM events GROUP BY username ORDER BY count DESC"
)
SQL_LIKE_AND = "SELECT * FROM events WHERE filename LIKE '%.py' AND action = 'view'"
SQL_REGEXP = (
    "SELECT uuid, filename, action FROM events "
    "WHERE regexp_matches(filename, 'demofile4[0-9]\\.(py|csv)')"
)
SQL_REGEXP_DIGITS = r"SELECT uuid, filename FROM events WHERE regexp_matches(filename, 'demofile4\d\.py$')"
SQL_QUOTED_NAME = "SELECT uuid, \"action\" FROM events WHERE \"action\" = 'click' -- it's a comment"
SQL_ORDER_NULLS = (
    "SELECT environmentName, COUNT(*) AS n, CAST(MIN(rn) AS BIGINT) AS first_rn FROM (SELECT environmentName, uuid, "
    "row_number() OVER (PARTITION BY action ORDER BY environmentName, uuid DESC) AS rn FROM events) t "
    "GROUP BY environmentName ORDER BY environmentName LIMIT 4"
)
SQL_LIKE_BACKSLASH = (
    r"SELECT uuid, replace(filename, '/', '\') AS winpath FROM events WHERE replace(filename, '/', '\') LIKE '\mnt\data\%' "
    r"AND replace(filename, '/', '\') NOT LIKE '%\' || 'demofile4%' AND filename NOT LIKE '%!_%' ESCAPE '!'"
)
SQL_INTEGER_DIVISION = (
    "SELECT timestamp // 86400000000000 AS day, COUNT(*) AS n, MAX(timestamp // 1000 // 1000 % 86400000 // 3600000) AS last_hour "
    "FROM events GROUP BY timestamp // 86400000000000 ORDER BY day DESC"
)
SQL_REGEXP_OPTIONS = (
    "SELECT uuid, filename FROM events WHERE regexp_matches(filename, 'DEMOFILE4\\d\\.PY$', 'i') "
    "AND NOT regexp_matches(projectName, concat('PROJ', '1$'), 'i') AND regexp_matches(filename, '.py', 'l')"
)
SQL_ESCAPED = r"SELECT uuid, 'it''s' AS quoted, 'a\b\' AS slashed FROM events WHERE filename LIKE '%demofile4%'"


def events_for(spark: SparkSession, sf_dir: str, rng=FULL) -> EventSet:
    """The audit ``EventSet`` of a range; files are listed and read anew by every query."""
    ensure_conf(spark)
    return EventSet(audit_source(spark, sf_dir), *rng)


def all_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every audit row, whatever its time."""
    ensure_conf(spark)
    return audit_source(spark, sf_dir).canonical()


# ---------------------------------------------------------------------------
# Spark side.
# ---------------------------------------------------------------------------


def q_load_range(spark, d):
    """Every event of a partial date range (closed end)."""
    return events_for(spark, d, PART).rows


def q_filter_exact(spark, d):
    """Exact values on one column."""
    return events_for(spark, d).filtered(EXACT)


def q_filter_substring(spark, d):
    """A plain substring (pushes down as StringContains on real files)."""
    return events_for(spark, d).filtered(SUBSTRING)


def q_filter_substring_wildcard(spark, d):
    """P3/D4: '_' inside a term stays a LIKE wildcard."""
    return events_for(spark, d).filtered(WILDCARD)


def q_filter_regex(spark, d):
    """An RE2 pattern with an end anchor."""
    return events_for(spark, d).filtered(REGEX)


def q_filter_combined(spark, d):
    """OR within a column, AND across columns, all three modes."""
    return events_for(spark, d).filtered(COMBINED)


def q_total_count(spark, d):
    """A1: the total under combined filters."""
    return total_frame(events_for(spark, d).filtered(COMBINED))


def q_page_desc(spark, d):
    """O1-O3: page 3 of the default order (timestamp DESC, uuid tie-break)."""
    return page_rows(events_for(spark, d).filtered(EXACT), page=3, page_size=100)


def q_page_asc_nulls(spark, d):
    """A page straddling the nulls-last boundary of a tied string sort."""
    return page_rows(events_for(spark, d).rows, page=129, page_size=70,
                     sort_column="environmentName", sort_order="ASC")


def q_page_filename_desc(spark, d):
    """A descending string sort with many ties."""
    return page_rows(events_for(spark, d).filtered(SUBSTRING), page=2, page_size=100,
                     sort_column="filename", sort_order="desc")


KEYSET_AFTER = {"timestamp": 1705708800000000000, "uuid": ""}  # 2024-01-20T00:00:00Z


def q_page_keyset(spark, d):
    """O3: the keyset page after a given (timestamp, uuid)."""
    return events_for(spark, d).page_after(KEYSET_AFTER, EXACT, page_size=100)


def q_page_deep_seek(spark, d):
    ev = events_for(spark, d)
    return deep_page_rows(ev.rows, page=80, page_size=100, sort_order="DESC",
                          lo_ns=ev.lo_ns, hi_ns=ev.hi_ns, small=500)


def q_page_deep_filename(spark, d):
    """A middle page of a string sort, located by counts between sampled splits (no deep top-k)."""
    return seek_page_rows(events_for(spark, d).rows, page=60, page_size=100,
                          sort_column="filename", sort_order="ASC", small=500)


def _with_decimal(rows):
    """Rows with a decimal key whose values differ in the 20th place only, beyond a double."""
    digits = F.lpad((F.col("uuid").cast("bigint") * 7 % 8191).cast("string"), 20, "0")
    amount = F.concat(F.lit("98765432109876543."), digits).cast("decimal(38,20)")
    return rows.select("uuid", "timestamp", amount.alias("amount"))


def q_page_deep_decimal(spark, d):
    """O3: a middle page sorted by a decimal that no double tells apart."""
    rows = _with_decimal(events_for(spark, d).rows)
    page = seek_page_rows(rows, page=50, page_size=100, sort_column="amount", sort_order="DESC", small=500)
    return page.withColumn("amount", F.col("amount").cast("string"))


def q_page_last_env_asc(spark, d):
    """Last page of a string sort with nulls and ties, read from the far end."""
    rows = events_for(spark, d).rows
    total = rows.count()
    last = (max(1, -(-total // 100)) - 1) * 100
    return tail_page_rows(rows, total, last, 100, "environmentName", "ASC")


def q_page_info(spark, d):
    """Total, page and record range of a page."""
    return page_info_frame(events_for(spark, d).filtered(COMBINED), page=3, page_size=25)


def q_page_info_clamped(spark, d):
    """A page past the end falls back to page 1."""
    return page_info_frame(events_for(spark, d).filtered(COMBINED), page=9999, page_size=25)


def q_events_over_time_hour(spark, d):
    """A one-day range charts by hour."""
    return events_for(spark, d, HOUR).events_over_time()


def q_events_over_time_day(spark, d):
    """Day buckets, zero-filled, under a filter."""
    return events_for(spark, d).events_over_time(FilterSpec(exact={"action": ["click"]}))


def q_events_over_time_week(spark, d):
    """Sunday-started weeks over a 91-day range."""
    return events_for(spark, d, WEEK).events_over_time()


def q_events_over_time_month(spark, d):
    """A2: month buckets over a range longer than a year."""
    return events_for(spark, d, MONTH).events_over_time(SUBSTRING)


def q_top_values(spark, d):
    """A4/F8: the 10 most frequent workspace labels ('' and null -> Unknown)."""
    return events_for(spark, d).top_values("workspaceName")


def q_distinct_labels(spark, d):
    """Distinct label count."""
    return distinct_labels(events_for(spark, d).rows, "workspaceName")


def q_breakdown_day(spark, d):
    """A3: breakdown by action (5 labels, no Other) under a regex filter."""
    spec = FilterSpec(regex={"environmentName": ["/^env[0-2]$"]})
    return events_for(spark, d).breakdown("action", spec)


def q_breakdown_week_other(spark, d):
    """Top 10 + Other by workspace, weekly."""
    return events_for(spark, d, WEEK).breakdown("workspaceName")


def q_breakdown_hour_users(spark, d):
    """A3: a high-cardinality field (users) by hour."""
    return events_for(spark, d, HOUR).breakdown("username")


def q_column_values(spark, d):
    """Each column's first 1000 distinct values."""
    return events_for(spark, d).column_values(FACET_COLUMNS)


def q_column_values_prelimit(spark, d):
    """``column_values`` with each task's candidates cut to 1000 per column before the shuffle."""
    return column_values(events_for(spark, d).rows, FACET_COLUMNS, prelimit=True)


def q_column_metadata(spark, d):
    """Type, label and values per column."""
    return column_metadata_values(events_for(spark, d).rows, FACET_COLUMNS)


def q_facets_cascading(spark, d):
    """Cascading facet values under combined filters, one scan."""
    return events_for(spark, d).facets(COMBINED, FACET_COLUMNS)


def q_facet_counts(spark, d):
    """Available vs total values and the '(a of m)' label."""
    return events_for(spark, d).facet_counts(COMBINED, FACET_COLUMNS)


def q_value_search(spark, d):
    """Case-insensitive search in a column's facet values."""
    return events_for(spark, d).value_search("filename", "DEMOFILE4", FilterSpec(exact={"action": ["click"]}))


def q_table_view(spark, d):
    """One page as the table shows it."""
    return events_for(spark, d).table_view(FilterSpec(exact={"action": ["view"]}), page=1)


def q_export_rows(spark, d):
    """The export projection."""
    return events_for(spark, d).export_frame(COMBINED)


def q_export_roundtrip_csv(spark, d):
    """K2/K4: write the export as CSV and read it back."""
    ev = events_for(spark, d)
    frame = ev.export_frame(COMBINED)
    path = ev.export_csv(COMBINED, sinks.export_path(scratch_path(spark, "export"), "csv"))
    return sinks.read_csv_export(spark, path, frame.schema)


def q_export_roundtrip_parquet(spark, d):
    """K3/K4: write the export as Parquet and read it back."""
    ev = events_for(spark, d)
    path = ev.export_parquet(COMBINED, sinks.export_path(scratch_path(spark, "export"), "parquet"))
    return spark.read.parquet(path)


def q_sql_equality(spark, d):
    """Q1/Q2: SQL mode, equality example."""
    return events_for(spark, d).sql(SQL_EQUALITY)


def q_sql_group_count(spark, d):
    """Q3: SQL mode, group count with the user's ORDER BY."""
    return events_for(spark, d).sql(SQL_GROUP_COUNT)


def q_sql_like_and(spark, d):
    """Q4: SQL mode, LIKE + AND example."""
    return events_for(spark, d).sql(SQL_LIKE_AND)


def q_sql_regexp_matches(spark, d):
    """Q5: SQL mode, regexp_matches."""
    return events_for(spark, d).sql(SQL_REGEXP)


def q_sql_chart(spark, d):
    """SQL-mode results drawn as the zero-filled chart (the app updates chart and table)."""
    from eventlens.plans.request import sql_chart

    return sql_chart(events_for(spark, d), SQL_EQUALITY)


def q_path_basename(spark, d):
    """base name of each path."""
    rows = all_rows(spark, d)
    return rows.select("uuid", T.basename(F.col("filename")).alias("basename"))


def q_ellipsis(spark, d):
    """paths shortened to 30 characters + '...'."""
    rows = all_rows(spark, d)
    return rows.select("uuid", T.ellipsis(F.col("filename")).alias("short_path"))


def q_display_timestamp(spark, d):
    """table display time."""
    rows = all_rows(spark, d)
    return rows.select("uuid", T.display_timestamp("timestamp").alias("display_time"))


def q_refresh_time_text(spark, d):
    """refresh banner time format."""
    rows = all_rows(spark, d)
    return rows.select("uuid", T.refresh_timestamp(event_time("timestamp")).alias("time_text"))


def q_camel_words(spark, d):
    """camelCase split into words."""
    rows = all_rows(spark, d)
    cap = F.concat(F.upper(F.substring("action", 1, 1)), F.substring("action", 2, 1 << 30))
    return rows.select("uuid", T.camel_words(F.concat(cap, F.col("environmentName"))).alias("words"))


def q_refresh_incremental(spark, d):
    """Stream the ``events`` file through the audit mapping into a date-partitioned
    table (availableNow), then read the table back over the full range."""
    from eventlens.streaming.refresh import refresh

    source = audit_source(spark, d)
    schema = source.frame.schema
    base = scratch_path(spark, "refresh")
    events = table_path(d, "events")
    # The table is one file in the folder, or a folder of part files.
    landing, glob = (events, None) if os.path.isdir(events) else (d, os.path.basename(events))
    refresh(
        spark,
        landing=landing,
        table=f"{base}/table",
        checkpoint=f"{base}/checkpoint",
        schema=schema,
        transform=lambda s: s.select(*[c.alias(n) for n, c in source.projection]),
        file_glob=glob,
    )
    return parquet_source(spark, f"{base}/table").canonical().select(*AUDIT_COLUMNS)


def q_refresh_status(spark, d):
    """R2: what a refresh of one row a batch at most reports, against the table it wrote."""
    from eventlens.streaming.refresh import refresh

    base = scratch_path(spark, "refresh")
    all_rows(spark, d).repartition(6, "uuid").write.parquet(f"{base}/landing")
    status = refresh(spark, f"{base}/landing", f"{base}/table", f"{base}/checkpoint",
                     all_rows(spark, d).schema, max_files_per_trigger=1)
    table = spark.read.parquet(f"{base}/table")
    return table.agg(F.count(F.lit(1)).alias("table_rows")).select(
        F.lit(status.status).alias("status"), F.lit(status.rows).cast("bigint").alias("reported_rows"), "table_rows"
    )


def q_refresh_optional_columns(spark, d):
    """Columns beyond the canonical ones come through a refresh whose schema is read from the files."""
    from eventlens.streaming.refresh import landing_schema, refresh

    base = scratch_path(spark, "refresh")
    more = F.concat(F.lit("rev-"), F.col("userId"))
    all_rows(spark, d).withColumn("environmentRevisionNumber", more).write.parquet(f"{base}/landing")
    schema = landing_schema(spark, f"{base}/landing")
    refresh(spark, f"{base}/landing", f"{base}/table", f"{base}/checkpoint", schema)
    rows = parquet_source(spark, f"{base}/table").canonical()
    return rows.select(*AUDIT_COLUMNS, "environmentRevisionNumber")


def q_union_files(spark, d):
    """Several folders of Parquet files as one relation."""
    base = scratch_path(spark, "union")
    rows = all_rows(spark, d)
    parts = [f"{base}/a", f"{base}/b"]
    rows.where("action = 'click'").write.parquet(parts[0])
    rows.where("action <> 'click' OR action IS NULL").repartition(3, "uuid").write.parquet(parts[1])
    return EventSet.load(spark, parts, *FULL).rows.select(*AUDIT_COLUMNS)


def q_sql_regexp_digits(spark, d):
    """Q5: a pattern with a class escape and an end anchor, as users write it."""
    return events_for(spark, d).sql(SQL_REGEXP_DIGITS)


def q_sql_quoted_identifier(spark, d):
    """Q1: a double-quoted name is a column."""
    return events_for(spark, d).sql(SQL_QUOTED_NAME)


def q_sql_escaped_quote(spark, d):
    """Q1: a doubled quote and backslashes in literals."""
    return events_for(spark, d).sql(SQL_ESCAPED)


def q_sql_order_nulls(spark, d):
    """Sort items of the query, a window and a subquery put nulls last."""
    return events_for(spark, d).sql(SQL_ORDER_NULLS)


def q_sql_like_backslash(spark, d):
    """Q1: LIKE has no escape character unless the query names one, for computed patterns too."""
    return events_for(spark, d).sql(SQL_LIKE_BACKSLASH)


def q_sql_integer_division(spark, d):
    """Q1: ``//`` divides integers."""
    return events_for(spark, d).sql(SQL_INTEGER_DIVISION)


def q_sql_regexp_options(spark, d):
    """Q5: regexp_matches with options, for a literal and a computed pattern."""
    return events_for(spark, d).sql(SQL_REGEXP_OPTIONS)


def _accented(spark, d):
    """Events whose project name is written with accents and in capitals."""
    events = events_for(spark, d)
    return events.rows.select(
        "uuid", F.concat(F.lit("É"), F.upper("projectName"), F.lit(" été "), F.col("filename")).alias("label")
    )


def q_filter_regex_unicode(spark, d):
    """A case-insensitive pattern folds accented letters."""
    return apply_filters(_accented(spark, d), FilterSpec(regex={"label": ["/(?i)^éproj[12] ÉTÉ.*\\.PY$"]}))


def q_filter_regex_boundary(spark, d):
    """Word boundaries go by ASCII, and ``{,2}`` is itself."""
    spec = FilterSpec(regex={"label": ["/\\bPROJ3\\b", "/x{,2}", "/\\bt\\b.*demofile1\\d\\."]})
    return apply_filters(_accented(spark, d), spec)


def q_sql_page_default_sort(spark, d):
    """Q1/O1: a page of an unordered query shows the newest rows first."""
    return events_for(spark, d).sql_page(SQL_EQUALITY, page=2).rows


def q_sql_page_request_sort(spark, d):
    """Q1/O1: a page of an unordered query in the order the request asks for."""
    return events_for(spark, d).sql_page(SQL_EQUALITY, page=3, page_size=50, sort_column="filename", sort_order="ASC").rows


def q_page_invalid_order(spark, d):
    """O2: an unknown direction is DESC."""
    return page_rows(events_for(spark, d).filtered(EXACT), page=1, page_size=40, sort_column="username", sort_order="sideways")


def q_page_keyset_duplicates(spark, d):
    """O3: keyset pages of rows that all occur three times lose none and repeat none."""
    rows = events_for(spark, d).filtered(EXACT)
    thrice = rows.unionByName(rows).unionByName(rows)
    cursor = None
    for _ in range(3):  # pages of 50 end inside groups of three
        last, seen = cursor or (None, 0)
        cursor = next_cursor(page_after(thrice, last, 50, seen=seen).collect(), cursor)
    return page_after(thrice, cursor[0], 50, seen=cursor[1])


def q_export_roundtrip_csv_spaces(spark, d):
    """K2: values that begin and end in white space survive the CSV export."""
    rows = events_for(spark, d).filtered(COMBINED)
    padded = rows.withColumn("filename", F.concat(F.lit(" \t"), F.col("filename"), F.lit("  ")))
    frame = EventSet.from_frame(padded, *FULL).export_frame()
    path = sinks.write_csv(frame, sinks.export_path(scratch_path(spark, "export"), "csv"))
    return sinks.read_csv_export(spark, path, frame.schema)


def q_filter_regex_class(spark, d):
    """Brackets and ampersands in a class are members of it."""
    return events_for(spark, d).filtered(REGEX_CLASS)


def q_breakdown_filename(spark, d):
    """A3/A5: a field with almost as many labels as rows."""
    return events_for(spark, d).breakdown("filename")


def q_facet_panel_values(spark, d):
    """The values of a filter panel."""
    return events_for(spark, d).facet_panel(COMBINED, FACET_COLUMNS).values


def q_facet_panel_counts(spark, d):
    """The counts of a filter panel."""
    return events_for(spark, d).facet_panel(COMBINED, FACET_COLUMNS).counts


def q_facet_counts_empty_column(spark, d):
    """A column without a value is listed with none."""
    rows = events_for(spark, d).rows.withColumn("hardwareTierId", F.lit(None).cast("string"))
    return facet_counts(rows, COMBINED, [*FACET_COLUMNS, "hardwareTierId"])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    name[2:]: fn for name, fn in sorted(globals().items()) if name.startswith("q_") and callable(fn)
}

# ---------------------------------------------------------------------------
# DuckDB oracle.
# ---------------------------------------------------------------------------


def _lo(day: str) -> str:
    return f"epoch_us(TIMESTAMP '{day}') * 1000"


def _hi(day: str) -> str:
    return f"epoch_us(TIMESTAMP '{day}' + INTERVAL 1 DAY) * 1000"


def _ranged(rng, where: str = "") -> str:
    cond = f'"timestamp" >= {_lo(rng[0])} AND "timestamp" <= {_hi(rng[1])}'
    if where:
        cond += f" AND ({where})"
    return f"WITH audit AS ({AUDIT_VIEW_SQL}), ev AS (SELECT * FROM audit WHERE {cond})"


EVERY = f"WITH ev AS ({AUDIT_VIEW_SQL})"

T_EVENT = 'make_timestamp(("timestamp" - ("timestamp" % 1000)) // 1000)'

W_EXACT = "action IN ('click', 'purchase')"
W_SUBSTRING = "filename LIKE '%demofile1%'"
W_WILDCARD = "filename LIKE '%proj_/demofile1_.py%'"
W_REGEX = "regexp_matches(filename, 'demofile4\\d\\.py$')"
W_REGEX_CLASS = "regexp_matches(filename, 'demofile[[4&&5]\\d\\.py$')"
W_COMBINED = (
    "action IN ('click', 'view')"
    " AND (filename LIKE '%demofile1%' OR regexp_matches(filename, '\\.ipynb$'))"
    " AND username LIKE '%user_1%'"
    " AND regexp_matches(environmentName, '^env[12]$')"
)
COMBINED_PARTS = {
    "action": "action IN ('click', 'view')",
    "filename": "(filename LIKE '%demofile1%' OR regexp_matches(filename, '\\.ipynb$'))",
    "username": "username LIKE '%user_1%'",
    "environmentName": "regexp_matches(environmentName, '^env[12]$')",
}

BUCKET_SQL = {
    "hour": (f"date_trunc('hour', {T_EVENT})", "'%Y-%m-%d %H:00'", "INTERVAL 1 HOUR"),
    "day": (f"date_trunc('day', {T_EVENT})", "'%Y-%m-%d'", "INTERVAL 1 DAY"),
    "week": (
        f"CAST(CAST({T_EVENT} AS DATE) - CAST(dayofweek({T_EVENT}) AS INTEGER) AS TIMESTAMP)",
        "'%Y-%m-%d'",
        "INTERVAL 7 DAY",
    ),
    "month": (f"date_trunc('month', {T_EVENT})", "'%Y-%m'", "INTERVAL 1 MONTH"),
}


def _spine(rng, unit: str) -> str:
    s, e = f"DATE '{rng[0]}'", f"DATE '{rng[1]}'"
    if unit == "hour":
        first, last = f"CAST({s} AS TIMESTAMP)", f"CAST({e} AS TIMESTAMP) + INTERVAL 23 HOUR"
    elif unit == "day":
        first, last = f"CAST({s} AS TIMESTAMP)", f"CAST({e} AS TIMESTAMP)"
    elif unit == "week":
        first = f"CAST({s} - CAST(dayofweek({s}) AS INTEGER) AS TIMESTAMP)"
        last = f"CAST({e} - CAST(dayofweek({e}) AS INTEGER) AS TIMESTAMP)"
    else:
        first, last = f"date_trunc('month', CAST({s} AS TIMESTAMP))", f"date_trunc('month', CAST({e} AS TIMESTAMP))"
    return f"SELECT x AS b FROM generate_series({first}, {last}, {BUCKET_SQL[unit][2]}) t(x)"


def _over_time(rng, unit: str, where: str = "") -> str:
    b, fmt, _ = BUCKET_SQL[unit]
    return f"""{_ranged(rng, where)},
spine AS ({_spine(rng, unit)}),
c AS (SELECT {b} AS b, count(*) AS n FROM ev GROUP BY 1)
SELECT strftime(spine.b, {fmt}) AS bucket, epoch_ms(spine.b) AS bucket_ms,
       coalesce(c.n, 0) AS event_count
FROM spine LEFT JOIN c ON spine.b = c.b"""


def _label(col: str) -> str:
    return f"CASE WHEN {col} IS NULL OR {col} = '' THEN 'Unknown' ELSE {col} END"


def _breakdown(rng, unit: str, field: str, where: str = "", n: int = 10) -> str:
    b, fmt, _ = BUCKET_SQL[unit]
    return f"""{_ranged(rng, where)},
spine AS ({_spine(rng, unit)}),
g AS (SELECT {b} AS b, {_label(field)} AS label, count(*) AS n FROM ev GROUP BY 1, 2),
tot AS (SELECT label, sum(n) AS n FROM g GROUP BY label),
top AS (SELECT label, row_number() OVER (ORDER BY n DESC, label ASC) AS series_rank
        FROM tot ORDER BY n DESC, label ASC LIMIT {n}),
m AS (SELECT g.b, CASE WHEN top.label IS NULL THEN 'Other' ELSE g.label END AS series,
             top.label IS NULL AS is_other, coalesce(top.series_rank, {n + 1}) AS series_rank, g.n
      FROM g LEFT JOIN top ON g.label = top.label),
cnt AS (SELECT b, series, is_other, series_rank, sum(n) AS n FROM m GROUP BY ALL),
series AS (SELECT DISTINCT series, is_other, series_rank FROM cnt)
SELECT strftime(spine.b, {fmt}) AS bucket, epoch_ms(spine.b) AS bucket_ms,
       series.series, series.is_other, CAST(series.series_rank AS BIGINT) AS series_rank,
       CAST(coalesce(cnt.n, 0) AS BIGINT) AS event_count
FROM series CROSS JOIN spine
LEFT JOIN cnt ON cnt.b = spine.b AND cnt.series = series.series AND cnt.is_other = series.is_other"""


def _facet_branch(col: str, parts: dict[str, str], cap: int = 1000) -> str:
    others = [p for c, p in parts.items() if c != col]
    where = " AND ".join([f"{col} IS NOT NULL"] + others)
    return f"""SELECT '{col}' AS column_name, v AS value,
       CAST(row_number() OVER (ORDER BY v) AS BIGINT) AS value_rank
FROM (SELECT DISTINCT CAST({col} AS VARCHAR) AS v FROM ev WHERE {where}) d
QUALIFY value_rank <= {cap}"""


def _facet_union(parts: dict[str, str], columns=FACET_COLUMNS) -> str:
    return "\nUNION ALL\n".join(f"({_facet_branch(c, parts)})" for c in columns)


def _facets(rng, parts: dict[str, str], columns=FACET_COLUMNS) -> str:
    return f"{_ranged(rng)}\n{_facet_union(parts, columns)}"


def _facet_counts(rng, parts: dict[str, str], columns=FACET_COLUMNS, empty: tuple[str, ...] = ()) -> str:
    branches = [f"SELECT '{c}' AS column_name, 0 AS available_values, 0 AS total_values" for c in empty]
    for c in columns:
        others = " AND ".join([p for k, p in parts.items() if k != c] or ["TRUE"])
        branches.append(
            f"SELECT '{c}' AS column_name,"
            f" count(DISTINCT CASE WHEN {others} THEN {c} END) AS available_values,"
            f" count(DISTINCT {c}) AS total_values FROM ev"
        )
    union = "\nUNION ALL\n".join(branches)
    return f"""{_ranged(rng)}, cnt AS ({union})
SELECT column_name, available_values, total_values,
       CASE WHEN least(available_values, 1000) < least(total_values, 1000)
            THEN '(' || CAST(least(available_values, 1000) AS VARCHAR) || ' of '
                 || CAST(least(total_values, 1000) AS VARCHAR) || ')'
            ELSE '(' || CAST(least(total_values, 1000) AS VARCHAR) || ')' END AS count_label
FROM cnt"""


ISO_SQL = (
    f"strftime({T_EVENT}, '%Y-%m-%dT%H:%M:%S') || CASE WHEN (\"timestamp\" // 1000) % 1000000 <> 0"
    " THEN '.' || lpad(CAST((\"timestamp\" // 1000) % 1000000 AS VARCHAR), 6, '0') ELSE '' END"
)

EXPORT_SELECT = f"""SELECT {ISO_SQL} AS "Date & Time (UTC)", username AS "User Name", action AS "Event",
       filename AS "File Path", projectName AS "Project Name", workspaceName AS "Workspace Name",
       environmentName AS "Environment Name" FROM ev"""

PAGE_INFO = """, t AS (SELECT count(*) AS total FROM ev),
p AS (SELECT total, CASE WHEN {page} > greatest(1, CAST(ceil(total / {size}) AS BIGINT)) THEN 1 ELSE {page} END AS page FROM t)
SELECT total, CAST(page AS BIGINT) AS page, CAST({size} AS BIGINT) AS page_size,
       CAST(CASE WHEN total > 0 THEN (page - 1) * {size} + 1 ELSE 0 END AS BIGINT) AS start_row,
       CAST(CASE WHEN total > 0 THEN least(page * {size}, total) ELSE 0 END AS BIGINT) AS end_row
FROM p"""


def _sql_mode(rng, user_sql: str) -> str:
    return f"{_ranged(rng)} SELECT * FROM ({user_sql.replace('FROM events', 'FROM ev')}) q"


ORACLE_SQL: dict[str, str] = {
    "load_range": f"{_ranged(PART)} SELECT * FROM ev",
    "filter_exact": f"{_ranged(FULL, W_EXACT)} SELECT * FROM ev",
    "filter_substring": f"{_ranged(FULL, W_SUBSTRING)} SELECT * FROM ev",
    "filter_substring_wildcard": f"{_ranged(FULL, W_WILDCARD)} SELECT * FROM ev",
    "filter_regex": f"{_ranged(FULL, W_REGEX)} SELECT * FROM ev",
    "filter_combined": f"{_ranged(FULL, W_COMBINED)} SELECT * FROM ev",
    "total_count": f"{_ranged(FULL, W_COMBINED)} SELECT count(*) AS total FROM ev",
    "page_desc": f'{_ranged(FULL, W_EXACT)} SELECT * FROM ev ORDER BY "timestamp" DESC, uuid ASC LIMIT 100 OFFSET 200',
    "page_asc_nulls": f'{_ranged(FULL)} SELECT * FROM ev ORDER BY environmentName ASC NULLS LAST, "timestamp" DESC, uuid ASC LIMIT 70 OFFSET 8960',
    "page_filename_desc": f'{_ranged(FULL, W_SUBSTRING)} SELECT * FROM ev ORDER BY filename DESC NULLS LAST, "timestamp" DESC, uuid ASC LIMIT 100 OFFSET 100',
    "page_keyset": f'''{_ranged(FULL, W_EXACT)} SELECT * FROM ev
WHERE "timestamp" < 1705708800000000000 OR ("timestamp" = 1705708800000000000 AND uuid > '')
ORDER BY "timestamp" DESC, uuid ASC LIMIT 100''',
    "page_deep_seek": f'{_ranged(FULL)} SELECT * FROM ev ORDER BY "timestamp" DESC, uuid ASC LIMIT 100 OFFSET 7900',
    "page_deep_filename": f'{_ranged(FULL)} SELECT * FROM ev ORDER BY filename ASC NULLS LAST, "timestamp" DESC, uuid ASC LIMIT 100 OFFSET 5900',
    "page_deep_decimal": f"""{_ranged(FULL)}, amounts AS (
    SELECT uuid, "timestamp", CAST('98765432109876543.' || lpad(CAST(CAST(uuid AS BIGINT) * 7 % 8191 AS VARCHAR), 20, '0')
           AS DECIMAL(38,20)) AS amount FROM ev)
SELECT uuid, "timestamp", CAST(amount AS VARCHAR) AS amount FROM amounts
ORDER BY amounts.amount DESC, "timestamp" DESC, uuid ASC LIMIT 100 OFFSET 4900""",
    "page_last_env_asc": f"""{_ranged(FULL)}
SELECT uuid, "timestamp", filename, projectName, userId, username, environmentName, workspaceName, action FROM (
  SELECT *, row_number() OVER (ORDER BY environmentName ASC NULLS LAST, "timestamp" DESC, uuid ASC) AS rn,
         count(*) OVER () AS c FROM ev) x
WHERE rn > (greatest(1, CAST(ceil(c / 100) AS BIGINT)) - 1) * 100""",
    "page_info": _ranged(FULL, W_COMBINED) + PAGE_INFO.format(page=3, size=25),
    "page_info_clamped": _ranged(FULL, W_COMBINED) + PAGE_INFO.format(page=9999, size=25),
    "events_over_time_hour": _over_time(HOUR, "hour"),
    "events_over_time_day": _over_time(FULL, "day", "action IN ('click')"),
    "events_over_time_week": _over_time(WEEK, "week"),
    "events_over_time_month": _over_time(MONTH, "month", W_SUBSTRING),
    "top_values": f"""{_ranged(FULL)}, tot AS (SELECT {_label('workspaceName')} AS label, count(*) AS event_count FROM ev GROUP BY 1)
SELECT label, event_count, CAST(row_number() OVER (ORDER BY event_count DESC, label ASC) AS BIGINT) AS series_rank
FROM tot ORDER BY event_count DESC, label ASC LIMIT 10""",
    "distinct_labels": f"{_ranged(FULL)} SELECT count(DISTINCT {_label('workspaceName')}) AS distinct_labels FROM ev",
    "breakdown_day": _breakdown(FULL, "day", "action", "regexp_matches(environmentName, '^env[0-2]$')"),
    "breakdown_week_other": _breakdown(WEEK, "week", "workspaceName"),
    "breakdown_hour_users": _breakdown(HOUR, "hour", "username"),
    "column_values": _facets(FULL, {}),
    "column_values_prelimit": _facets(FULL, {}),
    "column_metadata": f"""{_ranged(FULL)},
v AS ({_facet_union({})}),
meta(column_name, data_type, label) AS (VALUES
  ('uuid', 'string', 'UUID'), ('filename', 'string', 'File Path'),
  ('projectName', 'string', 'Project Name'), ('userId', 'string', 'User ID'),
  ('username', 'string', 'User Name'), ('environmentName', 'string', 'Environment Name'),
  ('workspaceName', 'string', 'Workspace Name'), ('action', 'string', 'Event'))
SELECT v.column_name, meta.data_type, meta.label, v.value, v.value_rank
FROM v JOIN meta ON v.column_name = meta.column_name""",
    "facets_cascading": _facets(FULL, COMBINED_PARTS),
    "facet_counts": _facet_counts(FULL, COMBINED_PARTS),
    "value_search": f"""{_ranged(FULL)} SELECT * FROM ({_facet_branch('filename', {'action': "action IN ('click')"})}) s
WHERE lower(value) LIKE '%demofile4%'""",
    "table_view": f"""{_ranged(FULL, "action IN ('view')")}
SELECT strftime({T_EVENT}, '%m/%d/%Y, %H:%M:%S') AS "DATE & TIME (UTC)", username AS "USER NAME",
       action AS "EVENT", filename AS "FILE PATH", projectName AS "PROJECT NAME",
       workspaceName AS "WORKSPACE NAME", environmentName AS "ENVIRONMENT NAME"
FROM ev ORDER BY "timestamp" DESC, uuid ASC LIMIT 100""",
    "export_rows": f"{_ranged(FULL, W_COMBINED)} {EXPORT_SELECT}",
    "export_roundtrip_csv": f"""{_ranged(FULL, W_COMBINED)}
SELECT "Date & Time (UTC)", nullif("User Name", '') AS "User Name", nullif("Event", '') AS "Event",
       nullif("File Path", '') AS "File Path", nullif("Project Name", '') AS "Project Name",
       nullif("Workspace Name", '') AS "Workspace Name", nullif("Environment Name", '') AS "Environment Name"
FROM ({EXPORT_SELECT}) x""",
    "export_roundtrip_parquet": f"{_ranged(FULL, W_COMBINED)} {EXPORT_SELECT}",
    "sql_equality": _sql_mode(FULL, SQL_EQUALITY),
    "sql_group_count": _sql_mode(FULL, SQL_GROUP_COUNT),
    "sql_like_and": _sql_mode(FULL, SQL_LIKE_AND),
    "sql_regexp_matches": _sql_mode(FULL, SQL_REGEXP),
    "sql_chart": _over_time(FULL, "day", "action = 'click'"),
    "path_basename": f"{EVERY} SELECT uuid, coalesce(nullif(string_split(filename, '/')[-1], ''), filename) AS basename FROM ev",
    "ellipsis": f"{EVERY} SELECT uuid, CASE WHEN length(filename) > 30 THEN filename[1:30] || '...' ELSE filename END AS short_path FROM ev",
    "display_timestamp": f"{EVERY} SELECT uuid, strftime({T_EVENT}, '%m/%d/%Y, %H:%M:%S') AS display_time FROM ev",
    "refresh_time_text": f"{EVERY} SELECT uuid, strftime({T_EVENT}, '%b %-d, %Y - %-I:%M %p') AS time_text FROM ev",
    "camel_words": f"{EVERY} SELECT uuid, trim(regexp_replace(upper(action[1]) || action[2:] || environmentName, '([A-Z])', ' \\1', 'g')) AS words FROM ev",
    "refresh_incremental": f"{EVERY} SELECT * FROM ev",
    "refresh_status": f"{EVERY} SELECT 'Completed' AS status, count(*) AS reported_rows, count(*) AS table_rows FROM ev",
    "refresh_optional_columns": f"{EVERY} SELECT *, 'rev-' || userId AS environmentRevisionNumber FROM ev",
    "union_files": f"{_ranged(FULL)} SELECT * FROM ev",
    "sql_regexp_digits": _sql_mode(FULL, SQL_REGEXP_DIGITS),
    "sql_quoted_identifier": _sql_mode(FULL, SQL_QUOTED_NAME + "\n"),
    "sql_escaped_quote": _sql_mode(FULL, SQL_ESCAPED),
    "sql_order_nulls": _sql_mode(FULL, SQL_ORDER_NULLS),
    "sql_like_backslash": _sql_mode(FULL, SQL_LIKE_BACKSLASH),
    "sql_integer_division": _sql_mode(FULL, SQL_INTEGER_DIVISION),
    "sql_regexp_options": _sql_mode(FULL, SQL_REGEXP_OPTIONS),
    "filter_regex_unicode": f"""{_ranged(FULL)}, labelled AS (
    SELECT uuid, 'É' || upper(projectName) || ' été ' || filename AS label FROM ev)
SELECT * FROM labelled WHERE regexp_matches(label, '(?i)^éproj[12] ÉTÉ.*\\.PY$')""",
    "filter_regex_boundary": f"""{_ranged(FULL)}, labelled AS (
    SELECT uuid, 'É' || upper(projectName) || ' été ' || filename AS label FROM ev)
SELECT * FROM labelled WHERE regexp_matches(label, '\\bPROJ3\\b') OR regexp_matches(label, 'x{{,2}}')
   OR regexp_matches(label, '\\bt\\b.*demofile1\\d\\.')""",
    "sql_page_default_sort": f"""{_ranged(FULL, "action = 'click'")}
SELECT * FROM ev ORDER BY "timestamp" DESC, uuid ASC LIMIT 100 OFFSET 100""",
    "sql_page_request_sort": f"""{_ranged(FULL, "action = 'click'")}
SELECT * FROM ev ORDER BY filename ASC NULLS LAST, "timestamp" DESC, uuid ASC LIMIT 50 OFFSET 100""",
    "page_invalid_order": f"""{_ranged(FULL, W_EXACT)}
SELECT * FROM ev ORDER BY username DESC NULLS LAST, "timestamp" DESC, uuid ASC LIMIT 40""",
    "page_keyset_duplicates": f"""{_ranged(FULL, W_EXACT)}
SELECT * FROM (SELECT * FROM ev UNION ALL SELECT * FROM ev UNION ALL SELECT * FROM ev) x
ORDER BY "timestamp" DESC, uuid ASC LIMIT 50 OFFSET 150""",
    "export_roundtrip_csv_spaces": f"""{_ranged(FULL, W_COMBINED)}
SELECT "Date & Time (UTC)", nullif("User Name", '') AS "User Name", nullif("Event", '') AS "Event",
       ' ' || chr(9) || "File Path" || '  ' AS "File Path", nullif("Project Name", '') AS "Project Name",
       nullif("Workspace Name", '') AS "Workspace Name", nullif("Environment Name", '') AS "Environment Name"
FROM ({EXPORT_SELECT}) x""",
    "filter_regex_class": f"{_ranged(FULL, W_REGEX_CLASS)} SELECT * FROM ev",
    "breakdown_filename": _breakdown(FULL, "day", "filename"),
    "facet_panel_values": _facets(FULL, COMBINED_PARTS),
    "facet_panel_counts": _facet_counts(FULL, COMBINED_PARTS),
    "facet_counts_empty_column": _facet_counts(FULL, COMBINED_PARTS, empty=("hardwareTierId",)),
}
