"""Filter-mode and SQL-mode requests, shaped like the audited app's JSON bodies.

``run_request`` answers one request with a total, one page and one chart
DataFrame; the chart is an aggregate (bucket x series), never the filtered
rows themselves, and the total is read off that same aggregate.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlens.dataset import EventSet
from eventlens.operators.breakdown import breakdown_from_counts, series_counts
from eventlens.operators.filters import FilterSpec
from eventlens.operators.paging import PageResult, normalize_order, page_result
from eventlens.operators.timeseries import Spine, bucket_counts, over_time_from_counts
from eventlens.session import materialize
from eventlens.schema import TIME_COLUMN


@dataclass(frozen=True)
class QueryRequest:
    """A filter-mode or SQL-mode request (the app's JSON body, parsed)."""

    spec: FilterSpec = field(default_factory=FilterSpec)
    page: int = 1
    page_size: int | None = None
    sort_column: str | None = None  # None: the view's
    sort_order: str | None = None
    query: str = ""

    @classmethod
    def from_body(cls, body: Mapping | None) -> QueryRequest:
        body = body or {}
        return cls(
            spec=FilterSpec.from_request(body),
            page=int(body.get("page", 1) or 1),
            page_size=int(body["pageSize"]) if body.get("pageSize") else None,
            sort_column=body.get("sortColumn") or None,
            sort_order=normalize_order(body["sortOrder"]) if body.get("sortOrder") else None,
            query=body.get("query") or "",
        )


@dataclass(frozen=True)
class QueryResult:
    """The page and the chart answering a request (chart is ``None`` without time)."""

    page: PageResult
    chart: DataFrame | None


def run_request(
    events: EventSet,
    request: QueryRequest,
    chart_field: str | None = None,
    unit: str | None = None,
    top_n: int | None = None,
) -> QueryResult:
    """Answer a request: SQL mode when ``query`` is set, filter mode otherwise.

    In filter mode the chart's counts (stored, at most a row for each bucket
    and series) give the total too; the page is one ``TakeOrderedAndProject``.
    No other rows leave the executors.
    """
    top_n = events.view.top_n if top_n is None else top_n
    if request.query:
        page = events.sql_page(request.query, request.page, request.page_size, request.sort_column, request.sort_order)
        return QueryResult(page, sql_chart(events, request.query, chart_field, unit, top_n))
    rows = events.filtered(request.spec)
    spine = Spine.for_range(events.start, events.end, unit)
    if chart_field:
        counts = series_counts(rows, chart_field, spine, top_n)
        chart = breakdown_from_counts(counts, spine, top_n)
    else:
        counts = materialize(bucket_counts(rows, spine))
        chart = over_time_from_counts(counts, spine)
    total = counts.agg(F.sum("event_count")).first()[0] or 0
    page = page_result(rows, total, request.page, request.page_size or events.view.page_size,
                       *events.order(request.sort_column, request.sort_order), (events.lo_ns, events.hi_ns))
    return QueryResult(page, chart)


def sql_chart(
    events: EventSet,
    query: str,
    chart_field: str | None = None,
    unit: str | None = None,
    top_n: int | None = None,
) -> DataFrame | None:
    """SQL results chart like filter results when they carry the int64 ns
    ``timestamp`` column (a breakdown when ``chart_field`` is a result column);
    ``None`` otherwise, since there is no time to bucket."""
    top_n = events.view.top_n if top_n is None else top_n
    df = events.sql(query)
    if dict(df.dtypes).get(TIME_COLUMN) != "bigint":
        return None
    spine = Spine.for_range(events.start, events.end, unit)
    if chart_field and chart_field in df.columns:
        return breakdown_from_counts(series_counts(df, chart_field, spine, top_n), spine, top_n)
    return over_time_from_counts(bucket_counts(df, spine), spine)
