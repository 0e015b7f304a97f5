"""eventlens: audit-event analytics on Spark DataFrames.

Load Parquet events for a date range, filter them (exact / substring /
regex), page them, chart them (zero-filled buckets, top-N + "Other"),
facet them (cascading, one scan), query them with SQL, export them, and
refresh them incrementally with Structured Streaming.
"""

from eventlens.dataset import EventSet
from eventlens.operators.facets import FacetPanel
from eventlens.operators.filters import FilterSpec
from eventlens.operators.paging import PageResult
from eventlens.plans.request import QueryRequest, QueryResult, run_request
from eventlens.schema import DEFAULT_VIEW, ViewConfig
from eventlens.session import build_session, ensure_conf
from eventlens.streaming.refresh import RefreshStatus, refresh, start_refresh, status_of

__version__ = "0.1.0"

__all__ = [
    "DEFAULT_VIEW",
    "EventSet",
    "FacetPanel",
    "FilterSpec",
    "PageResult",
    "QueryRequest",
    "QueryResult",
    "RefreshStatus",
    "ViewConfig",
    "build_session",
    "ensure_conf",
    "refresh",
    "run_request",
    "start_refresh",
    "status_of",
]
