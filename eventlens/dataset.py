"""``EventSet``: audit events of one date range, and every question asked of them.

An ``EventSet`` is immutable and lazy: it holds the range-filtered
DataFrame (the range predicate sits on the physical time column, so it
reaches the Parquet scan) and hands out DataFrames. Only bounded results
(a count, a page) are ever brought to the driver by this class.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from eventlens.functions.time import range_bounds_ns
from eventlens.operators import breakdown as _breakdown
from eventlens.operators import facets as _facets
from eventlens.operators import paging as _paging
from eventlens.operators import projection as _projection
from eventlens.operators import timeseries as _timeseries
from eventlens.operators.filters import FilterSpec, apply_filters
from eventlens.plans.sql import has_order_by, sql_frame
from eventlens.schema import DEFAULT_VIEW, ViewConfig
from eventlens.sources import sinks
from eventlens.sources.parquet import EventSource, column_metadata, frame_source, parquet_source
from eventlens.session import ensure_conf, scratch_path


class EventSet:
    """Audit events of one date range (closed: ``[start, end + 1 day]``), as lazy DataFrames."""

    def __init__(self, source: EventSource, start, end, view: ViewConfig = DEFAULT_VIEW):
        if start is None or end is None:
            raise ValueError("start and end dates are required")
        ensure_conf(source.frame.sparkSession)
        self.source = source
        self.view = view
        self.start = start
        self.end = end
        self.lo_ns, self.hi_ns = range_bounds_ns(start, end)
        self.rows: DataFrame = source.in_range(self.lo_ns, self.hi_ns)

    def __repr__(self) -> str:
        return f"EventSet({self.start} .. {self.end}, columns={self.columns})"

    # -- construction (S1, S2, S4) -------------------------------------------

    @classmethod
    def load(cls, spark: SparkSession, paths, start, end, merge_schema: bool = False,
             view: ViewConfig = DEFAULT_VIEW) -> EventSet:
        """Events from canonical Parquet files or folders (one relation)."""
        return cls(parquet_source(spark, paths, merge_schema), start, end, view)

    @classmethod
    def from_frame(cls, frame: DataFrame, start, end, time_column: str = "timestamp",
                   view: ViewConfig = DEFAULT_VIEW) -> EventSet:
        """Events from any DataFrame with the canonical columns."""
        return cls(frame_source(frame, time_column), start, end, view)

    def persist(self, storage_level: StorageLevel = StorageLevel.MEMORY_AND_DISK) -> EventSet:
        """Cache the range rows for repeated requests (count, page, chart, facets).

        Lost blocks are recomputed from lineage. Worth it when the range fits
        the cluster's memory and disk; call :meth:`unpersist` when done.
        """
        self.rows.persist(storage_level)
        return self

    def unpersist(self) -> None:
        self.rows.unpersist()

    @property
    def spark(self) -> SparkSession:
        return self.rows.sparkSession

    @property
    def columns(self) -> list[str]:
        return self.rows.columns

    def column_metadata(self) -> list[dict]:
        return column_metadata(self.rows, self.view.labels)

    # -- filter mode (P*, A1, O*) ----------------------------------------------

    def filtered(self, spec: FilterSpec | None = None) -> DataFrame:
        """The range's rows passing ``spec`` (lazy)."""
        return apply_filters(self.rows, spec)

    def total(self, spec: FilterSpec | None = None) -> int:
        """Number of rows passing ``spec`` (one job)."""
        return self.filtered(spec).count()

    def page(
        self,
        spec: FilterSpec | None = None,
        page: int = 1,
        page_size: int | None = None,
        sort_column: str | None = None,
        sort_order: str | None = None,
    ) -> _paging.PageResult:
        """Total + one page (deep pages use the seek strategies)."""
        return _paging.fetch_page(self.filtered(spec), page, page_size or self.view.page_size,
                                  *self.order(sort_column, sort_order), (self.lo_ns, self.hi_ns))

    def order(self, sort_column: str | None, sort_order: str | None) -> tuple[str, str]:
        """The sort asked for, with the view's defaults where it says nothing."""
        return sort_column or self.view.sort_column, sort_order or self.view.sort_order

    def page_after(
        self,
        last: dict | None,
        spec: FilterSpec | None = None,
        page_size: int | None = None,
        sort_column: str | None = None,
        sort_order: str | None = None,
        seen: int = 0,
    ) -> DataFrame:
        """Keyset paging: the rows after ``last`` (previous page's last row), of
        whose equals ``seen`` have been shown (see ``paging.next_cursor``)."""
        return _paging.page_after(self.filtered(spec), last, page_size or self.view.page_size,
                                  *self.order(sort_column, sort_order), seen=seen)

    # -- charts (A2-A6) ----------------------------------------------------------

    def events_over_time(self, spec: FilterSpec | None = None, unit: str | None = None) -> DataFrame:
        """Zero-filled counts per bucket (width from the range unless ``unit``)."""
        return _timeseries.events_over_time(self.filtered(spec), self.start, self.end, unit)

    def breakdown(
        self,
        field: str,
        spec: FilterSpec | None = None,
        unit: str | None = None,
        top_n: int | None = None,
    ) -> DataFrame:
        """Top-N + "Other" series over time; aggregates now, see
        :func:`eventlens.operators.breakdown.breakdown`."""
        top_n = self.view.top_n if top_n is None else top_n
        return _breakdown.breakdown(self.filtered(spec), field, self.start, self.end, unit, top_n)

    def top_values(self, field: str, spec: FilterSpec | None = None, n: int | None = None) -> DataFrame:
        """The ``n`` most frequent labels of ``field``."""
        return _breakdown.top_values(self.filtered(spec), field, self.view.top_n if n is None else n)

    # -- facets (A7-A9, P11) -----------------------------------------------------
    #
    # Default targets are the filter panel's columns (``view.filterable``:
    # action, username, projectName, filename when present); pass
    # ``columns=`` for others. Unique ids (uuid, deduplicationId) are left out
    # by default because their distinct values would dominate the shuffle.

    def facet_columns(self, columns: Sequence[str] | None = None) -> list[str]:
        """Facet targets: ``columns`` if given, else the filter panel's columns."""
        if columns is not None:
            return list(columns)
        return self.view.filterable(self.columns) or _facets.target_columns(self.rows, None)

    def column_values(self, columns: Sequence[str] | None = None, cap: int | None = None,
                      prelimit: bool = False) -> DataFrame:
        """Each column's first distinct values (no filters), as many as the view's cap."""
        return _facets.column_values(self.rows, self.facet_columns(columns), cap or self.view.facet_cap, prelimit)

    def facets(
        self, spec: FilterSpec | None = None, columns: Sequence[str] | None = None, cap: int | None = None,
        prelimit: bool = False,
    ) -> DataFrame:
        """Cascading facet values; ``prelimit=True`` for high-cardinality columns
        (per-task cut before the shuffle, same result)."""
        cap = cap or self.view.facet_cap
        return _facets.facet_values(self.rows, spec, self.facet_columns(columns), cap, prelimit=prelimit)

    def facet_counts(self, spec: FilterSpec | None = None, columns: Sequence[str] | None = None,
                     approx: bool = False) -> DataFrame:
        """Available vs total distinct values per column, with the panel label."""
        return _facets.facet_counts(self.rows, spec, self.facet_columns(columns), self.view.facet_cap, approx=approx)

    def facet_panel(self, spec: FilterSpec | None = None, columns: Sequence[str] | None = None,
                    cap: int | None = None, approx: bool = False) -> _facets.FacetPanel:
        """Cascading values and "(a of m)" counts together
        (``approx=True``: exact values via the per-task cut, estimated counts)."""
        cap = cap or self.view.facet_cap
        return _facets.facet_panel(self.rows, spec, self.facet_columns(columns), cap, approx=approx)

    def value_search(self, column: str, term: str, spec: FilterSpec | None = None) -> DataFrame:
        """Facet values of ``column`` containing ``term`` (case-insensitive)."""
        return _facets.value_search(self.rows, column, term, spec, self.view.facet_cap)

    # -- display and export (J*, K*) -----------------------------------------

    def table_view(self, spec: FilterSpec | None = None, page: int = 1, page_size: int | None = None,
                   sort_column: str | None = None, sort_order: str | None = None) -> DataFrame:
        """One page, projected for display (titles, display time, hidden columns out)."""
        rows = _paging.page_rows(self.filtered(spec), page, page_size or self.view.page_size,
                                 *self.order(sort_column, sort_order))
        return _projection.table_view(rows, self.view)

    def export_frame(self, spec: FilterSpec | None = None) -> DataFrame:
        """Rows passing ``spec`` as exported: ISO time, hidden columns out, labelled."""
        return _projection.export_frame(self.filtered(spec), self.view)

    def export_csv(self, spec: FilterSpec | None = None, path: str | None = None, single_file: bool = False) -> str:
        """Write the export as a CSV folder (default: a new path in the shared folder)."""
        path = path or sinks.export_path(scratch_path(self.spark, "exports"), "csv")
        return sinks.write_csv(self.export_frame(spec), path, single_file)

    def export_parquet(self, spec: FilterSpec | None = None, path: str | None = None, single_file: bool = False) -> str:
        """Write the export as a Parquet folder (default: a new path in the shared folder)."""
        path = path or sinks.export_path(scratch_path(self.spark, "exports"), "parquet")
        return sinks.write_parquet(self.export_frame(spec), path, single_file)

    # -- SQL mode (Q1-Q5) ----------------------------------------------------------

    def sql(self, text: str, raw: bool = False) -> DataFrame:
        """``text`` over ``events`` = this range's rows (or every row with ``raw=True``)."""
        return sql_frame(self.source.canonical() if raw else self.rows, text)

    def sql_page(
        self,
        text: str,
        page: int = 1,
        page_size: int | None = None,
        sort_column: str | None = None,
        sort_order: str | None = None,
        raw: bool = False,
    ) -> _paging.PageResult:
        """Count and page a SQL result.

        A query with its own ORDER BY keeps it. Others are sorted by
        ``sort_column``, or the view's default, if the result has it (newest
        first by default), else by all their columns, so that pages agree.
        """
        page_size = page_size or self.view.page_size
        df = self.sql(text, raw)
        total = df.count()
        column = sort_column or self.view.sort_column
        if not has_order_by(text):
            if column not in df.columns:
                column = _paging.sortable_columns(df)[0] if _paging.sortable_columns(df) else None
                sort_order = "ASC"
            if column is not None:
                # Deep pages get the same far-end / seek strategies as filter mode.
                order = sort_order or self.view.sort_order
                return _paging.page_result(df, total, page, page_size, column, order)
        page = _paging.clamp_page(total, page, page_size)
        start, end = _paging.page_bounds(total, page, page_size)
        offset = (page - 1) * page_size
        rows = (df.offset(offset) if offset else df).limit(page_size)
        return _paging.PageResult(total, page, page_size, start, end, rows)
