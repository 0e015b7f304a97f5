"""Projections for display and export.

All of these are narrow: a ``select`` over the filtered rows, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from eventlens.functions.text import column_label, display_timestamp, title_label
from eventlens.functions.time import iso_string
from eventlens.operators.filters import qcol
from eventlens.schema import DEFAULT_VIEW, HIDDEN_COLUMNS, TABLE_COLUMN_ORDER, TIME_COLUMN, ViewConfig


def drop_hidden(df: DataFrame, hidden=HIDDEN_COLUMNS) -> DataFrame:
    """Remove hidden columns that exist (missing names are ignored)."""
    return df.drop(*[c for c in hidden if c in df.columns])


def ordered_columns(columns: list[str], order=TABLE_COLUMN_ORDER) -> list[str]:
    """Preferred order first, then the remaining columns in their own order."""
    head = [c for c in order if c in columns]
    return head + [c for c in columns if c not in order]


def table_columns(columns: list[str], order=TABLE_COLUMN_ORDER, hidden=HIDDEN_COLUMNS) -> list[str]:
    """Visible table columns: preferred order present, then others not hidden."""
    head = [c for c in order if c in columns]
    return head + [c for c in columns if c not in order and c not in hidden]


def export_frame(rows: DataFrame, view: ViewConfig = DEFAULT_VIEW) -> DataFrame:
    """Export projection: ISO time text, hidden columns dropped, reordered, labelled."""
    labels = view.labels
    df = drop_hidden(rows, view.hidden_columns)
    cols = ordered_columns(df.columns, view.column_order)
    return df.select(
        *[
            (iso_string(c) if c == TIME_COLUMN else qcol(c)).alias(labels.get(c, c))
            for c in cols
        ]
    )


def table_view(rows: DataFrame, view: ViewConfig = DEFAULT_VIEW) -> DataFrame:
    """Display projection of (usually one page of) rows: upper-cased titles, display time."""
    cols = table_columns(rows.columns, view.column_order, view.hidden_columns)
    return rows.select(
        *[
            (display_timestamp(c) if c == TIME_COLUMN else qcol(c)).alias(title_label(c, view.labels))
            for c in cols
        ]
    )


def labelled(rows: DataFrame, labels: dict[str, str] | None = None) -> DataFrame:
    """Rename every column to its human label (unknown names kept)."""
    return rows.select(*[qcol(c).alias(column_label(c, labels)) for c in rows.columns])
