"""Display and label functions over columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StringType

from eventlens.functions.time import event_time
from eventlens.schema import (
    COLUMN_LABELS,
    DISPLAY_TIME_FORMAT,
    ELLIPSIS_AT,
    REFRESH_TIME_FORMAT,
    UNKNOWN_LABEL,
)


def series_label(c: Column, dtype: DataType) -> Column:
    """Chart label of a value: strings null or '' -> 'Unknown'; others null -> 'Unknown'."""
    if isinstance(dtype, StringType):
        return F.when(c.isNull() | (c == F.lit("")), F.lit(UNKNOWN_LABEL)).otherwise(c)
    return F.coalesce(c.cast("string"), F.lit(UNKNOWN_LABEL))


def basename(path: Column) -> Column:
    """Last ``/`` segment of a path, or the whole path when that segment is empty."""
    return F.coalesce(F.nullif(F.element_at(F.split(path, "/"), -1), F.lit("")), path)


def ellipsis(c: Column, width: int = ELLIPSIS_AT) -> Column:
    """Strings longer than ``width`` -> first ``width`` characters + '...'."""
    return F.when(F.length(c) > width, F.concat(F.substring(c, 1, width), F.lit("..."))).otherwise(c)


def camel_words(c: Column) -> Column:
    """``InProgress`` -> ``In Progress``: a space before each capital, then trim."""
    return F.trim(F.regexp_replace(c, "([A-Z])", " $1"))


def display_timestamp(ns: str = "timestamp") -> Column:
    """Table cell text of an ns epoch: ``MM/DD/YYYY, HH:mm:ss`` (UTC)."""
    return F.date_format(event_time(ns), DISPLAY_TIME_FORMAT)


def refresh_timestamp(t: Column) -> Column:
    """Refresh banner text of a TIMESTAMP: ``MMM D, YYYY - h:mm AM/PM`` (UTC)."""
    return F.date_format(t, REFRESH_TIME_FORMAT)


def refresh_text(dt) -> str:
    """Driver-side twin of :func:`refresh_timestamp` for one status time."""
    hour = dt.hour % 12 or 12
    return f"{dt:%b} {dt.day}, {dt.year} - {hour}:{dt:%M} {'AM' if dt.hour < 12 else 'PM'}"


def camel_words_text(name: str) -> str:
    """Driver-side twin of :func:`camel_words` for column names."""
    return re.sub(r"([A-Z])", r" \1", name).strip()


def column_label(name: str, labels: dict[str, str] | None = None) -> str:
    """Human label: given map, then the built-in map, then split camelCase."""
    if labels and labels.get(name):
        return labels[name]
    return COLUMN_LABELS.get(name) or camel_words_text(name)


def title_label(name: str, labels: dict[str, str] | None = None) -> str:
    """Table header: the label upper-cased."""
    return column_label(name, labels).upper()
