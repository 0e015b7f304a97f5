"""Time functions: nanosecond epochs, ISO strings, chart buckets and spines.

Event time is an int64 count of nanoseconds since the Unix epoch (UTC).
Predicates stay on that raw column so Parquet min/max statistics can skip
row groups; calendar work happens on ``timestamp_micros(ns div 1000)``.
"""

from __future__ import annotations

from datetime import date, datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import (
    DataType,
    DateType,
    IntegralType,
    TimestampNTZType,
    TimestampType,
)

from eventlens.schema import BUCKET_LABEL_FORMATS, BUCKET_MAX_DAYS

NS_PER_US = 1_000
NS_PER_DAY = 86_400 * 1_000_000_000
EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)

BUCKET_UNITS = ("hour", "day", "week", "month")

_SPINE_STEP = {
    "hour": "INTERVAL 1 HOUR",
    "day": "INTERVAL 1 DAY",
    "week": "INTERVAL 7 DAYS",
    "month": "INTERVAL 1 MONTH",
}


# --------------------------------------------------------------------------
# Plan-time (driver) arithmetic on the requested range: F2, F3, F4, F6, F7.
# --------------------------------------------------------------------------


def parse_instant(value: str | date | datetime) -> datetime:
    """ISO date or date-time -> aware UTC datetime. Naive values are UTC."""
    if isinstance(value, datetime):
        dt = value
    elif isinstance(value, date):
        dt = datetime(value.year, value.month, value.day)
    else:
        text = str(value).strip()
        if not text:
            raise ValueError("empty date")
        if text.endswith("Z"):
            text = text[:-1] + "+00:00"
        dt = datetime.fromisoformat(text)
    if dt.tzinfo is None:
        dt = dt.replace(tzinfo=timezone.utc)
    return dt.astimezone(timezone.utc)


def epoch_ns(dt: datetime) -> int:
    """Exact integer nanoseconds since the epoch (no float rounding)."""
    delta = parse_instant(dt) - EPOCH
    return (delta.days * 86_400 + delta.seconds) * 1_000_000_000 + delta.microseconds * 1_000


def range_bounds_ns(start, end) -> tuple[int, int]:
    """Closed nanosecond interval for a date range: [start, end + 1 day].

    The upper bound is inclusive, so the instant 00:00:00.000000000 of the
    day after ``end`` is part of the range.
    """
    lo = epoch_ns(parse_instant(start))
    hi = epoch_ns(parse_instant(end) + timedelta(days=1))
    if hi < lo:
        raise ValueError(f"range end {end!r} is before start {start!r}")
    return lo, hi


def default_range(today: date | None = None, days: int = 7) -> tuple[str, str]:
    """The picker's default: the last ``days`` days through today (UTC), as ISO dates."""
    today = today or datetime.now(timezone.utc).date()
    return (today - timedelta(days=days)).isoformat(), today.isoformat()


def auto_bucket(start, end) -> str:
    """Bucket width from the range length in whole days."""
    if start is None or end is None:
        return "day"
    days = int((parse_instant(end) - parse_instant(start)) / timedelta(days=1))
    for unit in ("hour", "day", "week"):
        if days <= BUCKET_MAX_DAYS[unit]:
            return unit
    return "month"


def _day_floor(dt: datetime) -> datetime:
    return dt.replace(hour=0, minute=0, second=0, microsecond=0)


def bucket_floor(dt: datetime, unit: str) -> datetime:
    """Start of the bucket holding ``dt`` (UTC); weeks start on Sunday."""
    dt = parse_instant(dt)
    if unit == "hour":
        return dt.replace(minute=0, second=0, microsecond=0)
    if unit == "day":
        return _day_floor(dt)
    if unit == "week":
        day = _day_floor(dt)
        return day - timedelta(days=(day.weekday() + 1) % 7)
    if unit == "month":
        return _day_floor(dt).replace(day=1)
    raise ValueError(f"unknown bucket unit {unit!r}; expected one of {BUCKET_UNITS}")


def spine_bounds(start, end, unit: str) -> tuple[datetime, datetime, int]:
    """First and last bucket start of the chart axis, and the bucket count.

    The axis runs from the start day's first bucket through the bucket
    holding the last moment of the end day.
    """
    s = _day_floor(parse_instant(start))
    e = _day_floor(parse_instant(end))
    first = bucket_floor(s, unit)
    last = bucket_floor(e + timedelta(hours=23), unit)
    if last < first:
        raise ValueError("range end is before start")
    if unit == "hour":
        n = int((last - first) / timedelta(hours=1)) + 1
    elif unit == "day":
        n = (last - first).days + 1
    elif unit == "week":
        n = (last - first).days // 7 + 1
    else:
        n = (last.year - first.year) * 12 + (last.month - first.month) + 1
    return first, last, n


def spine_sequence(first: datetime, last: datetime, unit: str) -> Column:
    """Array of bucket starts from ``first`` to ``last`` (a generator input)."""
    return F.sequence(F.lit(first), F.lit(last), F.expr(_SPINE_STEP[unit]))


# --------------------------------------------------------------------------
# Column expressions: F1, F5 and typed range predicates for P1.
# --------------------------------------------------------------------------


def ns_to_micros(ns: str) -> Column:
    """Floor division of an int64 ns column to microseconds (exact, integer ``div``)."""
    q = f"`{ns}`"
    return F.expr(f"({q} - pmod({q}, {NS_PER_US})) div {NS_PER_US}")


def event_time(ns: str = "timestamp") -> Column:
    """int64 ns epoch column -> Spark TIMESTAMP (microsecond precision, UTC)."""
    return F.timestamp_micros(ns_to_micros(ns))


def iso_string(ns: str = "timestamp") -> Column:
    """ns epoch -> ``YYYY-MM-DDTHH:MM:SS[.ffffff]`` (fraction only when non-zero)."""
    t = event_time(ns)
    micros = F.pmod(ns_to_micros(ns), F.lit(1_000_000))
    fraction = F.when(micros != 0, F.concat(F.lit("."), F.lpad(micros.cast("string"), 6, "0")))
    return F.concat(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss"), F.coalesce(fraction, F.lit("")))


def bucket_start(t: Column, unit: str) -> Column:
    """Start of the bucket (TIMESTAMP) holding event time ``t``."""
    if unit in ("hour", "day", "month"):
        return F.date_trunc(unit, t)
    if unit == "week":
        d = F.to_date(t)
        return F.date_sub(d, F.dayofweek(d) - 1).cast("timestamp")
    raise ValueError(f"unknown bucket unit {unit!r}; expected one of {BUCKET_UNITS}")


def bucket_label(start: Column, unit: str) -> Column:
    """Display key of a bucket start."""
    return F.date_format(start, BUCKET_LABEL_FORMATS[unit])


def _ntz_literal(micros: int) -> Column:
    text = (datetime(1970, 1, 1) + timedelta(microseconds=micros)).isoformat(sep=" ")
    return F.lit(text).cast("timestamp_ntz")


def ns_range_predicate(column: str, dtype: DataType, lo_ns: int, hi_ns: int) -> Column:
    """``lo_ns <= time <= hi_ns`` written on the *physical* column so it pushes down.

    int64 columns hold ns already; TIMESTAMP / TIMESTAMP_NTZ columns hold
    microseconds, so the bounds are rounded inward (exact for ``us * 1000``).
    """
    c = F.col(column)
    if isinstance(dtype, IntegralType):
        return (c >= F.lit(lo_ns)) & (c <= F.lit(hi_ns))
    lo_us = -((-lo_ns) // NS_PER_US)
    hi_us = hi_ns // NS_PER_US
    if isinstance(dtype, TimestampNTZType):
        return (c >= _ntz_literal(lo_us)) & (c <= _ntz_literal(hi_us))
    if isinstance(dtype, TimestampType):
        return (c >= F.timestamp_micros(F.lit(lo_us))) & (c <= F.timestamp_micros(F.lit(hi_us)))
    if isinstance(dtype, DateType):
        # A day column (e.g. a date partition) can only be narrowed to the
        # days touching the range: a superset filter, exact one stays on time.
        lo_day = lo_ns // NS_PER_DAY
        hi_day = hi_ns // NS_PER_DAY
        return (c >= F.date_from_unix_date(F.lit(lo_day))) & (
            c <= F.date_from_unix_date(F.lit(hi_day))
        )
    raise TypeError(f"column {column!r} of type {dtype.simpleString()} is not a time column")


def ns_from_physical(column: str, dtype: DataType) -> Column:
    """Physical time column -> canonical int64 ns (exact for micro timestamps)."""
    c = F.col(column)
    if isinstance(dtype, IntegralType):
        return c.cast("long")
    if isinstance(dtype, TimestampNTZType):
        return F.expr(
            f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{column}`)"
        ) * F.lit(NS_PER_US)
    if isinstance(dtype, TimestampType):
        return F.unix_micros(c) * F.lit(NS_PER_US)
    raise TypeError(f"column {column!r} of type {dtype.simpleString()} is not a time column")
