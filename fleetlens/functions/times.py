"""Column helpers for time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def seconds_of(ts: Column | str) -> Column:
    """Seconds since 1970 of a timestamp with or without zone, fractions dropped."""
    return F.unix_timestamp(F.date_trunc("second", col(ts)).cast("timestamp"))


def boundary_diff(unit: str, start: Column | str, end: Column | str) -> Column:
    """Boundaries of the unit (second, minute, hour, day) crossed from start to end."""
    size = _SECONDS[unit]
    return (F.floor(seconds_of(end) / size) - F.floor(seconds_of(start) / size)).cast("long")


def millis_between(start: Column | str, end: Column | str) -> Column:
    return F.unix_millis(col(end).cast("timestamp")) - F.unix_millis(col(start).cast("timestamp"))


def duration_text(ms: Column | str) -> Column:
    """[Nd ]hh:mm:ss.mmm; null counts as 0."""
    x = F.coalesce(col(ms), F.lit(0)).cast("long")
    days = F.floor(x / 86_400_000).cast("long")
    clock = F.format_string("%02d:%02d:%02d.%03d", F.floor(x / 3_600_000) % 24, F.floor(x / 60_000) % 60, F.floor(x / 1000) % 60, x % 1000)
    return F.when(days > 0, F.concat(days.cast("string"), F.lit("d "), clock)).otherwise(clock)


def hms_text(seconds: Column | str) -> Column:
    """Seconds as 02h 03m 04s, hours as long as needed."""
    s = col(seconds).cast("long")
    return F.format_string("%02dh %02dm %02ds", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)


def packed_seconds(packed: Column | str) -> Column:
    """A duration packed as hhmmss, hours of any length, in seconds."""
    p = col(packed).cast("long")
    return (F.floor(p / 10_000) * 3600 + F.floor(p / 100) % 100 * 60 + p % 100).cast("long")


def packed_timestamp(day: Column | str, clock: Column | str) -> Column:
    """A timestamp out of yyyymmdd and hhmmss; null where day is 0 or null."""
    d, t = col(day).cast("int"), F.coalesce(col(clock), F.lit(0)).cast("int")
    made = F.make_timestamp_ntz(F.floor(d / 10_000).cast("int"), F.floor(d / 100).cast("int") % 100, d % 100, F.floor(t / 10_000).cast("int"), F.floor(t / 100).cast("int") % 100, (t % 100).cast("int"))
    return F.when(d > 0, made)


def day_age(ts: Column | str, as_of: str) -> Column:
    return F.datediff(F.to_date(F.lit(as_of)), F.to_date(col(ts)))


def to_utc(ts: Column | str, offset_hours: Column | int) -> Column:
    """A local time shifted by its source's offset (local minus UTC, in hours)."""
    hours = offset_hours if isinstance(offset_hours, Column) else F.lit(offset_hours)
    return col(ts) - F.make_dt_interval(F.lit(0), hours.cast("int"))
