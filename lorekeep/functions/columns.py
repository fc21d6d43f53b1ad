"""Derived columns of memories. Times are TIMESTAMP_NTZ in UTC, and "now" is always an argument."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The clock of all registered queries.
AS_OF = dt.datetime(2024, 3, 1)


def instant(value: dt.datetime | str | Column) -> Column:
    """A literal time; strings are parsed as UTC."""
    if isinstance(value, Column):
        return value
    if isinstance(value, dt.datetime):
        if value.tzinfo:
            value = value.astimezone(dt.UTC).replace(tzinfo=None)
        value = value.isoformat(sep=" ")
    return F.lit(value).cast("timestamp_ntz")


def seconds_between(start: Column, end: Column) -> Column:
    """Whole seconds from ``start`` to ``end``."""
    return F.timestamp_diff("SECOND", start, end)


def shift_seconds(ts: Column, seconds: Column | int) -> Column:
    seconds = seconds if isinstance(seconds, Column) else F.lit(seconds)
    return F.timestamp_add("SECOND", seconds, ts).cast("timestamp_ntz")


def epoch(ts: Column) -> Column:
    """Seconds since 1970."""
    return seconds_between(instant("1970-01-01 00:00:00"), ts)


def clamp_unit(x: Column) -> Column:
    """To [0, 1]; not-a-number and null become 0."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.nanvl(x, F.lit(0.0)), F.lit(0.0))))


def is_expired(created: Column, ttl: Column, now: Column) -> Column:
    """Older than its time to live (strictly); never without one, nor before it exists."""
    return F.coalesce(seconds_between(created, now) > ttl, F.lit(False))


def time_remaining(created: Column, ttl: Column, now: Column) -> Column:
    """Seconds until expiry, at least 0; null without a time to live."""
    return F.when(ttl.isNotNull(), F.greatest(ttl - seconds_between(created, now), F.lit(0)))


def label(content: Column, most: int = 30) -> Column:
    """Content of at most ``most`` characters; longer ones end in three dots."""
    return F.when(F.char_length(content) > most, F.concat(F.substring(content, 1, most - 3), F.lit("..."))).otherwise(content)


def preview(content: Column) -> Column:
    return F.concat(F.substring(content, 1, 50), F.lit("..."))


def tenth(x: Column) -> Column:
    """The bucket of a value in [0, 1]."""
    return F.floor(x * 10)


def access_bucket(count: Column) -> Column:
    return F.least(F.floor(count / 10), F.lit(10))


def time_keys(ts: Column) -> dict[str, Column]:
    """year, month (yyyymm), day (yyyymmdd) and hour of the day."""
    year, month, day = F.year(ts), F.month(ts), F.dayofmonth(ts)
    return {"year": year, "month": year * 100 + month, "day": year * 10000 + month * 100 + day, "hour": F.hour(ts)}
