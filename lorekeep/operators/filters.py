"""Predicates on memories: DataFrame in, DataFrame out. Each is one ``where``, which Spark pushes down.

``bucketed=True`` compares tenths (or tens of accesses) instead of exact values, as a bucketed index does.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.functions.columns import access_bucket, instant, seconds_between, tenth
from lorekeep.functions.metadata import has_key, has_value

When = dt.datetime | str | Column


def by_source(memories: DataFrame, source: str) -> DataFrame:
    return memories.where(F.col("source") == source)


def _at_least(memories: DataFrame, column: str, least: float, bucketed: bool) -> DataFrame:
    value = F.col(column)
    return memories.where(tenth(value) >= tenth(F.lit(least)) if bucketed else value >= least)


def min_confidence(memories: DataFrame, least: float, bucketed: bool = False) -> DataFrame:
    return _at_least(memories, "confidence", least, bucketed)


def min_importance(memories: DataFrame, least: float, bucketed: bool = False) -> DataFrame:
    return _at_least(memories, "importance", least, bucketed)


def min_access(memories: DataFrame, least: int, bucketed: bool = False) -> DataFrame:
    count = F.col("access_count")
    return memories.where(access_bucket(count) >= access_bucket(F.lit(least)) if bucketed else count >= least)


def accessed_since(memories: DataFrame, when: When) -> DataFrame:
    return memories.where(F.col("last_accessed") >= instant(when))


def before(memories: DataFrame, when: When) -> DataFrame:
    return memories.where(F.col("timestamp") < instant(when))


def after(memories: DataFrame, when: When) -> DataFrame:
    return memories.where(F.col("timestamp") > instant(when))


def between(memories: DataFrame, start: When, end: When, inclusive: bool = True) -> DataFrame:
    if inclusive:
        return memories.where(F.col("timestamp").between(instant(start), instant(end)))
    return before(after(memories, start), end)


def _period(memories: DataFrame, start: dt.datetime, end: dt.datetime) -> DataFrame:
    """A half-open range of times: unlike year(ts) = y it can be pushed down to files."""
    return memories.where((F.col("timestamp") >= instant(start)) & (F.col("timestamp") < instant(end)))


def by_year(memories: DataFrame, year: int) -> DataFrame:
    return _period(memories, dt.datetime(year, 1, 1), dt.datetime(year + 1, 1, 1))


def by_month(memories: DataFrame, year: int, month: int) -> DataFrame:
    return _period(memories, dt.datetime(year, month, 1), dt.datetime(year + month // 12, month % 12 + 1, 1))


def by_day(memories: DataFrame, year: int, month: int, day: int) -> DataFrame:
    start = dt.datetime(year, month, day)
    return _period(memories, start, start + dt.timedelta(days=1))


def by_hour(memories: DataFrame, hour: int) -> DataFrame:
    """By hour of the day; hours beyond 23 have no memories."""
    return memories.where(F.hour("timestamp") == hour)


def with_key(memories: DataFrame, key: str) -> DataFrame:
    return memories.where(has_key(F.col("metadata"), key))


def with_value(memories: DataFrame, key: str, value: str) -> DataFrame:
    return memories.where(has_value(F.col("metadata"), key, value))


def expired(memories: DataFrame, now: When, since: str = "timestamp") -> DataFrame:
    """Memories past their time to live, counted from creation or, with since="last_accessed", from use."""
    return memories.where(seconds_between(F.col(since), instant(now)) > F.col("ttl"))


def most_recent(memories: DataFrame, k: int) -> DataFrame:
    return memories.orderBy(F.desc("timestamp"), "id").limit(k)


def most_important(memories: DataFrame, k: int) -> DataFrame:
    return memories.orderBy(F.desc("importance"), "id").limit(k)


def page(memories: DataFrame, after_id: str | None = None, size: int = 50) -> DataFrame:
    """A page in order of id; the last id of a page is the token of the next."""
    rows = memories if after_id is None else memories.where(F.col("id") > after_id)
    return rows.orderBy("id").limit(size)


def time_rollup(memories: DataFrame) -> DataFrame:
    """Counts by year, month, day and hour at every level, null meaning all."""
    ts = F.col("timestamp")
    keys = memories.select(F.year(ts).alias("year"), F.month(ts).alias("month"), F.dayofmonth(ts).alias("day"), F.hour(ts).alias("hour"))
    return keys.rollup("year", "month", "day", "hour").agg(F.count(F.lit(1)).alias("memories"))
