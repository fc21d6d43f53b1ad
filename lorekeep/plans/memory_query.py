"""The query builder: criteria that must all hold, an order and a limit, as one lazy plan."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.errors import InvalidOperation
from lorekeep.operators import filters, text_search

DEFAULT_LIMIT = 100
When = dt.datetime | str


@dataclass(frozen=True)
class MemoryQuery:
    """All criteria that are set must hold.

    ``exact`` asks for all tokens of the text and not any. year, month and day count only without
    before and after, a month needs a year and a day a month. order: recent, confidence, oldest or
    importance. Without criteria the result is the newest memories, ``limit`` or 100 of them.
    ``bucketed`` compares tenths, as a bucketed index does.
    """

    text: str | None = None
    exact: bool = False
    source: str | None = None
    min_confidence: float | None = None
    min_importance: float | None = None
    key: str | None = None
    value: str | None = None
    before: When | None = None
    after: When | None = None
    year: int | None = None
    month: int | None = None
    day: int | None = None
    order: str = "recent"
    limit: int | None = None
    bucketed: bool = False

    def with_text(self, text: str, exact: bool = False) -> MemoryQuery:
        return replace(self, text=text, exact=exact)

    def with_source(self, source: str) -> MemoryQuery:
        return replace(self, source=source)

    def with_min_confidence(self, least: float) -> MemoryQuery:
        return replace(self, min_confidence=least)

    def with_min_importance(self, least: float) -> MemoryQuery:
        return replace(self, min_importance=least)

    def with_metadata(self, key: str, value: str | None = None) -> MemoryQuery:
        return replace(self, key=key, value=value)

    def with_time_range(self, after: When, before: When) -> MemoryQuery:
        """Between two times, neither included."""
        return replace(self, after=after, before=before)

    def in_period(self, year: int, month: int | None = None, day: int | None = None) -> MemoryQuery:
        return replace(self, year=year, month=month, day=day)

    def with_limit(self, limit: int) -> MemoryQuery:
        return replace(self, limit=limit)

    def ordered(self, order: str) -> MemoryQuery:
        return replace(self, order=order)

    def where(self, memories: DataFrame) -> DataFrame:
        """The memories for which all criteria hold, in no order."""
        # the cheap criteria first: metadata is parsed and text searched only where these hold
        rows = memories
        if self.source is not None:
            rows = filters.by_source(rows, self.source)
        if self.min_confidence is not None:
            rows = filters.min_confidence(rows, self.min_confidence, self.bucketed)
        if self.min_importance is not None:
            rows = filters.min_importance(rows, self.min_importance, self.bucketed)
        if self.before is not None:
            rows = filters.before(rows, self.before)
        if self.after is not None:
            rows = filters.after(rows, self.after)
        if self.before is None and self.after is None and self.year is not None:
            if self.month is None:
                rows = filters.by_year(rows, self.year)
            elif self.day is None:
                rows = filters.by_month(rows, self.year, self.month)
            else:
                rows = filters.by_day(rows, self.year, self.month, self.day)
        if self.key is not None:
            rows = filters.with_key(rows, self.key) if self.value is None else filters.with_value(rows, self.key, self.value)
        if self.text is not None:
            rows = (text_search.search_all if self.exact else text_search.search_any)(rows, self.text)
        return rows

    def apply(self, memories: DataFrame) -> DataFrame:
        orders = {
            "recent": [F.desc("timestamp")],
            "oldest": [F.asc("timestamp")],
            "confidence": [F.desc("confidence")],
            "importance": [F.desc("importance")],
        }
        if self.order not in orders:
            raise InvalidOperation(f"unknown order {self.order}")
        rows = self.where(memories)
        limit = self.limit
        if limit is None and rows is memories:
            limit = DEFAULT_LIMIT
        rows = rows.orderBy(*orders[self.order], "id")
        return rows if limit is None else rows.limit(limit)


def search_combined(memories: DataFrame, **criteria) -> DataFrame:
    """Ids for which all criteria hold; none at all without criteria."""
    query = MemoryQuery(**criteria)
    rows = query.where(memories)
    return (memories.where("false") if rows is memories else rows).select("id")
