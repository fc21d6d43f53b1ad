"""Keyword search. A memory matches a query token if they share a stem, which equal tokens always do.

The words that have a stem are few and known beforehand, so texts are searched for them and not cut into
tokens; a stored index (:func:`postings`) is read by stem.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.functions.text import all_of, any_of, of_literal, says, says_stem, stem, stems, tokens


def postings(memories: DataFrame) -> DataFrame:
    """memory_id, token, stem: one row for each distinct token of a memory."""
    rows = memories.select(F.col("id").alias("memory_id"), F.explode(tokens(F.col("content"))).alias("token"))
    return rows.withColumn("stem", stem(F.col("token")))


def query_stems(query: str) -> list[str]:
    return of_literal(stems(F.lit(query)))


def matches_any(content: Column, query: str) -> Column:
    return F.coalesce(any_of([says_stem(content, s) for s in query_stems(query)]), F.lit(False))


def matches_all(content: Column, query: str) -> Column:
    """All tokens of the query; a query without usable tokens matches nothing."""
    return F.coalesce(all_of([says_stem(content, s) for s in query_stems(query)]), F.lit(False))


def search_any(memories: DataFrame, query: str) -> DataFrame:
    return memories.where(matches_any(F.col("content"), query))


def search_all(memories: DataFrame, query: str) -> DataFrame:
    return memories.where(matches_all(F.col("content"), query))


def find_keyword(memories: DataFrame, word: str) -> DataFrame:
    """Memories with the exact token."""
    low = word.lower()
    return memories.where(says(F.col("content"), low, [low]) if of_literal(tokens(F.lit(word))) == [low] else F.lit(False))


def find_stem(memories: DataFrame, word: str) -> DataFrame:
    """Memories with a token that has the stem of a word."""
    return memories.where(says_stem(F.col("content"), of_literal(F.array(stem(F.lit(word.lower()))))[0]))


def search_postings(index: DataFrame, query: str, match: str = "any") -> DataFrame:
    """Ids of matching memories from a stored index; the stems of the query reach its scan as a filter."""
    wanted = query_stems(query)
    hits = index.where(F.col("stem").isin(wanted) if wanted else F.lit(False))
    if match == "any":
        return hits.select("memory_id").distinct()
    return hits.groupBy("memory_id").agg(F.countDistinct("stem").alias("n")).where(F.col("n") == len(wanted)).select("memory_id")


def remove_from_index(index: DataFrame, ids: DataFrame) -> DataFrame:
    """The index without the memories whose ids (first column) are given."""
    gone = ids.select(F.col(ids.columns[0]).alias("memory_id")).distinct()
    return index.join(gone, "memory_id", "left_anti")


def search_required(memories: DataFrame, query: str, required: list[str], excluded: list[str] | None = None) -> DataFrame:
    """Any token of the query, all required keywords, none of the excluded ones."""
    rows = search_any(memories, query)
    if required:
        rows = search_all(rows, " ".join(required))
    for word in excluded or []:
        rows = rows.where(~matches_any(F.col("content"), word))
    return rows


def token_stats(index: DataFrame) -> DataFrame:
    return index.groupBy("token").agg(F.count(F.lit(1)).alias("memories"))


def stem_stats(index: DataFrame) -> DataFrame:
    rows = index.groupBy("stem").agg(F.countDistinct("memory_id").alias("memories"), F.countDistinct("token").alias("tokens"))
    return rows
