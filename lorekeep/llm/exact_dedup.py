"""Exact deduplication with a heavy-hitter split, in DataFrame operations only.

A frequent-items sketch (Misra-Gries family) names the digests that may fill a large share of the
rows. Their exact sizes and winners are counted with map-side combination, which leaves at most
``tracked`` rows, and are broadcast: copies of these texts are settled where they are read. All other
digests are shuffled; their groups are counted with map-side combination, so that no task holds a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.common import fresh_name, heavy_values, join_counted, lower_ascii
from lorekeep.session import materialize

TRACKED = 1024


def text_digest(text: Column) -> Column:
    """SHA-256 (lower-case hex) of the text with A-Z lower-cased; null counts as empty."""
    return F.sha2(lower_ascii(F.coalesce(text, F.lit(""))), 256)


def _winners(rows: DataFrame, tracked: int) -> DataFrame:
    """Verified frequent digests: text_sha256, keep_id, group_size (2 or more); at most ``tracked`` rows."""
    candidates = materialize(heavy_values(rows, "text_sha256", tracked), "candidates")
    counted = (
        rows.join(F.broadcast(candidates), "text_sha256", "left_semi")
        .groupBy("text_sha256")
        .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    )
    return materialize(counted.where("group_size > 1"), "winners")


def _digests(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return materialize(docs.select(F.col(id_col).alias("doc_id"), text_digest(F.col(text_col)).alias("text_sha256")), "digests")


def _groups(rows: DataFrame, winners: DataFrame) -> DataFrame:
    frequent = rows.join(F.broadcast(winners), "text_sha256")
    others = rows.join(F.broadcast(winners), "text_sha256", "left_anti")
    size = F.count(F.lit(1))
    groups = others.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), size.alias("group_size")).where("group_size > 1")
    met = join_counted(others, materialize(groups, "groups"), "text_sha256", "group_size", how="left")
    single = F.col("group_size").isNull()
    others = met.select("text_sha256", "doc_id", F.when(single, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"))
    columns = ["doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"]
    return frequent.select(*columns).unionByName(others.select(*columns))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tracked: int = TRACKED) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts (A-Z lower-cased, null as empty) the largest id stays. A null id loses against any
    other; a group with null ids only has a null keep_id and keeps its rows. Rows that repeat an id
    and its text are the same document: each has the same flags. An empty table gives no rows; other
    columns are ignored, whatever their names.
    """
    rows = _digests(docs, id_col, text_col)
    return _groups(rows, _winners(rows, tracked))


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tracked: int = TRACKED) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, each text once.

    Copies of frequent texts go before any shuffle; the others are found by id and digest. Where
    rows repeat an id and its text, one of them stays; if their other columns differ, which one is open. A null text is an empty
    one. A null id loses against any other, and of a text that has null ids only one row stays. An empty table gives no rows; columns
    keep their names, whatever these are.
    """
    key, sha, best, frequent = (fresh_name(docs, x) for x in ("key", "sha", "best", "frequent"))
    rows = _digests(docs, id_col, text_col)
    winners = _winners(rows, tracked)
    place = lambda i, digest: F.concat_ws(":", digest, i.cast("string"))
    kept = _groups(rows, winners).where("kept").select(place(F.col("doc_id"), F.col("text_sha256")).alias(key))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    marked = docs.withColumn(sha, text_digest(F.col(text_col))).withColumn(key, place(F.col(id_col), F.col(sha)))
    first = winners.select(F.col("text_sha256").alias(sha), F.col("keep_id").alias(best), F.lit(True).alias(frequent))
    left = marked.join(F.broadcast(first), sha, "left").where(F.col(frequent).isNull() | F.col(id_col).eqNullSafe(F.col(best)))
    return left.select(*columns, key).join(kept, key, "left_semi").dropDuplicates([key]).select(*columns)
