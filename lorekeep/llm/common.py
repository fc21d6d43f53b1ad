"""What the operators of this subpackage share."""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.session import materialize, own_folder

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share; ``clear_materialized`` deletes it too."""
    return f"{own_folder(spark)}/{name}"


def fresh_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` doesn't have, in whatever case."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name += "_"
    return name


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs that are run inside hand at most ``rows`` rows at a time to Python, so that batches of whole texts stay small."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else. On pure ASCII text ``lower`` does the same and is faster."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


_SPACE = re.compile(rb"\s")


def pieces(text: bytes, size: int) -> Iterator[slice]:
    """Stretches of a text of at least ``size`` bytes that end before white space, so that no word is cut."""
    at = 0
    while at < len(text):
        found = _SPACE.search(text, at + size)
        end = found.start() if found else len(text)
        yield slice(at, end)
        at = end


def sample_texts(docs: DataFrame, marked: DataFrame, id_col: str, text_col: str, most_bytes: int) -> list[tuple[bytes, int]]:
    """(text, label) of documents that ``marked`` (doc_id, label; one row an id, a bounded number) names, in order of the id.

    Each id stands for one text, the shortest of its rows and the first by bytes among these, whatever
    rows repeat it. Texts are taken in order of a hash of the id as long as they fit into ``most_bytes``;
    sizes come to the driver first, one for each id, and then the texts that were taken.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("binary"), F.lit("").cast("binary")).alias("text"))
    one = texts.join(F.broadcast(marked), "doc_id").groupBy("doc_id", "label").agg(F.min(F.struct(F.octet_length("text").alias("n"), "text")).alias("best"))
    one = materialize(one.select("doc_id", "label", "best.n", "best.text", F.xxhash64("doc_id").alias("h")), "sample")
    chosen, total = [], 0
    for r in sorted(one.drop("text").collect(), key=lambda r: (r["h"], r["doc_id"])):
        if total + r["n"] <= most_bytes:
            chosen.append((r["doc_id"],))
            total += r["n"]
    if not chosen:
        return []
    ids = docs.sparkSession.createDataFrame(chosen, "doc_id bigint")
    return [(bytes(r["text"]), r["label"]) for r in sorted(one.join(F.broadcast(ids), "doc_id").select("doc_id", "text", "label").collect(), key=lambda r: r["doc_id"])]


def heavy_values(df: DataFrame, column: str, tracked: int) -> DataFrame:
    """Candidates for the most frequent values of ``column``: at most ``tracked`` rows (value).

    ``approx_top_k`` keeps a frequent-items sketch of the Misra-Gries family per task and merges the
    sketches, so that a value with more than about 1/(0.75 * tracked) of all rows is always among
    the candidates. Counts of the sketch are not used; callers verify them.
    """
    top = df.where(F.col(column).isNotNull()).agg(F.expr(f"approx_top_k({column}, {tracked}, {tracked})").alias("_top"))
    return top.select(F.explode("_top").alias("_t")).select(F.col("_t.item").alias(column))


def join_counted(rows: DataFrame, groups: DataFrame, key: str, count: str, many: int = 1000, most: int = 50_000, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``groups`` (one row a key, and how many rows it has), without hot tasks.

    Keys with over ``many`` rows, at most ``most`` of them, are joined by broadcast; the bound of the
    broadcast is a number of rows. Where more keys are as frequent, the floor rises until the bound holds,
    and no key below it has more than a ``most``-th of all rows. The others are joined by a shuffle.
    ``groups`` must be cheap to read again. With ``how="left"`` rows of other keys stay.
    """
    frequent = groups.where(F.col(count) > many)
    found, floor = frequent.count(), many
    while found > most:
        floor *= 4
        frequent = groups.where(F.col(count) > floor)
        found = frequent.count()
    if not found:
        return rows.join(groups, key, how)
    rare = groups.where(F.col(count) <= floor)
    near = F.broadcast(frequent)
    return rows.join(near, key).unionByName(rows.join(near, key, "left_anti").join(rare, key, how))
