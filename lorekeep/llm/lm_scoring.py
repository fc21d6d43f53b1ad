"""Cross-entropy difference of two matched bigram models (Moore and Lewis 2010).

A target and a background model share one vocabulary, one order and one smoothing. The background is
counted over all documents and the target over those that are marked as good, and a document's score
is its mean loss per token under the target model less that under the background model: the lower, the
more the document reads like the target.

The vocabulary is every word of the corpus. The ``frequent`` most frequent words are classes of their
own, all others share a class, and a model is P(class | class before) x P(word | its class). So the
table of bigrams is bounded by ``frequent`` squared, and what says how rare words are is a table of
words that grows with the corpus: it is joined with the words of each document, counted per document,
and never leaves the cluster. All counts come from every document and are combined per task before
they are shuffled.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.common import join_counted
from lorekeep.session import materialize

#: Classes: that of all rare words, the beginning of a text, and the most frequent words.
FREQUENT = 2048
OTHER, BEGIN = 0, 1
#: Words and single punctuation marks of lower-cased UTF-8.
TOKEN = re.compile(rb"[a-z0-9\x80-\xff]+|[!-/:-@\[-`{-~]")
SMOOTH = 20.0
MOST_HELD = 300_000


def tokenize(text: bytes | None) -> list[bytes]:
    return TOKEN.findall((text or b"").lower())


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n) over the column ``text`` (binary) of all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for text in batch.column(batch.schema.get_field_index("text")).to_pylist():
                held.update(tokenize(text))
                if len(held) > MOST_HELD:
                    yield out()
                    held.clear()
        yield out()

    return docs.select("text").mapInArrow(run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def _ids(said: list[bytes], index: dict[bytes, int]) -> np.ndarray:
    """The classes of some words, after the mark of the beginning."""
    out = np.empty(len(said) + 1, np.int64)
    out[0] = BEGIN
    out[1:] = [index.get(w, OTHER) for w in said]
    return out


def count_bigrams(texts: DataFrame, index: dict[bytes, int], size: int) -> np.ndarray:
    """(size, size): how often a class follows another, over the column ``text`` of all rows."""
    shared = texts.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(size * size, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                ids = _ids(tokenize(text), shared.value)
                codes, n = np.unique(ids[:-1] * size + ids[1:], return_counts=True)
                held[codes] += n
        seen = np.flatnonzero(held).astype(np.int32)
        for at in range(0, len(seen), 100_000):
            some = seen[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(held[some])], names=["code", "n"])

    # at most ``size`` squared rows
    got = texts.select("text").mapInArrow(run, "code int, n bigint").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size * size)
    out[got.column("code").to_numpy()] = got.column("n").to_numpy()
    return out.reshape(size, size)


def losses(counts: np.ndarray, smooth: float = SMOOTH) -> np.ndarray:
    """-log P(second | first) as a (size, size) table.

    P1 is the add-one unigram estimate; a bigram has (count + smooth * P1) / (count of first + smooth).
    """
    size = counts.shape[0]
    single = counts.sum(axis=0)
    p1 = (single + 1.0) / (single.sum() + size)
    first = counts.sum(axis=1, keepdims=True)
    return -np.log((counts + smooth * p1) / (first + smooth))


def rare_words(counts: DataFrame, target_counts: DataFrame, frequent: DataFrame) -> DataFrame:
    """word (64-bit hash), n, target_loss, background_loss of the words (word, n) that aren't in ``frequent``.

    The losses are -log P(word | class of rare words), with one added to each count in either model.
    """
    both = counts.unionByName(target_counts.select("word", F.lit(0).cast("bigint").alias("n"), F.col("n").alias("t")), allowMissingColumns=True)
    words = both.groupBy("word").agg(F.sum("n").alias("n"), F.coalesce(F.sum("t"), F.lit(0)).alias("t"))
    words = materialize(words.join(F.broadcast(frequent), "word", "left_anti").select(F.xxhash64("word").alias("word"), "n", "t"), "rare_words")
    kinds, total, target = (x or 0 for x in words.agg(F.count(F.lit(1)), F.sum("n"), F.sum("t")).first())

    def loss(n: Column, all_: int) -> Column:
        return -F.log((n + 1.0) / float(max(1, all_ + kinds)))

    return words.select("word", "n", loss(F.col("t"), target).alias("target_loss"), loss(F.col("n"), total).alias("background_loss"))


def cross_entropy_difference(
    docs: DataFrame, target_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT, smooth: float = SMOOTH
) -> DataFrame:
    """One row per input row: doc_id, n_tokens, target_loss, background_loss, score.

    ``target_ids`` (first column: ids) marks the target documents; repeated and null ids there do no
    harm. Losses are means per token in nats, score is target_loss - background_loss. Null texts and
    those without a token have null losses and score 0. Rows that repeat an id are documents of their
    own, and a null id is never a target. With no target documents the target model is the smoothed
    uniform one. An empty table gives no rows; other columns are ignored, whatever their names.
    """
    context = docs.sparkSession.sparkContext
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    marks = target_ids.select(F.col(target_ids.columns[0]).alias("doc_id")).where("doc_id is not null").distinct()
    # by a shuffle of both sides at any size: the marks grow with the documents
    target = materialize(texts.join(marks.hint("merge"), "doc_id", "left_semi").select("text"), "target")
    counts, target_counts = materialize(count_words(texts), "words"), count_words(target)
    top = materialize(counts.orderBy(F.desc("n"), "word").limit(frequent - 2).select("word", "n"), "frequent")
    index = {bytes(r["word"]): i for i, r in enumerate(sorted(top.collect(), key=lambda r: (-r["n"], bytes(r["word"]))), 2)}
    rare = rare_words(counts, target_counts, top.select("word"))
    tables = [losses(count_bigrams(x, index, frequent), smooth).astype(np.float32) for x in (target, texts)]
    shared = context.broadcast((index, tables))
    schema = "row bigint, doc_id bigint, n_tokens bigint, target double, background double, words array<bigint>, times array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, tables = shared.value
        digest = xxhash.xxh64_intdigest
        for batch in batches:
            totals: list[list[float]] = [[], []]
            n, sizes, words, times = [], [], [], []
            for text in batch.column(2).to_pylist():
                said = tokenize(text)
                ids = _ids(said, index)
                n.append(len(said))
                for total, table in zip(totals, tables, strict=True):
                    total.append(float(table[ids[:-1], ids[1:]].sum(dtype=np.float64)))
                seldom = Counter(w for w in said if w not in index)
                words += [digest(w, 42) for w in seldom]
                times += seldom.values()
                sizes.append(len(seldom))
            offsets = pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, x) for x in (pa.array(np.array(words, np.uint64).view(np.int64)), pa.array(times, pa.int32()))]
            columns = [batch.column(0), batch.column(1), pa.array(n, pa.int64()), *[pa.array(x, pa.float64()) for x in totals], *lists]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "doc_id", "n_tokens", "target", "background", "words", "times"])

    numbered = texts.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    scored = materialize(numbered.mapInArrow(run, schema), "scored")
    said = scored.select("row", F.explode(F.arrays_zip("words", "times")).alias("w")).select("row", F.col("w.words").alias("word"), F.col("w.times").alias("times"))
    part = lambda name: F.sum(F.col("times") * F.col(name)).alias(f"rare_{name}")
    sums = join_counted(said, rare, "word", "n").groupBy("row").agg(part("target_loss"), part("background_loss"))
    mean = lambda name: F.when(F.col("n_tokens") > 0, (F.col(name) + F.coalesce(f"rare_{name}_loss", F.lit(0.0))) / F.col("n_tokens"))
    out = scored.drop("words", "times").join(sums, "row", "left").select("doc_id", "n_tokens", mean("target").alias("target_loss"), mean("background").alias("background_loss"))
    return out.withColumn("score", F.coalesce(F.col("target_loss") - F.col("background_loss"), F.lit(0.0)))
