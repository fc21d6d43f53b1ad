"""Mixing sources to target weights by blocks of fixed length.

The words of a source, document after document, are cut into blocks of ``block`` words. The mix is a
row of slots, dealt into output shards: a multinomial draw says how many slots of each source a shard
gets. The slots of a source are numbered through all shards, and number s means block
``perm(s mod blocks)``, where ``perm`` is a pseudorandom permutation of the source's block indices (a
Feistel network with cycle walking, with another key for each pass over the source). So no table of
a permutation is held anywhere, every pass takes every block once, and slots meet their blocks in a
join on (source, block index). The last slot of a source takes only as many words of its block as its
target still asks for, so that sources of few words meet their targets too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.llm.common import join_counted
from lorekeep.session import materialize

BLOCK = 128
#: Rows that one running sum covers, about, the runs of a span, and equal rows that one task numbers.
RUN, SPAN, COPIES = 64, 256, 4096
#: Shards of up to a slot count, and more of them beyond it.
SHARDS, MOST_IN_SHARD = 4096, 1 << 22


def word_counts(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """doc_id, source, size: the number of words (runs of anything but ASCII white space)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [len(x.as_py().split()) if x.is_valid else 0 for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64())], names=["doc_id", "source", "size"])

    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).cast("binary").alias("text"))
    return picked.mapInArrow(run, "doc_id bigint, source string, size bigint")


def number_sources(words: DataFrame) -> DataFrame:
    """src (0, 1, ... in order of code points, null last), source, skey, source_size, docs; one row a source.

    Sources are sorted in ranges, one a task; only the number of sources in each range comes to the driver.
    """
    spark = words.sparkSession
    found = words.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    order = (F.col("source").isNull(), F.col("source"))
    ranged = found.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    ranged = materialize(ranged, "sources")
    sizes = sorted((r["part"], r["n"]) for r in ranged.groupBy(F.shiftright("at", 33).alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())
    offsets, done = [], 0
    for part, n in sizes:
        offsets.append((part, done))
        done += n
    starts = spark.createDataFrame(offsets, "part bigint, first bigint")
    placed = ranged.withColumn("part", F.shiftright("at", 33)).join(F.broadcast(starts), "part")
    return placed.select((F.col("first") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).alias("src"), "source", _skey(F.col("source")).alias("skey"), "source_size", "docs")


def _skey(source: Column) -> Column:
    """A source as a join key, null included."""
    return F.when(source.isNull(), "n").otherwise(F.concat(F.lit("s"), source))


def water_fill(sources: DataFrame, weights: tuple[float, ...], most: float = 3.0) -> DataFrame:
    """``sources`` with target: shares of the sum of sizes by weight, none above ``most`` times its size.

    What a source can't take is shared again by weight among those that stay below their limit: the
    share that one unit of weight gets rises until no more sources are full. Each round is one
    aggregate over the sources.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("src") % len(weights) + 1).cast("int"))
    rows, size = sources.withColumn("weight", weight), F.col("source_size")
    share, before = 0.0, -1
    while True:
        full = F.lit(share) * F.col("weight") > most * size
        got = rows.where(size > 0).agg(
            F.sum(size).alias("total"), F.sum(F.when(full, size)).alias("full"), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("open"), F.sum(full.cast("int")).alias("n")
        ).first()
        if not got["total"] or not got["open"] or got["n"] == before:
            break
        share, before = (got["total"] - most * (got["full"] or 0)) / got["open"], got["n"]
    target = F.when(size > 0, F.least(F.lit(share) * F.col("weight"), most * size)).otherwise(0.0)
    return rows.withColumn("target", target).drop("weight")


def _slots_of(size: np.ndarray, goal: np.ndarray, block: int, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """blocks, slots, last: how many blocks sources have, how many slots give ``goal`` words, and the words of the last slot.

    Whole passes over a source give its size each. In the pass that is left the slots give a block
    each, but for the source's last block, which may be shorter, and the last slot, which is cut.
    ``last`` is 0 where no slot is cut.
    """
    blocks = -(-size // block)
    passes, rest = goal // size, goal % size
    short = block - (size - (blocks - 1) * block)  # words that the last block lacks
    place = unpermute(blocks - 1, blocks, _pass_key(key, passes))
    k = -(-rest // block)
    k += k * block - short * (place < k) < rest
    given = (k - 1) * block - short * (place < k - 1)
    return blocks, passes * blocks + np.where(rest > 0, k, 0), np.where(rest > 0, rest - given, 0)


def _pass_key(key: np.ndarray, number: np.ndarray) -> np.ndarray:
    """The key of the permutation of a source's pass."""
    return key.astype(np.uint64) * np.uint64(8) + number.astype(np.uint64)


def plan(words: DataFrame, block: int = BLOCK, seed: int = 1, weights: tuple[float, ...] = (1.0, 2.0, 3.0)) -> tuple[DataFrame, DataFrame]:
    """From (source, size) rows: the table of sources and that of their slots in each shard.

    Sources are in order of code points, null last, and weigh ``weights`` in turn. A source gives its
    target to half a word. Its slots are dealt into shards by a multinomial draw of its own, so the
    counts of the sources in a shard are those of slots that each fell into a shard at random. No source
    comes to the driver. sources: src, source, skey, source_size, docs, target; shares: src, shard,
    first_slot, slots, blocks, all_slots, last (words of the last slot, 0 if it is whole).
    """
    sources = materialize(water_fill(number_sources(words), weights), "targets")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            src, size, target = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            goal = np.minimum(3 * size, np.floor(target + 0.5).astype(np.int64))
            blocks, slots, last = _slots_of(size, goal, block, _source_key(src, seed))
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (blocks, slots, last))], names=["src", "blocks", "all_slots", "last"])

    sized = sources.where("source_size > 0").select("src", "source_size", "target").mapInArrow(count, "src bigint, blocks bigint, all_slots bigint, last bigint")
    sized = materialize(sized.where("all_slots > 0"), "slots")
    total = sized.agg(F.sum("all_slots")).first()[0] or 0
    shards = int(max(1, min(SHARDS, total // 256), total // MOST_IN_SHARD))
    names = ["src", "shard", "first_slot", "slots", "blocks", "all_slots", "last"]

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], names=names)

        for batch in batches:
            for src, blocks, all_slots, last in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                shard, n = draw_shards(all_slots, shards, seed, src)
                same = [np.full(len(n), x, np.int64) for x in (src, blocks, all_slots, last)]
                held.append([same[0], shard.astype(np.int32), np.cumsum(n) - n, n.astype(np.int64), *same[1:]])
                if len(n) > 1000 or len(held) > 1000:
                    yield out()
                    held.clear()
        if held:
            yield out()

    shares = sized.mapInArrow(draw, "src bigint, shard int, first_slot bigint, slots bigint, blocks bigint, all_slots bigint, last bigint")
    return sources, materialize(shares, "shares")


def draw_shards(slots: int, shards: int, seed: int, src: int) -> tuple[np.ndarray, np.ndarray]:
    """(shard, slots) of a source, from a multinomial draw of its slots over all shards."""
    rng = np.random.Generator(np.random.Philox(key=np.array([seed, src], np.uint64)))
    if slots < shards:  # the same draw, slot by slot
        return np.unique(rng.integers(0, shards, slots), return_counts=True)
    n = rng.multinomial(slots, np.full(shards, 1 / shards))
    return np.flatnonzero(n), n[n > 0].astype(np.int64)


def _source_key(src: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _mix64(src.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


def _mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _feistel(x: np.ndarray, half: np.ndarray, low: np.ndarray, key: np.ndarray, back: bool) -> np.ndarray:
    left, right = x >> half, x & low
    for r in reversed(range(4)) if back else range(4):
        if back:
            left, right = right ^ (_mix64(left + (key * np.uint64(4) + np.uint64(r + 1)) * np.uint64(0x9E3779B97F4A7C15)) & low), left
        else:
            left, right = right, left ^ (_mix64(right + (key * np.uint64(4) + np.uint64(r + 1)) * np.uint64(0x9E3779B97F4A7C15)) & low)
    return left << half | right


def permute(x: np.ndarray, n: np.ndarray | int, key: np.ndarray | int, back: bool = False) -> np.ndarray:
    """The places of ``x`` in pseudorandom permutations of range(n); n and key may differ by place."""
    n = np.broadcast_to(np.asarray(n, np.int64), x.shape)
    key = np.broadcast_to(np.asarray(key).astype(np.uint64), x.shape)
    half = np.maximum(1, (np.frexp((n - 1).astype(np.float64))[1] + 1) // 2).astype(np.uint64)
    low = (np.uint64(1) << half) - np.uint64(1)
    out = x.astype(np.uint64)
    todo = np.arange(len(out))
    with np.errstate(over="ignore"):
        while len(todo):  # a place beyond n goes on until it falls below
            out[todo] = _feistel(out[todo], half[todo], low[todo], key[todo], back)
            todo = todo[out[todo] >= n[todo].astype(np.uint64)]
    return out.astype(np.int64)


def unpermute(x: np.ndarray, n: np.ndarray | int, key: np.ndarray | int) -> np.ndarray:
    """What :func:`permute` sends to ``x``."""
    return permute(x, n, key, back=True)


def mixed_slots(shares: DataFrame, seed: int = 1, step: int = 1 << 16) -> DataFrame:
    """Every slot of the mix: src, shard, slot (number within its source), block, take (words of the block; null: all)."""
    names = ["src", "shard", "slot", "block", "take"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[int, ...]] = []  # src, shard, first slot, slots, blocks, all slots, last

        def out() -> pa.RecordBatch:
            src, shard, first, n, blocks, whole, last = np.array(parts, np.int64).T
            ends = np.cumsum(n)
            slot = np.arange(ends[-1]) - np.repeat(ends - n - first, n)
            src, shard, blocks, whole, last = (np.repeat(c, n) for c in (src, shard, blocks, whole, last))
            index = permute(slot % blocks, blocks, _pass_key(_source_key(src, seed), slot // blocks))
            cut = (slot == whole - 1) & (last > 0)
            return pa.RecordBatch.from_arrays([pa.array(src), pa.array(shard.astype(np.int32)), pa.array(slot), pa.array(index), pa.array(last, mask=~cut)], names=names)

        held = 0
        for batch in batches:
            for src, shard, first, slots, *rest in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                for at in range(first, first + slots, step):
                    n = min(step, first + slots - at)
                    if held + n > step and parts:
                        yield out()
                        parts, held = [], 0
                    parts.append((src, shard, at, n, *rest))
                    held += n
        if parts:
            yield out()

    # a given number of partitions: a few rows stand for many slots, and few bytes would be joined to one task
    wide = shares.repartition(int(shares.sparkSession.conf.get("spark.sql.shuffle.partitions")), "src", "shard")
    return wide.mapInArrow(run, "src bigint, shard int, slot bigint, block bigint, take bigint")


def placed(words: DataFrame, sources: DataFrame) -> DataFrame:
    """Where each document with words begins in its source: src, doc_id, size, start.

    The order is by a hash of id and size, then id, then size; rows that agree in both stand for each
    other and are counted first. A source is cut into runs of about ``RUN`` different rows and the runs
    into spans, so that no task sums up a whole source, whatever repeats.
    """
    known = sources.select("skey", "src", "docs")
    rows = words.where("size > 0").select(_skey(F.col("source")).alias("skey"), "doc_id", "size")
    run = F.pmod(F.xxhash64("doc_id", "size"), F.ceil(F.col("docs") / RUN))
    rows = join_counted(rows, known, "skey", "docs").select("src", run.alias("run"), "doc_id", "size")
    grouped = materialize(rows.groupBy("src", "run", "doc_id", "size").agg(F.count(F.lit(1)).alias("n")), "places")
    words_of = F.sum(F.col("n") * F.col("size"))
    span = F.expr(f"run div {SPAN}").alias("span")
    by_run = grouped.groupBy("src", "run", span).agg(words_of.alias("w"))
    by_span = by_run.groupBy("src", "span").agg(F.sum("w").alias("w"))
    earlier = lambda *keys: F.coalesce(F.sum("w").over(Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = by_run.select("src", "span", "run", earlier("src", "span", "run").alias("in_span")).join(by_span.select("src", "span", earlier("src", "span").alias("spans")), ["src", "span"])
    before = before.select("src", "run", (F.col("in_span") + F.col("spans")).alias("before"))
    inside = Window.partitionBy("src", "run").orderBy("doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    within = words_of.over(inside) - F.col("n") * F.col("size")
    firsts = grouped.withColumn("within", within).join(before, ["src", "run"]).select("src", "doc_id", "size", "n", (F.col("before") + F.col("within")).alias("first"))
    few = firsts.where(F.col("n") <= COPIES).withColumn("k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)))
    many = firsts.where(F.col("n") > COPIES).withColumn("c", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1, F.lit(COPIES).cast("bigint"))))
    many = many.repartition("src", "doc_id", "size", "c").withColumn("k", F.explode(F.sequence("c", F.least(F.col("c") + COPIES, F.col("n")) - 1))).drop("c")
    return few.unionByName(many).select("src", "doc_id", "size", (F.col("first") + F.col("k") * F.col("size")).alias("start"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = BLOCK, seed: int = 1) -> DataFrame:
    """One row per input row: doc_id, size, source_size, target, taken, source.

    taken says how many words of the document the mix has, repeats counted; it is at most 3 times
    size, and those of a source add up to its target to half a word. Empty and null texts have size 0
    and take nothing; a null source is a source. Rows that repeat an id are documents of their own. The
    same rows and seed give the same mix, in whatever order or partitions they come. An empty table
    gives no rows; other columns are ignored, whatever their names.
    """
    words = materialize(word_counts(docs, id_col, text_col, source_col), "word_counts")
    sources, shares = plan(words, block, seed)
    uses = mixed_slots(shares, seed).groupBy("src", "block").agg(F.sum(F.col("take").isNull().cast("int")).alias("uses"), F.coalesce(F.max("take"), F.lit(0)).alias("part"))
    first, last = F.expr(f"start div {block}"), F.expr(f"(start + size - 1) div {block}")
    spans = placed(words, sources).select("*", F.explode(F.sequence(first, last)).alias("block"))
    begin = F.greatest(F.col("start") - F.col("block") * block, F.lit(0))
    end = F.least(F.col("start") + F.col("size") - F.col("block") * block, F.lit(block))
    cut = F.greatest(F.least(end, F.col("part")) - begin, F.lit(0))
    counted = (
        spans.join(uses, ["src", "block"], "left")
        .groupBy("src", "start", "doc_id", "size")
        .agg(F.coalesce(F.sum(F.col("uses") * (end - begin) + cut), F.lit(0)).alias("taken"))
    )
    empty = words.where("size = 0").select(_skey(F.col("source")).alias("skey"), "doc_id", "size", F.lit(0).cast("bigint").alias("taken"))
    columns = ["doc_id", "size", "source_size", "target", "taken", "source"]
    met = join_counted(counted, sources.drop("skey"), "src", "docs").select(*columns)
    return met.unionByName(join_counted(empty, sources.drop("src"), "skey", "docs").select(*columns))


def mixed_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = BLOCK, seed: int = 1) -> DataFrame:
    """The mix itself: shard, slot, source, block, text (the words of the block, single-spaced)."""
    words = materialize(word_counts(docs, id_col, text_col, source_col), "word_counts")
    sources, shares = plan(words, block, seed)
    where = placed(words, sources).withColumnRenamed("doc_id", "_id")
    picked = docs.select(F.col(id_col).alias("doc_id"), _skey(F.col(source_col).cast("string")).alias("skey"), F.col(text_col).cast("binary").alias("text"))
    texts = join_counted(picked, sources.select("skey", "src", "docs"), "skey", "docs").select("src", "doc_id", "text")
    # rows that agree in id and size take their places in order of text
    nth = lambda df, i, *order: df.withColumn("_nth", F.row_number().over(Window.partitionBy("src", i, "size").orderBy(*order)))
    sized = texts.mapInArrow(_with_size, "src bigint, doc_id bigint, text binary, size bigint").where("size > 0")
    left, right = nth(sized, "doc_id", "text"), nth(where, "_id", "start")
    met = left.join(right, (left["src"] == right["src"]) & left["doc_id"].eqNullSafe(right["_id"]) & (left["size"] == right["size"]) & (left["_nth"] == right["_nth"])).select(left["src"], "text", "start")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, int, int, str]] = []
            for src, text, start in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                said, at = text.split(), 0
                while at < len(said):
                    index, offset = divmod(start + at, block)
                    some = said[at : at + block - offset]
                    out.append((src, index, offset, b" ".join(some).decode("utf-8", "replace")))
                    at += len(some)
            if out:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["src", "block", "offset", "piece"])

    pieces = met.mapInArrow(cut, "src bigint, block bigint, offset bigint, piece string")
    whole = pieces.groupBy("src", "block").agg(F.sort_array(F.collect_list(F.struct("offset", "piece"))).alias("p"))
    whole = whole.select("src", "block", F.array_join(F.transform("p", lambda x: x["piece"]), " ").alias("text"))
    slots = join_counted(mixed_slots(shares, seed).join(whole, ["src", "block"]), sources.select("src", "source", "docs"), "src", "docs")
    some = F.array_join(F.slice(F.split("text", "[ \\t-\\r]+"), F.lit(1), F.col("take").cast("int")), " ")
    return slots.select("shard", "slot", "source", "block", F.when(F.col("take").isNull(), F.col("text")).otherwise(some).alias("text"))


def _with_size(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = [len(x.as_py().split()) if x.is_valid else 0 for x in batch.column(2)]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes, pa.int64())], names=["src", "doc_id", "text", "size"])
