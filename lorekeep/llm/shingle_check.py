"""Exact shingle similarity within groups of candidates.

Documents are nodes by their set of distinct word shingles, so that equal sets are compared once. The
members of a candidate component are searched from one to the next: what a member reaches is not looked
for again. A component of few shingles is searched in one task. In a larger one, the members that were
reached last are compared, block by block, with those that none has reached; so a group of near copies,
most of which are like its first member, costs in proportion to its size. What some rounds leave is
compared in all pairs of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.common import join_counted
from lorekeep.session import materialize

#: A candidate component with more shingles is searched in blocks of about this many.
BLOCK = 1_000_000
#: Rounds of such a search before all that is left is compared.
ROUNDS = 3


def shingles(text: bytes | None, size: int = 5) -> np.ndarray:
    """Distinct shingle hashes of a UTF-8 text, in order; words as those of simhash_dedup."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line, digest, k = b" ".join(words), xxhash.xxh64_intdigest, min(size, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends.tolist()]
    hashes = (digest(line[a : b - 1], 42) for a, b in zip(starts[: len(words) - k + 1], starts[k:], strict=True))
    return np.unique(np.fromiter(hashes, np.uint64, len(words) - k + 1))


def node_of(hashes: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(hashes.astype("<u8").tobytes(), 7)


def shingle_sets(docs: DataFrame, size: int) -> DataFrame:
    """node, shingles of ``docs`` (text as binary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(text.as_py(), size) for text in batch.column(0)]
            offsets = pa.array(np.r_[0, np.cumsum([len(s) for s in sets])].astype(np.int32))
            flat = pa.array(np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64))
            nodes = np.array([node_of(s) for s in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.ListArray.from_arrays(offsets, flat)], names=["node", "shingles"])

    return docs.select("text").mapInArrow(run, "node bigint, shingles array<bigint>")


class _Left:
    """Sets that nothing has reached yet; ``reach`` takes out those that are like a given one."""

    def __init__(self, sets: list[np.ndarray], which: np.ndarray):
        self.which = which[[len(sets[k]) > 0 for k in which]] if len(which) else which
        self.size = np.array([len(sets[k]) for k in self.which], np.int64)
        self.flat = np.concatenate([np.zeros(0, np.int64), *[sets[k] for k in self.which]])

    def reach(self, one: np.ndarray, mark: np.ndarray, similarity: float) -> np.ndarray:
        fit = np.minimum(self.size, len(one)) >= similarity * np.maximum(self.size, len(one))
        if not len(one) or not fit.any():
            return self.which[:0]
        mark[one] = 1
        common = np.add.reduceat(mark[self.flat], np.cumsum(self.size) - self.size, dtype=np.int64)
        mark[one] = 0
        near = fit & (common >= similarity * (self.size + len(one) - common) - 1e-9)
        found = self.which[near]
        if len(found):
            self.flat = self.flat[np.repeat(~near, self.size)]
            self.which, self.size = self.which[~near], self.size[~near]
        return found


def _dense(sets: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """The sets with small numbers for shingles, and room to mark each of them."""
    if not sets:
        return [], np.zeros(0, np.int8)
    values, ids = np.unique(np.concatenate(sets), return_inverse=True)
    return np.split(ids, np.cumsum([len(x) for x in sets])[:-1]), np.zeros(len(values), np.int8)


def similar_pairs(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links among sets, each set linked once."""
    sets, mark = _dense(sets)
    left, out = _Left(sets, np.arange(len(sets))), []
    while len(left.which):
        first = left.which[0]
        front = left.reach(sets[first], mark, similarity).tolist()  # itself among them
        out += [(int(first), y) for y in front if y != first]
        while front and len(left.which):
            x = front.pop()
            found = left.reach(sets[x], mark, similarity).tolist()
            out += [(x, y) for y in found]
            front += found
    return out


def pairs_between(sets: list[np.ndarray], front: np.ndarray, rest: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Links from sets of ``front`` to those of ``rest``, each of which is linked once."""
    sets, mark = _dense(sets)
    left, out = _Left(sets, rest), []
    for x in front.tolist():
        if not len(left.which):
            break
        out += [(x, y) for y in left.reach(sets[x], mark, similarity).tolist()]
    return out


def _rows(table: pa.Table) -> tuple[np.ndarray, list[np.ndarray], pa.Table]:
    """Nodes, each once (rows that repeat an id bring theirs more than once), and their sets."""
    nodes, first = np.unique(table.column("node").to_numpy(), return_index=True)
    table = table.take(pa.array(first))
    return nodes, [np.asarray(s.values.to_numpy(zero_copy_only=False), np.int64) for s in table.column("shingles").combine_chunks()], table


def _edges(nodes: np.ndarray, found: list[tuple[int, int]]) -> pa.Table:
    a, b = (nodes[[p[i] for p in found]] if found else np.zeros(0, np.int64) for i in (0, 1))
    return pa.table({"node": pa.array(b, pa.int64()), "root": pa.array(a, pa.int64())})


def linked(candidates: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(node, root): links of the given similarity inside the candidate components (node, root, n)."""
    sizes = materialize(candidates.groupBy("root").agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("members")), "sizes")
    placed = join_counted(candidates, sizes, "root", "members").select("node", "root", "n", "all")

    def run(table: pa.Table) -> pa.Table:
        nodes, rows, _ = _rows(table)
        return _edges(nodes, similar_pairs(rows, similarity))

    small = placed.where(F.col("all") <= BLOCK).select("node", "root").join(sets, "node").groupBy("root").applyInArrow(run, "node bigint, root bigint")
    if sizes.where(F.col("all") > BLOCK).isEmpty():
        return small
    large = materialize(placed.where(F.col("all") > BLOCK).select("root", "node", "n"), "large")
    return small.unionByName(_search(large, materialize(sets.join(large.select("node"), "node", "left_semi"), "sets"), similarity))


def _search(left: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(node, root): links that hold together what is similar in each of some components (root, node, n).

    The search begins at the smallest node. In each round the members that the last one reached meet
    those that none has reached, in blocks of both; where none was reached, it goes on from the smallest
    node that is left. After ``ROUNDS`` of them, what is still ahead or left is compared in all pairs of blocks.
    """
    schema = "node bigint, root bigint"

    def run(table: pa.Table) -> pa.Table:
        nodes, rows, table = _rows(table)
        ahead = table.column("ahead").to_numpy()
        return _edges(nodes, pairs_between(rows, np.flatnonzero(ahead), np.flatnonzero(~ahead), similarity))

    out, front = left.select("node", "root").where("false"), left.where("false")
    for _ in range(ROUNDS):
        if left.isEmpty():
            return out
        idle = left.join(front.select("root").distinct(), "root", "left_anti")
        first = idle.groupBy("root").agg(F.min(F.struct("node", "n")).alias("m")).select("root", "m.node", "m.n")
        front = materialize(front.unionByName(first), "front")
        left = materialize(left.join(front.select("node"), "node", "left_anti").select("root", "node", "n"), "left")
        count = lambda rows, name: rows.groupBy("root").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias(name), F.count(F.lit(1)).alias(f"{name}_rows"))
        blocks = count(front, "a").join(count(left, "b"), "root").withColumn("rows", F.col("a_rows") + F.col("b_rows"))
        blocks = materialize(blocks.select("root", "a", "b", "rows"), "blocks")
        both = join_counted(front.withColumn("ahead", F.lit(True)).unionByName(left.withColumn("ahead", F.lit(False))), blocks, "root", "rows")
        mine = lambda many: F.pmod(F.xxhash64("node"), F.col(many)).cast("int")
        all_ = lambda many: F.sequence(F.lit(0), F.col(many) - 1)
        spread = F.when(F.col("ahead"), F.transform(all_("b"), lambda j: F.struct(mine("a").alias("i"), j.alias("j")))).otherwise(F.transform(all_("a"), lambda i: F.struct(i.alias("i"), mine("b").alias("j"))))
        dealt = both.select("root", "node", "ahead", F.explode(spread).alias("at")).select("root", "at.i", "at.j", "ahead", "node").join(sets, "node")
        found = dealt.groupBy("root", "i", "j").applyInArrow(run, schema)
        found = materialize(found.groupBy("node").agg(F.min("root").alias("root")), "reached")
        out = out.unionByName(found)
        reached = found.select("node")
        front = materialize(left.join(reached, "node", "left_semi"), "front")
        left = materialize(left.join(reached, "node", "left_anti"), "left")

    def inside(table: pa.Table) -> pa.Table:
        nodes, rows, _ = _rows(table)
        return _edges(nodes, similar_pairs(rows, similarity))

    rest = front.unionByName(left)
    many = materialize(rest.groupBy("root").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("many"), F.count(F.lit(1)).alias("rows")), "rest")
    mine = F.pmod(F.xxhash64("node"), F.col("many")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("many") - 1), lambda j: F.least(mine, j) * F.col("many") + F.greatest(mine, j))
    dealt = join_counted(rest, many, "root", "rows").select("root", F.explode(pairs).alias("pair"), "node").join(sets, "node")
    return out.unionByName(dealt.groupBy("root", "pair").applyInArrow(inside, schema))
