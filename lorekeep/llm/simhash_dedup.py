"""SimHash near-duplicate groups by the generalised pigeonhole principle.

Two 64-bit fingerprints that differ in at most T bits differ, in some part i of m disjoint parts, in
at most t_i bits, for any thresholds with sum(t_i) = T - m + 1 (Qin et al. 2018, "GPH: Similarity
search in Hamming space"). Correlated bits share a part, which keeps the parts independent of each
other. Dynamic programming over parts and thresholds, on candidate counts estimated from statistics of
all fingerprints, picks the cheapest allocation; a threshold of -1 skips a part. Every fingerprint is
put into its own bucket of each part and probes the buckets within t_i bits. Candidates are verified
on all 64 bits. Buckets give star edges, never all pairs, and the components are found by large-star /
small-star rounds (Kiveris et al. 2014).

Pairs of a given shingle similarity differ in too many of 64 bits for any such bound: at a Jaccard
similarity of 0.8 in 15 of 100. For them the fingerprint has several words of 64 bits. In each word the
search runs as before, with the bound and the number of words at which the predicted share of missed
pairs is small at the least cost; candidates are verified on two words, on four, and then on whole shingle sets.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.errors import ComputationError
from lorekeep.llm.common import fresh_name, join_counted
from lorekeep.llm.shingle_check import linked, node_of, shingle_sets, shingles
from lorekeep.session import materialize

BITS = 64
#: Shingles whose hashes are held at once, of one document.
CHUNK = 1 << 16
#: A bucket with more rows is compared in blocks of about this many.
BLOCK = 20_000
#: Comparisons of a bucket that are made at once.
CELLS = 1 << 17
#: Links that one task joins to components.
MOST_LOCAL = 1_000_000
#: Heavy buckets that are broadcast at most; more are joined by a shuffle.
MOST_HEAVY = 50_000
#: Words of the fingerprint for similarity search, and the share of pairs at the bound that may be missed.
WORDS, MISS = 16, 0.002
#: Costs of a row that is dealt to a bucket and of a comparison, in microseconds.
ROW_COST, PAIR_COST = 2.0, 0.004
#: The same for similarity search, whose rows are wider.
WIDE_COSTS = (5.0, 0.01)
#: Names of the words of a row in a bucket. A pair is compared on the first two, and if near by these on all: among millions of
#: texts some are near on two words by chance, and their links would draw all groups together.
CODES = "abcd"

#: (words, bits): how many bits of the first words may differ.
Bounds = list[tuple[int, int]]


def _bit_counts(words: list[bytes], size: int) -> tuple[np.ndarray, int]:
    """How many shingle hashes have each bit set, and the number of shingles."""
    n = max(1, len(words) - size + 1)
    counts = np.zeros(BITS, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, CHUNK):
        part = words[at : min(at + CHUNK, n) + size - 1] if n > 1 else words
        ends = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)) + 1)
        line = b" ".join(part)
        starts = [0, *ends.tolist()]
        k = min(size, len(part))
        hashes = [digest(line[a : b - 1], 42) for a, b in zip(starts[: len(part) - k + 1], starts[k:], strict=True)]
        raw = np.array(hashes, np.uint64)
        counts += np.unpackbits(raw.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return counts, n


def simhash(text: bytes | None, size: int = 4) -> int:
    """The fingerprint of a UTF-8 text as an unsigned number; 0 if it has no word."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    counts, n = _bit_counts(words, size)
    return int((np.uint64(1) << np.nonzero(2 * counts > n)[0].astype(np.uint64)).sum(dtype=np.uint64))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4) -> DataFrame:
    """One row per input row: doc_id, fp (the 64 bits as a signed long).

    Words are runs of anything but ASCII white space, A-Z is lower-cased, shingles count with
    repeats; a text of fewer words is one shingle. Null and blank texts have the fingerprint 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((simhash(x.as_py(), size) for x in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, "doc_id bigint, fp bigint")


def bit_statistics(distinct: DataFrame, words: int = 1) -> tuple[int, np.ndarray]:
    """The number of fingerprints, and for each pair of bits of a word how many have both set (words x 64 x 64).

    The first column of ``distinct`` is a word or an array of words.
    """
    cells = words * BITS * BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((words, BITS, BITS))
        n = 0
        for batch in batches:
            column = batch.column(0)
            flat = column.flatten() if pa.types.is_list(column.type) else column
            fps = flat.to_numpy(zero_copy_only=False).astype("<i8").reshape(batch.num_rows, words)
            for k in range(words):
                bits = np.unpackbits(np.ascontiguousarray(fps[:, k]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
                total[k] += bits.T @ bits
            n += len(fps)
        both = np.append(total.reshape(-1), n).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(both), dtype=np.int32)), pa.array(both)], names=["cell", "n"])

    got = distinct.select(distinct.columns[0]).mapInArrow(run, "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    flat = np.zeros(cells + 1, np.int64)
    for row in got:
        flat[row["cell"]] = row["n"]
    return int(flat[-1]), flat[:-1].reshape(words, BITS, BITS)


def group_bits(both: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """``parts`` groups of almost equal size; each grows by the bit that is most correlated with it."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    tie = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(tie, 0)
    free, groups = list(range(BITS)), []
    for k in range(parts):
        want = (BITS - sum(map(len, groups))) // (parts - k)
        first = max(free, key=lambda b: (tie[b, free].sum(), -b))
        group = [first]
        free.remove(first)
        while len(group) < want:
            best = max(free, key=lambda b: (tie[b, group].sum(), -b))
            group.append(best)
            free.remove(best)
        groups.append(sorted(group))
    return groups


def _within(bits: list[int], p: np.ndarray, most: int) -> list[float]:
    """The chance that two fingerprints differ in at most 0..most of ``bits``."""
    chances = np.zeros(most + 1)
    chances[0] = 1
    for b in bits:
        differ = 2 * p[b] * (1 - p[b])
        chances[1:] = chances[1:] * (1 - differ) + chances[:-1] * differ
        chances[0] *= 1 - differ
    return list(np.cumsum(chances))


def allocate(both: np.ndarray, n: int, distance: int, costs: tuple[float, float] = (ROW_COST, PAIR_COST)) -> tuple[float, list[tuple[list[int], int]]]:
    """The cheapest (cost, parts with their thresholds), over all numbers of parts."""
    p = np.diag(both) / max(n, 1)
    best: tuple[float, list[tuple[list[int], int]]] = (math.inf, [])
    for m in range(1, distance + 2):
        groups = group_bits(both, n, m)
        total = distance - m + 1
        # state: sum of thresholds so far -> (cost, thresholds)
        states: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}
        for bits in groups:
            chance = _within(bits, p, distance)
            after: dict[int, tuple[float, tuple[int, ...]]] = {}
            for (done, (cost, chosen)), t in itertools.product(states.items(), range(-1, min(distance, len(bits)) + 1)):
                rows = 0 if t < 0 else sum(math.comb(len(bits), j) for j in range(t + 1))
                pairs = 0 if t < 0 else n * n / 2 * chance[t]
                new = cost + rows * n * costs[0] + pairs * costs[1]
                if new < after.get(done + t, (math.inf,))[0]:
                    after[done + t] = (new, (*chosen, t))
            states = after
        if total in states and states[total][0] < best[0]:
            best = (states[total][0], [(b, t) for b, t in zip(groups, states[total][1], strict=True) if t >= 0])
    return best


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >= 1 << (BITS - 1) else x


def bucket_rows(parts: list[tuple[list[int], int]], word: str = "fp", first: int = 0, more: tuple[str, ...] = ()) -> Column:
    """The buckets (part, key, own, word, more) that a fingerprint stands in (own) and those that it probes, as an array.

    Parts are numbered from ``first`` on.
    """
    arrays = []
    for k, (bits, t) in enumerate(parts, first):
        mask = _signed(sum(1 << b for b in bits))
        flips = [sum(1 << b for b in some) for j in range(t + 1) for some in itertools.combinations(bits, j)]
        base = F.expr(word).bitwiseAND(F.lit(mask).cast("bigint"))
        flip = F.array(*[F.lit(_signed(x)).cast("bigint") for x in flips])
        arrays.append(_probes(k, base, flip, word, more))
    return F.concat(*arrays)


def _probes(part: int, base: Column, flips: Column, word: str, more: tuple[str, ...]) -> Column:
    codes = [F.expr(x).alias(name) for x, name in zip((word, *more), CODES, strict=False)]
    return F.transform(flips, lambda f: F.struct(F.lit(part).alias("part"), base.bitwiseXOR(f).alias("key"), (f == 0).alias("own"), *codes))


def _minima(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (member, smallest member) of the components that the pairs (a, b) form."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    far = label != np.arange(len(nodes))
    return nodes[far], nodes[label[far]]


def _differing(words: list[np.ndarray], a, b) -> np.ndarray:
    """In how many bits the rows ``a`` and ``b`` of some words differ."""
    differ = np.bitwise_count(words[0][a] ^ words[0][b])
    if len(words) * BITS > 255:
        differ = differ.astype(np.uint16)
    for word in words[1:]:
        differ += np.bitwise_count(word[a] ^ word[b])
    return differ


def _near(codes: list[np.ndarray], a: np.ndarray, b: np.ndarray | np.integer, bounds: Bounds) -> np.ndarray:
    """Whether the rows ``a`` and ``b`` differ in at most so many bits of the first words as each bound says."""
    (words, most), *more = bounds
    near = _differing(codes[:words], a, b) <= most
    for words, most in more:
        at = np.flatnonzero(near)  # the first bound leaves few
        if not len(at):
            break
        near[at] = _differing(codes[:words], a[at], b if np.ndim(b) == 0 else b[at]) <= most
    return near


def _all_near(codes: list[np.ndarray], bounds: Bounds) -> tuple[np.ndarray, np.ndarray] | None:
    """All pairs of rows that are near, by blocks of comparisons; None where these are so many that a search is better."""
    (words, most), *more = bounds
    n, x, y = len(codes[0]), [], []
    step = max(1, min(CELLS // n, -(-n // 4)))
    for at in range(0, n, step):
        near = _differing(codes[:words], (slice(at, at + step), None), (None, slice(at, None))) <= most
        if at + step < n and np.count_nonzero(near) > near.size // 8:
            return None
        i, j = np.divmod(np.flatnonzero(near), n - at)
        i, j = i[i < j] + at, j[i < j] + at
        if more and len(i):
            hit = _near(codes, i, j, more)
            i, j = i[hit], j[hit]
        x.append(i)
        y.append(j)
    return np.concatenate(x), np.concatenate(y)


def _large_bucket(ids: np.ndarray, codes: list[np.ndarray], bounds: Bounds) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Links of one bucket: all of them where they are few, else each node linked once by a search that removes what it reaches."""
    _, first = np.unique(ids, return_index=True)
    pairs = _all_near([c[first] for c in codes], bounds)
    if pairs is not None:
        return [ids[first[pairs[0]]]], [ids[first[pairs[1]]]]
    left, a, b = first, [], []
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            x = front.pop()
            near = _near(codes, left, x, bounds)
            if near.any():
                hit = left[near]
                left = left[~near]
                front.extend(hit)
                a.append(np.full(len(hit), ids[x]))
                b.append(ids[hit])
    return a, b


def _links(group: np.ndarray, ids: np.ndarray, codes: list[np.ndarray], bounds: Bounds | int, small: int = 128) -> tuple[np.ndarray, np.ndarray]:
    """Verified links among rows of the same group; ``group`` is sorted, ``codes`` has the words of each id. A number bounds all words."""
    bounds = [(len(codes), bounds)] if isinstance(bounds, int) else bounds
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    sizes = np.diff(np.r_[starts, len(group)])
    a, b = [np.zeros(0, ids.dtype)], [np.zeros(0, ids.dtype)]
    for s, n in zip(starts[sizes > small], sizes[sizes > small], strict=True):
        x, y = _large_bucket(ids[s : s + n], [c[s : s + n] for c in codes], bounds)
        a += x
        b += y
    rest = np.repeat(sizes <= small, sizes)
    left_in = np.repeat(sizes, sizes) - (np.arange(len(group)) - np.repeat(starts, sizes))
    for step in range(1, small):
        at = np.flatnonzero(rest & (left_in > step))
        if not len(at):
            break
        hit = at[_near(codes, at, at + step, bounds)]
        hit = hit[ids[hit] != ids[hit + step]]
        a.append(ids[hit])
        b.append(ids[hit + step])
    return np.concatenate(a), np.concatenate(b)


def star_edges(buckets: DataFrame, codes: list[str], bounds: Bounds) -> DataFrame:
    """(node, root): in each bucket, every linked node with the smallest that it reaches there.

    ``buckets`` has part, key, own, node and the words ``codes``. Buckets stream through the tasks in
    sorted order, so a task holds one batch and the bucket at its end. Rows of the same bucket are
    compared by ``bounds``; a link is a link whichever of its buckets shows it, so own and probing rows
    needn't be told apart but for buckets that no node owns. A bucket of over ``BLOCK`` rows is dealt
    into blocks, each pair of which is a bucket of its own.
    """
    heavy = heavy_buckets(buckets)
    near = F.broadcast(heavy) if heavy.count() <= MOST_HEAVY else heavy
    many = F.coalesce(F.col("_blocks"), F.lit(1))
    mine = F.pmod(F.xxhash64("node"), many).cast("int")
    others = F.transform(F.sequence(F.lit(0), many - 1), lambda j: F.least(mine, j) * many + F.greatest(mine, j))
    keyed = (
        buckets.join(near, ["part", "key"], "left")
        .withColumn("pair", F.explode(F.when(F.col("_blocks").isNull(), F.array(F.lit(0))).otherwise(others)))
        .select("part", "key", "pair", "own", "node", *codes)
    )
    dealt = keyed.repartition("part", "key", "pair").sortWithinPartitions("part", "key", "pair")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] = []
        serial = 0  # of the last row's group
        last = None

        def done(group: np.ndarray, own: np.ndarray, ids: np.ndarray, *words: np.ndarray) -> pa.RecordBatch:
            _, at = np.unique(group, return_inverse=True)
            real = (np.bincount(at, own) > 0) & (np.bincount(at) > 1)
            use = real[at]
            node, root = _minima(*_links(group[use], ids[use], [w[use] for w in words], bounds))
            return pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), pa.array(root.view(np.int64))], names=["node", "root"])

        for batch in batches:
            if not batch.num_rows:
                continue
            part, key, pair, own, *longs = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            new = np.r_[True, (part[1:] != part[:-1]) | (key[1:] != key[:-1]) | (pair[1:] != pair[:-1])]
            new[0] = (part[0], key[0], pair[0]) != last
            last = (part[-1], key[-1], pair[-1])
            group = serial + np.cumsum(new)
            serial = int(group[-1])
            now = [group, own.astype(np.float64), *[x.astype(np.int64).view(np.uint64) for x in longs]]
            rest = [np.concatenate(x) for x in zip(rest, now, strict=True)] if rest else now
            whole = rest[0] < serial
            if whole.sum() >= 50_000:
                yield done(*[x[whole] for x in rest])
                rest = [x[~whole] for x in rest]
        if rest:
            yield done(*rest)

    return dealt.mapInArrow(run, "node bigint, root bigint").distinct()


def heavy_buckets(buckets: DataFrame) -> DataFrame:
    """(part, key, _blocks) of all buckets with over ``BLOCK`` rows, by an exact count."""
    counted = buckets.groupBy("part", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK)
    return materialize(counted.select("part", "key", F.ceil(F.col("n") / BLOCK).cast("int").alias("_blocks")), "heavy_buckets")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): every node of ``edges`` (node, root) with the smallest that it is connected to.

    Up to ``MOST_LOCAL`` edges go to one task. More go through rounds of large-star and small-star until
    the edges stay the same; each round is written to the shared folder, and the rows of a hub meet what
    belongs to it by broadcast. Nothing is collected but counts. Roots themselves are not among the nodes.
    """
    now = materialize(edges.where("node <> root").select(F.greatest("node", "root").alias("node"), F.least("node", "root").alias("root")).distinct(), "edges")
    if now.count() <= MOST_LOCAL:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts = [[c.to_numpy(zero_copy_only=False) for c in batch.columns] for batch in batches]
            ends = [np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*parts, strict=True)] or [np.zeros(0, np.int64)] * 2
            node, root = _minima(*ends)
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], names=["node", "root"])

        return materialize(now.select("node", "root").repartition(1).mapInArrow(run, "node bigint, root bigint"), "components")
    total = lambda df: tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("node", "root").cast("decimal(20,0)"))).first())
    lowest = lambda df: materialize(df.groupBy("node").agg(F.min("root").alias("low"), F.count(F.lit(1)).alias("n")), "lowest")
    before = total(now)
    while True:
        both = now.unionByName(now.select(F.col("root").alias("node"), F.col("node").alias("root")))
        least = lowest(both).select("node", F.least("node", "low").alias("low"), "n")
        large = join_counted(both, least, "node", "n").where("root > node").select(F.col("root").alias("node"), F.col("low").alias("root")).distinct()
        large = materialize(large, "large")
        small = (
            join_counted(large, lowest(large), "node", "n")
            .select(F.explode(F.array(F.struct(F.col("root").alias("node"), F.col("low").alias("root")), F.struct("node", F.col("low").alias("root")))).alias("e"))
            .select("e.node", "e.root")
            .where("node <> root")
            .distinct()
        )
        now = materialize(small, "edges")
        after = total(now)
        if after == before:
            return now
        before = after


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4, distance: int = 4) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id.

    Documents whose fingerprints differ in at most ``distance`` bits are linked, and component_id is
    the smallest id that links reach. Copies share a fingerprint and are one node, so the work
    depends on the distinct fingerprints only. Null ids have a place in a group but never name one,
    unless it has no other. An empty table gives no rows; other columns are ignored.
    """
    fps = materialize(fingerprints(docs, id_col, text_col, size), "fingerprints")
    distinct = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")), "distinct")
    n, both = bit_statistics(distinct)
    if n < 2:  # no other fingerprint to be near to
        named = distinct.select("fp", F.col("rep").alias("component_id"), "copies")
    else:
        _, parts = allocate(both[0], n, distance)
        buckets = distinct.select(F.col("fp").alias("node"), F.explode(bucket_rows(parts)).alias("b")).select("node", "b.*")
        ids = _lowest(components(star_edges(buckets, ["a"], [(1, distance)])), distinct.select(F.col("fp").alias("node"), "rep"))
        named = distinct.join(ids.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("low", "rep").alias("component_id"), "copies")
    named = materialize(named, "named")
    met = join_counted(fps, named, "fp", "copies")
    return met.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _lowest(linked_: DataFrame, reps: DataFrame) -> DataFrame:
    """(node, low): every node of some components (node, root), roots included, with the smallest ``rep`` of its component."""
    roots = linked_.select(F.col("root").alias("node"), "root").distinct()
    member = materialize(linked_.unionByName(roots).join(reps, "node"), "members")
    lows = materialize(member.groupBy("root").agg(F.min("rep").alias("low"), F.count(F.lit(1)).alias("members")), "lows")
    return join_counted(member, lows, "root", "members").select("node", "low")


# pairs of a shingle similarity


def _mix64(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_STEPS = np.arange(1, WORDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def wide_simhash(hashes: np.ndarray, words: int = WORDS) -> np.ndarray:
    """The words of the fingerprint of a set of shingle hashes; a bit is 1 if set in over half of them."""
    counts = np.zeros(words * BITS, np.int64)
    for at in range(0, len(hashes), 255):  # the counts of so many fit a byte
        mixed = _mix64(hashes[at : at + 255, None] + _STEPS[:words])
        bits = np.unpackbits(mixed.astype("<u8").view(np.uint8).reshape(len(mixed), -1), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, node (of the shingle set), n (its size), fp (the words) of ``docs`` (doc_id, text as binary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(text.as_py(), size) for text in batch.column(1)]
            nodes = np.array([node_of(s) for s in sets], np.uint64).view(np.int64)
            words = np.concatenate([np.zeros(0, np.uint64), *map(wide_simhash, sets)]).view(np.int64)
            lists = pa.ListArray.from_arrays(np.arange(len(sets) + 1, dtype=np.int32) * WORDS, pa.array(words))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nodes), pa.array([len(s) for s in sets], pa.int64()), lists], names=["doc_id", "node", "n", "fp"])

    return docs.mapInArrow(run, "doc_id bigint, node bigint, n bigint, fp array<bigint>")


def differing(similarity: float) -> float:
    """The share of bits in which two sets of equal size and a Jaccard similarity differ: their angle over pi."""
    return math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi


def missed(parts: list[tuple[list[int], int]], share: float) -> float:
    """The chance that a word shows a pair that differs in ``share`` of its bits in none of its parts."""
    out = 1.0
    for bits, t in parts:
        w = len(bits)
        out *= 1 - sum(math.comb(w, j) * share**j * (1 - share) ** (w - j) for j in range(t + 1))
    return out


def plan_search(both: np.ndarray, n: int, similarity: float, miss: float = MISS) -> list[list[tuple[list[int], int]]]:
    """The parts and thresholds of each word that is searched, cheapest for a predicted share of ``miss``.

    The bound of a word and the number of words go together: a low bound has few candidates and needs
    more words. Each word has the parts that its own bits ask for. If no plan for the words that there are
    misses so few, it is an error.
    """
    share, plans = differing(similarity), []
    for distance in range(2, 9):
        cost, parts = allocate(both[0], n, distance, WIDE_COSTS)
        chance = missed(parts, share)
        words = math.ceil(math.log(miss) / math.log(chance)) if 0 < chance < 1 else 1 if chance <= 0 else len(both) + 1
        if words <= len(both):
            plans.append((cost * words, distance, words))
    if not plans:
        raise ComputationError(f"{len(both)} words don't show pairs of similarity {similarity} among {n} fingerprints; ask for a higher one")
    _, distance, words = min(plans)
    return [allocate(both[k], n, distance, WIDE_COSTS)[1] for k in range(words)]


def close_pairs(distinct: DataFrame, similarity: float) -> DataFrame:
    """(node, root): candidates among ``distinct`` (node, fp), as star edges of the buckets of all words."""
    n, both = bit_statistics(distinct.select("fp"), WORDS)
    if n < 2:
        return distinct.select("node", F.col("node").alias("root")).where("false")
    arrays, first = [], 0
    for k, parts in enumerate(plan_search(both, n, similarity)):
        arrays.append(bucket_rows(parts, f"fp[{k}]", first, tuple(f"fp[{(k + j) % WORDS}]" for j in range(1, len(CODES)))))
        first += len(parts)
    buckets = distinct.select("node", F.explode(F.concat(*arrays)).alias("b")).select("node", "b.*")
    share = differing(similarity)
    # few pairs are farther: 3.5 deviations of two words, and 4 of all, where by chance none is as near
    bounds = [(words, round(bits * share + spread * math.sqrt(bits * share * (1 - share)))) for words, spread in ((2, 3.5), (len(CODES), 4.0)) for bits in (words * BITS,)]
    return star_edges(buckets, list(CODES), bounds)


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row per input row: doc_id, component_id, the smallest id of its group.

    Documents are linked if their sets of ``size``-word shingles have a Jaccard similarity of
    ``similarity`` or more, and links make groups. A text of fewer words is one shingle; null and blank
    texts are one group. Candidates come from SimHash fingerprints, by which ``MISS`` of the pairs at
    the very bound are missed by the formula and fewer above; what is linked has the similarity. Null
    ids have a place in a group but never name one, unless it has no other. An empty table gives no rows.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    found = materialize(sketches(texts, size), "sketches")
    distinct = materialize(
        found.groupBy("node").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("fp").alias("fp")), "distinct"
    )
    loose = components(close_pairs(distinct, similarity))
    roots = loose.select(F.col("root").alias("node"), "root").distinct()
    loose = materialize(loose.unionByName(roots).join(distinct.select("node", "rep", "n"), "node"), "candidates")
    sets = shingle_sets(_of_nodes(texts, loose), size)
    ids = _lowest(components(linked(loose.select("node", "root", "n"), sets, similarity)), distinct.select("node", "rep"))
    first = materialize(distinct.join(ids, "node", "left").select("node", F.coalesce("low", "rep").alias("low"), "copies"), "named")
    return join_counted(found.select("doc_id", "node"), first, "node", "copies").select("doc_id", F.col("low").alias("component_id"))


def _of_nodes(texts: DataFrame, loose: DataFrame) -> DataFrame:
    """Texts of the candidates: one id for each node is enough, null ids are looked at whole."""
    wanted = loose.where("rep is not null").select(F.col("rep").alias("doc_id")).distinct()
    named = texts.where("doc_id is not null").join(wanted.hint("merge"), "doc_id", "left_semi")
    return named.unionByName(texts.where("doc_id is null"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` that name their group in :func:`similar_groups`, with all their columns: one document of each.

    Rows without an id can't be told apart afterwards and all stay; rows that repeat an id have the
    same fate, and stay if any of them names its group.
    """
    column, gone = F.col(f"`{id_col}`"), fresh_name(docs, "gone")
    groups = similar_groups(docs.where(column.isNotNull()), id_col, text_col, size, similarity)
    # joins with the texts are by a shuffle at every size, as what goes grows with the input
    fate = groups.groupBy(F.col("doc_id").alias(gone)).agg(F.max(F.col("doc_id") == F.col("component_id")).alias("names"))
    losers = materialize(fate.where("NOT names").select(gone), "gone")
    return docs.join(losers.hint("merge"), column == F.col(gone), "left_anti")
