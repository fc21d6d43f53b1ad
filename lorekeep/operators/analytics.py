"""Graph analytics: centralities, cores, clusters, sequences, communities, flow, health.

Graphs are DataFrames ``edges`` (source_id, target_id, weight) without parallel edges, and ``nodes`` (id).
Loops write their state to the shared folder and end when nothing changes; there is no bound on rounds.
What is left of a graph goes to one task once it is small, where the rest of a loop takes no jobs.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.functions.columns import epoch, instant, seconds_between
from lorekeep.operators.links import attached, degrees
from lorekeep.session import materialize

#: Edges that betweenness and path lengths broadcast at most; beyond them they go by joins.
MOST_EDGES = 2_000_000
#: Keys, a node in one of several searches each, that a task holds at once.
MOST_KEYS = 500_000
#: The shortest that an edge is taken for.
LEAST_LENGTH = 1e-9
#: Edges that one task takes over from a loop.
MOST_LOCAL = 1_000
#: Links, each seen from both ends, of the nodes of a level of communities that one task moves one after another; and of a coarser level.
MOST_IN_TURN, MOST_COARSE = 20_000, 300_000
#: A level ends with a round that brings less than this share of what all its rounds brought; what is left moves on coarser levels.
LEAST_GAIN = 0.01
#: Distinct seconds of an island that one task folds.
MOST_SECONDS = 100_000
#: Rows of (source, node) that the joins of path lengths hold at once, about.
MOST_PAIRS = 200_000_000

Pairs = list[tuple[str, str]]


def simple_graph(links: DataFrame, memories: DataFrame) -> DataFrame:
    """One edge a pair of memories; of parallel links the weight of the last id counts."""
    return attached(links, memories).groupBy("source_id", "target_id").agg(F.max_by("weight", "id").alias("weight"))


def _in_one_task(edges: DataFrame, solve: Callable[[Pairs], dict[str, str]], name: str) -> DataFrame:
    """(id, ``name``) that ``solve`` makes of all edges, which are few."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs: Pairs = []
        for batch in batches:
            pairs += zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
        found = solve(pairs)
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.string())], names=["id", name])

    return edges.select("source_id", "target_id").repartition(1).mapInArrow(run, f"id string, {name} string")


def _count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"))


def in_degree_centrality(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """id, centrality: incoming edges over n - 1."""
    rows = nodes.select("id").join(degrees(edges).select("id", "in_degree"), "id", "left").crossJoin(F.broadcast(_count(nodes)))
    return rows.select("id", F.when(F.col("n") > 1, F.coalesce("in_degree", F.lit(0)) / (F.col("n") - 1)).otherwise(0.0).alias("centrality"))


def pagerank(edges: DataFrame, nodes: DataFrame, rounds: int = 10, damping: float = 0.85, cut: int = 2, tolerance: float | None = None) -> DataFrame:
    """id, rank after ``rounds`` power steps by edge weight; nodes without outgoing edges spread evenly.

    A round reads the ranks twice, so they are written every ``cut`` rounds lest the plan double each time.

    With ``tolerance`` it ends once the ranks move by less than tolerance * n in all.
    """
    n = max(1, nodes.count())
    edges = materialize(edges.select("source_id", "target_id", "weight"), "weights")
    out = edges.groupBy(F.col("source_id").alias("id")).agg(F.sum("weight").alias("out"))
    share = materialize(edges.join(out, edges["source_id"] == out["id"]).select("source_id", "target_id", (F.col("weight") / F.col("out")).alias("share")), "shares")
    base = materialize(nodes.select("id").join(out.select("id", F.lit(True).alias("gives")), "id", "left"), "nodes")
    ranks = base.select("id", "gives", F.lit(1.0 / n).alias("rank"))
    for i in range(1, rounds + 1):
        sent = ranks.select(F.col("id").alias("source_id"), "rank").join(share, "source_id").groupBy(F.col("target_id").alias("id")).agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        idle = ranks.agg(F.coalesce(F.sum(F.when(F.col("gives").isNull(), F.col("rank"))), F.lit(0.0)).alias("idle"))
        new = (1 - damping) / n + damping * (F.coalesce("got", F.lit(0.0)) + F.col("idle") / n)
        after = base.join(sent, "id", "left").crossJoin(F.broadcast(idle)).select("id", "gives", new.alias("rank"))
        if i % cut == 0 or tolerance is not None:
            after = materialize(after, "ranks")
        if tolerance is not None:
            moved = after.join(ranks.select("id", F.col("rank").alias("old")), "id").agg(F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0]
            if (moved or 0.0) < tolerance * n:
                return after.select("id", "rank")
        ranks = after
    return ranks.select("id", "rank")


class _Graph:
    """Edges by number, in order of their sources, as arrays that a broadcast can carry."""

    def __init__(self, names: list[str], source: np.ndarray, target: np.ndarray, length: np.ndarray):
        order = np.lexsort((target, source))
        self.names, self.target, self.length = names, target[order], length[order]
        self.degree = np.bincount(source, minlength=len(names))
        self.first = np.cumsum(self.degree) - self.degree

    def number(self) -> dict[str, int]:
        return {name: i for i, name in enumerate(self.names)}

    def ahead(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(from, to, edge) of all edges of some keys; a key is a node's number, plus that of its search times all nodes."""
        node = at % len(self.names)
        rows, edge = _spread(self.first[node], self.degree[node])
        return at[rows], self.target[edge] + (at - node)[rows], edge


def _spread(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) for the ``count`` places from ``first`` on of each row."""
    rows = np.repeat(np.arange(len(count)), count)
    return rows, np.arange(len(rows)) + np.repeat(first - (np.cumsum(count) - count), count)


def _once(keys: np.ndarray, mark: np.ndarray) -> np.ndarray:
    """Each key once; ``mark`` is room for all keys."""
    mark[keys] = np.arange(len(keys))
    return keys[mark[keys] == np.arange(len(keys))]


def _adjacency(edges: DataFrame) -> _Graph | None:
    """All edges on the driver if there are at most ``MOST_EDGES``."""
    rows = edges.select("source_id", "target_id", F.col("weight").cast("double").alias("weight")).limit(MOST_EDGES + 1).toArrow()
    if len(rows) > MOST_EDGES:
        return None
    ends = pa.concat_arrays([*rows.column(0).chunks, *rows.column(1).chunks]) if len(rows) else pa.array([], pa.string())
    coded = ends.dictionary_encode()
    at = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return _Graph(coded.dictionary.to_pylist(), at[: len(rows)], at[len(rows) :], rows.column(2).to_numpy().astype(np.float64))


def _hops(graph: _Graph, starts: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Hops from each start to all nodes (by key, -1: none), and the links (from, to) of the shortest paths, level by level."""
    size = len(graph.names)
    far, mark = np.full(len(starts) * size, -1, np.int32), np.empty(len(starts) * size, np.int32)
    front, levels = np.arange(len(starts)) * size + starts, []
    far[front] = 0
    while len(front):
        at, to, _ = graph.ahead(front)
        fresh = far[to] < 0
        at, to = at[fresh], to[fresh]
        levels.append((at, to))
        far[to] = len(levels)
        front = _once(to, mark)
    return far, levels


class _Reach:
    """Which searches have come to each node, as bits, a word for 64 searches; all searches take a hop at once."""

    #: Words that a hop over all edges gathers at most, words of a node, and edges into a node that are taken one by one.
    ROOM, WORDS, SINGLE = 1 << 23, 16, 8

    def __init__(self, graph: _Graph):
        self.graph, source = graph, np.repeat(np.arange(len(graph.names)), graph.degree)
        self.words = min(self.WORDS, max(1, self.ROOM // max(1, len(source))))
        order = np.argsort(graph.target, kind="stable")
        heads, first, count = np.unique(graph.target[order], return_index=True, return_counts=True)
        most = np.argsort(-count, kind="stable")
        self.heads, first, count = heads[most], first[most], count[most]
        # the k-th edge into each node that has so many; what is left of nodes with many more
        self.single = [source[order[first[: (count > k).sum()] + k]] for k in range(min(self.SINGLE, int(count.max(initial=0))))]
        left = count[count > self.SINGLE] - self.SINGLE
        self.rest = source[order[_spread(first[: len(left)] + self.SINGLE, left)[1]]]
        self.starts = np.cumsum(left) - left

    def _over_all(self, front: np.ndarray) -> np.ndarray:
        """What comes to ``heads`` over all edges."""
        out = front[self.single[0]]
        for source in self.single[1:]:
            out[: len(source)] |= front[source]
        if len(self.rest):
            out[: len(self.starts)] |= np.bitwise_or.reduceat(front[self.rest], self.starts, axis=0)
        return out

    def _over_some(self, at: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nodes behind the edges of ``at``, and what comes to them."""
        rows, edge = _spread(self.graph.first[at], self.graph.degree[at])
        order = np.argsort(self.graph.target[edge], kind="stable")
        to = self.graph.target[edge[order]]
        starts = np.flatnonzero(np.r_[True, to[1:] != to[:-1]])
        return to[starts], np.bitwise_or.reduceat(bits[rows[order]], starts, axis=0)

    def hops(self, starts: np.ndarray) -> Iterator[int]:
        """How many pairs of a start and a node are 1, 2, ... hops apart."""
        nth = np.arange(len(starts))
        seen = np.zeros((len(self.graph.names), -(-len(starts) // 64)), np.uint64)
        np.bitwise_or.at(seen, (starts, nth // 64), np.uint64(1) << (nth % 64).astype(np.uint64))
        at = np.unique(starts)
        bits = seen[at]
        while edges := int(self.graph.degree[at].sum()):
            if 4 * edges < len(self.graph.target):
                to, got = self._over_some(at, bits)
            else:
                front = np.zeros_like(seen)
                front[at] = bits
                to, got = self.heads, self._over_all(front)
            got &= ~seen[to]
            new = got.any(axis=1)
            at, bits = to[new], got[new]
            if not len(at):
                return
            seen[at] |= bits
            yield int(np.bitwise_count(bits).sum(dtype=np.int64))


def _lengths(graph: _Graph, starts: np.ndarray) -> np.ndarray:
    """The length of the shortest path from each start to all nodes, by key; infinite: none.

    What is nearest goes first, about as far as an edge is long; a node whose length falls later goes again.
    """
    size = len(graph.names)
    far, mark = np.full(len(starts) * size, np.inf), np.empty(len(starts) * size, np.int32)
    open_ = np.arange(len(starts)) * size + starts
    far[open_] = 0.0
    step = float(graph.length.mean()) if len(graph.length) else 1.0
    while len(open_):
        there = far[open_]
        near = there <= there.min() + step
        at, to, edge = graph.ahead(open_[near])
        reached = far[at] + graph.length[edge]
        shorter = reached < far[to]
        to = to[shorter]
        np.minimum.at(far, to, reached[shorter])
        open_ = _once(np.concatenate([open_[~near], to]), mark)
    return far


def _levels_by_length(graph: _Graph, starts: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Links of the shortest paths by length as in :func:`_hops`, each after all links to its beginning; and the starts for which that fails.

    It fails where an edge is too short to change a sum, so that links go round.
    """
    size, far = len(graph.names), _lengths(graph, starts)
    known = np.flatnonzero(np.isfinite(far))
    at, to, edge = graph.ahead(known)
    front = np.arange(len(starts)) * size + starts
    tight = (far[at] + graph.length[edge] == far[to]) & (at != to)
    tight[tight] = far[to[tight]] > 0
    at, to = at[tight], to[tight]  # in order of their beginnings
    count = np.bincount(at, minlength=len(far))
    first, left = np.cumsum(count) - count, np.bincount(to, minlength=len(far))
    mark, done, levels = np.empty(len(far), np.int32), np.zeros(len(far), bool), []
    while len(front):
        done[front] = True
        rows, place = _spread(first[front], count[front])
        here, there = front[rows], to[place]
        levels.append((here, there))
        np.subtract.at(left, there, 1)
        front = _once(there[left[there] == 0], mark)
    return levels, np.unique(known[~done[known]] // size)


def _from_source(graph: _Graph, source: int) -> dict[int, float]:
    """The dependencies of the nodes on the shortest paths from a source (Brandes 2001), one node after another."""
    done: list[int] = []
    before: dict[int, list[int]] = {source: []}
    ways, far, settled = {source: 1.0}, {source: 0.0}, set()
    queue = [(0.0, source)]
    while queue:
        d, v = heapq.heappop(queue)
        if v in settled:
            continue
        settled.add(v)
        done.append(v)
        for at in range(graph.first[v], graph.first[v] + graph.degree[v]):
            w, there = int(graph.target[at]), d + graph.length[at]
            if w == v:
                continue
            if w not in far or there < far[w]:
                far[w], ways[w], before[w] = there, ways[v], [v]
                heapq.heappush(queue, (there, w))
            elif there == far[w] and w not in settled:
                ways[w] += ways[v]
                before[w].append(v)
    depend = dict.fromkeys(done, 0.0)
    for w in reversed(done):
        for v in before[w]:
            depend[v] += ways[v] / ways[w] * (1 + depend[w])
    depend.pop(source)
    return depend


def _depend_on(graph: _Graph, starts: np.ndarray, weighted: bool) -> np.ndarray:
    """For each node the dependencies of some sources on it, all sources at once."""
    size, odd = len(graph.names), np.array([], np.int64)
    if weighted:
        levels, odd = _levels_by_length(graph, starts)
    else:
        levels = _hops(graph, starts)[1]
    ways, depend = np.zeros(len(starts) * size), np.zeros(len(starts) * size)
    ways[np.arange(len(starts)) * size + starts] = 1.0
    for at, to in levels:
        np.add.at(ways, to, ways[at])
    for at, to in reversed(levels):
        np.add.at(depend, at, ways[at] / ways[to] * (1 + depend[to]))
    depend = depend.reshape(len(starts), size)
    depend[np.arange(len(starts)), starts] = 0.0
    depend[odd] = 0.0
    out = depend.sum(0)
    for k in odd.tolist():
        for v, x in _from_source(graph, int(starts[k])).items():
            out[v] += x
    return out


def _numbered(graph: _Graph, batches: Iterator[pa.RecordBatch], block: int | None = None) -> Iterator[np.ndarray]:
    """The sources of some batches that have edges, by number, in blocks of ``block`` or else of about ``MOST_KEYS`` keys."""
    number, block = graph.number(), block or max(1, MOST_KEYS // max(1, len(graph.names)))
    for batch in batches:
        known = np.array([number[x] for x in batch.column(0).to_pylist() if x in number], np.int64)
        for at in range(0, len(known), block):
            yield known[at : at + block]


def _dealt(nodes: DataFrame) -> DataFrame:
    """The nodes as sources, in some tasks a core, as their searches take unlike times."""
    return nodes.select("id").repartition(4 * nodes.sparkSession.sparkContext.defaultParallelism, "id")


def _dependencies(graph: _Graph, nodes: DataFrame, weighted: bool) -> DataFrame:
    """(id, x): for each node the dependencies of all sources on it, from a broadcast adjacency."""
    shared = nodes.sparkSession.sparkContext.broadcast(graph)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph = shared.value
        total = np.zeros(len(graph.names))
        for starts in _numbered(graph, batches):
            total += _depend_on(graph, starts, weighted)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([graph.names[i] for i in some.tolist()], pa.string()), pa.array(total[some])], names=["id", "x"])

    return _dealt(nodes).mapInArrow(run, "id string, x double").groupBy("id").agg(F.sum("x").alias("x"))


def _source_blocks(nodes: DataFrame) -> Iterator[DataFrame]:
    """The nodes in blocks of so many that a block times all nodes is about ``MOST_PAIRS`` rows."""
    blocks = max(1, math.ceil(nodes.count() ** 2 / MOST_PAIRS))
    for k in range(blocks):
        yield nodes.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == k).select(F.col("id").alias("source"))


def _distances(steps: DataFrame, sources: DataFrame) -> DataFrame:
    """(source, id, far): the length of the shortest path to all that a source reaches, by rounds of joins."""
    far = materialize(sources.select("source", F.col("source").alias("id"), F.lit(0.0).alias("far"), F.lit(True).alias("new")), "far")
    while not (front := far.where("new")).isEmpty():
        there = front.select("source", F.col("id").alias("source_id"), "far").join(steps, "source_id")
        there = there.groupBy("source", F.col("target_id").alias("id")).agg(F.min(F.col("far") + F.col("length")).alias("there"))
        met = far.select("source", "id", "far").join(there, ["source", "id"], "full")
        shorter = F.col("far").isNull() | (F.col("there") < F.col("far"))
        far = materialize(met.select("source", "id", F.least("far", "there").alias("far"), F.coalesce(shorter, F.lit(False)).alias("new")), "far")
    return far.select("source", "id", "far")


def _steps(edges: DataFrame, weighted: bool) -> DataFrame:
    length = F.col("weight").cast("double") if weighted else F.lit(1.0)
    return materialize(edges.where("source_id <> target_id").select("source_id", "target_id", length.alias("length")), "steps")


def _sum_along(links: DataFrame, start: DataFrame, at: str, to: str, factor: Column) -> DataFrame:
    """(source, id, x): x = start + sum of factor * x of the nodes before, over an acyclic graph of links for each source.

    Rounds send on only what came in the round before, so the sums are complete when nothing is sent.
    """
    total = sent = materialize(start, "sums")
    while not sent.isEmpty():
        met = sent.select("source", F.col("id").alias(at), "x").join(links, ["source", at])
        sent = materialize(met.groupBy("source", F.col(to).alias("id")).agg(F.sum(F.col("x") * factor).alias("x")), "sent")
        total = materialize(total.unionByName(sent).groupBy("source", "id").agg(F.sum("x").alias("x")), "sums")
    return total


def _dependencies_by_joins(edges: DataFrame, nodes: DataFrame, weighted: bool) -> DataFrame:
    """As :func:`_dependencies`, for graphs that are too large to broadcast; blocks of sources one after another."""
    steps, out = _steps(edges, weighted), None
    for sources in _source_blocks(nodes):
        far = _distances(steps, sources)
        ahead = far.select("source", F.col("id").alias("target_id"), F.col("far").alias("there"))
        met = far.withColumnRenamed("id", "source_id").join(steps, "source_id").join(ahead, ["source", "target_id"])
        links = materialize(met.where(F.col("far") + F.col("length") == F.col("there")).select("source", "source_id", "target_id"), "links")
        ways = _sum_along(links, sources.select("source", F.col("source").alias("id"), F.lit(1.0).alias("x")), "source_id", "target_id", F.lit(1.0))
        of = lambda end: ways.select("source", F.col("id").alias(end), F.col("x").alias(f"ways_{end}"))  # noqa: B023, E731
        shared = materialize(links.join(of("source_id"), ["source", "source_id"]).join(of("target_id"), ["source", "target_id"]), "shares")
        part = F.col("ways_source_id") / F.col("ways_target_id")
        # depend(v) = sum of share * (1 + depend(w)) over the nodes w behind v
        first = shared.groupBy("source", F.col("source_id").alias("id")).agg(F.sum(part).alias("x"))
        depend = _sum_along(shared, first, "target_id", "source_id", part).where("id <> source").groupBy("id").agg(F.sum("x").alias("x"))
        out = depend if out is None else materialize(out.unionByName(depend).groupBy("id").agg(F.sum("x").alias("x")), "depend")
    return out


def betweenness(edges: DataFrame, nodes: DataFrame, weighted: bool = False) -> DataFrame:
    """id, betweenness: the share of shortest paths through each node, over (n - 1)(n - 2).

    With ``weighted`` the weight of an edge is its length, and one of ``LEAST_LENGTH`` or less counts as so long, lest
    paths go round for nothing. Sources are dealt over the cluster with a
    broadcast adjacency, or, if that has over ``MOST_EDGES`` edges, paths grow by joins.
    """
    if weighted:
        edges = edges.withColumn("weight", F.greatest(F.col("weight").cast("double"), F.lit(LEAST_LENGTH)))
    adjacency = _adjacency(edges)
    sums = _dependencies_by_joins(edges, nodes, weighted) if adjacency is None else _dependencies(adjacency, nodes, weighted)
    rows = nodes.select("id").join(sums, "id", "left").crossJoin(F.broadcast(_count(nodes)))
    pairs = (F.col("n") - 1) * (F.col("n") - 2)
    return rows.select("id", F.when(pairs > 0, F.coalesce("x", F.lit(0.0)) / pairs).otherwise(0.0).alias("betweenness"))


def path_statistics(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """pairs, mean_length, diameter over all ordered pairs that a path joins (unweighted)."""
    adjacency = _adjacency(edges)
    if adjacency is None:
        steps, found = _steps(edges, False), None
        for sources in _source_blocks(nodes):
            one = _distances(steps, sources).where("id <> source").agg(F.count(F.lit(1)).alias("n"), F.sum("far").alias("total"), F.max("far").cast("bigint").alias("most"))
            one = materialize(one, "lengths")
            found = one if found is None else found.unionByName(one)
    else:
        shared = edges.sparkSession.sparkContext.broadcast(adjacency)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n = total = most = 0
            reach = _Reach(shared.value)
            for starts in _numbered(shared.value, batches, 64 * reach.words):
                for hop, pairs in enumerate(reach.hops(starts), 1):
                    n, total, most = n + pairs, total + hop * pairs, max(most, hop)
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([float(total)]), pa.array([most], pa.int64())], names=["n", "total", "most"])

        found = _dealt(nodes).mapInArrow(run, "n bigint, total double, most bigint")
    return found.agg(F.sum("n").alias("pairs"), (F.sum("total") / F.sum("n")).alias("mean_length"), F.coalesce(F.max("most"), F.lit(0)).alias("diameter"))


def forgetting_scores(memories: DataFrame, links: DataFrame, context_members: DataFrame, now, weights: tuple[float, float, float] = (0.4, 0.3, 0.3), with_betweenness: bool = True, rounds: int = 100) -> DataFrame:
    """How forgettable each memory is, from age, confidence and centrality (weights in this order)."""
    nodes, edges = memories.select("id"), materialize(simple_graph(links, memories), "edges")
    rank = pagerank(edges, nodes, rounds, tolerance=1e-6 if rounds > 20 else None)
    parts = in_degree_centrality(edges, nodes).join(rank, "id")
    between = F.lit(0.0)
    if with_betweenness:
        parts = parts.join(betweenness(edges, nodes, weighted=True), "id")
        between = F.col("betweenness")
    age = seconds_between(F.col("timestamp"), instant(now))
    oldest = memories.agg(F.max(age).alias("oldest"))
    refs = context_members.select("context_id", F.col("memory_id").alias("id")).distinct().groupBy("id").agg(F.count(F.lit(1)).alias("refs"))
    rows = memories.crossJoin(F.broadcast(oldest)).join(parts, "id").join(degrees(edges), "id", "left").join(refs, "id", "left")
    recency = F.when(F.col("oldest") > 0, 1 - age / F.col("oldest")).otherwise(1.0)
    centrality = (F.col("centrality") + F.col("rank") + between) / 3
    a, b, c = weights
    return rows.select(
        "id", "confidence", centrality.alias("centrality"), recency.alias("recency"),
        *[F.coalesce(x, F.lit(0)).alias(x) for x in ("in_degree", "out_degree")], F.coalesce("refs", F.lit(0)).alias("context_references"),
        (a * (1 - recency) + b * (1 - F.col("confidence")) + c * (1 - centrality)).alias("score"),
    )


def undirected(edges: DataFrame) -> DataFrame:
    """(a, b) in both directions, without loops, each once."""
    pair = F.explode(F.array(F.struct(F.col("source_id").alias("a"), F.col("target_id").alias("b")), F.struct(F.col("target_id").alias("a"), F.col("source_id").alias("b"))))
    return edges.where("source_id <> target_id").select(pair.alias("p")).select("p.a", "p.b").distinct()


def _core_of(pairs: Pairs, k: int) -> dict[str, str]:
    near: dict[str, set[str]] = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
    weak = [v for v, n in near.items() if len(n) < k]
    while weak:
        for w in near.pop(v := weak.pop(), ()):
            if w in near:
                near[w].discard(v)
                if len(near[w]) == k - 1:
                    weak.append(w)
    return {v: v for v in near}


def k_core(edges: DataFrame, k: int) -> DataFrame:
    """Ids of the largest subgraph in which every node has at least k neighbours.

    Weak nodes go round by round until there are none, or until the rest fits one task.
    """
    left = materialize(undirected(edges), "core")
    while (size := left.count()) > MOST_LOCAL:
        strong = left.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= k).select("a")
        kept = left.join(strong, "a", "left_semi").join(strong.withColumnRenamed("a", "b"), "b", "left_semi").select("a", "b")
        left = materialize(kept, "core")
        if left.count() == size:
            return left.select(F.col("a").alias("id")).distinct()
    rest = left.select(F.col("a").alias("source_id"), F.col("b").alias("target_id"))
    return _in_one_task(rest, lambda pairs: _core_of(pairs, k), "core").select("id")


def core_abstractions(edges: DataFrame, ks: tuple[int, ...] = (3, 4, 5), sizes: tuple[int, int] = (3, 10)) -> DataFrame:
    """kind, name, size, quality of the k-cores of a fitting size."""
    out = None
    for k in ks:
        row = _count(k_core(edges, k)).where(F.col("n").between(*sizes)).select(
            F.lit("core").alias("kind"), F.lit(f"{k}-core").alias("name"), F.col("n").alias("size"), F.lit(0.7 + 0.05 * k).alias("quality")
        )
        out = row if out is None else out.unionByName(row)
    return out


def topic_of(metadata: str = "metadata") -> Column:
    return F.coalesce(F.get_json_object(metadata, "$.topic"), F.lit("unknown"))


def group_density(members: DataFrame, edges: DataFrame) -> DataFrame:
    """For members (group, id): group, size, edges, density of the subgraph that a group induces."""
    sizes = members.groupBy("group").agg(F.count(F.lit(1)).alias("size"))
    of = members.select(F.col("id"), "group")
    inner = (
        edges.join(of.withColumnRenamed("id", "source_id"), "source_id")
        .join(of.select(F.col("id").alias("target_id"), F.col("group").alias("other")), "target_id")
        .where(F.col("group") == F.col("other")).groupBy("group").agg(F.count(F.lit(1)).alias("edges"))
    )
    rows = sizes.join(inner, "group", "left").withColumn("edges", F.coalesce("edges", F.lit(0)))
    possible = F.col("size") * (F.col("size") - 1)
    return rows.withColumn("density", F.when(possible > 0, F.col("edges") / possible).otherwise(0.0))


def topic_clusters(memories: DataFrame, edges: DataFrame, sizes: tuple[int, int] = (3, 10), min_density: float = 0.2) -> DataFrame:
    """Topics whose memories are few and densely linked: topic, size, edges, density, quality."""
    members = memories.select(topic_of().alias("group"), "id")
    rows = group_density(members, edges).where(F.col("size").between(*sizes) & (F.col("density") > min_density))
    return rows.select(F.col("group").alias("topic"), "size", "edges", "density", (0.5 + 0.5 * F.col("density")).alias("quality"))


def sequence_windows(memories: DataFrame, seconds: int = 3600) -> DataFrame:
    """id, start: the window of each memory in time order.

    A window begins at the first memory after the one before it and takes all within ``seconds``. Times
    are first cut where a whole stretch of ``seconds`` is empty, which always begins a window. Within such
    an island distinct seconds are folded; an island with over ``MOST_SECONDS`` of them goes by joins.
    """
    rows = memories.where("timestamp is not null").select("id", epoch(F.col("timestamp")).alias("s")).withColumn("bucket", F.floor(F.col("s") / seconds))
    order = Window.orderBy("bucket")
    buckets = rows.select("bucket").distinct().withColumn("new", F.when(F.col("bucket") - F.lag("bucket").over(order) > 1, 1).otherwise(0))
    islands = buckets.select("bucket", F.sum("new").over(order).alias("island"))
    times = materialize(rows.select("s", "bucket").distinct().join(islands, "bucket").select("island", "s"), "times")
    sizes = times.groupBy("island").agg(F.count(F.lit(1)).alias("n"))
    large = materialize(sizes.where(F.col("n") > MOST_SECONDS).select("island"), "islands")
    none = F.array().cast("array<bigint>")

    def fold(starts: Column, s: Column) -> Column:
        return F.when((F.size(starts) == 0) | (s - F.element_at(starts, -1) > seconds), F.concat(starts, F.array(s))).otherwise(starts)

    small = times.join(large, "island", "left_anti").groupBy("island").agg(F.sort_array(F.collect_list("s")).alias("all"))
    starts = small.select(F.explode(F.aggregate("all", none, fold)).alias("start"))
    if not large.isEmpty():
        starts = starts.unionByName(_window_starts(times.join(large, "island", "left_semi"), seconds))
    # a window's rows stand in its own bucket or the next
    wide = starts.select("start", F.explode(F.array(F.floor(F.col("start") / seconds), F.floor(F.col("start") / seconds) + 1)).alias("bucket"))
    met = rows.join(wide, "bucket").where((F.col("s") >= F.col("start")) & (F.col("s") <= F.col("start") + seconds))
    return met.groupBy("id").agg(F.max("start").alias("start"))


def _window_starts(times: DataFrame, seconds: int) -> DataFrame:
    """start of all windows of some islands (island, s).

    Each second knows where the next window would begin if one began there. From the first second of an
    island as many starts again are found in every round, by steps that are twice as long.
    """
    bucket = lambda s: F.floor(s / seconds).alias("bucket")
    ends = times.select("island", bucket(F.col("s") + seconds), (F.col("s") + seconds).alias("x"), F.lit(1).alias("asks"))
    both = times.select("island", bucket(F.col("s")), F.col("s").alias("x"), F.lit(0).alias("asks")).unionByName(ends)
    # from the latest on, an end sees the earliest second after it in its own stretch
    after = Window.partitionBy("island", "bucket").orderBy(F.desc("x"), F.desc("asks"))
    seen = F.last(F.when(F.col("asks") == 0, F.col("x")), ignorenulls=True).over(after.rowsBetween(Window.unboundedPreceding, 0))
    asked = both.withColumn("next", seen).where("asks = 1")
    firsts = times.groupBy("island", bucket(F.col("s"))).agg(F.min("s").alias("first"))
    later = firsts.select("island", (F.col("bucket") - 1).alias("bucket"), F.col("first").alias("later"))
    # islands have no empty stretch, so the next one after an end's is there unless the island ends
    steps = asked.join(later, ["island", "bucket"], "left").select(F.col("x") - seconds, F.coalesce("next", "later")).toDF("s", "to").where("`to` IS NOT NULL")
    steps = materialize(steps, "steps")
    starts = materialize(times.groupBy("island").agg(F.min("s").alias("start")).select("start"), "starts")
    size, before = starts.count(), 0
    while size > before:
        more = starts.join(steps, F.col("start") == F.col("s")).select(F.col("to").alias("start"))
        starts = materialize(starts.unionByName(more).distinct(), "starts")
        size, before = starts.count(), size
        there = steps.select(F.col("s").alias("to"), F.col("to").alias("far"))
        steps = materialize(steps.join(there, "to").select("s", F.col("far").alias("to")), "steps")
    return starts


def temporal_sequences(memories: DataFrame, edges: DataFrame, seconds: int = 3600, sizes: tuple[int, int] = (3, 10)) -> DataFrame:
    """Windows of a fitting size with at least one edge inside: start, size, edges, quality."""
    members = sequence_windows(memories, seconds).withColumnRenamed("start", "group")
    rows = group_density(members, edges).where(F.col("size").between(*sizes) & (F.col("edges") > 0))
    return rows.select(F.col("group").alias("start"), "size", "edges", (0.4 + 0.6 * F.col("edges") / F.col("size")).alias("quality"))


def _around(edges: DataFrame) -> DataFrame:
    """(id, other, weight) in both directions, the weight of a pair summed up; no loops."""
    both = edges.select(F.col("source_id").alias("id"), F.col("target_id").alias("other"), "weight").unionByName(edges.select(F.col("target_id").alias("id"), F.col("source_id").alias("other"), "weight"))
    return materialize(both.where("id <> other").groupBy("id", "other").agg(F.sum("weight").cast("double").alias("weight")), "around")


def _first_of_neighbours(want: DataFrame, around: DataFrame, round_: int) -> DataFrame:
    """Of neighbours among ``want`` (id, ...) those whose hash in this round is the greatest, so no two of them are neighbours."""
    turns = want.withColumn("turn", F.md5(F.concat(F.lit(f"{round_}:"), "id")))
    rival = around.join(turns.select(F.col("id").alias("other"), F.col("turn").alias("theirs")), "other").groupBy("id").agg(F.max("theirs").alias("theirs"))
    return turns.join(rival, "id", "left").where("theirs IS NULL OR turn > theirs").drop("turn", "theirs")


def label_propagation(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """id, community by weighted label propagation to a fixed point; deterministic.

    A node wants the label with the most weight around it, the smallest of equals, if it has more than
    its own. Of neighbours that want to change, in each round that goes first whose hash is greater;
    so no two of them change at once, every change adds weight inside communities, and the rounds come to
    an end. Nodes without edges keep their own label.
    """
    around = _around(edges)
    labels, round_ = materialize(nodes.select("id", F.col("id").alias("community")), "labels"), 0
    while True:
        weight = around.join(labels.select(F.col("id").alias("other"), "community"), "other").groupBy("id", "community").agg(F.round(F.sum("weight"), 9).alias("w"))
        mine = weight.join(labels, ["id", "community"]).select("id", F.col("w").alias("own"))
        best = weight.groupBy("id").agg(F.min(F.struct(-F.col("w"), "community")).alias("best")).select("id", F.col("best.community").alias("next"), (-F.col("best.col1")).alias("top"))
        want = materialize(best.join(mine, "id", "left").where(F.col("top") > F.coalesce("own", F.lit(0.0))).select("id", "next"), "want")
        if want.isEmpty():
            return labels
        first = _first_of_neighbours(want, around, round_).select("id", "next")
        labels = materialize(labels.join(first, "id", "left").select("id", F.coalesce("next", "community").alias("community")), "labels")
        round_ += 1


def communities(edges: DataFrame, nodes: DataFrame, resolution: float = 1.0) -> DataFrame:
    """id, community (its smallest id) by modularity, level by level (Blondel et al. 2008); deterministic.

    On each level nodes move to the community that gains the most modularity, and then the communities are the
    nodes of the next level, until nothing moves. Once a coarser level has at most ``MOST_COARSE`` links, one task does it and
    all after it, which writes no tables. A greater ``resolution`` makes more communities. Weights, of both
    directions together, are 0 or more; nodes without edges are alone.
    """
    around = _around(edges)
    loops = edges.where("source_id = target_id").groupBy(F.col("source_id").alias("id")).agg((2 * F.sum("weight")).cast("double").alias("loop"))
    strength = around.groupBy("id").agg(F.sum("weight").alias("weight"))
    sizes = nodes.select("id").join(strength, "id", "left").join(loops, "id", "left")
    sizes = materialize(sizes.select("id", (F.coalesce("weight", F.lit(0.0)) + F.coalesce("loop", F.lit(0.0))).alias("k")), "strength")
    total = sizes.agg(F.sum("k")).first()[0] or 0.0
    members = nodes.select("id", F.col("id").alias("community"))
    level = 0
    while total > 0:
        if level and around.count() <= MOST_COARSE:
            moved = materialize(_levels_in_turn(around, sizes, total, resolution), "moved")
            to = moved.select(F.col("id").alias("community"), F.col("community").alias("next"))
            members = materialize(members.join(to, "community").select("id", F.col("next").alias("community")), "members")
            break
        moved = _local_moves(around, sizes, total, resolution)
        level += 1
        if moved is None:
            break
        to = moved.select(F.col("id").alias("community"), F.col("community").alias("next"))
        members = materialize(members.join(to, "community").select("id", F.col("next").alias("community")), "members")
        of = lambda end: moved.select(F.col("id").alias(end), F.col("community").alias(f"of_{end}"))  # noqa: B023, E731
        coarse = around.join(of("id"), "id").join(of("other"), "other").where("of_id <> of_other")
        around = materialize(coarse.groupBy(F.col("of_id").alias("id"), F.col("of_other").alias("other")).agg(F.sum("weight").alias("weight")), "around")
        sizes = materialize(moved.groupBy(F.col("community").alias("id")).agg(F.sum("k").alias("k")), "strength")
    names = members.groupBy("community").agg(F.min("id").alias("least"))
    return members.join(names, "community").select("id", F.col("least").alias("community"))


def _local_moves(around: DataFrame, sizes: DataFrame, total: float, resolution: float) -> DataFrame | None:
    """(id, community, k) when moves gain no modularity, or a round little (``LEAST_GAIN``), or None if none gains to begin with.

    Nodes that move at once may gain less than each alone would. Rounds try a half of all moves, by a hash; a round
    that doesn't raise the modularity is taken back, and from there on no two neighbours move at once; if that doesn't either,
    of all moves that leave or enter a community only one is made, whose gain is then what it was computed as. So the modularity
    rises with every round that counts. A round of halves writes one table, whose sums one job brings. Once the nodes that
    want to move have at most ``MOST_IN_TURN`` links, one task moves them one after another, each by what it gains then.
    """
    labels = sizes.select("id", F.col("id").alias("community"), "k")
    last: tuple[float, int, int, DataFrame] | None = None
    moved, way, round_, in_turn, begin = False, 0, 0, False, 0.0
    while True:
        known = _scored(around, labels, total, resolution)
        now, wanting, links = _modularity(known, total, resolution)
        if last is None or now > last[0]:
            slow = last is not None and now - last[0] < LEAST_GAIN * (now - begin)
            begin = begin if last else now
            moved, last = last is not None, (now, wanting, links, known)
            if slow:
                way = 3
        else:
            way = 3 if in_turn else way + 1
        _, wanting, links, known = last
        if not wanting or way > 2:  # nothing is to gain, or little, or less than the rounding of sums
            return known.select("id", F.col("own").alias("community"), "k") if moved else None
        in_turn = links <= MOST_IN_TURN
        if in_turn:
            first = _moves_in_turn(around, known, total, resolution)
            labels = materialize(known.join(first, "id", "left").select("id", F.coalesce("to", "own").alias("community"), "k"), "labels")
        elif way == 0:
            half = F.pmod(F.xxhash64("id", F.lit(round_)), F.lit(2)) == 0
            labels = known.select("id", F.when(half, F.col("next")).otherwise(F.col("own")).alias("community"), "k")
        else:
            want = known.where("next <> own").select("id", "own", "next")
            some = _first_of_neighbours(want, around, round_) if way == 1 else _one_a_community(want, round_)
            first = some.select("id", F.col("next").alias("to"))
            labels = materialize(known.join(first, "id", "left").select("id", F.coalesce("to", "own").alias("community"), "k"), "labels")
        round_ += 1


def _scored(around: DataFrame, labels: DataFrame, total: float, resolution: float) -> DataFrame:
    """id, own, k, next (the best community, its own among equals, else the smallest), inside (weight to its own), links."""
    met = around.join(labels.select(F.col("id").alias("other"), "community"), "other").select("id", "community", "weight", F.lit(1).alias("link"))
    met = met.unionByName(labels.select("id", "community", F.lit(0.0).alias("weight"), F.lit(0).alias("link")))
    weight = met.groupBy("id", "community").agg(F.sum("weight").alias("w"), F.sum("link").alias("links"))
    totals = labels.groupBy("community").agg(F.sum("k").alias("all"))
    rows = weight.join(totals, "community").join(labels.select("id", F.col("community").alias("own"), "k"), "id")
    others = F.col("all") - F.when(F.col("community") == F.col("own"), F.col("k")).otherwise(0.0)
    loss = F.round(resolution * F.col("k") * others / total - F.col("w"), 9)
    best = F.min(F.struct(loss.alias("loss"), (F.col("community") != F.col("own")).alias("elsewhere"), "community"))
    inside = F.max(F.when(F.col("community") == F.col("own"), F.col("w")))
    scored = rows.groupBy("id", "own", "k").agg(best.alias("best"), inside.alias("inside"), F.sum("links").alias("links"))
    return materialize(scored.select("id", "own", "k", F.col("best.community").alias("next"), "inside", "links"), "scored")


def _modularity(known: DataFrame, total: float, resolution: float) -> tuple[float, int, int]:
    """The modularity of a level's labels, less what its nodes have inside themselves; how many nodes want to move, and their links."""
    want = (F.col("next") != F.col("own")).cast("int")
    sums = known.groupBy("own").agg(F.sum("inside").alias("inside"), F.sum("k").alias("all"), F.sum(want).alias("want"), F.sum(want * F.col("links")).alias("links"))
    r = sums.agg(F.sum("inside").alias("inside"), F.sum(F.col("all") * F.col("all")).alias("squares"), F.sum("want").alias("want"), F.sum("links").alias("links")).first()
    return (r["inside"] or 0.0) / total - resolution * (r["squares"] or 0.0) / total**2, r["want"] or 0, r["links"] or 0


class _InTurn:
    """Nodes in communities, which move one after another: ``near`` has the links of those that may move."""

    def __init__(self, own: dict[str, str], k: dict[str, float], all_: dict[str, float], near: dict[str, list[tuple[str, float]]], total: float, resolution: float):
        self.own, self.k, self.all, self.near, self.total, self.resolution = own, k, all_, near, total, resolution

    def settle(self) -> bool:
        """Move what gains modularity by it, until nothing does; whether anything moved."""
        moved, again = False, sorted(self.near)
        while again:
            touched = set()
            for v in again:
                if (to := self._best(v)) != (own := self.own[v]):
                    self.own[v] = to
                    self.all[own] -= self.k[v]
                    self.all[to] += self.k[v]
                    moved = True
                    touched.update(w for w, _ in self.near[v] if w in self.near)
            again = sorted(touched)
        return moved

    def _best(self, v: str) -> str:
        """By the rule of :func:`_scored`."""
        own, k = self.own[v], self.k[v]
        weight = {own: 0.0}
        for w, x in self.near[v]:
            c = self.own[w]
            weight[c] = weight.get(c, 0.0) + x
        loss = lambda c: round(self.resolution * k * (self.all[c] - (k if c == own else 0.0)) / self.total - weight[c], 9)
        return min((loss(c), c != own, c) for c in weight)[2]


def _moves_in_turn(around: DataFrame, known: DataFrame, total: float, resolution: float) -> DataFrame:
    """(id, to) of the nodes that one task moves, of those that want to."""
    want = known.where("next <> own").select("id", "own", "k")
    totals = known.groupBy("own").agg(F.sum("k").alias("all"))
    of = known.select(F.col("id").alias("other"), F.col("own").alias("theirs"))
    links = around.join(want, "id").join(of, "other").select("id", "own", "k", "other", "theirs", "weight")
    itself = want.select("id", "own", "k", F.col("id").alias("other"), F.col("own").alias("theirs"), F.lit(0.0).alias("weight"))
    rows = links.unionByName(itself).join(totals.withColumnRenamed("own", "theirs"), "theirs").select("id", "own", "k", "other", "theirs", "weight", "all")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = sorted(x for batch in batches for x in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        own, k, all_, near = {}, {}, {}, {}
        for v, mine, strength, other, theirs, weight, sum_ in given:
            own[v], k[v], own[other], all_[theirs] = mine, strength, theirs, sum_
            near.setdefault(v, [])
            if other != v:
                near[v].append((other, weight))
        before = {v: own[v] for v in near}
        _InTurn(own, k, all_, near, total, resolution).settle()
        to = [(v, own[v]) for v in near if own[v] != before[v]]
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in to], pa.string()) for i in (0, 1)], names=["id", "to"])

    return rows.repartition(1).mapInArrow(run, "id string, to string")


def _levels_in_turn(around: DataFrame, sizes: DataFrame, total: float, resolution: float) -> DataFrame:
    """(id, community) after all levels that are left, from the links and nodes of a small one."""
    rows = sizes.select("id", F.col("id").alias("other"), F.col("k").alias("weight")).unionByName(around.select("id", "other", "weight"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = sorted(x for batch in batches for x in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        k = {v: x for v, w, x in given if v == w}
        near = {v: [] for v in k}
        for v, w, x in given:
            if v != w:
                near[v].append((w, x))
        member = {v: v for v in k}
        while True:
            own = {v: v for v in k}
            if not _InTurn(own, k, dict(k), near, total, resolution).settle():
                break
            member = {v: own[c] for v, c in member.items()}
            sums, joined = {}, {}
            for v, x in k.items():
                sums[own[v]] = sums.get(own[v], 0.0) + x
            for v, of in near.items():
                for w, x in of:
                    if own[v] != own[w]:
                        joined[own[v], own[w]] = joined.get((own[v], own[w]), 0.0) + x
            k, near = sums, {v: [] for v in sums}
            for (v, w), x in joined.items():
                near[v].append((w, x))
        yield pa.RecordBatch.from_arrays([pa.array(list(member), pa.string()), pa.array(list(member.values()), pa.string())], names=["id", "community"])

    return rows.repartition(1).mapInArrow(run, "id string, community string")


def _one_a_community(want: DataFrame, round_: int) -> DataFrame:
    """Of the moves (id, own, next) those that are first by a hash among all that leave or enter either community."""
    turns = want.withColumn("turn", F.md5(F.concat(F.lit(f"{round_}:"), "id")))
    each = turns.select(F.explode(F.array("own", "next")).alias("community"), "turn").groupBy("community").agg(F.max("turn").alias("first"))
    of = lambda end: each.select(F.col("community").alias(end), F.col("first").alias(f"first_{end}"))
    return turns.join(of("own"), "own").join(of("next"), "next").where("turn = first_own AND turn = first_next")


def modularity(members: DataFrame, edges: DataFrame, resolution: float = 1.0) -> float:
    """The modularity of communities (id, community), by weights of both directions."""
    of = lambda end: members.select(F.col("id").alias(end), F.col("community").alias(f"of_{end}"))
    met = edges.join(of("source_id"), "source_id").join(of("target_id"), "target_id").select("of_source_id", "of_target_id", F.col("weight").cast("double").alias("weight"))
    total = (met.agg(F.sum("weight")).first()[0] or 0.0) * 2
    if not total:
        return 0.0
    inside = met.where("of_source_id = of_target_id").agg(F.sum("weight")).first()[0] or 0.0
    ends = met.select(F.explode(F.array("of_source_id", "of_target_id")).alias("community"), "weight").groupBy("community").agg(F.sum("weight").alias("all"))
    return 2 * inside / total - resolution * (ends.agg(F.sum(F.col("all") * F.col("all"))).first()[0] or 0.0) / total**2


def community_stats(members: DataFrame, memories: DataFrame, edges: DataFrame) -> DataFrame:
    """Of members (id, community): size, density, main topic and its share, mean confidence; no singles."""
    rows = members.join(memories.select("id", "confidence", topic_of().alias("topic")), "id")
    by_topic = rows.groupBy("community", "topic").agg(F.count(F.lit(1)).alias("n"), F.sum("confidence").alias("c"))
    best = by_topic.groupBy("community").agg(F.max_by("topic", F.struct("n", "topic")).alias("dominant_topic"), (F.max("n") / F.sum("n")).alias("topic_concentration"), (F.sum("c") / F.sum("n")).alias("mean_confidence"))
    dense = group_density(members.select(F.col("community").alias("group"), "id"), edges).where("size > 1")
    return dense.select(F.col("group").alias("community"), "size", "density").join(best, "community")


def community_contexts(members: DataFrame, memories: DataFrame, edges: DataFrame, top: int = 10, rounds: int = 10) -> DataFrame:
    """For each community its ``top`` memories by PageRank of its own subgraph: community, id, rank, place.

    :func:`community_topics` has the topics that a context made of them is about.
    """
    of = members.select(F.col("id"), "community")
    inner = edges.join(of.select(F.col("id").alias("source_id"), "community"), "source_id").join(of.select(F.col("id").alias("target_id"), F.col("community").alias("other")), "target_id")
    inner = materialize(inner.where(F.col("community") == F.col("other")).select("source_id", "target_id", "weight"), "inner")
    # communities share no edge, so one run ranks all of them but for the size of each
    ranks = pagerank(inner, members.select("id"), rounds).join(of, "id")
    place = F.row_number().over(Window.partitionBy("community").orderBy(F.desc("rank"), "id"))
    return ranks.withColumn("place", place).where(F.col("place") <= top).select("community", "id", "rank", "place")


def community_topics(members: DataFrame, memories: DataFrame) -> DataFrame:
    """The distribution of topics in each community of over one member: community, topic, memories, share."""
    rows = members.join(memories.select("id", topic_of().alias("topic")), "id")
    counted = rows.groupBy("community", "topic").agg(F.count(F.lit(1)).alias("memories"))
    sizes = members.groupBy("community").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    return counted.join(sizes, "community").select("community", "topic", "memories", (F.col("memories") / F.col("size")).alias("share"))


def bridges(edges: DataFrame, nodes: DataFrame, least: float = 0.1) -> DataFrame:
    """id, betweenness of the nodes that over ``least`` of all shortest paths go through."""
    return betweenness(edges, nodes).where(F.col("betweenness") > least)


def sources_and_sinks(edges: DataFrame) -> DataFrame:
    """id, role: nodes with over two edges, all outgoing (source) or all incoming (sink)."""
    role = F.when((F.col("out_degree") > 2) & (F.col("in_degree") == 0), "source").when((F.col("in_degree") > 2) & (F.col("out_degree") == 0), "sink")
    return degrees(edges).select("id", role.alias("role")).where("role is not null")


def _components_of(pairs: Pairs) -> dict[str, str]:
    """For each node the smallest id of its strong component (Tarjan 1972), without recursion."""
    near: dict[str, list[str]] = {}
    for a, b in pairs:
        near.setdefault(a, []).append(b)
        near.setdefault(b, [])
    order: dict[str, int] = {}
    low: dict[str, int] = {}
    out: dict[str, str] = {}
    stack: list[str] = []
    for start in near:
        if start in order:
            continue
        walk = [(start, iter(near[start]))]
        order[start] = low[start] = len(order)
        stack.append(start)
        while walk:
            v, ends = walk[-1]
            for w in ends:
                if w not in order:
                    order[w] = low[w] = len(order)
                    stack.append(w)
                    walk.append((w, iter(near[w])))
                    break
                if w not in out:
                    low[v] = min(low[v], order[w])
            else:
                walk.pop()
                if walk:
                    low[walk[-1][0]] = min(low[walk[-1][0]], low[v])
                if low[v] == order[v]:
                    found = [stack.pop()]
                    while found[-1] != v:
                        found.append(stack.pop())
                    out.update(dict.fromkeys(found, min(found)))
    return out


def _peel(left: DataFrame) -> DataFrame:
    """The edges that are left when nodes without incoming or outgoing edges go, once."""
    kept = left.join(left.select(F.col("target_id").alias("source_id")).distinct(), "source_id", "left_semi")
    return materialize(kept.join(kept.select(F.col("source_id").alias("target_id")).distinct(), "target_id", "left_semi").select("source_id", "target_id"), "peeled")


def _shorten(left: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Draw chains together: the edges between other nodes, and (id, start, end) of the nodes in chains.

    A chain is made of nodes with one edge in and one out. Each looks ahead and back twice as far in every
    round, so a chain of n nodes takes log n rounds. What still looks at chains after that is a cycle of
    such nodes; its start and end are its smallest node.
    """
    inner = left.groupBy(F.col("target_id").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.min("source_id").alias("start")).where("n = 1")
    outer = left.groupBy(F.col("source_id").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.min("target_id").alias("end")).where("n = 1")
    chain = inner.drop("n").join(outer.drop("n"), "id")
    mark = lambda end: chain.select(F.col("id").alias(end), F.lit(False).alias(f"{end}_done"))
    done = [F.coalesce(f"{end}_done", F.lit(True)).alias(f"{end}_done") for end in ("start", "end")]
    rows = materialize(chain.join(mark("start"), "start", "left").join(mark("end"), "end", "left").select("id", "start", "end", *done, F.col("id").alias("low")), "chains")
    reach, size = 1, rows.count()
    while reach <= size and not rows.where("NOT start_done OR NOT end_done").isEmpty():
        back = rows.select(F.col("id").alias("start"), F.col("start").alias("start2"), F.col("start_done").alias("s2"))
        ahead = rows.select(F.col("id").alias("end"), F.col("end").alias("end2"), F.col("end_done").alias("e2"), F.col("low").alias("low2"))
        met = rows.join(back, "start", "left").join(ahead, "end", "left")
        rows = materialize(
            met.select(
                "id", F.when(F.col("start_done"), F.col("start")).otherwise(F.col("start2")).alias("start"), F.when(F.col("end_done"), F.col("end")).otherwise(F.col("end2")).alias("end"),
                (F.col("start_done") | F.col("s2")).alias("start_done"), (F.col("end_done") | F.col("e2")).alias("end_done"), F.least("low", "low2").alias("low"),
            ),
            "chains",
        )
        reach *= 2
    cycle = ~F.col("end_done")
    chains = rows.select("id", F.when(cycle, F.col("low")).otherwise(F.col("start")).alias("start"), F.when(cycle, F.col("low")).otherwise(F.col("end")).alias("end"))
    other = left.join(chains.select(F.col("id").alias("source_id")), "source_id", "left_anti")
    short = other.join(chains.select(F.col("id").alias("target_id"), "end"), "target_id", "left").select("source_id", F.coalesce("end", "target_id").alias("target_id"))
    return materialize(short.where("source_id <> target_id").distinct(), "short"), materialize(chains, "chains")


def _by_colour(left: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, component) of a part of the nodes, and the edges among the rest.

    The smallest id spreads forward to a fixed point; what reaches it backward, within its colour, is a
    component.
    """
    ids = left.select(F.col("source_id").alias("id")).unionByName(left.select(F.col("target_id").alias("id"))).distinct()
    colour = materialize(ids.select("id", F.col("id").alias("colour"), F.lit(True).alias("new")), "colours")
    while not (front := colour.where("new")).isEmpty():
        got = left.join(front.select(F.col("id").alias("source_id"), "colour"), "source_id").groupBy(F.col("target_id").alias("id")).agg(F.min("colour").alias("less"))
        met = colour.select("id", "colour").join(got, "id", "left")
        colour = materialize(met.select("id", F.least("colour", "less").alias("colour"), F.coalesce(F.col("less") < F.col("colour"), F.lit(False)).alias("new")), "colours")
    of = lambda end: colour.select(F.col("id").alias(end), F.col("colour").alias(f"of_{end}"))
    same = left.join(of("source_id"), "source_id").join(of("target_id"), "target_id").where("of_source_id = of_target_id")
    back = materialize(same.select(F.col("target_id").alias("id"), F.col("source_id").alias("before")), "back")
    found = front = materialize(colour.where("id = colour").select("id", F.col("colour").alias("component")), "found")
    while not front.isEmpty():
        more = front.join(back, "id").select(F.col("before").alias("id"), "component").distinct()
        front = materialize(more.join(found, "id", "left_anti"), "front")
        found = materialize(found.unionByName(front), "found")
    for end in ("source_id", "target_id"):
        left = left.join(found.select(F.col("id").alias(end)), end, "left_anti")
    return found, materialize(left.select("source_id", "target_id"), "rest")


def strong_components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """id, component (its smallest id).

    While many edges are left, nodes that no cycle can hold are peeled off, chains are drawn together, and
    where neither helps much components are found by colours. Then one task does the rest. A node of a
    chain belongs to a component if both ends of the chain do.
    """
    left = materialize(edges.where("source_id <> target_id").select("source_id", "target_id").distinct(), "left")
    chains: list[DataFrame] = []
    found = nodes.select("id", F.lit(None).cast("string").alias("component")).where("false")
    while (size := left.count()) > MOST_LOCAL:
        left, drawn = _shorten(_peel(left))
        chains.append(drawn)
        if left.count() > 0.9 * size:
            some, left = _by_colour(left)
            found = materialize(found.unionByName(some), "components")
    if size:
        found = found.unionByName(_in_one_task(left, _components_of, "component"))
    found = materialize(found, "components")
    for drawn in reversed(chains):
        of = lambda end: found.select(F.col("id").alias(end), F.col("component").alias(f"of_{end}"))  # noqa: B023, E731
        met = drawn.join(of("start"), "start", "left").join(of("end"), "end", "left")
        # an end that was found alone, or in no component, stands for itself
        a, b = F.coalesce("of_start", "start"), F.coalesce("of_end", "end")
        inside = met.where(a == b).select("id", a.alias("component"))
        heads = inside.select(F.col("component").alias("id"), "component").distinct().join(found, "id", "left_anti").join(inside.select("id"), "id", "left_anti")
        found = materialize(found.unionByName(inside).unionByName(heads), "components")
    lowest = found.groupBy("component").agg(F.min("id").alias("least"))
    named = found.join(lowest, "component").select("id", "least")
    return nodes.select("id").join(named, "id", "left").select("id", F.coalesce("least", "id").alias("component"))


def is_acyclic(edges: DataFrame) -> bool:
    if not edges.where("source_id = target_id").isEmpty():
        return False
    ids = edges.select(F.col("source_id").alias("id")).unionByName(edges.select(F.col("target_id").alias("id"))).distinct()
    return strong_components(edges, ids).where("id <> component").isEmpty()


def graph_metrics(memories: DataFrame, links: DataFrame) -> DataFrame:
    """One row: nodes, edges, density, reciprocity, isolated, mean_confidence."""
    edges = simple_graph(links, memories)
    mutual = edges.where("source_id <> target_id").alias("a").join(
        edges.select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id")), ["source_id", "target_id"], "left_semi"
    )
    touched = degrees(edges).select("id")
    n = memories.agg(F.count(F.lit(1)).alias("nodes"), F.avg("confidence").alias("mean_confidence"))
    m = edges.agg(F.count(F.lit(1)).alias("edges"))
    r = mutual.agg(F.count(F.lit(1)).alias("mutual"))
    i = memories.select("id").join(touched, "id", "left_anti").agg(F.count(F.lit(1)).alias("isolated"))
    row = n.crossJoin(F.broadcast(m)).crossJoin(F.broadcast(r)).crossJoin(F.broadcast(i))
    pairs = F.col("nodes") * (F.col("nodes") - 1)
    return row.select(
        "nodes", "edges", F.when(pairs > 0, F.col("edges") / pairs).otherwise(0.0).alias("density"),
        F.when(F.col("edges") > 0, F.col("mutual") / F.col("edges")).otherwise(0.0).alias("reciprocity"), "isolated", "mean_confidence",
    )


def health_score(density: Column, isolated_ratio: Column, n_communities: Column, reciprocity: Column, confidence: Column) -> Column:
    """0 to 100 from the metrics of a graph."""
    split = F.when(n_communities.between(3, 10), 10.0).when(n_communities > 10, 5.0).otherwise(0.0)
    sure = F.when(confidence > 0.8, 10.0).when(confidence > 0.6, 5.0).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), density * 20 - isolated_ratio * 15 + split + reciprocity * 10 + sure))


def health_report(memories: DataFrame, links: DataFrame, now, found: DataFrame | None = None) -> DataFrame:
    """One row of metrics with score and grade; ``found`` (id, community) saves detecting communities.

    components counts the strong ones, and acyclic says that no path of links leads back to its start.
    """
    edges = materialize(simple_graph(links, memories), "edges")
    found = communities(edges, memories.select("id")) if found is None else found
    groups = found.groupBy("community").agg(F.count(F.lit(1)).alias("size")).where("size > 1").agg(F.count(F.lit(1)).alias("communities"))
    age = seconds_between(F.col("timestamp"), instant(now)) / 86400
    ages = memories.agg(F.max(age).alias("oldest_days"), F.min(age).alias("newest_days"), F.avg(age).alias("mean_days"))
    strong = strong_components(edges, memories.select("id")).agg(F.countDistinct("component").alias("components"), F.coalesce(F.sum((F.col("id") != F.col("component")).cast("int")), F.lit(0)).alias("_inside"))
    loops = edges.where("source_id = target_id").agg(F.count(F.lit(1)).alias("_loops"))
    row = graph_metrics(memories, links).crossJoin(F.broadcast(groups)).crossJoin(F.broadcast(ages)).crossJoin(F.broadcast(strong)).crossJoin(F.broadcast(loops))
    row = row.withColumn("acyclic", (F.col("_inside") == 0) & (F.col("_loops") == 0)).drop("_inside", "_loops")
    ratio = F.when(F.col("nodes") > 0, F.col("isolated") / F.col("nodes")).otherwise(0.0)
    row = row.withColumn("score", health_score(F.col("density"), ratio, F.col("communities"), F.col("reciprocity"), F.col("mean_confidence")))
    grade = F.lit("Critical")
    for least, name in ((20, "Poor"), (40, "Fair"), (60, "Good"), (80, "Excellent")):
        grade = F.when(F.col("score") >= least, name).otherwise(grade)
    return row.withColumn("grade", grade)


def recommendations(memories: DataFrame, links: DataFrame, found: DataFrame | None = None, max_cycle: int = 3) -> DataFrame:
    """kind, issue, severity, evidence of what a graph should be improved in.

    Cycles are looked for up to ``max_cycle`` links, since the number of all cycles has no bound.
    """
    edges = materialize(simple_graph(links, memories), "edges")
    found = communities(edges, memories.select("id")) if found is None else found
    metrics = graph_metrics(memories, links)
    low = memories.agg(F.sum((F.col("confidence") < 0.6).cast("int")).alias("low"))
    groups = found.groupBy("community").agg(F.count(F.lit(1)).alias("size")).where("size > 1").agg(F.count(F.lit(1)).alias("communities"))
    s = epoch(F.col("timestamp"))
    span = memories.agg(F.max(s).alias("last"), F.min(s).alias("first"))
    fresh = memories.crossJoin(F.broadcast(span)).agg(F.sum(((F.col("last") - s) < (F.col("last") - F.col("first")) * 0.1).cast("int")).alias("fresh"))
    hub = degrees(edges).agg(F.max("in_degree").alias("hub"))
    cycles = _short_cycles(edges, max_cycle).agg(F.count(F.lit(1)).alias("cycles"))
    shapes = topic_clusters(memories, edges).agg(F.count(F.lit(1)).alias("a")).crossJoin(temporal_sequences(memories, edges).agg(F.count(F.lit(1)).alias("b"))).select((F.col("a") + F.col("b")).alias("abstractions"))
    row = metrics
    for more in (low, groups, span, fresh, hub, cycles, shapes):
        row = row.crossJoin(F.broadcast(more))
    n = F.col("nodes")
    rules = [
        ("connectivity", "low density", "medium", F.col("density") < 0.05, F.col("density")),
        ("connectivity", "isolated memories", "high", F.col("isolated") > n * 0.1, F.col("isolated")),
        ("structure", "cycles", "low", F.col("cycles") > 0, F.col("cycles")),
        ("quality", "low confidence", "medium", F.col("low") > n * 0.2, F.col("low")),
        ("structure", "few communities", "low", F.col("communities") < 2, F.col("communities")),
        ("structure", "fragmented communities", "medium", (F.col("communities") >= 2) & (F.col("communities") > n * 0.4), F.col("communities")),
        ("recency", "stale", "medium", (F.col("last") > F.col("first")) & (F.col("fresh") < n * 0.05), F.col("fresh")),
        ("abstraction", "abstractions possible", "low", F.col("abstractions") > 10, F.col("abstractions")),
        ("structure", "bottleneck", "medium", F.col("hub") > n * 0.3, F.col("hub")),
    ]
    made = [F.when(test, F.struct(F.lit(k).alias("kind"), F.lit(i).alias("issue"), F.lit(v).alias("severity"), e.cast("double").alias("evidence"))) for k, i, v, test, e in rules]
    return row.select(F.explode(F.array_compact(F.array(*made))).alias("r")).select("r.*")


def _short_cycles(edges: DataFrame, most: int) -> DataFrame:
    """Cycles of at most ``most`` links, each once, from its smallest id: path."""
    steps = edges.select("source_id", "target_id")
    front = steps.select(F.array("source_id").alias("path"), F.col("target_id").alias("at"))
    out = None
    for size in range(1, most + 1):
        closed = front.where(F.col("at") == F.col("path")[0]).select("path")
        out = closed if out is None else out.unionByName(closed)
        if size < most:
            open_ = front.where((F.col("at") > F.col("path")[0]) & ~F.array_contains("path", F.col("at")))
            front = open_.join(steps, F.col("at") == F.col("source_id")).select(F.concat("path", F.array("at")).alias("path"), F.col("target_id").alias("at"))
    return out


def abstraction_nodes(groups: DataFrame, memories: DataFrame, now) -> DataFrame:
    """One new memory for each group (group, kind, id): a summary with the mean confidence of its members."""
    rows = groups.join(memories.select("id", "content", "confidence"), "id")
    made = rows.groupBy("group", "kind").agg(
        F.sort_array(F.collect_list(F.struct("id", F.substring("content", 1, 50).alias("said")))).alias("m"), F.avg("confidence").alias("confidence"), F.count(F.lit(1)).alias("size")
    )
    return made.select(
        F.concat(F.lit("abstract-"), F.col("kind"), F.lit("-"), F.col("group").cast("string")).alias("id"),
        F.concat(F.lit("Summary of "), F.col("size"), F.lit(" memories: "), F.array_join(F.transform("m", lambda x: x["said"]), "; ")).alias("content"),
        F.lit("abstraction").alias("source"), "confidence", F.lit(0.5).alias("importance"), F.lit(0).cast("bigint").alias("access_count"),
        instant(now).alias("timestamp"), instant(now).alias("last_accessed"), F.lit(None).cast("bigint").alias("ttl"),
        F.to_json(F.struct(F.col("kind").alias("type"), F.transform("m", lambda x: x["id"]).alias("member_ids"))).alias("metadata"),
    )


def optimized(memories: DataFrame, links: DataFrame, context_members: DataFrame, now, share: float = 0.1, most: int = 5, with_betweenness: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(memories, links, context_members) without the most forgettable share, with a few abstractions.

    The best topic clusters (quality over 0.7) become abstraction memories that link to their members.
    """
    scores = forgetting_scores(memories, links, context_members, now, with_betweenness=with_betweenness)
    n = int(memories.count() * share)
    gone = materialize(scores.orderBy(F.desc("score"), "id").limit(n).select("id"), "gone")
    kept = materialize(memories.join(gone, "id", "left_anti"), "kept")
    pruned = attached(links, kept)
    edges = simple_graph(pruned, kept)
    best = topic_clusters(kept, edges).where("quality > 0.7").orderBy(F.desc("quality"), "topic").limit(most).select(F.col("topic").alias("group"))
    groups = kept.select("id", topic_of().alias("group")).join(F.broadcast(best), "group").withColumn("kind", F.lit("topic"))
    fresh = abstraction_nodes(groups, kept, now)
    member = groups.select(F.concat(F.lit("abstract-topic-"), "group").alias("source_id"), F.col("id").alias("target_id"))
    extra = member.select(F.concat("source_id", F.lit("-"), "target_id").alias("id"), "source_id", "target_id", F.lit("abstracts").alias("relationship_type"), F.lit(1.0).alias("weight"), F.lit(None).cast("string").alias("metadata"))
    left = context_members.join(gone.withColumnRenamed("id", "memory_id"), "memory_id", "left_anti").select(*context_members.columns)
    return kept.unionByName(fresh), pruned.unionByName(extra), left
