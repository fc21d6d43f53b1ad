"""Vector search, exact and by an inverted file, and deterministic embeddings."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.errors import ComputationError, InvalidOperation, NotFound

#: Query vectors that one pass over the rows answers.
QUERY_BLOCK = 1024
#: Rows that are held against a block of queries at once.
ROW_BLOCK = 1024
MODELS = {"e5": 1024, "gte": 768, "jina": 768, "custom": 768}


class Embedder(Protocol):
    """Turns a column of texts into a column of vectors."""

    dimensions: int

    def embed(self, rows: DataFrame, text: str, out: str) -> DataFrame: ...


class HashEmbedder:
    """Pseudorandom unit vectors from the sum of a text's UTF-8 bytes: equal sums, equal vectors.

    A linear congruential generator modulo 2^64, seeded by the sum, gives a step for each dimension.
    """

    def __init__(self, dimensions: int = 768):
        self.dimensions = dimensions

    def vectors(self, sums: np.ndarray) -> np.ndarray:
        state, out = sums.astype(np.uint64), np.empty((len(sums), self.dimensions))
        with np.errstate(over="ignore"):
            for i in range(self.dimensions):
                state = state * np.uint64(6364136223846793005) + np.uint64(1)
                out[:, i] = (state % np.uint64(1000)).astype(np.float64) / 500 - 1
        size = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(size == 0, 1, size)

    def embed(self, rows: DataFrame, text: str, out: str) -> DataFrame:
        place = rows.columns.index(text)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sums = np.array([sum((x or "").encode()) for x in batch.column(place).to_pylist()], np.uint64)
                distinct, at = np.unique(sums, return_inverse=True)
                made = self.vectors(distinct)[at]
                lists = pa.ListArray.from_arrays(np.arange(0, made.size + 1, self.dimensions, dtype=np.int32), pa.array(made.reshape(-1)))
                yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, out])

        schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), f"`{out}` array<double>"])
        return rows.mapInArrow(run, schema)


def _matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(column) and (column.null_count or len(flat) != len(column) * dimensions):
        raise ComputationError("vectors of unlike dimensions")
    return flat.reshape(len(column), dimensions)


def similarities(rows: np.ndarray, queries: np.ndarray, metric: str) -> np.ndarray:
    """(queries x rows): cosine similarity, or minus the euclidean distance."""
    if metric == "euclidean":
        squares = (queries**2).sum(1)[:, None] + (rows**2).sum(1)[None] - 2 * queries @ rows.T
        return -np.sqrt(np.maximum(squares, 0))
    size = np.linalg.norm(queries, axis=1)[:, None] * np.linalg.norm(rows, axis=1)[None]
    return np.divide(queries @ rows.T, size, out=np.zeros_like(size), where=size > 0)


class Best:
    """The ``k`` best rows of each query so far, ties by id; holds little more than these."""

    def __init__(self, queries: int, k: int):
        self.k, self.least, self.parts, self.held = k, np.full(queries, -np.inf), [], 0

    def add(self, which: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """``scores`` (queries x rows) of the queries ``which``; no number counts as the least."""
        if not self.k or not scores.size:
            return
        keys = np.where(np.isnan(scores), -np.inf, scores)
        least = self.least[which]
        if keys.shape[1] > self.k:
            least = np.maximum(least, np.partition(keys, keys.shape[1] - self.k, axis=1)[:, keys.shape[1] - self.k])
        at, row = np.nonzero(keys >= least[:, None])
        self.parts.append((which[at], keys[at, row], scores[at, row], ids[row]))
        self.held += len(at)
        if self.held > 4 * self.k * len(self.least):
            self.shrink()

    def shrink(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, score, id) of what is best; the rest goes."""
        if not self.parts:
            return np.array([], np.int64), np.array([]), np.array([], object)
        query, key, score, ids = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.lexsort((ids.astype(str), -key, query))
        query, key, score, ids = query[order], key[order], score[order], ids[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        self.least[query[place == self.k - 1]] = key[place == self.k - 1]
        kept = place < self.k
        self.parts, self.held = [(query[kept], key[kept], score[kept], ids[kept])], int(kept.sum())
        return query[kept], score[kept], ids[kept]

    def batch(self, names: list[str]) -> pa.RecordBatch:
        query, score, ids = self.shrink()
        return pa.RecordBatch.from_arrays([pa.array([names[i] for i in query.tolist()], pa.string()), pa.array(ids.tolist(), pa.string()), pa.array(score, pa.float64())], names=["query_id", "memory_id", "score"])


def _ranked(near: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "memory_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k)


def _by_blocks(queries: DataFrame, find: Callable[[list[tuple[str, list[float]]]], DataFrame]) -> DataFrame:
    """What ``find`` has for each block of queries (query_id, vector), all together."""
    out, block = None, []
    for row in queries.select("query_id", "vector").toLocalIterator():
        block.append((row["query_id"], row["vector"]))
        if len(block) == QUERY_BLOCK:
            found = find(block)
            out, block = found if out is None else out.unionByName(found), []
    if block or out is None:
        found = find(block)
        out = found if out is None else out.unionByName(found)
    return out


def top_k(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "cosine") -> DataFrame:
    """query_id, memory_id, score: the k nearest rows of each query, ties by id.

    ``queries`` has query_id and vector. A block of them is held against blocks of rows by matrix products; a
    task passes on k candidates a query, so neither its memory nor the shuffle grows with its rows. Scores are rounded
    to 6 places, that ties are ties on every machine.
    """
    return _by_blocks(queries, lambda block: _top_k(vectors, block, k, metric))


def _top_k(vectors: DataFrame, block: list[tuple[str, list[float]]], k: int, metric: str) -> DataFrame:
    if len({len(v) for _, v in block}) > 1:
        raise ComputationError("vectors of unlike dimensions")
    names, matrix = [i for i, _ in block], np.array([v for _, v in block], np.float64)
    shared = vectors.sparkSession.sparkContext.broadcast((names, matrix))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, queries = shared.value
        if not len(names):
            return
        best, all_ = Best(len(names), k), np.arange(len(names))
        for whole in batches:
            for at in range(0, whole.num_rows, ROW_BLOCK):
                batch = whole.slice(at, ROW_BLOCK)
                scores = np.round(similarities(_matrix(batch.column(1), queries.shape[1]), queries, metric), 6) + 0.0
                best.add(all_, scores, np.array(batch.column(0).to_pylist(), object))
        yield best.batch(names)

    near = vectors.select("memory_id", "vector").mapInArrow(run, "query_id string, memory_id string, score double")
    return _ranked(near, k)


def search(vectors: DataFrame, k: int = 10, vector: list[float] | None = None, similar_to: str | None = None, text: str | None = None,
           embedder: Embedder | None = None, min_score: float | None = None, exclude_self: bool = True, metric: str = "cosine") -> DataFrame:
    """memory_id, score, rank for one query: a vector, a text to embed, or a memory to be like.

    min_score holds after the top k; exclude_self concerns similar_to only.
    """
    spark = vectors.sparkSession
    if vector is not None:
        query = spark.createDataFrame([("q", [float(x) for x in vector])], "query_id string, vector array<double>")
    elif similar_to is not None:
        own = vectors.where(F.col("memory_id") == similar_to).select(F.lit("q").alias("query_id"), "vector").limit(1)
        if own.isEmpty():
            raise NotFound(f"no vector of {similar_to}")
        query = own
    elif text is not None and embedder is not None:
        query = embedder.embed(spark.createDataFrame([("q", text)], "query_id string, text string"), "text", "vector")
    else:
        raise InvalidOperation("a query needs a vector, a text with an embedder, or a memory")
    skip = similar_to is not None and vector is None and exclude_self
    found = top_k(vectors, query, k + skip, metric).drop("query_id")
    if skip:
        found = found.where(F.col("memory_id") != similar_to).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "memory_id"))).where(F.col("rank") <= k)
    return found if min_score is None else found.where(F.col("score") >= min_score)


def choose_vectors(memories: DataFrame, vectors: DataFrame, embedder: Embedder) -> DataFrame:
    """memory_id, vector, origin: the vector that an index takes for each memory.

    One in the metadata goes first (``embedding_vector``, an array of numbers), then a stored reduced
    one, then a stored original, then one computed from the content.
    """
    own = F.from_json(F.get_json_object("metadata", "$.embedding_vector"), "array<double>")
    stored = vectors.groupBy("memory_id").agg(
        F.max(F.when(F.col("reduced"), F.struct(F.lit(1), "vector")))["vector"].alias("small"), F.max(F.when(~F.col("reduced"), F.struct(F.lit(1), "vector")))["vector"].alias("full")
    )
    rows = memories.select(F.col("id").alias("memory_id"), "content", own.alias("own")).join(stored, "memory_id", "left")
    wide = lambda c: F.col(c).cast("array<double>")
    rows = rows.withColumn("kept", F.coalesce("own", wide("small"), wide("full")))
    origin = F.when(F.col("own").isNotNull(), "metadata").when(F.col("small").isNotNull(), "reduced").when(F.col("full").isNotNull(), "stored").otherwise("computed")
    rows = rows.withColumn("origin", origin)
    known = rows.where("kept is not null").select("memory_id", F.col("kept").alias("vector"), "origin")
    new = embedder.embed(rows.where("kept is null").select("memory_id", "origin", "content"), "content", "vector")
    return known.unionByName(new.select("memory_id", "vector", "origin"))


class InvertedFile:
    """Approximate search: rows stand in the cells of k-means centroids, and a query reads the nearest.

    Centroids are fitted on at most ``sample`` rows (the first by a hash of the id); every row is
    indexed. ``index`` adds the column ``cell``; written partitioned by it, a query reads ``probes``
    cells of ``cells`` only. Without ``probes`` so many are read that the ``near`` nearest of the sample
    are found in a share of ``recall``: few where the vectors form groups, most where they form none.
    """

    def __init__(self, cells: int = 16, probes: int | None = None, sample: int = 10_000, rounds: int = 10, seed: int = 1, recall: float = 0.95, near: int = 10):
        self.cells, self.probes, self.sample, self.rounds, self.seed, self.recall, self.near = cells, probes, sample, rounds, seed, recall, near
        self.centers: np.ndarray | None = None

    @staticmethod
    def _unit(x: np.ndarray) -> np.ndarray:
        size = np.linalg.norm(x, axis=1, keepdims=True)
        return x / np.where(size == 0, 1, size)

    def fit(self, vectors: DataFrame) -> InvertedFile:
        rows = vectors.orderBy(F.xxhash64("memory_id"), "memory_id").limit(self.sample).select("vector").collect()
        if not rows:
            raise ComputationError("an index needs vectors")
        x = self._unit(np.array([r["vector"] for r in rows], np.float64))
        rng = np.random.default_rng(self.seed)
        centers = x[rng.permutation(len(x))[: self.cells]]
        for _ in range(self.rounds):
            cell = np.argmax(x @ centers.T, axis=1)
            sums = np.zeros_like(centers)
            np.add.at(sums, cell, x)
            centers = self._unit(np.where(np.bincount(cell, minlength=len(centers))[:, None] > 0, sums, centers))
        self.centers = centers
        if self.probes is None:
            self.probes = self._enough(x)
        return self

    def _enough(self, x: np.ndarray, asked: int = 512) -> int:
        """The cells to read, by the cells of the nearest rows of the first ``asked`` of a sample."""
        cell, some = np.argmax(x @ self.centers.T, axis=1), x[:asked]
        k = min(self.near, len(x))
        nearest = np.argpartition(-(some @ x.T), k - 1, axis=1)[:, :k]
        place = np.argsort(np.argsort(-(some @ self.centers.T), axis=1, kind="stable"), axis=1)
        needed = np.take_along_axis(place, cell[nearest], axis=1)
        shares = [(needed < p).mean() for p in range(1, len(self.centers) + 1)]
        return next((p for p, share in enumerate(shares, 1) if share >= self.recall), len(self.centers))

    def _cells(self, vectors: DataFrame, id_col: str, many: int) -> DataFrame:
        shared = vectors.sparkSession.sparkContext.broadcast(self.centers)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centers = shared.value
            for batch in batches:
                x = _matrix(batch.column(1), centers.shape[1])
                best = np.argsort(-(x @ centers.T), axis=1, kind="stable")[:, :many]
                at = pa.array(np.repeat(np.arange(batch.num_rows), best.shape[1]))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(best.reshape(-1).astype(np.int32))], names=[id_col, "vector", "cell"])

        kind = vectors.schema["vector"].dataType.simpleString()
        return vectors.select(id_col, "vector").mapInArrow(run, f"{id_col} string, vector {kind}, cell int")

    def index(self, vectors: DataFrame) -> DataFrame:
        return self._cells(vectors, "memory_id", 1)

    def search(self, index: DataFrame, queries: DataFrame, k: int) -> DataFrame:
        """query_id, memory_id, score, rank; a block of queries is held against the rows of the cells that each reads."""
        return _by_blocks(queries, lambda block: self._search(index, block, k))

    def _search(self, index: DataFrame, block: list[tuple[str, list[float]]], k: int) -> DataFrame:
        if any(len(v) != self.centers.shape[1] for _, v in block):
            raise ComputationError("vectors of unlike dimensions")
        queries = np.array([v for _, v in block], np.float64).reshape(len(block), self.centers.shape[1])
        order = np.argsort(-(queries @ self.centers.T), axis=1, kind="stable")[:, : self.probes]
        reads = {c: np.flatnonzero((order == c).any(1)) for c in range(len(self.centers))}
        shared = index.sparkSession.sparkContext.broadcast(([i for i, _ in block], queries, reads))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, queries, reads = shared.value
            best = Best(len(names), k)
            for whole in batches:
                for at in range(0, whole.num_rows, ROW_BLOCK):
                    batch = whole.slice(at, ROW_BLOCK)
                    x, ids, cells = _matrix(batch.column(1), queries.shape[1]), np.array(batch.column(0).to_pylist(), object), batch.column(2).to_numpy()
                    for c in np.unique(cells).tolist():
                        rows, asked = cells == c, reads[c]
                        if len(asked):
                            best.add(asked, np.round(similarities(x[rows], queries[asked], "cosine"), 6) + 0.0, ids[rows])
            yield best.batch(names)

        near = index.where(F.col("cell").isin([c for c, asked in reads.items() if len(asked)])).select("memory_id", "vector", "cell")
        return _ranked(near.mapInArrow(run, "query_id string, memory_id string, score double"), k)
