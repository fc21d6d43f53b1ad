"""An approximate vector index that lies in a store and changes with it.

Vectors stand in cells of k-means centers. What a vector differs from its center by is cut into parts,
and each part is one byte, the number of the nearest of 256 words of a codebook (product quantisation). A
query is held against all codes of the cells that it probes by tables, one sum of table entries a
vector; the best few candidates are then compared with the full vectors. Codes lie in folders by cell, apart
from other columns, so a search reads the codes of some cells and the vectors of fewer rows.

Vectors that are put delete older codes of the same memories; removed ones are only named. A cell that has
grown is split: it keeps one half and a new cell takes the other, so whoever puts vectors by the older
cells meanwhile puts them where a search still looks. Every change is one commit of the store.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.errors import ComputationError, InvalidOperation
from lorekeep.operators.vectors import QUERY_BLOCK, _matrix, similarities
from lorekeep.session import materialize
from lorekeep.sources.store import GraphStore

#: Words of a part of the codebook: a code is a byte.
WORDS = 256
#: What sums of table entries and rounded scores may be off by.
SLACK = 1e-5
#: Codes that are held against queries at once.
ROWS = 2048


def unit(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(size == 0, 1, size)


def nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """The number of the center nearest to each row."""
    return np.argmin((centers**2).sum(1)[None] - 2 * x @ centers.T, axis=1)


def k_means(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """At most ``k`` centers of some rows."""
    rng = np.random.default_rng(seed)
    centers = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        of = nearest(x, centers)
        n = np.bincount(of, minlength=len(centers))
        order = np.argsort(of, kind="stable")
        some = np.flatnonzero(n)
        centers[some] = np.add.reduceat(x[order], (np.cumsum(n) - n)[some]) / n[some, None]
    return centers


class Codes:
    """Centers of cells and the codebook, as arrays; what the tasks of a job are given."""

    def __init__(self, cells: np.ndarray, centers: np.ndarray, words: list[np.ndarray]):
        self.cells, self.centers, self.words = cells, centers, words
        self.limits = np.concatenate([[0], np.cumsum([w.shape[1] for w in words])])

    @property
    def dimensions(self) -> int:
        return int(self.limits[-1])

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cell, code) of each row."""
        return self.encode_with_error(x)[:2]

    def encode_with_error(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(cell, code, error) of each row; error is the distance of its unit vector from what cell and code stand for."""
        x = unit(x)
        of = nearest(x, self.centers)
        rest = x - self.centers[of]
        code = np.stack([nearest(rest[:, a:b], w) for a, b, w in zip(self.limits, self.limits[1:], self.words, strict=False)], 1)
        said = np.concatenate([w[code[:, j]] for j, w in enumerate(self.words)], 1)
        return self.cells[of], code.astype(np.uint8), np.linalg.norm(rest - said, axis=1)

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """(part, query, word): what a word adds to the product of a query with a vector."""
        return np.stack([queries[:, a:b] @ np.pad(w, ((0, WORDS - len(w)), (0, 0))).T for a, b, w in zip(self.limits, self.limits[1:], self.words, strict=False)]).astype(np.float32)


def fit(vectors: DataFrame, cells: int, parts: int, sample: int = 10_000, rounds: int = 10, seed: int = 1) -> Codes:
    """Centers and codebook from at most ``sample`` vectors, the first by a hash of their ids."""
    rows = vectors.orderBy(F.xxhash64("memory_id"), "memory_id").limit(sample).select("vector").collect()
    if not rows:
        raise ComputationError("an index needs vectors")
    if len({len(r["vector"]) for r in rows}) > 1:
        raise ComputationError("vectors of unlike dimensions")
    x = unit(np.array([r["vector"] for r in rows], np.float64))
    centers = k_means(x, cells, rounds, seed)
    rest = x - centers[nearest(x, centers)]
    limits = np.linspace(0, x.shape[1], min(parts, x.shape[1]) + 1).astype(int)
    words = [k_means(rest[:, a:b], WORDS, rounds, seed + j) for j, (a, b) in enumerate(zip(limits, limits[1:], strict=False))]
    return Codes(np.arange(len(centers), dtype=np.int32), centers, words)


class VectorIndex:
    """``build``, ``put``, ``remove``, ``clear`` and ``search`` over the vectors of a store.

    ``parts`` bytes stand for a vector; ``cell_rows`` is how many rows a cell has before it is split;
    a query probes a share of ``probes`` of all cells, or so many if it is an int, and ``candidates`` rows for each
    row asked for are compared in full. With ``probes=1.0`` every row is compared that its code, by its error, doesn't rule out, so a search is exact.
    """

    def __init__(self, store: GraphStore, parts: int = 32, cell_rows: int = 65_536, probes: float | int = 0.25, candidates: int = 2, sample: int = 10_000, seed: int = 1):
        self.store, self.parts, self.cell_rows, self.probes, self.candidates, self.sample, self.seed = store, parts, cell_rows, probes, candidates, sample, seed

    # what is stored

    def codes(self) -> Codes:
        cells = sorted(self.store.read("cells").collect(), key=lambda r: r["cell"])
        if not cells:
            raise InvalidOperation("the store has no vector index; build it first")
        words = sorted(self.store.read("codebook").collect(), key=lambda r: r["part"])
        return Codes(np.array([r["cell"] for r in cells], np.int32), np.array([r["center"] for r in cells]), [np.array(r["words"]) for r in words])

    def sizes(self) -> dict[int, int]:
        """Rows of each cell; one row a cell comes to the driver."""
        return {r["cell"]: r["n"] for r in self.store.read("codes").groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}

    # changes

    def build(self, vectors: DataFrame) -> None:
        """Fit an index and put all of ``vectors`` (memory_id, vector); an index that is there is replaced."""
        n = vectors.count()
        codes = fit(vectors, max(1, math.ceil(n / self.cell_rows)), self.parts, self.sample, seed=self.seed)
        spark = self.store.spark
        batch = self._without_rows()
        batch.delete("cells", self.store.read("cells").select("cell")).delete("codebook", self.store.read("codebook").select("part"))
        batch.put("cells", self._cells(codes.cells, codes.centers))
        batch.put("codebook", spark.createDataFrame([(j, w.tolist()) for j, w in enumerate(codes.words)], "part int, words array<array<double>>"))
        batch.put("codes", self._encoded(vectors, codes)).commit()
        self.split()

    def put(self, vectors: DataFrame) -> None:
        """Insert vectors, or replace those of the same memories."""
        rows = self._encoded(vectors, self.codes())
        self.store.batch().delete("codes", vectors.select("memory_id")).put("codes", rows).commit()
        self.split()

    def remove(self, ids: DataFrame) -> None:
        self.store.batch().delete("codes", ids.select(F.col(ids.columns[0]).alias("memory_id"))).commit()

    def clear(self) -> None:
        """No vector is left; centers and codebook stay."""
        self._without_rows().commit()

    def split(self) -> None:
        """Halve cells of over twice ``cell_rows`` rows until there are none; cells of equal vectors stay as they are."""
        whole: set[int] = set()
        while large := [c for c, n in self.sizes().items() if n > 2 * self.cell_rows and c not in whole]:
            codes, moved = self.codes(), []
            ids, centers = list(codes.cells), list(codes.centers)
            rank = F.row_number().over(Window.partitionBy("cell").orderBy(F.xxhash64("memory_id"), "memory_id"))
            some = self.store.read("codes").where(F.col("cell").isin(large)).select("cell", "vector", rank.alias("nth")).where(F.col("nth") <= max(2, self.sample // len(large)))
            by_cell: dict[int, list] = {}
            for r in some.collect():  # at most ``sample`` rows, or two a cell
                by_cell.setdefault(r["cell"], []).append(r["vector"])
            for cell in large:
                x = unit(np.array(by_cell[cell], np.float64))
                halves = k_means(x, 2, 10, self.seed)
                if len(np.unique(nearest(x, halves))) < 2:
                    whole.add(cell)
                    continue
                centers[ids.index(cell)] = halves[0]
                ids.append(np.int32(uuid.uuid4().int & 0x7FFFFFFF))  # two splits at once take other numbers
                centers.append(halves[1])
                moved.append(cell)
            if moved:
                new = Codes(np.array(ids, np.int32), np.array(centers), codes.words)
                rows = self.store.read("codes").where(F.col("cell").isin(moved)).select("memory_id", "vector")
                changed = [k for k, c in enumerate(ids) if c in moved or k >= len(codes.cells)]
                batch = self.store.batch().put("cells", self._cells(new.cells[changed], new.centers[changed]))
                batch.delete("codes", rows.select("memory_id")).put("codes", self._encoded(rows, new)).commit()

    def _without_rows(self):
        return self.store.batch().delete("codes", self.store.read("codes").select("memory_id"))

    def _cells(self, cells: np.ndarray, centers: np.ndarray) -> DataFrame:
        return self.store.spark.createDataFrame([(int(c), [float(x) for x in center]) for c, center in zip(cells, centers, strict=True)], "cell int, center array<double>")

    def _encoded(self, vectors: DataFrame, codes: Codes) -> DataFrame:
        shared = vectors.sparkSession.sparkContext.broadcast(codes)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cell, code, error = shared.value.encode_with_error(_matrix(batch.column(1), shared.value.dimensions))
                said = pa.array([row.tobytes() for row in code], pa.binary())
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), said, pa.array(error)], names=["memory_id", "vector", "cell", "code", "error"])

        rows = vectors.select("memory_id", F.col("vector").cast("array<float>").alias("vector"))
        return rows.mapInArrow(run, "memory_id string, vector array<float>, cell int, code binary, error double")

    # search

    def search(self, queries: DataFrame, k: int = 10) -> DataFrame:
        """query_id, memory_id, score, rank: about the ``k`` most similar vectors of each query, by exact cosines of the candidates."""
        codes, out, block = self.codes(), None, []
        for row in queries.select("query_id", "vector").toLocalIterator():
            block.append((row["query_id"], row["vector"]))
            if len(block) == QUERY_BLOCK:
                found = self._search(codes, block, k)
                out, block = found if out is None else out.unionByName(found), []
        if block or out is None:
            found = self._search(codes, block, k)
            out = found if out is None else out.unionByName(found)
        return out

    def plan(self, codes: Codes, queries: np.ndarray) -> np.ndarray:
        """(query x cell): whether a query probes a cell."""
        n = len(codes.cells)
        probes = min(n, self.probes if isinstance(self.probes, int) else max(1, math.ceil(self.probes * n)))
        order = np.argsort(-(queries @ codes.centers.T), axis=1, kind="stable")[:, :probes]
        out = np.zeros((len(queries), n), bool)
        np.put_along_axis(out, order, True, 1)
        return out

    def candidates_of(self, codes: Codes, block: list[tuple[str, list[float]]], k: int) -> DataFrame:
        """query, memory_id, cell: the rows that the codes say are nearest, ``candidates`` times ``k`` for each query."""
        spark = self.store.spark
        if any(len(v) != codes.dimensions for _, v in block):
            raise ComputationError("vectors of unlike dimensions")
        queries = unit(np.array([v for _, v in block], np.float64).reshape(len(block), codes.dimensions))
        probed = self.plan(codes, queries)
        wanted = [int(c) for c, some in zip(codes.cells, probed.any(0), strict=True) if some]
        # (cell -> the queries that probe it), their tables, and their products with the centers
        asked = {int(c): np.flatnonzero(probed[:, j]) for j, c in enumerate(codes.cells)}
        base = {int(c): queries @ codes.centers[j] for j, c in enumerate(codes.cells)}
        shared = spark.sparkContext.broadcast((asked, base, codes.tables(queries)))
        most = k * self.candidates
        rows = self.store.read("codes").where(F.col("cell").isin(wanted)).select("memory_id", "cell", "code")
        found = rows.mapInArrow(_scan(shared, most), "query int, memory_id string, cell int, score float")
        rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "memory_id"))
        return found.withColumn("nth", rank).where(F.col("nth") <= most).select("query", "memory_id", "cell")

    def _search(self, codes: Codes, block: list[tuple[str, list[float]]], k: int) -> DataFrame:
        # a block of queries times the candidates of each: the bound of this broadcast
        best = self._scored(F.broadcast(self.candidates_of(codes, block, k)), block, k)
        if isinstance(self.probes, int) or self.probes < 1.0:
            return best
        # every cell is probed, so the nearest of all are asked for: compare whatever the codes can't rule out
        best = materialize(best, "best")
        least = {r["query_id"]: r["least"] for r in best.where(F.col("rank") == k).groupBy("query_id").agg(F.min("score").alias("least")).collect()}  # one row a query
        return self._scored(self._not_ruled_out(codes, block, np.array([least.get(i, -np.inf) for i, _ in block])), block, k)

    def _not_ruled_out(self, codes: Codes, block: list[tuple[str, list[float]]], least: np.ndarray) -> DataFrame:
        """query, memory_id, cell: the rows whose codes, with their errors, allow a score of ``least`` of the query or more."""
        queries = unit(np.array([v for _, v in block], np.float64).reshape(len(block), codes.dimensions))
        base = {int(c): queries @ codes.centers[j] for j, c in enumerate(codes.cells)}
        shared = self.store.spark.sparkContext.broadcast((base, codes.tables(queries), least - SLACK))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            base, tables, least = shared.value
            for whole in batches:
                for at in range(0, whole.num_rows, ROWS):
                    batch = whole.slice(at, ROWS)
                    cell = batch.column(1).to_numpy()
                    code = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
                    most = np.stack([base[c] for c in cell.tolist()], 1) + batch.column(3).to_numpy(zero_copy_only=False)
                    for j in range(code.shape[1]):
                        most += tables[j][:, code[:, j]]
                    query, found = np.nonzero(~(most < least[:, None]))
                    yield pa.RecordBatch.from_arrays([pa.array(query.astype(np.int32)), batch.column(0).take(pa.array(found)), pa.array(cell[found], pa.int32())], names=["query", "memory_id", "cell"])

        # a row without an error is ruled out by nothing
        rows = self.store.read("codes").select("memory_id", "cell", "code", F.coalesce("error", F.lit(2.0)).alias("error"))
        return rows.mapInArrow(run, "query int, memory_id string, cell int")

    def _scored(self, near: DataFrame, block: list[tuple[str, list[float]]], k: int) -> DataFrame:
        met = self.store.read("codes").select("memory_id", "cell", "vector").join(near, ["memory_id", "cell"])
        shared = self.store.spark.sparkContext.broadcast(([i for i, _ in block], np.array([v for _, v in block], np.float64)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, queries = shared.value
            for batch in batches:
                x, of = _matrix(batch.column(1), queries.shape[1] if queries.ndim > 1 else 0), batch.column(2).to_numpy()
                score = np.array([similarities(v[None], queries[i][None], "cosine")[0, 0] for v, i in zip(x, of, strict=True)], np.float64)
                yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in of.tolist()], pa.string()), batch.column(0), pa.array(np.round(score, 6) + 0.0)], names=["query_id", "memory_id", "score"])

        scored = met.select("memory_id", "vector", "query").mapInArrow(run, "query_id string, memory_id string, score double")
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "memory_id"))
        return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def _scan(shared, most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The best candidates of each query in a batch of codes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, base, tables = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                cell = batch.column(1).to_numpy()
                code = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
                score = np.full((tables.shape[1], batch.num_rows), -np.inf, np.float32)
                for c in np.unique(cell).tolist():
                    queries, rows = asked[c], np.flatnonzero(cell == c)
                    if len(queries):
                        sums = np.repeat(base[c][queries, None].astype(np.float32), len(rows), 1)
                        for j in range(code.shape[1]):
                            sums += tables[j][queries][:, code[rows, j]]
                        score[np.ix_(queries, rows)] = sums
                few = min(most, batch.num_rows)
                best = np.argpartition(-score, few - 1, axis=1)[:, :few]
                query = np.repeat(np.arange(len(score), dtype=np.int32), few)
                found = best.ravel()
                kept = np.isfinite(score[query, found])
                query, found = query[kept], found[kept]
                yield pa.RecordBatch.from_arrays([pa.array(query), batch.column(0).take(pa.array(found)), pa.array(cell[found], pa.int32()), pa.array(score[query, found])], names=["query", "memory_id", "cell", "score"])

    return run
