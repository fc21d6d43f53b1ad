"""Centroid clustering with Drake's adaptive bounds (Drake and Hamerly 2012), in integers.

Each vector keeps an upper bound of the distance to its centroid, lower bounds of the distances to its
few nearest other centroids, in order, and one remainder bound for all that are farther. Centroids move,
and the bounds move with them. Where the order of the bounds certifies that no other centroid can be as
near, a vector stays without any distance; where it certifies a shorter list of candidates, only these
are compared; else all are. Bounds are rounded outwards and a tie is never certified, so the assignments are
those of comparing everything. The number of bounds follows the longest list that a round needed.

Centroids are a bounded number of rows and go to all tasks; vectors with their bounds are written after each
round and never leave the cluster. Sums of a cluster are combined in the tasks that read it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.session import materialize

CENTROIDS, ROUNDS, DIMENSIONS, SCALE = 16, 3, 64, 64
#: Components beyond this size count as of this size, so that squared distances of 64 of them fit 63 bits.
LARGEST = 1 << 27
#: Rounding outwards: bounds take a few floating-point steps a round, each off by 1e-16 of its value.
SLACK = 1e-12
#: Vectors that are compared at once.
BLOCK = 2048

STATE = "vec_id bigint, v array<bigint>, cluster int, upper double, near array<int>, low array<double>, rest double, used int, distance bigint"


def kept_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """vec_id, v (components floor(scale * x)) of vectors of exactly ``dimensions`` finite components."""
    x = F.col(f"`{vector_col}`").cast("array<double>")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    whole = F.transform(x, lambda c: F.floor(F.greatest(F.lit(-float(LARGEST)), F.least(F.lit(float(LARGEST)), c * scale))).cast("bigint"))
    return vectors.where((F.size(x) == dimensions) & finite).select(F.col(f"`{id_col}`").cast("bigint").alias("vec_id"), whole.alias("v"))


def first_centroids(kept: DataFrame, k: int) -> np.ndarray:
    """The vectors whose ids hash lowest; null ids come last, and rows of one id in the order of their components."""
    rank = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    rows = kept.orderBy(rank.asc_nulls_last(), "v").limit(k).select("v").collect()
    return np.array([r["v"] for r in rows], dtype=np.int64)


def squared(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of ``v`` to all rows of ``c``."""
    most = max(int(np.abs(v).max(initial=0)), int(np.abs(c).max(initial=0)))
    kind = np.float64 if most * most * v.shape[1] * 4 < 2**53 else np.int64  # floats are exact below 2^53, and faster
    a, b = v.astype(kind), c.astype(kind)
    return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)


def outwards(d2: np.ndarray, side: int) -> np.ndarray:
    return np.sqrt(d2.astype(np.float64)) * (1 + side * SLACK)


class Bounds:
    """The state of a block of vectors, as arrays."""

    def __init__(self, v: np.ndarray, cluster: np.ndarray, upper: np.ndarray, near: np.ndarray, low: np.ndarray, rest: np.ndarray):
        self.v, self.cluster, self.upper, self.near, self.low, self.rest = v, cluster, upper, near, low, rest

    @staticmethod
    def unknown(v: np.ndarray, bounds: int) -> Bounds:
        """Nothing is known, so nothing is certified."""
        n = len(v)
        return Bounds(v, np.zeros(n, np.int32), np.full(n, np.inf), np.zeros((n, bounds), np.int32), np.zeros((n, bounds)), np.zeros(n))

    def narrow(self, bounds: int) -> None:
        """Keep fewer bounds; those that go are part of the remainder."""
        if bounds < self.near.shape[1]:
            self.rest = np.minimum(self.rest, self.low[:, bounds:].min(1))
            self.near, self.low = self.near[:, :bounds], self.low[:, :bounds]

    def moved(self, drift: np.ndarray) -> None:
        """Centroids moved by at most ``drift``."""
        self.upper = (self.upper + drift[self.cluster]) * (1 + SLACK)
        self.low = np.maximum(0, self.low - drift[self.near]) * (1 - SLACK)
        self.rest = np.maximum(0, self.rest - drift.max(initial=0)) * (1 - SLACK)

    def assign(self, centroids: np.ndarray) -> np.ndarray:
        """Move each vector to its nearest centroid; how many ranks of each list were compared, -1 for all centroids."""
        n, bounds = self.near.shape
        # a rank's bound holds for all behind it too
        tail = np.minimum.accumulate(np.concatenate([self.low, self.rest[:, None]], 1)[:, ::-1], 1)[:, ::-1]
        doubt = np.flatnonzero(~(self.upper < tail[:, 0]))
        own = ((self.v[doubt] - centroids[self.cluster[doubt]]) ** 2).sum(1)
        self.upper[doubt] = np.where(np.isinf(self.upper[doubt]), np.inf, outwards(own, 1))
        certified = self.upper[:, None] < tail
        ranks = np.where(certified.any(1), certified.argmax(1), -1).astype(np.int32)
        for z in range(1, bounds + 1):
            rows = np.flatnonzero(ranks == z)
            if len(rows):
                self._compare(rows, z, centroids)
        rows = np.flatnonzero(ranks == -1)
        if len(rows):
            self._compare_all(rows, centroids)
        return ranks

    def _compare(self, rows: np.ndarray, z: int, centroids: np.ndarray) -> None:
        """Order the centroid and the first ``z`` of the list anew, by exact distances."""
        ids = np.concatenate([self.cluster[rows, None], self.near[rows, :z]], 1)
        d2 = ((self.v[rows][:, None, :] - centroids[ids]) ** 2).sum(2)
        order = np.lexsort((ids, d2), axis=1)
        ids, d2 = np.take_along_axis(ids, order, 1), np.take_along_axis(d2, order, 1)
        self.cluster[rows], self.upper[rows] = ids[:, 0], outwards(d2[:, 0], 1)
        self.near[rows, :z], self.low[rows, :z] = ids[:, 1:], outwards(d2[:, 1:], -1)

    def _compare_all(self, rows: np.ndarray, centroids: np.ndarray) -> None:
        bounds = self.near.shape[1]
        d2 = squared(self.v[rows], centroids)
        order = np.argsort(d2, 1, kind="stable").astype(np.int32)  # ties: the smaller number first
        d2 = np.take_along_axis(d2, order, 1)
        self.cluster[rows], self.upper[rows] = order[:, 0], outwards(d2[:, 0], 1)
        self.near[rows], self.low[rows] = order[:, 1 : bounds + 1], outwards(d2[:, 1 : bounds + 1], -1)
        self.rest[rows] = outwards(d2[:, bounds + 1], -1) if d2.shape[1] > bounds + 1 else np.inf


def _rows(batch: pa.RecordBatch, name: str, width: int, kind: type) -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, width)


def _lists(x: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32) if x.shape[1] else np.zeros(len(x) + 1, np.int32), pa.array(x.ravel(), kind))


def _step(centroids: np.ndarray, drift: np.ndarray | None, had: int, bounds: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Assign vectors anew. ``had`` bounds are in the rows, ``bounds`` shall be; without ``drift`` nothing is known yet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(at, BLOCK)
                v = _rows(batch, "v", centroids.shape[1], np.int64)
                if drift is None:
                    state = Bounds.unknown(v, bounds)
                else:
                    one = lambda name: batch.column(name).to_numpy(zero_copy_only=False).copy()  # noqa: B023, E731
                    state = Bounds(v, one("cluster"), one("upper"), _rows(batch, "near", had, np.int32), _rows(batch, "low", had, np.float64), one("rest"))
                    state.narrow(bounds)
                    state.moved(drift)
                used = state.assign(centroids)
                distance = ((v - centroids[state.cluster]) ** 2).sum(1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id"), batch.column("v"), pa.array(state.cluster, pa.int32()), pa.array(state.upper), _lists(state.near, pa.int32()), _lists(state.low, pa.float64()), pa.array(state.rest), pa.array(used, pa.int32()), pa.array(distance, pa.int64())],
                    names=["vec_id", "v", "cluster", "upper", "near", "low", "rest", "used", "distance"],
                )

    return run


def _means(state: DataFrame, centroids: np.ndarray) -> tuple[np.ndarray, int]:
    """Componentwise floor(sum / count) of every cluster, empty ones as before, and the longest list that was needed."""
    sums = [F.sum(F.col("v")[i]).alias(f"s{i}") for i in range(centroids.shape[1])]
    out, longest = centroids.copy(), 0
    for r in state.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.max("used").alias("used"), *sums).collect():  # one row a centroid
        out[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in range(centroids.shape[1])]
        longest = max(longest, r["used"])
    return out, longest


def assigned(kept: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """The state of all vectors after the last assignment (see ``STATE``), and the centroids.

    used is the number of ranks of its list that a vector was compared with in the last assignment, 0 if the
    bounds alone certified it, -1 if all centroids were compared.
    """
    spark = kept.sparkSession
    kept = materialize(kept, "vectors")
    centroids = first_centroids(kept, k)
    if not len(centroids):
        return spark.createDataFrame([], STATE), centroids
    bounds = max(0, min(len(centroids) - 1, max(1, len(centroids) // 4)))
    state = materialize(kept.mapInArrow(_step(centroids, None, 0, bounds), STATE), "state")
    for i in range(rounds):
        new, longest = _means(state, centroids)
        drift = outwards(((new - centroids) ** 2).sum(1), 1)
        # the first round compares all centroids and tells nothing about lists
        fewer = bounds if i == 0 else min(bounds, max(1, len(centroids) // 8, longest))
        state = materialize(state.mapInArrow(_step(new, drift, bounds, fewer), STATE), "state")
        centroids, bounds = new, fewer
    return state, centroids


def cluster(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = CENTROIDS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, one row a kept vector.

    Kept are vectors with exactly ``dimensions`` components, none null, NaN or infinite; a component x counts
    as floor(scale * x), at most 2^27 in size. The ``k`` kept vectors with the smallest sha256 of ``1:<vec_id>`` are the first
    centroids, or all if there are fewer. Each round assigns vectors to the nearest centroid (ties: the smaller number)
    and moves each to the floor of its vectors' mean; an empty one stays. distance is squared, and
    inertia its sum (null beyond 63 bits). Rows that repeat an id count each, null ids are ranked last, an
    empty table gives no rows, and other columns are ignored whatever their names.
    """
    state, centroids = assigned(kept_vectors(vectors, id_col, vector_col, dimensions, scale), k, rounds)
    rows = state.select("vec_id", "cluster", "distance")
    total: Column = F.sum(F.col("distance").cast("decimal(38,0)"))
    of = {r["cluster"]: r["t"] for r in rows.groupBy("cluster").agg(total.alias("t")).collect()}  # one row a centroid
    fits = lambda t: int(t) if t < 2**63 else None
    facts = [(j, fits(t), fits(sum(of.values())), hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest()) for j, t in of.items()]
    told = rows.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return rows.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
