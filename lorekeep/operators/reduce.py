"""Dimension reduction of vectors: principal components, random projection, truncation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.errors import ComputationError, InvalidOperation
from lorekeep.operators.vectors import _matrix

METHODS = ("pca", "projection", "truncation")


class VectorReducer:
    """Fit on a ``vectors`` table, then transform it; the reduced rows have reduced = true."""

    def __init__(self, method: str, target: int, seed: int = 1):
        if method not in METHODS:
            raise InvalidOperation(f"unknown method {method}")
        self.method, self.target, self.seed = method, target, seed
        self.source: int | None = None
        self.mean: np.ndarray | None = None
        self.basis: np.ndarray | None = None
        self.explained: np.ndarray | None = None

    def fit(self, vectors: DataFrame) -> VectorReducer:
        """One pass over all rows; only sums of the size dimensions squared come to the driver."""
        sizes = [r[0] for r in vectors.select(F.size("vector")).distinct().limit(2).collect()]
        if not sizes:
            raise ComputationError("no vectors to fit on")
        if len(sizes) > 1:
            raise ComputationError("vectors of unlike dimensions")
        self.source = n = sizes[0]
        if self.target >= n:
            raise InvalidOperation(f"{self.target} dimensions are no fewer than {n}")
        if self.method == "projection":
            self.mean = np.zeros(n)
            self.basis = np.random.default_rng(self.seed).normal(0, 1 / np.sqrt(self.target), (n, self.target))
        elif self.method == "truncation":
            self.mean, self.basis = np.zeros(n), np.eye(n)[:, : self.target]
        else:
            self._components(vectors, n)
        return self

    def _components(self, vectors: DataFrame, n: int) -> None:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((n + 1, n + 1))
            for batch in batches:
                x = np.c_[_matrix(batch.column(0), n), np.ones(batch.num_rows)]
                total += x.T @ x
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size, dtype=np.int32)), pa.array(total.reshape(-1))], names=["cell", "x"])

        sums = vectors.select("vector").mapInArrow(run, "cell int, x double").groupBy("cell").agg(F.sum("x").alias("x")).collect()
        total = np.zeros((n + 1) ** 2)
        for r in sums:
            total[r["cell"]] = r["x"]
        total = total.reshape(n + 1, n + 1)
        count = total[n, n]
        self.mean = total[n, :n] / count
        values, axes = np.linalg.eigh(total[:n, :n] / count - np.outer(self.mean, self.mean))
        order = np.argsort(-values)[: self.target]
        axes = axes[:, order]
        axes = axes * np.where(axes[np.abs(axes).argmax(0), np.arange(self.target)] < 0, -1, 1)  # the largest entry is positive
        self.basis, self.explained = axes, np.maximum(values[order], 0)

    def transform(self, vectors: DataFrame) -> DataFrame:
        if self.basis is None:
            raise InvalidOperation("fit the reducer first")
        if self.method == "truncation":
            small = vectors.withColumn("vector", F.slice("vector", 1, self.target).cast("array<double>"))
        else:
            small = self._project(vectors)
        extra = F.create_map(
            F.lit("original_dimensions"), F.lit(str(self.source)), F.lit("reduction_method"), F.lit(self.method), F.lit("target_dimensions"), F.lit(str(self.target))
        )
        return small.withColumns(
            {
                "model": F.concat("model", F.lit("_reduced")),
                "dimensions": F.lit(self.target),
                "metadata": F.map_concat(F.map_filter("metadata", lambda k, _: ~k.isin("original_dimensions", "reduction_method", "target_dimensions")), extra),
                "reduced": F.lit(True),
            }
        )

    def _project(self, vectors: DataFrame) -> DataFrame:
        shared = vectors.sparkSession.sparkContext.broadcast((self.mean, self.basis))
        place = vectors.columns.index("vector")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            mean, basis = shared.value
            for batch in batches:
                made = (_matrix(batch.column(place), len(mean)) - mean) @ basis
                lists = pa.ListArray.from_arrays(np.arange(0, made.size + 1, made.shape[1], dtype=np.int32), pa.array(made.reshape(-1)))
                yield pa.RecordBatch.from_arrays([*batch.columns[:place], lists, *batch.columns[place + 1 :]], names=batch.schema.names)

        schema = ", ".join(f"`{f.name}` {'array<double>' if f.name == 'vector' else f.dataType.simpleString()}" for f in vectors.schema)
        return vectors.mapInArrow(run, schema)
