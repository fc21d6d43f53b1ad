"""Dimension reduction as stages of a machine-learning pipeline, with parameters, saving and loading."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol, HasSeed
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.operators.reduce import VectorReducer
from lorekeep.operators.vectors import _matrix


class _Reduction(HasInputCol, HasOutputCol, HasSeed):
    method = Param(Params._dummy(), "method", "pca, projection or truncation", TypeConverters.toString)
    target = Param(Params._dummy(), "target", "dimensions that are left", TypeConverters.toInt)

    def __init__(self, *args):
        super().__init__(*args)
        self._setDefault(inputCol="vector", outputCol="reduced_vector", method="pca", seed=1)

    def getMethod(self) -> str:
        return self.getOrDefault(self.method)

    def getTarget(self) -> int:
        return self.getOrDefault(self.target)


class VectorReduction(Estimator, _Reduction, DefaultParamsReadable, DefaultParamsWritable):
    """Fits a reducer on a column of arrays. All rows are read; null vectors are left out."""

    @keyword_only
    def __init__(self, *, inputCol: str = "vector", outputCol: str = "reduced_vector", method: str = "pca", target: int | None = None, seed: int = 1):
        super().__init__()
        self.setParams(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    @keyword_only
    def setParams(self, *, inputCol: str = "vector", outputCol: str = "reduced_vector", method: str = "pca", target: int | None = None, seed: int = 1) -> VectorReduction:
        return self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> VectorReductionModel:
        rows = dataset.select(F.col(f"`{self.getInputCol()}`").cast("array<double>").alias("vector")).where("vector IS NOT NULL")
        fitted = VectorReducer(self.getMethod(), self.getTarget(), self.getSeed()).fit(rows)
        return self._copyValues(VectorReductionModel(fitted.mean, fitted.basis))


class VectorReductionModel(Model, _Reduction, MLReadable, MLWritable):
    """Adds the reduced vectors as a column; null where the vector is null. A column of that name is replaced."""

    def __init__(self, mean: np.ndarray | None = None, basis: np.ndarray | None = None):
        super().__init__()
        self.mean, self.basis = mean, basis

    def _transform(self, dataset: DataFrame) -> DataFrame:
        shared = dataset.sparkSession.sparkContext.broadcast((self.mean, self.basis))

        @F.pandas_udf("array<double>")
        def reduced(vectors: pd.Series) -> pd.Series:
            mean, basis = shared.value
            known = vectors.notna().to_numpy()
            made = iter((_matrix(pa.array(vectors[known].tolist(), pa.list_(pa.float64())), len(mean)) - mean) @ basis if known.any() else ())
            out = pd.Series([next(made) if k else None for k in known], index=vectors.index, dtype=object)
            return out

        return dataset.withColumn(self.getOutputCol(), reduced(F.col(f"`{self.getInputCol()}`").cast("array<double>")))

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)


class _Writer(MLWriter):
    def __init__(self, instance: VectorReductionModel):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession)
        rows = [(i, float(m), [float(x) for x in b]) for i, (m, b) in enumerate(zip(self.instance.mean, self.instance.basis, strict=True))]
        self.sparkSession.createDataFrame(rows, "dimension int, mean double, basis array<double>").coalesce(1).write.parquet(f"{path}/data")


class _Reader(MLReader):
    def __init__(self, kind: type[VectorReductionModel]):
        super().__init__()
        self.kind = kind

    def load(self, path: str) -> VectorReductionModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        rows = sorted(self.sparkSession.read.parquet(f"{path}/data").collect(), key=lambda r: r["dimension"])
        model = self.kind(np.array([r["mean"] for r in rows]), np.array([r["basis"] for r in rows]))
        DefaultParamsReader.getAndSetParams(model, metadata)
        model._resetUid(metadata["uid"])
        return model
