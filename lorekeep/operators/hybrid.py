"""Hybrid search: keyword hits and vector hits, joined and combined to one score."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.errors import InvalidOperation
from lorekeep.functions.columns import tenth
from lorekeep.functions.metadata import has_value
from lorekeep.operators import vectors as vector_ops
from lorekeep.operators.text_search import matches_all, matches_any


@dataclass(frozen=True)
class HybridQuery:
    """What to search for, and how the parts count.

    Memories without a keyword or vector hit don't appear. Filters hold after the vector top k, or
    before it with ``prefilter``. Of several metadata filters one is enough, or all with match="all".
    """

    text: str | None = None
    vector: tuple[float, ...] | None = None
    vector_limit: int = 10
    metadata: tuple[tuple[str, str], ...] = ()
    match: str = "any"
    required: tuple[str, ...] = ()
    excluded: tuple[str, ...] = ()
    source: str | None = None
    min_confidence: float | None = None
    bucketed: bool = True
    collection: str | None = None
    method: str = "weighted"
    keyword_weight: float = 1.0
    vector_weight: float = 1.0
    metadata_weight: float = 0.5
    limit: int = 10
    prefilter: bool = False

    def with_text(self, text: str) -> HybridQuery:
        return replace(self, text=text)

    def with_vector(self, vector: list[float], limit: int = 10) -> HybridQuery:
        return replace(self, vector=tuple(vector), vector_limit=limit)


def combine(method: str, parts: dict[str, tuple[Column, float]]) -> Column:
    """sum, max (at least 0) or weighted mean over the components that a row has."""
    present = lambda make: sum((F.when(c.isNotNull(), make(c, w)).otherwise(0.0) for c, w in parts.values()), F.lit(0.0))
    if method == "sum":
        return present(lambda c, w: c)
    if method == "max":
        return F.greatest(F.lit(0.0), *[F.coalesce(c, F.lit(0.0)) for c, _ in parts.values()])
    if method != "weighted":
        raise InvalidOperation(f"unknown method {method}")
    total = present(lambda c, w: F.lit(float(w)))
    return F.when(total > 0, present(lambda c, w: c * w) / total).otherwise(0.0)


def _filters(query: HybridQuery, members: DataFrame | None, rows: DataFrame) -> DataFrame:
    if query.source is not None:
        rows = rows.where(F.col("source") == query.source)
    if query.min_confidence is not None:
        least = F.lit(query.min_confidence)
        rows = rows.where(tenth(F.col("confidence")) >= tenth(least) if query.bucketed else F.col("confidence") >= least)
    if query.required:
        rows = rows.where(matches_all(F.col("content"), " ".join(query.required)))
    for word in query.excluded:
        rows = rows.where(~matches_any(F.col("content"), word))
    if query.collection is not None:
        if members is None:
            raise InvalidOperation("a collection needs the members of collections")
        ids = members.where(F.col("collection_id") == query.collection).select(F.col("memory_id").alias("id"))
        rows = rows.join(ids, "id", "left_semi")
    return rows


def search(memories: DataFrame, vectors: DataFrame, query: HybridQuery, members: DataFrame | None = None, embedder: vector_ops.Embedder | None = None) -> DataFrame:
    """The memories that fit best, with score and component_scores (keyword, vector, metadata)."""
    pool = _filters(query, members, memories) if query.prefilter else memories
    hits = None
    if query.text is not None:
        hits = pool.where(matches_any(F.col("content"), query.text)).select("id", F.lit(1.0).alias("keyword"))
    if query.vector is not None or query.text is not None and embedder is not None:
        rows = vectors.join(pool.select(F.col("id").alias("memory_id")), "memory_id", "left_semi") if query.prefilter else vectors
        near = vector_ops.search(rows, query.vector_limit, vector=list(query.vector) if query.vector else None, text=query.text, embedder=embedder)
        near = near.select(F.col("memory_id").alias("id"), F.col("score").alias("vector"))
        hits = near if hits is None else hits.join(near, "id", "full")
    if hits is None:
        raise InvalidOperation("a hybrid query needs a text or a vector")
    for name in ("keyword", "vector"):
        if name not in hits.columns:
            hits = hits.withColumn(name, F.lit(None).cast("double"))
    rows = _filters(query, members, memories.join(hits, "id"))
    rows = rows.withColumn("metadata_hit", F.lit(None).cast("double"))
    if query.metadata:
        tests = [has_value(F.col("metadata"), k, v) for k, v in query.metadata]
        fits = tests[0]
        for t in tests[1:]:
            fits = (fits | t) if query.match == "any" else (fits & t)
        rows = rows.where(fits).withColumn("metadata_hit", F.lit(1.0))
    parts = {"keyword": (F.col("keyword"), query.keyword_weight), "vector": (F.col("vector"), query.vector_weight), "metadata": (F.col("metadata_hit"), query.metadata_weight)}
    entries = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, parts)), F.array(*[c for c, _ in parts.values()])), lambda _, v: v.isNotNull())
    scored = rows.withColumns({"score": F.round(combine(query.method, parts), 6), "component_scores": entries})
    return scored.select(*memories.columns, "score", "component_scores").orderBy(F.desc("score"), "id").limit(query.limit)
