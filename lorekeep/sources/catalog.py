"""The tables of a memory graph, and their derivation from plain corpus tables."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorekeep.operators import text_search

_S = T.StringType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


MEMORIES = _struct(
    id=_S, content=_S, source=_S, confidence=T.DoubleType(), importance=T.DoubleType(), access_count=T.LongType(),
    timestamp=T.TimestampNTZType(), last_accessed=T.TimestampNTZType(), ttl=T.LongType(), metadata=_S,
)
LINKS = _struct(id=_S, source_id=_S, target_id=_S, relationship_type=_S, weight=T.DoubleType(), metadata=_S)
COLLECTIONS = _struct(id=_S, name=_S, description=_S, metadata=_S)
COLLECTION_MEMBERS = _struct(collection_id=_S, memory_id=_S)
AGENTS = _struct(id=_S, name=_S, description=_S, capabilities=T.ArrayType(_S), metadata=_S)
AGENT_GRANTS = _struct(agent_id=_S, collection_id=_S)
CONTEXTS = _struct(id=_S, name=_S, description=_S, metadata=_S)
CONTEXT_MEMBERS = _struct(context_id=_S, memory_id=_S)
CONTEXT_AGENTS = _struct(context_id=_S, agent_id=_S)
VECTORS = _struct(memory_id=_S, vector=T.ArrayType(T.FloatType()), model=_S, dimensions=T.IntegerType(), metadata=T.MapType(_S, _S), reduced=T.BooleanType())
POSTINGS = _struct(memory_id=_S, token=_S, stem=_S)

SCHEMAS: dict[str, T.StructType] = {
    "memories": MEMORIES, "links": LINKS, "collections": COLLECTIONS, "collection_members": COLLECTION_MEMBERS, "agents": AGENTS,
    "agent_grants": AGENT_GRANTS, "contexts": CONTEXTS, "context_members": CONTEXT_MEMBERS, "context_agents": CONTEXT_AGENTS, "vectors": VECTORS,
    "postings": POSTINGS,
}

#: Identity of a row, for upserts and deletes.
KEYS: dict[str, tuple[str, ...]] = {
    "memories": ("id",), "links": ("id",), "collections": ("id",), "collection_members": ("collection_id", "memory_id"), "agents": ("id",),
    "agent_grants": ("agent_id", "collection_id"), "contexts": ("id",), "context_members": ("context_id", "memory_id"),
    "context_agents": ("context_id", "agent_id"), "vectors": ("memory_id", "reduced"), "postings": ("memory_id", "token"),
}


#: What a store keeps besides: an approximate vector index.
INDEX_SCHEMAS: dict[str, T.StructType] = {
    "cells": _struct(cell=T.IntegerType(), center=T.ArrayType(T.DoubleType())),
    "codebook": _struct(part=T.IntegerType(), words=T.ArrayType(T.ArrayType(T.DoubleType()))),
    "codes": _struct(memory_id=_S, vector=T.ArrayType(T.FloatType()), cell=T.IntegerType(), code=T.BinaryType(), error=T.DoubleType()),
}
INDEX_KEYS: dict[str, tuple[str, ...]] = {"cells": ("cell",), "codebook": ("part",), "codes": ("memory_id",)}


@dataclass(frozen=True)
class Tables:
    """All tables of a graph, by name; each a lazy DataFrame."""

    frames: dict[str, DataFrame]

    def __getattr__(self, name: str) -> DataFrame:
        try:
            return self.frames[name]
        except KeyError:
            raise AttributeError(name) from None

    def replace(self, **frames: DataFrame) -> Tables:
        return Tables({**self.frames, **frames})


def from_rows(spark: SparkSession, **rows: list[tuple]) -> Tables:
    """Tables from literal rows; those that aren't given are empty."""
    return Tables({name: spark.createDataFrame(rows.get(name, []), schema) for name, schema in SCHEMAS.items()})


class CorpusCatalog:
    """A memory graph over the tables of a folder: documents, events, embeddings, conversations, supplier."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def memories(self) -> DataFrame:
        start = "TIMESTAMP_NTZ '2024-01-01 00:00:00'"
        return self.table("documents").selectExpr(
            "CAST(doc_id AS STRING) AS id",
            "text AS content",
            "source",
            "((doc_id * 37) % 101) / 100.0D AS confidence",
            "((doc_id * 53) % 101) / 100.0D AS importance",
            "(doc_id * 7) % 130 AS access_count",
            f"CAST(timestampadd(SECOND, doc_id * 7919, {start}) AS TIMESTAMP_NTZ) AS timestamp",
            f"CAST(timestampadd(SECOND, doc_id * 7919 + ((doc_id * 7) % 130) * 3600, {start}) AS TIMESTAMP_NTZ) AS last_accessed",
            "CASE WHEN doc_id % 3 = 0 THEN (doc_id % 50 + 1) * 86400 END AS ttl",
            """concat('{"lang":"', lang, '","topic":"t', CAST(doc_id % 12 AS STRING), '","rank":', CAST(doc_id % 5 AS STRING), '}') AS metadata""",
        )

    @cached_property
    def links(self) -> DataFrame:
        """Three links a document; some point nowhere, one to itself."""
        size = self.table("documents").agg(F.count(F.lit(1)).alias("n"))
        ids = self.table("documents").select("doc_id").crossJoin(F.broadcast(size))
        return ids.select("doc_id", "n", F.explode(F.array(*[F.lit(k).cast("bigint") for k in (2, 3, 5)])).alias("k")).selectExpr(
            "CAST(doc_id * 10 + k AS STRING) AS id",
            "CAST(doc_id AS STRING) AS source_id",
            "CAST(CASE WHEN doc_id % 97 = 0 AND k = 5 THEN n + doc_id ELSE (doc_id * k + 1) % n END AS STRING) AS target_id",
            "CASE k WHEN 2 THEN 'supports' WHEN 3 THEN 'causes' ELSE 'references' END AS relationship_type",
            "((doc_id * k) % 91 + 10) / 101.0D AS weight",
            "CAST(NULL AS STRING) AS metadata",
        )

    @cached_property
    def event_memories(self) -> DataFrame:
        return self.table("events").selectExpr("CAST(event_id AS STRING) AS id", "ts AS timestamp", "event_type AS source", "value", "props AS metadata", "user_id")

    @cached_property
    def event_links(self) -> DataFrame:
        """Each event of a user with the next three."""
        window = "OVER (PARTITION BY user_id ORDER BY ts, event_id)"
        ahead = self.table("events").selectExpr("event_id", "event_type", *[f"lead(event_id, {i}) {window} AS n{i}" for i in (1, 2, 3)])
        return ahead.selectExpr("event_id", "event_type", "stack(3, 1, n1, 2, n2, 3, n3) AS (lag, target)").where("target is not null").selectExpr(
            "CAST(event_id * 10 + lag AS STRING) AS id", "CAST(event_id AS STRING) AS source_id", "CAST(target AS STRING) AS target_id",
            "event_type AS relationship_type", "1.0D / lag AS weight", "CAST(NULL AS STRING) AS metadata",
        )

    @cached_property
    def supplier_links(self) -> DataFrame:
        """Suppliers that share orders, each pair once in either direction, with the number of shared orders.

        Lines are dealt out by order once, which serves the removal of doubles and both sides of the join.
        """
        parts = self.table("lineitem").select("l_orderkey", "l_suppkey").repartition("l_orderkey").distinct()
        a, b = parts.alias("a"), parts.alias("b")
        pairs = a.join(b, (F.col("a.l_orderkey") == F.col("b.l_orderkey")) & (F.col("a.l_suppkey") < F.col("b.l_suppkey")))
        counted = pairs.groupBy(F.col("a.l_suppkey").alias("s"), F.col("b.l_suppkey").alias("t")).agg(F.count(F.lit(1)).alias("n"))
        return counted.selectExpr(
            "concat(s, '-', t) AS id", "CAST(s AS STRING) AS source_id", "CAST(t AS STRING) AS target_id", "'shares_orders' AS relationship_type",
            "CAST(n AS DOUBLE) AS weight", "CAST(NULL AS STRING) AS metadata",
        )

    @cached_property
    def collections(self) -> DataFrame:
        return self.memories.select("source").distinct().selectExpr("source AS id", "concat('source ', source) AS name", "'' AS description", "CAST(NULL AS STRING) AS metadata")

    @cached_property
    def collection_members(self) -> DataFrame:
        return self.memories.selectExpr("source AS collection_id", "id AS memory_id")

    @cached_property
    def agents(self) -> DataFrame:
        return self.table("supplier").selectExpr(
            "CAST(s_suppkey AS STRING) AS id", "s_name AS name", "'' AS description", "array('read', concat('nation', s_nationkey)) AS capabilities", "CAST(NULL AS STRING) AS metadata"
        )

    @cached_property
    def agent_grants(self) -> DataFrame:
        sources = F.explode(F.sequence(F.lit(0), F.lit(19))).alias("k")
        return (
            self.table("supplier").select("s_suppkey", sources).where("(k + s_suppkey) % 5 = 0")
            .selectExpr("CAST(s_suppkey AS STRING) AS agent_id", "concat('src', k) AS collection_id")
        )

    @cached_property
    def contexts(self) -> DataFrame:
        return self.table("conversations").select("conv_id").distinct().selectExpr(
            "CAST(conv_id AS STRING) AS id", "concat('conversation ', conv_id) AS name", "'' AS description", "CAST(NULL AS STRING) AS metadata"
        )

    def _by_context(self, ids: DataFrame, column: str, name: str) -> DataFrame:
        size = self.table("conversations").agg(F.countDistinct("conv_id").alias("n"))
        return ids.crossJoin(F.broadcast(size)).selectExpr(f"CAST({column} % n AS STRING) AS context_id", f"CAST({column} AS STRING) AS {name}")

    @cached_property
    def context_members(self) -> DataFrame:
        return self._by_context(self.table("documents").select("doc_id"), "doc_id", "memory_id")

    @cached_property
    def context_agents(self) -> DataFrame:
        return self._by_context(self.table("supplier").select("s_suppkey"), "s_suppkey", "agent_id")

    @cached_property
    def vectors(self) -> DataFrame:
        return self.table("embeddings").selectExpr(
            "CAST(vec_id AS STRING) AS memory_id", "embedding AS vector", "'table' AS model", "size(embedding) AS dimensions", "CAST(map() AS MAP<STRING, STRING>) AS metadata", "false AS reduced"
        )

    @cached_property
    def postings(self) -> DataFrame:
        return text_search.postings(self.memories)

    def tables(self) -> Tables:
        return Tables({name: getattr(self, name) for name in SCHEMAS})
