"""Registered queries over stores, exchange formats, changes of records and the facade, with their DuckDB twins."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.functions import columns as C
from lorekeep.operators import analytics, filters, forgetting, groups, hybrid, links, text_search, vectors
from lorekeep.plans.engine import MemoryEngine
from lorekeep.plans.registry import AGENT, NOW, SOURCE, WORD, _add, _core_sql, _ids, _sql, _VECTORS
from lorekeep.session import shared_folder
from lorekeep.sources import exchange, generate, store
from lorekeep.sources.catalog import CorpusCatalog


def _folder(c: CorpusCatalog) -> str:
    return f"{shared_folder(c.spark)}/lorekeep/stores/{uuid.uuid4().hex}"


def _kept(c: CorpusCatalog, *names: str) -> store.GraphStore:
    """A new store with some tables of a folder, put in one commit."""
    out = store.GraphStore(c.spark, _folder(c))
    batch = out.batch()
    for name in names:
        batch.put(name, getattr(c, name))
    batch.commit()
    return out


_LINK = ("id", "source_id", "target_id", "relationship_type", "weight")
_LINK_SQL = ", ".join(_LINK)

# stores

_add("store_ids", lambda c: _kept(c, "memories").ids("memories"), _sql("m", "SELECT id FROM memories"))
_add("store_get", lambda c: _kept(c, "memories").get("memories", "7").select("id", "content", "confidence"), _sql("m", "SELECT id, content, confidence FROM memories WHERE id = '7'"))


def _deleted(c: CorpusCatalog) -> DataFrame:
    kept = _kept(c, "memories", "links")
    kept.batch().delete_memories(filters.min_confidence(c.memories, 0.8).select("id")).commit()
    return kept.read("links").select(*_LINK).unionByName(kept.read("memories").select("id", *[F.lit(None).cast(t).alias(n) for n, t in c.links.select(*_LINK[1:]).dtypes]))


_HIGH = "(SELECT id FROM memories WHERE confidence >= 0.8)"
_add("store_delete", _deleted, _sql("ml", f"SELECT {_LINK_SQL} FROM links WHERE source_id NOT IN {_HIGH} AND target_id NOT IN {_HIGH} UNION ALL SELECT id, NULL, NULL, NULL, NULL FROM memories WHERE id NOT IN {_HIGH}"))
_add(
    "store_vectors",
    lambda c: _kept(c, "vectors").read("vectors").select("memory_id", "dimensions", "model", F.round(F.aggregate(F.col("vector").cast("array<double>"), F.lit(0.0), lambda s, x: s + x), 5).alias("total")),
    f"WITH {_VECTORS} SELECT id AS memory_id, len(x)::BIGINT AS dimensions, 'table' AS model, round(list_sum(x), 5) AS total FROM v",
)


def _transaction(c: CorpusCatalog) -> DataFrame:
    """A batch that is committed, one that is dropped, and a replacement."""
    kept = _kept(c, "memories", "links", "collections", "agents", "contexts")
    kept.batch().delete("memories", c.memories.select("id")).abort()
    kept.batch().delete("agents", c.agents.where("CAST(id AS INT) % 2 = 0").select("id")).put("collections", c.collections.limit(1).withColumn("id", F.lit("one more"))).commit()
    kept.put("memories", c.memories.withColumn("confidence", F.lit(1.0)))
    return kept.stats()


_add(
    "store_transaction",
    _transaction,
    _sql("ml", 'SELECT \'memories\' AS "table", count(*) AS "rows" FROM memories UNION ALL SELECT \'links\', count(*) FROM links UNION ALL SELECT \'collections\', count(DISTINCT source) + 1 FROM memories UNION ALL SELECT \'agents\', count(*) FROM supplier WHERE s_suppkey % 2 = 1 UNION ALL SELECT \'contexts\', count(DISTINCT conv_id) FROM conversations'),
)


def _compacted(c: CorpusCatalog) -> DataFrame:
    kept = _kept(c, "memories")
    kept.put("memories", c.memories.where("confidence < 0.3").withColumn("source", F.lit("changed")))
    kept.delete("memories", c.memories.where("confidence < 0.1").select("id"))
    kept.compact()
    kept.vacuum()
    return kept.read("memories").select("id", "source")


_add("store_compaction", _compacted, _sql("m", "SELECT id, CASE WHEN confidence < 0.3 THEN 'changed' ELSE source END AS source FROM memories WHERE confidence >= 0.1"))


def _without_links(c: CorpusCatalog) -> DataFrame:
    kept = _kept(c, "links")
    kept.delete("links", c.links.where("relationship_type = 'supports'").select("id"))
    return links.neighbors(kept.read("links"), "11")


_add("store_links_removed", _without_links, _sql("l", "SELECT DISTINCT target_id AS id FROM links WHERE source_id = '11' AND relationship_type <> 'supports'"))

# exchange


def _exported(c: CorpusCatalog, how: str, partial: bool = False):
    folder = _folder(c)
    if how == "lines":
        exchange.export_lines(c.tables(), folder)
        return exchange.import_lines(c.spark, folder, partial)
    if how == "backup":
        return exchange.import_json(c.spark, exchange.backup(c.tables(), folder, dt.datetime(2024, 3, 1)), partial)
    exchange.export_json(c.tables(), folder)
    return exchange.import_json(c.spark, folder, partial)


_add("exchange_document", lambda c: _exported(c, "json").memories.select("id", "content", "confidence"), _sql("m", "SELECT id, content, confidence FROM memories"))
_add("exchange_lines", lambda c: _exported(c, "lines").collection_members, _sql("mr", "SELECT collection_id, memory_id FROM collection_members"))
_add("exchange_backup", lambda c: _exported(c, "backup").links.select(*_LINK), _sql("l", f"SELECT {_LINK_SQL} FROM links"))
_add(
    "exchange_partial",
    lambda c: store.table_counts(_exported(c, "json", partial=True)),
    _sql("ml", 'SELECT \'memories\' AS "table", count(*) AS "rows" FROM memories UNION ALL SELECT \'links\', count(*) FROM links UNION ALL SELECT \'collections\', count(DISTINCT source) FROM memories UNION ALL SELECT \'agents\', 0 UNION ALL SELECT \'contexts\', 0'),
)
_add("without_dangling", lambda c: exchange.without_dangling(c.tables()).links.select(*_LINK), _sql("ml", f"SELECT {_LINK_SQL} FROM links WHERE source_id IN (SELECT id FROM memories) AND target_id IN (SELECT id FROM memories)"))
_add(
    "group_memories",
    lambda c: generate.group_memories(c.memories, analytics.topic_of()).select("collection_id", F.array_join("memory_ids", ",").alias("memory_ids")),
    _sql("m", "SELECT topic AS collection_id, string_agg(id, ',' ORDER BY id) AS memory_ids FROM memories GROUP BY topic"),
)

# changes of records

_add(
    "set_ttl",
    lambda c: forgetting.set_ttl(c.memories, c.memories.where("CAST(id AS INT) % 5 < 2").select("id", F.when(F.expr("CAST(id AS INT) % 5 = 0"), 777).cast("bigint").alias("ttl"))).select("id", F.coalesce("ttl", F.lit(-1)).alias("ttl")),
    _sql("m", "SELECT id, coalesce(CASE doc_id % 5 WHEN 0 THEN 777 WHEN 1 THEN NULL ELSE ttl END, -1) AS ttl FROM memories"),
)
_add(
    "set_importance",
    lambda c: forgetting.set_importance(c.memories, c.memories.where("CAST(id AS INT) % 3 = 0").select("id", (F.col("importance") * 3 - 1).alias("importance"))).select("id", F.round("importance", 9).alias("importance")),
    _sql("m", "SELECT id, round(CASE WHEN doc_id % 3 = 0 THEN greatest(0, least(1, importance * 3 - 1)) ELSE importance END, 9) AS importance FROM memories"),
)
_add(
    "merge_update",
    lambda c: store.merge_update(
        c.memories, c.memories.where("CAST(id AS INT) % 2 = 0").selectExpr("id", "CASE WHEN CAST(id AS INT) % 4 = 0 THEN '' ELSE 'fresh' END AS source", "CASE WHEN CAST(id AS INT) % 6 = 0 THEN 0.0D ELSE 0.5D END AS confidence")
    ).select("id", "source", "confidence"),
    _sql("m", "SELECT id, CASE WHEN doc_id % 4 = 2 THEN 'fresh' ELSE source END AS source, CASE WHEN doc_id % 2 = 0 AND doc_id % 6 <> 0 THEN 0.5::DOUBLE ELSE confidence END AS confidence FROM memories"),
)
_add(
    "remove_from_index",
    lambda c: text_search.remove_from_index(text_search.postings(c.memories), filters.min_confidence(c.memories, 0.5).select("id")).groupBy("memory_id").agg(F.count(F.lit(1)).alias("tokens")),
    _sql("mp", "SELECT memory_id, count(*) AS tokens FROM postings WHERE memory_id IN (SELECT id FROM memories WHERE NOT confidence >= 0.5) GROUP BY 1"),
)
_add(
    "changed_grants",
    lambda c: groups.revoke(groups.grant(groups.grant(c.agent_grants, AGENT, "src2"), AGENT, "src2"), "2", "src3"),
    _sql("mr", f"SELECT DISTINCT * FROM (SELECT * FROM agent_grants UNION ALL SELECT '{AGENT}', 'src2') WHERE NOT (agent_id = '2' AND collection_id = 'src3')"),
)


def _may(c: CorpusCatalog) -> DataFrame:
    asked = [(AGENT, f"src{k}") for k in range(6)]
    return c.spark.createDataFrame([(a, b, groups.has_access(c.agent_grants, a, b)) for a, b in asked], "agent_id string, collection_id string, allowed boolean")


_add("access_check", _may, _sql("mr", f"SELECT '{AGENT}' AS agent_id, 'src' || k AS collection_id, EXISTS (SELECT 1 FROM agent_grants WHERE agent_id = '{AGENT}' AND collection_id = 'src' || k) AS allowed FROM (SELECT unnest(range(6)) AS k)"))
_add(
    "context_agent_orphans",
    lambda c: links.member_orphans(c.context_agents, "context_id", "agent_id", c.agents.where("CAST(id AS INT) % 3 > 0").select("id")),
    _sql("mr", "SELECT context_id, count(*) AS missing FROM context_agents WHERE CAST(agent_id AS INT) % 3 = 0 GROUP BY 1"),
)

# vectors, hybrid, analytics

_add(
    "chosen_vectors",
    lambda c: vectors.choose_vectors(c.memories, c.vectors, vectors.HashEmbedder(8)).select("memory_id", "origin", F.size("vector").alias("dimensions")),
    _sql("m", f", {_VECTORS} SELECT m.id AS memory_id, CASE WHEN v.id IS NULL THEN 'computed' ELSE 'stored' END AS origin, coalesce(len(x), 8)::BIGINT AS dimensions FROM memories m LEFT JOIN v ON v.id = m.id"),
)


def _in_collection(c: CorpusCatalog) -> DataFrame:
    vector = tuple(c.vectors.where("memory_id = '42'").first()["vector"])
    query = hybrid.HybridQuery(text=WORD, vector=vector, vector_limit=200, method="sum", limit=40, collection=SOURCE)
    return hybrid.search(c.memories, c.vectors, query, c.collection_members).select("id", "score")


_add(
    "hybrid_in_collection",
    _in_collection,
    _sql("mp", f""", {_VECTORS}, near AS (SELECT v.id, round(list_cosine_similarity(v.x, q.x), 6) AS vector FROM v, v q WHERE q.id = '42' ORDER BY 2 DESC, 1 LIMIT 200),
      hits AS (SELECT DISTINCT memory_id AS id, 1.0::DOUBLE AS keyword FROM postings WHERE stem = '{WORD}')
      SELECT id, round(coalesce(keyword, 0) + coalesce(vector, 0), 6) AS score FROM hits FULL JOIN near USING (id) JOIN memories USING (id) WHERE source = '{SOURCE}' ORDER BY 2 DESC, 1 LIMIT 40"""),
)
_add(
    "abstraction_nodes",
    lambda c: analytics.abstraction_nodes(c.memories.select("id", analytics.topic_of().alias("group"), F.lit("topic").alias("kind")), c.memories, C.AS_OF).select("id", "content", F.round("confidence", 9).alias("confidence"), "source"),
    _sql("m", "SELECT 'abstract-topic-' || topic AS id, 'Summary of ' || count(*) || ' memories: ' || string_agg(left(content, 50), '; ' ORDER BY id) AS content, round(avg(confidence), 9) AS confidence, 'abstraction' AS source FROM memories GROUP BY topic"),
)
_add(
    "core_abstractions",
    lambda c: analytics.core_abstractions(analytics.simple_graph(c.links, c.memories), (3, 4), (3, 1_000_000_000)).select("name", "size", F.round("quality", 9).alias("quality")),
    _sql("mlg", _core_sql(4, 20) + _core_sql(3, 20, "k")
         + " SELECT * FROM (SELECT '4-core' AS name, count(DISTINCT a) AS size, 0.9::DOUBLE AS quality FROM c20 UNION ALL SELECT '3-core', count(DISTINCT a), 0.85 FROM k20) WHERE size >= 3"),
)

# the facade


def _wrappers(c: CorpusCatalog) -> DataFrame:
    engine = MemoryEngine(c.tables())
    found = {
        "source": engine.search_source(SOURCE, 7), "confidence": engine.search_confidence(0.9, 7), "metadata": engine.search_metadata("topic", "t5", 7), "before": engine.search_before("2024-01-05", 7),
        "after": engine.search_after("2024-03-01", 7), "between": engine.search_between("2024-01-05", "2024-01-09", 7), "period": engine.search_period(2024, 2, limit=7), "text": engine.search_text(WORD, limit=7),
        "recent": engine.recent(7), "important": engine.important(7),
    }
    out = None
    for name, rows in found.items():
        one = rows.select(F.lit(name).alias("search"), "id")
        out = one if out is None else out.unionByName(one)
    return out


def _first(name: str, where: str, order: str = "ts DESC") -> str:
    return f"(SELECT '{name}' AS search, id FROM memories WHERE {where} ORDER BY {order}, id LIMIT 7)"


_add(
    "engine_searches",
    _wrappers,
    _sql("mp", " UNION ALL ".join([
        _first("source", f"source = '{SOURCE}'"), _first("confidence", "confidence >= 0.9", "confidence DESC"), _first("metadata", "topic = 't5'"), _first("before", "ts < TIMESTAMP '2024-01-05'"),
        _first("after", "ts > TIMESTAMP '2024-03-01'"), _first("between", "ts > TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-09'"), _first("period", "year(ts) = 2024 AND month(ts) = 2"),
        _first("text", f"id IN (SELECT memory_id FROM postings WHERE stem = '{WORD}')"), _first("recent", "true"), _first("important", "true", "importance DESC"),
    ])),
)


def _views(c: CorpusCatalog) -> DataFrame:
    mark = f"v{uuid.uuid4().hex}_"
    MemoryEngine(c.tables()).register_views(mark)
    return c.spark.sql(f"SELECT relationship_type, count(*) AS links, round(avg(m.confidence), 9) AS confidence FROM {mark}links l JOIN {mark}memories m ON m.id = l.target_id GROUP BY 1")


_add("engine_views", _views, _sql("ml", "SELECT relationship_type, count(*) AS links, round(avg(m.confidence), 9) AS confidence FROM links l JOIN memories m ON m.id = l.target_id GROUP BY 1"))
_add(
    "engine_expired",
    lambda c: _ids(forgetting.forget(c.memories, forgetting.ttl_policy(), C.AS_OF)),
    _sql("m", f"SELECT id FROM memories WHERE NOT coalesce(date_diff('second', last_accessed, {NOW}) > ttl, false)"),
)
