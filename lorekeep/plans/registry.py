"""The registered queries over the tables of a folder, each with its DuckDB twin where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.functions import columns as C
from lorekeep.functions import vector as V
from lorekeep.operators import analytics, filters, forgetting, groups, hybrid, links, ranking, reduce, text_search, traverse, vectors
from lorekeep.plans.engine import MemoryEngine
from lorekeep.plans.memory_query import MemoryQuery
from lorekeep.session import shared_folder
from lorekeep.sources import exchange, store, vector_index
from lorekeep.sources.catalog import CorpusCatalog
from lorekeep.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

# fixed arguments of the queries
ANY_TEXT, ALL_TEXT, WORD = "the stations", "the and", "than"
SOURCE, AGENT, CONTEXT = "src3", "1", "5"
NODE, FAR_NODE = "1", "13"
LINKED = "src19"  # a collection with links inside
SPAN = ("2024-01-20 00:00:00", "2024-02-20 00:00:00")
DAMPING, ROUNDS = 0.85, 10

# views of the DuckDB twins

_MEMORIES = """memories AS (
  SELECT CAST(doc_id AS VARCHAR) AS id, text AS content, source, ((doc_id * 37) % 101) / 100.0::DOUBLE AS confidence,
    ((doc_id * 53) % 101) / 100.0::DOUBLE AS importance, (doc_id * 7) % 130 AS access_count,
    TIMESTAMP '2024-01-01 00:00:00' + to_seconds(doc_id * 7919) AS ts,
    TIMESTAMP '2024-01-01 00:00:00' + to_seconds(doc_id * 7919 + ((doc_id * 7) % 130) * 3600) AS last_accessed,
    CASE WHEN doc_id % 3 = 0 THEN (doc_id % 50 + 1) * 86400 END AS ttl,
    '{"lang":"' || lang || '","topic":"t' || CAST(doc_id % 12 AS VARCHAR) || '","rank":' || CAST(doc_id % 5 AS VARCHAR) || '}' AS metadata,
    't' || CAST(doc_id % 12 AS VARCHAR) AS topic, doc_id
  FROM documents)"""

_LINKS = """links AS (
  SELECT CAST(doc_id * 10 + k AS VARCHAR) AS id, CAST(doc_id AS VARCHAR) AS source_id,
    CAST(CASE WHEN doc_id % 97 = 0 AND k = 5 THEN n + doc_id ELSE (doc_id * k + 1) % n END AS VARCHAR) AS target_id,
    CASE k WHEN 2 THEN 'supports' WHEN 3 THEN 'causes' ELSE 'references' END AS relationship_type,
    ((doc_id * k) % 91 + 10) / 101.0::DOUBLE AS weight
  FROM documents, (SELECT count(*) AS n FROM documents), (SELECT unnest([2, 3, 5])::BIGINT AS k))"""

_SPLIT = r"[\s\v\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}[:punct:]]+"
_STEM = """CASE WHEN ends_with({0}, 's') AND strlen({0}) > 3 THEN left({0}, length({0}) - 1) WHEN ends_with({0}, 'ing') AND strlen({0}) > 5
  THEN left({0}, length({0}) - 3) WHEN ends_with({0}, 'ed') AND strlen({0}) > 4 THEN left({0}, length({0}) - 2) ELSE {0} END"""

_POSTINGS = f"""tokens AS (
  SELECT DISTINCT id AS memory_id, unnest(string_split_regex(lower(content), '{_SPLIT}')) AS token FROM memories),
postings AS (SELECT memory_id, token, {_STEM.format("token")} AS stem FROM tokens WHERE strlen(token) >= 3)"""

_GRAPH = """edges AS (
  SELECT source_id, target_id, arg_max(weight, id) AS weight FROM links
  WHERE source_id IN (SELECT id FROM memories) AND target_id IN (SELECT id FROM memories) GROUP BY ALL),
degree AS (
  SELECT id, sum(i)::BIGINT AS in_degree, sum(o)::BIGINT AS out_degree
  FROM (SELECT target_id AS id, 1 AS i, 0 AS o FROM edges UNION ALL SELECT source_id, 0, 1 FROM edges) GROUP BY id)"""

_GROUPS = """collection_members AS (SELECT source AS collection_id, id AS memory_id FROM memories),
agents AS (SELECT CAST(s_suppkey AS VARCHAR) AS id, s_suppkey FROM supplier),
agent_grants AS (SELECT id AS agent_id, 'src' || k AS collection_id FROM agents, (SELECT unnest(range(20)) AS k) WHERE (k + s_suppkey) % 5 = 0),
contexts AS (SELECT DISTINCT CAST(conv_id AS VARCHAR) AS id FROM conversations),
n_conv AS (SELECT count(DISTINCT conv_id) AS n FROM conversations),
context_members AS (SELECT CAST(doc_id % n AS VARCHAR) AS context_id, id AS memory_id FROM memories, n_conv),
context_agents AS (SELECT CAST(s_suppkey % n AS VARCHAR) AS context_id, id AS agent_id FROM agents, n_conv)"""

_EVENTS = """event_memories AS (SELECT CAST(event_id AS VARCHAR) AS id, ts, event_type AS source, user_id, event_id FROM events),
ahead AS (SELECT event_id, event_type, unnest([lead(event_id, 1) OVER w, lead(event_id, 2) OVER w, lead(event_id, 3) OVER w]) AS target, unnest([1, 2, 3]) AS lag
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
event_links AS (SELECT CAST(event_id * 10 + lag AS VARCHAR) AS id, CAST(event_id AS VARCHAR) AS source_id, CAST(target AS VARCHAR) AS target_id, event_type AS relationship_type, 1.0::DOUBLE / lag AS weight
  FROM ahead WHERE target IS NOT NULL)"""

_SUPPLIERS = """parts AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem),
supplier_links AS (SELECT CAST(a.l_suppkey AS VARCHAR) AS source_id, CAST(b.l_suppkey AS VARCHAR) AS target_id, count(*)::DOUBLE AS weight
  FROM parts a JOIN parts b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey < b.l_suppkey GROUP BY ALL)"""

_VIEWS = {"m": _MEMORIES, "l": _LINKS, "p": _POSTINGS, "g": _GRAPH, "r": _GROUPS, "e": _EVENTS, "s": _SUPPLIERS}
NOW = "TIMESTAMP '2024-03-01 00:00:00'"


def _sql(views: str, body: str, recursive: bool = False) -> str:
    parts = [_VIEWS[v] for v in views]
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(parts) + "\n" + body if parts else body


def _plain(df: DataFrame) -> DataFrame:
    """Integers as long and floats as double, as the twins have them."""
    wide = {"int": "bigint", "smallint": "bigint", "tinyint": "bigint", "float": "double"}
    return df.select(*[F.col(f"`{c}`").cast(wide[t]).alias(c) if t in wide else F.col(f"`{c}`") for c, t in df.dtypes])


def _query(name: str, sql: str | None = None) -> Callable[[Callable[[CorpusCatalog], DataFrame]], Callable[[CorpusCatalog], DataFrame]]:
    def add(make: Callable[[CorpusCatalog], DataFrame]) -> Callable[[CorpusCatalog], DataFrame]:
        QUERIES[name] = lambda spark, folder: _plain(make(CorpusCatalog(spark, folder)))
        if sql:
            ORACLE_SQL[name] = sql
        return make

    return add


def _add(name: str, make: Callable[[CorpusCatalog], DataFrame], sql: str | None = None) -> None:
    _query(name, sql)(make)


def _ids(df: DataFrame) -> DataFrame:
    return df.select("id")


# filters and derived columns

for _name, _make, _where in (
    ("by_source", lambda c: filters.by_source(c.memories, SOURCE), f"source = '{SOURCE}'"),
    ("min_confidence_exact", lambda c: filters.min_confidence(c.memories, 0.85), "confidence >= 0.85"),
    ("min_confidence_bucket", lambda c: filters.min_confidence(c.memories, 0.85, True), "floor(confidence * 10) >= 8"),
    ("min_importance", lambda c: filters.min_importance(c.memories, 0.75), "importance >= 0.75"),
    ("min_importance_bucket", lambda c: filters.min_importance(c.memories, 0.75, True), "floor(importance * 10) >= 7"),
    ("min_access", lambda c: filters.min_access(c.memories, 105), "access_count >= 105"),
    ("min_access_bucket", lambda c: filters.min_access(c.memories, 105, True), "least(access_count // 10, 10) >= 10"),
    ("accessed_since", lambda c: filters.accessed_since(c.memories, SPAN[1]), f"last_accessed >= TIMESTAMP '{SPAN[1]}'"),
    ("before", lambda c: filters.before(c.memories, SPAN[0]), f"ts < TIMESTAMP '{SPAN[0]}'"),
    ("after", lambda c: filters.after(c.memories, SPAN[1]), f"ts > TIMESTAMP '{SPAN[1]}'"),
    ("between", lambda c: filters.between(c.memories, *SPAN), f"ts BETWEEN TIMESTAMP '{SPAN[0]}' AND TIMESTAMP '{SPAN[1]}'"),
    ("between_open", lambda c: filters.between(c.memories, *SPAN, inclusive=False), f"ts > TIMESTAMP '{SPAN[0]}' AND ts < TIMESTAMP '{SPAN[1]}'"),
    ("by_year", lambda c: filters.by_year(c.memories, 2024), "year(ts) = 2024"),
    ("by_month", lambda c: filters.by_month(c.memories, 2024, 2), "year(ts) = 2024 AND month(ts) = 2"),
    ("by_day", lambda c: filters.by_day(c.memories, 2024, 1, 15), "CAST(ts AS DATE) = DATE '2024-01-15'"),
    ("by_hour", lambda c: filters.by_hour(c.memories, 13), "hour(ts) = 13"),
    ("metadata_key", lambda c: filters.with_key(c.memories, "topic"), "list_contains(json_keys(metadata), 'topic')"),
    ("metadata_value", lambda c: filters.with_value(c.memories, "topic", "t3"), "json_type(metadata, '$.topic') = 'VARCHAR' AND json_extract_string(metadata, '$.topic') = 't3'"),
    ("metadata_value_of_number", lambda c: filters.with_value(c.memories, "rank", "3"), "json_type(metadata, '$.rank') = 'VARCHAR' AND json_extract_string(metadata, '$.rank') = '3'"),
    ("expired_created", lambda c: filters.expired(c.memories, C.AS_OF), f"date_diff('second', ts, {NOW}) > ttl"),
    ("expired_idle", lambda c: filters.expired(c.memories, C.AS_OF, "last_accessed"), f"date_diff('second', last_accessed, {NOW}) > ttl"),
):
    _add(_name, lambda c, make=_make: _ids(make(c)), _sql("m", f"SELECT id FROM memories WHERE {_where}"))


@_query("entity_columns", _sql("m", f"""SELECT id, CASE WHEN length(content) > 30 THEN left(content, 27) || '...' ELSE content END AS label, left(content, 50) || '...' AS preview,
  CAST(floor(importance * 10) AS BIGINT) AS importance_bucket, CAST(floor(confidence * 10) AS BIGINT) AS confidence_bucket, least(access_count // 10, 10) AS access_bucket,
  greatest(0, least(1, importance * 3 - 1)) AS clamped, coalesce(date_diff('second', ts, {NOW}) > ttl, false) AS expired,
  year(ts) AS "year", year(ts) * 100 + month(ts) AS "month", year(ts) * 10000 + month(ts) * 100 + day(ts) AS "day", hour(ts) AS "hour" FROM memories"""))  # fmt: skip
def _entity_columns(c: CorpusCatalog) -> DataFrame:
    content, ts = F.col("content"), F.col("timestamp")
    return c.memories.select(
        "id", C.label(content).alias("label"), C.preview(content).alias("preview"), C.tenth(F.col("importance")).alias("importance_bucket"),
        C.tenth(F.col("confidence")).alias("confidence_bucket"), C.access_bucket(F.col("access_count")).alias("access_bucket"),
        C.clamp_unit(F.col("importance") * 3 - 1).alias("clamped"), C.is_expired(ts, F.col("ttl"), C.instant(C.AS_OF)).alias("expired"),
        *[x.alias(k) for k, x in C.time_keys(ts).items()],
    )


_add(
    "time_remaining",
    lambda c: c.memories.where("ttl is not null").select("id", C.time_remaining(F.col("timestamp"), F.col("ttl"), C.instant(C.AS_OF)).alias("seconds")),
    _sql("m", f"SELECT id, greatest(ttl - date_diff('second', ts, {NOW}), 0) AS seconds FROM memories WHERE ttl IS NOT NULL"),
)
_add("most_recent", lambda c: _ids(filters.most_recent(c.memories, 25)), _sql("m", "SELECT id FROM memories ORDER BY ts DESC, id LIMIT 25"))
_add("most_important", lambda c: _ids(filters.most_important(c.memories, 25)), _sql("m", "SELECT id FROM memories ORDER BY importance DESC, id LIMIT 25"))
_add("paged", lambda c: _ids(filters.page(c.memories, "150", 50)), _sql("m", "SELECT id FROM memories WHERE id > '150' ORDER BY id LIMIT 50"))
_add(
    "time_rollup",
    lambda c: filters.time_rollup(c.event_memories).na.fill(-1),
    'WITH k AS (SELECT year(ts) AS y, month(ts) AS m, day(ts) AS d, hour(ts) AS h FROM events) SELECT coalesce(y, -1) AS "year", coalesce(m, -1) AS "month", coalesce(d, -1) AS "day", coalesce(h, -1) AS "hour", count(*) AS memories FROM k GROUP BY ROLLUP (y, m, d, h)',
)

# text



def _stems_of(text: str) -> str:
    words = f"SELECT unnest(string_split_regex(lower('{text}'), '{_SPLIT}')) AS w"
    return f"(SELECT DISTINCT {_STEM.format('w')} AS stem FROM ({words}) WHERE strlen(w) >= 3)"


_ANY = f"SELECT DISTINCT memory_id AS id FROM postings WHERE stem IN {_stems_of(ANY_TEXT)}"
_ALL = "SELECT memory_id AS id FROM postings WHERE stem IN {0} GROUP BY memory_id HAVING count(DISTINCT stem) = (SELECT count(*) FROM {0} q)"
_BM25 = f"""words AS (SELECT id AS memory_id, unnest(string_split_regex(lower(content), '{_SPLIT}')) AS token FROM memories),
  stemmed AS (SELECT memory_id, {_STEM.format("token")} AS stem FROM words WHERE strlen(token) >= 3),
  lengths AS (SELECT memory_id, count(*) AS length FROM stemmed GROUP BY 1), corpus AS (SELECT count(*) AS n, avg(length) AS mean FROM lengths),
  hits AS (SELECT memory_id, stem, count(*) AS tf FROM stemmed WHERE stem IN WANTED GROUP BY ALL), rarity AS (SELECT stem, count(*) AS df FROM hits GROUP BY 1),
  scored AS (SELECT memory_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 6) AS score
    FROM hits JOIN rarity USING (stem) JOIN lengths USING (memory_id) CROSS JOIN corpus GROUP BY memory_id)"""
RANKED_TEXT = f"{WORD} {ANY_TEXT}"
_add("bm25_scores", lambda c: ranking.scan_scores(c.memories, ANY_TEXT), _sql("m", f", {_BM25.replace('WANTED', _stems_of(ANY_TEXT))} SELECT memory_id, score FROM scored"))
_add(
    "bm25_topk",
    lambda c: ranking.RankedIndex.build(c.memories).search(RANKED_TEXT, 25),
    _sql("m", f", {_BM25.replace('WANTED', _stems_of(RANKED_TEXT))} SELECT memory_id, score, row_number() OVER (ORDER BY score DESC, memory_id) AS rank FROM scored QUALIFY rank <= 25"),
)


_add("search_any", lambda c: _ids(text_search.search_any(c.memories, ANY_TEXT)), _sql("mp", _ANY))
_add("search_all", lambda c: _ids(text_search.search_all(c.memories, ALL_TEXT)), _sql("mp", _ALL.format(_stems_of(ALL_TEXT))))
_add("search_postings_any", lambda c: text_search.search_postings(text_search.postings(c.memories), ANY_TEXT).withColumnRenamed("memory_id", "id"), _sql("mp", _ANY))
_add("search_postings_all", lambda c: text_search.search_postings(text_search.postings(c.memories), ALL_TEXT, "all").withColumnRenamed("memory_id", "id"), _sql("mp", _ALL.format(_stems_of(ALL_TEXT))))
_add("keyword_exact", lambda c: _ids(text_search.find_keyword(c.memories, WORD)), _sql("mp", f"SELECT DISTINCT memory_id AS id FROM postings WHERE token = '{WORD}'"))
_add("find_stem", lambda c: _ids(text_search.find_stem(c.memories, f"{WORD}ing")), _sql("mp", f"SELECT DISTINCT memory_id AS id FROM postings WHERE stem = '{WORD}'"))
_add("token_stats", lambda c: text_search.token_stats(text_search.postings(c.memories)), _sql("mp", "SELECT token, count(*) AS memories FROM postings GROUP BY token"))
_add(
    "stem_stats",
    lambda c: text_search.stem_stats(text_search.postings(c.memories)),
    _sql("mp", "SELECT stem, count(DISTINCT memory_id) AS memories, count(DISTINCT token) AS tokens FROM postings GROUP BY stem"),
)
_add(
    "search_required",
    lambda c: _ids(text_search.search_required(c.memories, ANY_TEXT, ["and"], ["with"])),
    _sql("mp", f"SELECT DISTINCT memory_id AS id FROM postings WHERE stem IN {_stems_of(ANY_TEXT)} AND memory_id IN (SELECT memory_id FROM postings WHERE stem = 'and') AND memory_id NOT IN (SELECT memory_id FROM postings WHERE stem = 'with')"),
)

# combined queries

_add(
    "search_combined",
    lambda c: MemoryQuery(text=ANY_TEXT, source=SOURCE, min_confidence=0.2, key="lang", value="en", after="2024-01-01", before="2024-04-01", limit=50).apply(c.memories).select("id", "confidence", C.epoch(F.col("timestamp")).alias("ts")),
    _sql("mp", f"SELECT id, confidence, CAST(epoch(ts) AS BIGINT) AS ts FROM memories WHERE id IN ({_ANY}) AND source = '{SOURCE}' AND confidence >= 0.2 AND json_extract_string(metadata, '$.lang') = 'en' AND ts > TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-04-01' ORDER BY memories.ts DESC, id LIMIT 50"),
)
_add(
    "search_period_by_confidence",
    lambda c: _ids(MemoryQuery(year=2024, month=1, min_importance=0.3, order="confidence", limit=40).apply(c.memories)),
    _sql("m", "SELECT id FROM memories WHERE year(ts) = 2024 AND month(ts) = 1 AND importance >= 0.3 ORDER BY confidence DESC, id LIMIT 40"),
)
_add("query_without_criteria", lambda c: _ids(MemoryQuery().apply(c.memories)), _sql("m", "SELECT id FROM memories ORDER BY ts DESC, id LIMIT 100"))
_add("query_oldest", lambda c: _ids(MemoryQuery(source=SOURCE, order="oldest", limit=10).apply(c.memories)), _sql("m", f"SELECT id FROM memories WHERE source = '{SOURCE}' ORDER BY ts, id LIMIT 10"))

# links

_LINK = "id, source_id, target_id, relationship_type, weight"
for _name, _make, _where in (
    ("outgoing", lambda c: links.outgoing(c.links, NODE), f"source_id = '{NODE}'"),
    ("incoming", lambda c: links.incoming(c.links, NODE), f"target_id = '{NODE}'"),
    ("touching", lambda c: links.touching(c.links, NODE), f"source_id = '{NODE}' OR target_id = '{NODE}'"),
    ("links_by_source_and_type", lambda c: links.by_type(c.links, "causes", source=NODE), f"source_id = '{NODE}' AND relationship_type = 'causes'"),
    ("links_by_target_and_type", lambda c: links.by_type(c.links, "supports", target="7"), "target_id = '7' AND relationship_type = 'supports'"),
    ("links_of_type", lambda c: links.by_type(c.links, "references"), "relationship_type = 'references'"),
    ("between_nodes", lambda c: links.between_nodes(c.links, "1", "3", c.memories), "source_id = '1' AND target_id = '3'"),
    ("attached_links", lambda c: links.attached(c.links, c.memories), "source_id IN (SELECT id FROM memories) AND target_id IN (SELECT id FROM memories)"),
):
    _add(_name, lambda c, make=_make: make(c).drop("metadata"), _sql("ml", f"SELECT {_LINK} FROM links WHERE {_where}"))
_add("strongest_links", lambda c: links.strongest_first(c.links).limit(30).drop("metadata"), _sql("l", f"SELECT {_LINK} FROM links ORDER BY weight DESC, id LIMIT 30"))
_add("neighbors_in", lambda c: links.neighbors(c.links, "11", "in"), _sql("l", "SELECT DISTINCT source_id AS id FROM links WHERE target_id = '11'"))
_add("neighbors_out", lambda c: links.neighbors(c.links, "11"), _sql("l", "SELECT DISTINCT target_id AS id FROM links WHERE source_id = '11'"))
_add(
    "links_with_content",
    lambda c: links.with_content(c.links, c.memories).select("id", "source_content", "target_content"),
    _sql("ml", "SELECT l.id, coalesce(a.content, 'Unknown (ID: ' || source_id || ')') AS source_content, coalesce(b.content, 'Unknown (ID: ' || target_id || ')') AS target_content FROM links l LEFT JOIN memories a ON a.id = source_id LEFT JOIN memories b ON b.id = target_id"),
)
_add(
    "orphan_links",
    lambda c: links.orphans(c.links, c.memories).select("id", "source_exists", "target_exists"),
    _sql("ml", "SELECT * FROM (SELECT id, source_id IN (SELECT id FROM memories) AS source_exists, target_id IN (SELECT id FROM memories) AS target_exists FROM links) WHERE NOT (source_exists AND target_exists)"),
)
_KNOWN = "(SELECT id FROM memories WHERE confidence >= 0.1)"
_add(
    "collection_orphans",
    lambda c: links.member_orphans(c.collection_members, "collection_id", "memory_id", filters.min_confidence(c.memories, 0.1).select("id")),
    _sql("mr", f"SELECT collection_id, count(*) AS missing FROM collection_members WHERE memory_id NOT IN {_KNOWN} GROUP BY collection_id"),
)
_add(
    "context_orphans",
    lambda c: links.member_orphans(c.context_members, "context_id", "memory_id", filters.min_confidence(c.memories, 0.1).select("id")),
    _sql("mr", f"SELECT context_id, count(*) AS missing FROM context_members WHERE memory_id NOT IN {_KNOWN} GROUP BY context_id"),
)
_add("links_by_type", lambda c: links.type_counts(c.links), _sql("l", "SELECT relationship_type, count(*) AS links FROM links GROUP BY relationship_type"))
_DEGREES = "(SELECT id, sum(i)::BIGINT AS in_degree, sum(o)::BIGINT AS out_degree FROM (SELECT target_id AS id, 1 AS i, 0 AS o FROM {0} UNION ALL SELECT source_id, 0, 1 FROM {0}) GROUP BY id)"
_add("degrees", lambda c: links.degrees(c.event_links), _sql("e", f"SELECT *, in_degree + out_degree AS degree FROM {_DEGREES.format('event_links')}"))
_add(
    "centrality_importance",
    lambda c: links.centrality_importance(c.memories, c.links, damped=True).select("id", F.round("importance", 9).alias("importance")),
    _sql("ml", f"SELECT m.id, round(CASE WHEN in_degree + out_degree > 0 THEN least(1, (1 + ln(in_degree + out_degree)) / 5) ELSE 0.2 END, 9) AS importance FROM memories m LEFT JOIN {_DEGREES.format('links')} d ON d.id = m.id"),
)
_add(
    "graph_edges",
    lambda c: links.graph_edges(c.links, c.collection_members, c.agent_grants, c.context_members, c.context_agents),
    _sql("mlr", """SELECT 'memory' AS src_kind, source_id AS src, relationship_type AS edge_kind, 'memory' AS dst_kind, target_id AS dst FROM links
      UNION ALL SELECT 'collection', collection_id, 'contains', 'memory', memory_id FROM collection_members UNION ALL SELECT 'agent', agent_id, 'has_access', 'collection', collection_id FROM agent_grants
      UNION ALL SELECT 'context', context_id, 'contains', 'memory', memory_id FROM context_members UNION ALL SELECT 'agent', agent_id, 'participates', 'context', context_id FROM context_agents"""),
)
_add(
    "stats",
    lambda c: store.table_counts(c.tables()),
    _sql("mlr", 'SELECT \'memories\' AS "table", count(*) AS "rows" FROM memories UNION ALL SELECT \'links\', count(*) FROM links UNION ALL SELECT \'collections\', count(DISTINCT source) FROM memories UNION ALL SELECT \'agents\', count(*) FROM agents UNION ALL SELECT \'contexts\', count(*) FROM contexts'),
)

# collections, agents, contexts

_add("collection_sizes", lambda c: groups.collection_sizes(c.collection_members), _sql("m", "SELECT source AS collection_id, count(*) AS members FROM memories GROUP BY source"))
_add("collection_memories", lambda c: _ids(groups.collection_memories(c.collection_members, c.memories, SOURCE)), _sql("m", f"SELECT id FROM memories WHERE source = '{SOURCE}'"))
_add(
    "agent_memories",
    lambda c: _ids(groups.agent_memories(c.agent_grants, c.collection_members, c.memories, AGENT)),
    _sql("mr", f"SELECT DISTINCT memory_id AS id FROM collection_members JOIN agent_grants USING (collection_id) WHERE agent_id = '{AGENT}'"),
)
_add("agent_collections", lambda c: _ids(groups.agent_collections(c.agent_grants, c.collections, AGENT)), _sql("mr", f"SELECT DISTINCT collection_id AS id FROM agent_grants JOIN collection_members USING (collection_id) WHERE agent_id = '{AGENT}'"))
_add("agent_contexts", lambda c: _ids(groups.agent_contexts(c.context_agents, c.contexts, AGENT)), _sql("mr", f"SELECT id FROM contexts WHERE id IN (SELECT context_id FROM context_agents WHERE agent_id = '{AGENT}')"))
_add("context_members", lambda c: _ids(groups.context_memories(c.context_members, c.memories, CONTEXT)), _sql("mr", f"SELECT memory_id AS id FROM context_members WHERE context_id = '{CONTEXT}'"))
_add("context_agents", lambda c: _ids(groups.agents_in_context(c.context_agents, c.agents, CONTEXT)), _sql("mr", f"SELECT agent_id AS id FROM context_agents WHERE context_id = '{CONTEXT}'"))
_add(
    "context_sizes",
    lambda c: groups.context_sizes(c.contexts, c.context_members, c.context_agents),
    _sql("mr", "SELECT id, (SELECT count(*) FROM context_members WHERE context_id = id) AS memories, (SELECT count(*) FROM context_agents WHERE context_id = id) AS agents FROM contexts"),
)
_add("grant_counts", lambda c: groups.grant_counts(c.agents, c.agent_grants), _sql("mr", "SELECT id, (SELECT count(*) FROM agent_grants WHERE agent_id = id) AS collections FROM agents"))
_add("agents_able", lambda c: _ids(groups.has_capability(c.agents, "nation3")), "SELECT CAST(s_suppkey AS VARCHAR) AS id FROM supplier WHERE s_nationkey = 3")
_add(
    "context_summary",
    lambda c: groups.context_summary(c.context_members, c.memories).select("context_id", "memories", F.round("mean_confidence", 9).alias("mean_confidence"), F.array_join(F.transform(F.map_entries("topics"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("topics")),
    _sql("mr", "SELECT context_id, sum(n)::BIGINT AS memories, round(sum(c) / sum(n), 9) AS mean_confidence, string_agg(topic || '=' || n, ',' ORDER BY topic) AS topics FROM (SELECT context_id, topic, count(*) AS n, sum(confidence) AS c FROM context_members JOIN memories ON id = memory_id GROUP BY ALL) GROUP BY context_id"),
)
_add(
    "same_topic_links",
    lambda c: groups.same_topic_links(c.memories, _ids(filters.most_recent(c.memories, 5))).select("source_id", "target_id", "topic"),
    _sql("m", "SELECT a.id AS source_id, b.id AS target_id, a.topic FROM (SELECT * FROM memories ORDER BY ts DESC, id LIMIT 5) a JOIN memories b ON a.topic = b.topic WHERE b.id NOT IN (SELECT id FROM memories ORDER BY ts DESC, id LIMIT 5)"),
)

# traversal


def _seeds(c: CorpusCatalog, *ids: str) -> DataFrame:
    return c.spark.createDataFrame([(i,) for i in ids], "seed string")


def _walk(table: str, depth: int, stop: str) -> str:
    """Simple paths by recursion; they stop at a node."""
    return f"""pairs AS (SELECT DISTINCT source_id, target_id FROM {table}),
walk AS (SELECT ['{NODE}'] AS path, '{NODE}' AS here, 0 AS length UNION ALL
  SELECT list_append(path, target_id), target_id, length + 1 FROM walk JOIN pairs ON source_id = here
  WHERE length < {depth} AND here <> '{stop}' AND NOT list_contains(path, target_id))"""


def _hops(table: str, depth: int, seeds: str) -> str:
    return f"""pairs AS (SELECT DISTINCT source_id, target_id FROM {table}),
hops AS (SELECT seed, seed AS id, 0 AS hop FROM (SELECT unnest({seeds}) AS seed) UNION
  SELECT seed, target_id, hop + 1 FROM hops JOIN pairs ON source_id = id WHERE hop < {depth}),
near AS (SELECT seed, id, min(hop)::BIGINT AS hop FROM hops GROUP BY ALL)"""


_FOUND = f"walk WHERE here = '{FAR_NODE}' AND length > 0"
_add(
    "paths",
    lambda c: traverse.paths(c.links, NODE, FAR_NODE, 5).select(F.array_join("path", ">").alias("path"), "length"),
    _sql("ml", f", {_walk('links', 5, FAR_NODE)} SELECT array_to_string(path, '>') AS path, length::BIGINT AS length FROM {_FOUND}", True),
)
_add(
    "path_links",
    lambda c: traverse.path_links(traverse.paths(c.links, NODE, FAR_NODE, 5), c.links).select("id"),
    _sql("ml", f", {_walk('links', 5, FAR_NODE)}, steps AS (SELECT DISTINCT path[i] AS a, path[i + 1] AS b FROM {_FOUND.replace('walk', 'walk, unnest(range(1, 6)) AS t(i)')} AND i <= length) SELECT DISTINCT id FROM links JOIN steps ON source_id = a AND target_id = b", True),
)
_add(
    "described_paths",
    lambda c: traverse.described_paths(traverse.paths(c.links, NODE, FAR_NODE, 5), c.links).select(F.array_join("path", ">").alias("path"), F.round("total_weight", 9).alias("total_weight"), F.array_join("links", ",").alias("links")),
    _sql("ml", f", {_walk('links', 5, FAR_NODE)}, steps AS (SELECT path, i, path[i] AS a, path[i + 1] AS b FROM {_FOUND.replace('walk', 'walk, unnest(range(1, 6)) AS t(i)')} AND i <= length) SELECT array_to_string(path, '>') AS path, round(sum(weight), 9) AS total_weight, string_agg(id, ',' ORDER BY i, id) AS links FROM links JOIN steps ON source_id = a AND target_id = b GROUP BY steps.path", True),
)
_add("k_hop_nodes", lambda c: traverse.k_hop_nodes(c.links, _seeds(c, "1", "2", "50"), 3), _sql("ml", f", {_hops('links', 3, repr(['1', '2', '50']))} SELECT seed, id, hop FROM near", True))
_add(
    "k_hop_links",
    lambda c: traverse.k_hop_links(c.links, _seeds(c, NODE), 3).select("id"),
    _sql("ml", f", {_hops('links', 2, repr([NODE]))} SELECT DISTINCT links.id FROM links JOIN near ON source_id = near.id", True),
)
_add(
    "k_hop_events",
    lambda c: traverse.k_hop_nodes(c.event_links, c.event_memories.where("CAST(id AS BIGINT) % 100 = 0").select("id"), 2).groupBy("hop").agg(F.count(F.lit(1)).alias("nodes")),
    _sql("e", f", {_hops('event_links', 2, '(SELECT list(id) FROM event_memories WHERE event_id % 100 = 0)')} SELECT hop, count(*) AS nodes FROM near GROUP BY hop", True),
)
_add(
    "shortest_path",
    lambda c: traverse.shortest_path(c.links, NODE, FAR_NODE, 6).select(F.array_join("path", ">").alias("path"), "length"),
    _sql("ml", f", {_walk('links', 6, FAR_NODE)} SELECT array_to_string(path, '>') AS path, length::BIGINT AS length FROM {_FOUND} ORDER BY walk.length, walk.path LIMIT 1", True),
)
_add(
    "find_connections",
    lambda c: traverse.find_connections(c.links, "7", "in", ["supports", "causes"], 2).select("id"),
    _sql("ml", ", one AS (SELECT * FROM links WHERE target_id = '7' AND relationship_type IN ('supports', 'causes')) SELECT DISTINCT id FROM links WHERE relationship_type IN ('supports', 'causes') AND (target_id = '7' OR target_id IN (SELECT source_id FROM one))"),
)

# vectors

_VECTORS = "v AS (SELECT CAST(vec_id AS VARCHAR) AS id, embedding::DOUBLE[] AS x FROM embeddings)"
_RANKED = "SELECT query_id, memory_id, score, rank::BIGINT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, memory_id) AS rank FROM s) WHERE rank <= {0}"


def _asked(c: CorpusCatalog) -> DataFrame:
    """Every hundredth vector is a query against all."""
    return c.vectors.where("CAST(memory_id AS BIGINT) % 100 = 0").select(F.col("memory_id").alias("query_id"), "vector")


def _nearest(score: str, k: int) -> str:
    return f"WITH {_VECTORS}, s AS (SELECT q.id AS query_id, v.id AS memory_id, round({score}, 6) + 0.0 AS score FROM v, v q WHERE CAST(q.id AS BIGINT) % 100 = 0) {_RANKED.format(k)}"


_add("cosine_topk", lambda c: vectors.top_k(c.vectors, _asked(c), 10), _nearest("list_cosine_similarity(v.x, q.x)", 10))
_add("euclid_topk", lambda c: vectors.top_k(c.vectors, _asked(c), 10, "euclidean").where("rank > 1"), _nearest("-list_distance(v.x, q.x)", 10) + " AND rank > 1")
_add(
    "cosine_expressions",
    lambda c: _pairwise(c),
    f"WITH {_VECTORS} SELECT v.id AS memory_id, round(list_cosine_similarity(v.x, q.x), 6) + 0.0 AS cosine, round(list_distance(v.x, q.x), 6) + 0.0 AS distance FROM v, v q WHERE q.id = '7' AND v.id <> '7'",
)


def _pairwise(c: CorpusCatalog) -> DataFrame:
    one = c.vectors.where("memory_id = '7'").select(F.col("vector").alias("q"))
    met = c.vectors.where("memory_id <> '7'").crossJoin(F.broadcast(one))
    return met.select("memory_id", F.round(V.cosine(F.col("vector"), F.col("q")), 6).alias("cosine"), F.round(V.euclidean(F.col("vector"), F.col("q")), 6).alias("distance"))


_add(
    "similar_to",
    lambda c: vectors.search(c.vectors, 10, similar_to="42").select("memory_id", "score"),
    f"WITH {_VECTORS} SELECT v.id AS memory_id, round(list_cosine_similarity(v.x, q.x), 6) AS score FROM v, v q WHERE q.id = '42' AND v.id <> '42' ORDER BY 2 DESC, 1 LIMIT 10",
)
_add(
    "min_score",
    lambda c: vectors.search(c.vectors, 50, similar_to="42", exclude_self=False, min_score=0.2).select("memory_id", "score"),
    f"WITH {_VECTORS}, s AS (SELECT v.id AS memory_id, round(list_cosine_similarity(v.x, q.x), 6) AS score FROM v, v q WHERE q.id = '42' ORDER BY 2 DESC, 1 LIMIT 50) SELECT * FROM s WHERE score >= 0.2",
)
_add(
    "normalize",
    lambda c: c.vectors.select("memory_id", F.posexplode(V.normalize(F.transform("vector", lambda x: x * 3))).alias("at", "x")).select("memory_id", "at", F.round("x", 6).alias("x")),
    f"WITH {_VECTORS}, n AS (SELECT id, x, sqrt(list_sum(list_transform(x, lambda y: y * y))) AS size FROM v) SELECT id AS memory_id, i AS at, round(x[i + 1] / size, 6) AS x FROM n, unnest(range(len(x))) AS t(i)",
)
_add(
    "truncate_dims",
    lambda c: reduce.VectorReducer("truncation", 8).fit(c.vectors).transform(c.vectors).select("memory_id", F.round(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x), 6).alias("total"), "dimensions", "model"),
    f"WITH {_VECTORS} SELECT id AS memory_id, round(list_sum(x[1:8]), 6) AS total, 8::BIGINT AS dimensions, 'table_reduced' AS model FROM v",
)
_add(
    "hash_embedding",
    lambda c: vectors.HashEmbedder(8).embed(c.memories.select("id", "content"), "content", "x").select("id", *[F.round(F.col("x")[i], 6).alias(f"x{i}") for i in range(8)]),
    """WITH RECURSIVE sums AS (SELECT CAST(doc_id AS VARCHAR) AS id, coalesce(list_sum(list_transform(range(1, octet_length(encode(text)) + 1), lambda i: ('0x' || substr(hex(encode(text)), 2 * i - 1, 2))::INT)), 0)::HUGEINT AS s FROM documents),
    d AS (SELECT DISTINCT s FROM sums),
    g AS (SELECT s, 0 AS i, s AS state FROM d UNION ALL SELECT s, i + 1, (state * 6364136223846793005::HUGEINT + 1) % 18446744073709551616::HUGEINT FROM g WHERE i < 8),
    x AS (SELECT s, i, (state % 1000)::DOUBLE / 500 - 1 AS x FROM g WHERE i > 0),
    n AS (SELECT s, sqrt(sum(x * x)) AS size FROM x GROUP BY s) SELECT id, """
    + ", ".join(f"round(max(x) FILTER (i = {i + 1}) / any_value(CASE WHEN size = 0 THEN 1 ELSE size END), 6) AS x{i}" for i in range(8))
    + " FROM sums JOIN x USING (s) JOIN n USING (s) GROUP BY id",
)
_add("pca", lambda c: reduce.VectorReducer("pca", 8).fit(c.vectors).transform(c.vectors).select("memory_id", "vector", "model", "dimensions"))
_add("random_projection", lambda c: reduce.VectorReducer("projection", 8).fit(c.vectors).transform(c.vectors).select("memory_id", "vector", "model", "dimensions"))


@_query("inverted_file_topk")
def _inverted(c: CorpusCatalog) -> DataFrame:
    index = vectors.InvertedFile().fit(c.vectors)
    return index.search(index.index(c.vectors), _asked(c), 10)


def _indexed_vectors(c: CorpusCatalog, **how) -> vector_index.VectorIndex:
    """An index over all vectors, from which one in seven was removed and one in fourteen put anew with twice its length."""
    index = vector_index.VectorIndex(store.GraphStore(c.spark, f"{shared_folder(c.spark)}/lorekeep/stores/{uuid.uuid4().hex}"), **how)
    rows = c.vectors.select("memory_id", "vector")
    index.build(rows)
    index.remove(rows.where("CAST(memory_id AS BIGINT) % 7 = 0").select("memory_id"))
    index.put(rows.where("CAST(memory_id AS BIGINT) % 14 = 0").withColumn("vector", F.transform("vector", lambda x: x * 2)))
    return index


_LEFT = "CAST({0} AS BIGINT) % 7 <> 0 OR CAST({0} AS BIGINT) % 14 = 0"


@_query("vector_index_rows", f"WITH {_VECTORS} SELECT id AS memory_id, round(list_sum(x) * CASE WHEN CAST(id AS BIGINT) % 14 = 0 THEN 2 ELSE 1 END, 4) AS total FROM v WHERE {_LEFT.format('id')}")
def _vector_index_rows(c: CorpusCatalog) -> DataFrame:
    rows = _indexed_vectors(c, cell_rows=256).store.read("codes")
    return rows.select("memory_id", F.round(F.aggregate(F.col("vector").cast("array<double>"), F.lit(0.0), lambda s, x: s + x), 4).alias("total"))


@_query("vector_index_topk", f"WITH {_VECTORS}, s AS (SELECT q.id AS query_id, v.id AS memory_id, round(list_cosine_similarity(v.x, q.x), 6) + 0.0 AS score FROM v, v q WHERE CAST(q.id AS BIGINT) % 100 = 0 AND ({_LEFT.format('v.id')})) {_RANKED.format(10)}")
def _vector_index_topk(c: CorpusCatalog) -> DataFrame:
    """Every cell is probed and ten candidates a row are compared, which finds the nearest of these tables."""
    return _indexed_vectors(c, cell_rows=256, probes=1.0, candidates=10).search(_asked(c), 10)


# hybrid


def _hybrid(method: str, **more) -> Callable[[CorpusCatalog], DataFrame]:
    def make(c: CorpusCatalog) -> DataFrame:
        vector = c.vectors.where("memory_id = '42'").first()["vector"]
        query = hybrid.HybridQuery(text=WORD, vector=tuple(vector), vector_limit=50, method=method, limit=40, **more)
        return hybrid.search(c.memories, c.vectors, query).select("id", "score")

    return make


def _hybrid_sql(score: str, where: str = "true", meta: str = "NULL::DOUBLE") -> str:
    return _sql("mp", f""", {_VECTORS}, near AS (SELECT v.id, round(list_cosine_similarity(v.x, q.x), 6) AS vector FROM v, v q WHERE q.id = '42' ORDER BY 2 DESC, 1 LIMIT 50),
      hits AS (SELECT DISTINCT memory_id AS id, 1.0::DOUBLE AS keyword FROM postings WHERE stem = '{WORD}'),
      both_ AS (SELECT id, keyword, vector, {meta} AS meta FROM hits FULL JOIN near USING (id))
      SELECT id, round({score}, 6) AS score FROM both_ JOIN memories USING (id) WHERE {where} ORDER BY 2 DESC, 1 LIMIT 40""")  # fmt: skip


_WEIGHTED = "(coalesce(keyword, 0) + coalesce(vector, 0) + 0.5 * coalesce(meta, 0)) / ((keyword IS NOT NULL)::INT + (vector IS NOT NULL)::INT + 0.5 * (meta IS NOT NULL)::INT)"
_add("hybrid_sum", _hybrid("sum"), _hybrid_sql("coalesce(keyword, 0) + coalesce(vector, 0)"))
_add("hybrid_max", _hybrid("max"), _hybrid_sql("greatest(0, coalesce(keyword, 0), coalesce(vector, 0))"))
_add("hybrid_weighted", _hybrid("weighted"), _hybrid_sql(_WEIGHTED))
_add(
    "hybrid_filtered",
    _hybrid("weighted", metadata=(("topic", "t3"), ("topic", "t4")), min_confidence=0.35),
    _hybrid_sql(_WEIGHTED, "topic IN ('t3', 't4') AND floor(confidence * 10) >= 3", "1.0::DOUBLE"),
)

# forgetting

_OLD = f"{NOW} - INTERVAL 20 DAY"
_IDLE = "last_accessed < {0} AND access_count <= 60"
for _name, _policy, _where, _order in (
    ("forget_age", forgetting.age_policy(20, 40), f"ts < {_OLD}", "ts"),
    ("forget_importance", forgetting.importance_policy(0.25), "importance <= 0.25", "importance"),
    ("forget_access", forgetting.access_policy(60, 20), _IDLE.format(_OLD), "access_count"),
    ("forget_hybrid", forgetting.hybrid_policy(0.4, 60, 20, 30), f"importance <= 0.4 AND {_IDLE.format(_OLD)}", "importance"),
    ("forget_ttl", forgetting.ttl_policy(30), f"date_diff('second', last_accessed, {NOW}) > ttl", f"ttl - date_diff('second', last_accessed, {NOW})"),
):
    _limit = f" LIMIT {_policy.limit}" if _policy.limit else ""
    _add(_name, lambda c, p=_policy: _ids(forgetting.candidates(c.memories, p, C.AS_OF)), _sql("m", f"SELECT id FROM memories WHERE {_where} ORDER BY {_order}, id{_limit}"))
_add("after_forgetting", lambda c: _ids(forgetting.forget(c.memories, forgetting.importance_policy(0.25), C.AS_OF)), _sql("m", "SELECT id FROM memories WHERE NOT importance <= 0.25"))
_add(
    "links_after_forgetting",
    lambda c: _ids(forgetting.forget_with_links(c.memories, c.links, forgetting.importance_policy(0.25), C.AS_OF)[1]),
    _sql("ml", "SELECT id FROM links WHERE source_id NOT IN (SELECT id FROM memories WHERE importance <= 0.25) AND target_id NOT IN (SELECT id FROM memories WHERE importance <= 0.25)"),
)


@_query("record_accesses", _sql("m", ", n AS (SELECT count(*) AS n FROM documents), a AS (SELECT CAST(event_id % n AS VARCHAR) AS id, count(*) AS c, max(ts) AS last FROM events, n GROUP BY 1) SELECT id, access_count + coalesce(c, 0) AS access_count, CAST(epoch(date_trunc('second', greatest(last_accessed, last))) AS BIGINT) AS last FROM memories LEFT JOIN a USING (id)"))
def _record_accesses(c: CorpusCatalog) -> DataFrame:
    n = c.table("documents").agg(F.count(F.lit(1)).alias("n"))
    log = c.table("events").crossJoin(F.broadcast(n)).selectExpr("CAST(event_id % n AS STRING) AS memory_id", "ts AS accessed_at")
    return forgetting.record_accesses(c.memories, log).select("id", "access_count", C.epoch(F.date_trunc("second", "last_accessed").cast("timestamp_ntz")).alias("last"))


# analytics

_add("simple_graph", lambda c: analytics.simple_graph(c.links, c.memories), _sql("mlg", "SELECT source_id, target_id, weight FROM edges"))
_add(
    "in_degree_centrality",
    lambda c: analytics.in_degree_centrality(analytics.simple_graph(c.links, c.memories), c.memories).select("id", F.round("centrality", 9).alias("centrality")),
    _sql("mlg", "SELECT m.id, round(coalesce(in_degree, 0) / ((SELECT count(*) FROM memories) - 1), 9) AS centrality FROM memories m LEFT JOIN degree d ON d.id = m.id"),
)


def _rank_sql(edges: str, nodes: str, rounds: int) -> str:
    """Power steps, one after another; ends with the view rank<rounds>."""
    out = [
        f"nodes AS (SELECT id, (SELECT count(*) FROM {nodes}) AS n FROM {nodes})",
        f"share AS MATERIALIZED (SELECT source_id, target_id, weight / sum(weight) OVER (PARTITION BY source_id) AS share FROM {edges})",
        "gives AS MATERIALIZED (SELECT DISTINCT source_id AS id FROM share)",
        "rank0 AS MATERIALIZED (SELECT id, n, 1.0::DOUBLE / n AS rank FROM nodes)",
    ]
    for i in range(rounds):
        out.append(
            f"rank{i + 1} AS MATERIALIZED (SELECT r.id, r.n, {1 - DAMPING} / r.n + {DAMPING} * (coalesce(got, 0) + (SELECT coalesce(sum(rank), 0) FROM rank{i} WHERE id NOT IN (SELECT id FROM gives)) / r.n) AS rank "
            f"FROM rank{i} r LEFT JOIN (SELECT target_id AS id, sum(rank * share) AS got FROM rank{i} JOIN share ON source_id = rank{i}.id GROUP BY 1) g ON g.id = r.id)"
        )
    return ", ".join(out)


def _supplier_nodes(c: CorpusCatalog) -> DataFrame:
    return c.table("supplier").select(F.col("s_suppkey").cast("string").alias("id"))


_add(
    "pagerank",
    lambda c: analytics.pagerank(c.supplier_links, _supplier_nodes(c), ROUNDS).select("id", F.round("rank", 9).alias("rank")),
    _sql("s", f", suppliers AS (SELECT CAST(s_suppkey AS VARCHAR) AS id FROM supplier), {_rank_sql('supplier_links', 'suppliers', ROUNDS)} SELECT id, round(rank, 9) AS rank FROM rank{ROUNDS}"),
)
_add(
    "forgetting_scores",
    lambda c: analytics.forgetting_scores(c.memories, c.links, c.context_members, C.AS_OF).select("id", "in_degree", "out_degree", "context_references", F.round("score", 7).alias("score")),
)
_add(
    "forgetting_scores_without_betweenness",
    lambda c: analytics.forgetting_scores(c.memories, c.links, c.context_members, C.AS_OF, with_betweenness=False, rounds=ROUNDS).select("id", "in_degree", "out_degree", "context_references", F.round("score", 7).alias("score")),
    _sql("mlgr", f""", {_rank_sql('edges', 'memories', ROUNDS)}, aged AS (SELECT *, date_diff('second', ts, {NOW}) AS age, max(date_diff('second', ts, {NOW})) OVER () AS oldest FROM memories),
      refs AS (SELECT memory_id AS id, count(*) AS refs FROM context_members GROUP BY 1)
      SELECT m.id, coalesce(in_degree, 0) AS in_degree, coalesce(out_degree, 0) AS out_degree, coalesce(refs, 0) AS context_references,
        round(0.4 * (1 - CASE WHEN oldest > 0 THEN 1 - age / oldest ELSE 1 END) + 0.3 * (1 - confidence) + 0.3 * (1 - (coalesce(in_degree, 0) / (n - 1) + rank) / 3), 7) AS score
      FROM aged m JOIN rank{ROUNDS} p ON p.id = m.id LEFT JOIN degree d ON d.id = m.id LEFT JOIN refs ON refs.id = m.id"""),
)
_FAR = """steps AS MATERIALIZED (SELECT source_id::BIGINT AS a, target_id::BIGINT AS b FROM edges WHERE source_id <> target_id),
far(s, id, hop) USING KEY (s, id) AS (SELECT doc_id, doc_id, 0 FROM memories UNION
  SELECT DISTINCT f.s, b, hop + 1 FROM far f JOIN steps ON a = f.id WHERE NOT EXISTS (SELECT 1 FROM recurring.far r WHERE r.s = f.s AND r.id = b))"""


def _betweenness_sql(levels: int) -> str:
    """Ways from level to level away from each source, and dependencies back."""
    out = [f", {_FAR}", "w0 AS MATERIALIZED (SELECT s, id, 1.0::DOUBLE AS ways FROM far WHERE hop = 0)"]
    for k in range(1, levels + 1):
        out.append(f"w{k} AS MATERIALIZED (SELECT f.s, f.id, sum(ways) AS ways FROM w{k - 1} w JOIN steps ON a = w.id JOIN far f ON f.s = w.s AND f.id = b AND f.hop = {k} GROUP BY ALL)")
    out.append(f"d{levels} AS MATERIALIZED (SELECT s, id, ways, 0.0::DOUBLE AS x FROM w{levels})")
    for k in range(levels - 1, 0, -1):
        out.append(
            f"d{k} AS MATERIALIZED (SELECT w.s, w.id, w.ways, coalesce(sum(w.ways / n.ways * (1 + n.x)), 0) AS x FROM w{k} w "
            f"LEFT JOIN (SELECT s, a, ways, x FROM d{k + 1} JOIN steps ON b = id) n ON n.s = w.s AND n.a = w.id GROUP BY ALL)"
        )
    total = " UNION ALL ".join(f"SELECT id, x FROM d{k}" for k in range(1, levels + 1))
    return ", ".join(out) + f", n AS (SELECT count(*) AS n FROM memories) SELECT m.id, round(coalesce(x, 0) / ((n - 1) * (n - 2)), 9) AS betweenness FROM memories m CROSS JOIN n LEFT JOIN (SELECT id, sum(x) AS x FROM ({total}) GROUP BY id) t ON t.id = m.doc_id"


def _core_sql(k: int, rounds: int, name: str = "c") -> str:
    """Weak nodes go round by round; ends with the view <name><rounds> (a, b)."""
    out = [f", {name}0 AS MATERIALIZED (SELECT DISTINCT a, b FROM (SELECT source_id AS a, target_id AS b FROM edges UNION ALL SELECT target_id, source_id FROM edges) WHERE a <> b)"]
    for i in range(rounds):
        strong = f"(SELECT a FROM {name}{i} GROUP BY a HAVING count(*) >= {k})"
        out.append(f"{name}{i + 1} AS MATERIALIZED (SELECT a, b FROM {name}{i} WHERE a IN {strong} AND b IN {strong})")
    return ", ".join(out)


_add("betweenness", lambda c: analytics.betweenness(analytics.simple_graph(c.links, c.memories), c.memories).select("id", F.round("betweenness", 9).alias("betweenness")), _sql("mlg", _betweenness_sql(20), True))
_add(
    "path_statistics",
    lambda c: analytics.path_statistics(analytics.simple_graph(c.links, c.memories), c.memories).select("pairs", F.round("mean_length", 9).alias("mean_length"), "diameter"),
    _sql("mlg", f", {_FAR} SELECT count(*) AS pairs, round(avg(hop), 9) AS mean_length, max(hop)::BIGINT AS diameter FROM far WHERE hop > 0", True),
)
_add("k_core", lambda c: analytics.k_core(analytics.simple_graph(c.links, c.memories), 4), _sql("mlg", _core_sql(4, 20) + " SELECT DISTINCT a AS id FROM c20"))
_add("bridges", lambda c: analytics.bridges(analytics.simple_graph(c.links, c.memories), c.memories, 0.01).select("id"), _sql("mlg", _betweenness_sql(20).replace(" SELECT m.id, round(", " SELECT m.id FROM (SELECT m.id, round(") + ") m WHERE betweenness > 0.01", True))
_SMALL = "small AS (SELECT id, 'g' || CAST(doc_id // 6 AS VARCHAR) AS grp FROM memories)"
_add(
    "group_density",
    lambda c: analytics.group_density(c.memories.select(F.concat(F.lit("g"), F.expr("CAST(id AS BIGINT) div 6")).alias("group"), "id"), analytics.simple_graph(c.links, c.memories)).select(F.col("group").alias("grp"), "size", "edges", F.round("density", 9).alias("density")),
    _sql("mlg", f", {_SMALL}, i AS (SELECT a.grp, count(*) AS edges FROM edges JOIN small a ON a.id = source_id JOIN small b ON b.id = target_id AND a.grp = b.grp GROUP BY 1) SELECT grp, count(*) AS size, coalesce(any_value(edges), 0) AS edges, round(CASE WHEN count(*) > 1 THEN coalesce(any_value(edges), 0) / (count(*) * (count(*) - 1)) ELSE 0 END, 9) AS density FROM small LEFT JOIN i USING (grp) GROUP BY grp"),
)
_add(
    "topic_clusters",
    lambda c: analytics.topic_clusters(c.memories, analytics.simple_graph(c.links, c.memories), (3, 1_000_000), 0.0).select("topic", "size", "edges", F.round("quality", 9).alias("quality")),
    _sql("mlg", ", i AS (SELECT a.topic, count(*) AS edges FROM edges JOIN memories a ON a.id = source_id JOIN memories b ON b.id = target_id AND a.topic = b.topic GROUP BY 1) SELECT topic, count(*) AS size, any_value(edges) AS edges, round(0.5 + 0.5 * any_value(edges) / (count(*) * (count(*) - 1)), 9) AS quality FROM memories JOIN i USING (topic) GROUP BY topic HAVING count(*) >= 3"),
)
_add(
    "sequence_windows",
    lambda c: analytics.sequence_windows(c.event_memories).groupBy("start").agg(F.count(F.lit(1)).alias("size")),
    "WITH RECURSIVE t AS MATERIALIZED (SELECT CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events), w AS (SELECT min(s) AS start FROM t UNION ALL SELECT (SELECT min(s) FROM t WHERE s > w.start + 3600) FROM w WHERE w.start IS NOT NULL) SELECT start, (SELECT count(*) FROM t WHERE s >= start AND s <= start + 3600) AS size FROM w WHERE start IS NOT NULL",
)
_add(
    "temporal_sequences",
    lambda c: analytics.temporal_sequences(c.event_memories, analytics.simple_graph(c.event_links, c.event_memories), sizes=(3, 20)).select("start", "size", "edges", F.round("quality", 9).alias("quality")),
    _sql("e", ", t AS MATERIALIZED (SELECT id, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM event_memories), w AS (SELECT min(s) AS start FROM t UNION ALL SELECT (SELECT min(s) FROM t WHERE s > w.start + 3600) FROM w WHERE w.start IS NOT NULL), "
         "p AS MATERIALIZED (SELECT id, start FROM w JOIN t ON s >= start AND s <= start + 3600), g AS (SELECT start, count(*) AS size FROM p GROUP BY 1), i AS (SELECT a.start, count(DISTINCT (source_id, target_id)) AS edges FROM event_links JOIN p a ON a.id = source_id JOIN p b ON b.id = target_id AND a.start = b.start GROUP BY 1) "
         "SELECT start, size, edges, round(0.4 + 0.6 * edges / size, 9) AS quality FROM g JOIN i USING (start) WHERE size BETWEEN 3 AND 20", True),
)
_add(
    "sources_and_sinks",
    lambda c: analytics.sources_and_sinks(analytics.simple_graph(c.event_links, c.event_memories)),
    _sql("e", f"SELECT id, CASE WHEN in_degree = 0 THEN 'source' ELSE 'sink' END AS role FROM {_DEGREES.format('(SELECT DISTINCT source_id, target_id FROM event_links)')} WHERE (out_degree > 2 AND in_degree = 0) OR (in_degree > 2 AND out_degree = 0)"),
)
_add(
    "graph_metrics",
    lambda c: analytics.graph_metrics(c.memories, c.links).select("nodes", "edges", F.round("density", 9).alias("density"), F.round("reciprocity", 9).alias("reciprocity"), "isolated", F.round("mean_confidence", 9).alias("mean_confidence")),
    _sql("mlg", "SELECT n AS nodes, e AS edges, round(e / (n * (n - 1)), 9) AS density, round((SELECT count(*) FROM edges a JOIN edges b ON a.source_id = b.target_id AND a.target_id = b.source_id WHERE a.source_id <> a.target_id) / e, 9) AS reciprocity, n - (SELECT count(*) FROM degree) AS isolated, round(c, 9) AS mean_confidence FROM (SELECT count(*) AS n, avg(confidence) AS c FROM memories), (SELECT count(*) AS e FROM edges)"),
)


def _communities(c: CorpusCatalog) -> DataFrame:
    return analytics.communities(analytics.simple_graph(c.links, c.memories), c.memories)


_add("communities", _communities)
_add("community_stats", lambda c: analytics.community_stats(_communities(c), c.memories, analytics.simple_graph(c.links, c.memories)))
_add("community_contexts", lambda c: analytics.community_contexts(_communities(c), c.memories, analytics.simple_graph(c.links, c.memories)))
_add("community_topics", lambda c: analytics.community_topics(_communities(c), c.memories))
_add(
    "strong_components",
    lambda c: analytics.strong_components(analytics.simple_graph(c.links, c.memories), c.memories),
    _sql("mlg", """, reach AS (SELECT source_id AS a, target_id AS b FROM edges UNION SELECT a, target_id FROM reach JOIN edges ON source_id = b)
      SELECT m.id, least(m.id, min(r.b)) AS component FROM memories m LEFT JOIN (SELECT x.a, x.b FROM reach x JOIN reach y ON x.a = y.b AND x.b = y.a) r ON r.a = m.id GROUP BY m.id""", True),
)


def _by_source(c: CorpusCatalog) -> DataFrame:
    """Given groups in place of found ones, which SQL can follow."""
    return c.memories.select("id", F.col("source").alias("community"))


_add(
    "group_stats",
    lambda c: analytics.community_stats(_by_source(c), c.memories, analytics.simple_graph(c.links, c.memories)).select(
        "community", "size", F.round("density", 9).alias("density"), "dominant_topic", F.round("topic_concentration", 9).alias("topic_concentration"), F.round("mean_confidence", 9).alias("mean_confidence")
    ),
    _sql("mlg", """, i AS (SELECT a.source, count(*) AS e FROM edges JOIN memories a ON a.id = source_id JOIN memories b ON b.id = target_id AND a.source = b.source GROUP BY 1),
      t AS (SELECT source, topic, count(*) AS n, sum(confidence) AS c FROM memories GROUP BY ALL)
      SELECT source AS community, sum(n)::BIGINT AS size, round(coalesce(any_value(e), 0) / (sum(n) * (sum(n) - 1)), 9) AS density, arg_max(topic, (n, topic)) AS dominant_topic,
        round(max(n) / sum(n), 9) AS topic_concentration, round(sum(c) / sum(n), 9) AS mean_confidence FROM t LEFT JOIN i USING (source) GROUP BY source HAVING sum(n) > 1"""),
)
_add(
    "group_topics",
    lambda c: analytics.community_topics(_by_source(c), c.memories).select("community", "topic", "memories", F.round("share", 9).alias("share")),
    _sql("m", "SELECT source AS community, topic, count(*) AS memories, round(count(*) / any_value(size), 9) AS share FROM memories JOIN (SELECT source, count(*) AS size FROM memories GROUP BY 1) USING (source) WHERE size > 1 GROUP BY source, topic"),
)
_add(
    "group_contexts",
    lambda c: analytics.community_contexts(_by_source(c), c.memories, analytics.simple_graph(c.links, c.memories)).select("community", "id", F.round("rank", 9).alias("rank")),
    _sql("mlg", f""", inner_edges AS MATERIALIZED (SELECT source_id, target_id, weight FROM edges JOIN memories a ON a.id = source_id JOIN memories b ON b.id = target_id WHERE a.source = b.source),
      {_rank_sql('inner_edges', 'memories', ROUNDS)}
      SELECT community, id, round(rank, 9) AS rank FROM (SELECT m.source AS community, m.id, rank, row_number() OVER (PARTITION BY m.source ORDER BY round(rank, 12) DESC, m.id) AS place FROM rank{ROUNDS} r JOIN memories m ON m.id = r.id) WHERE place <= 10"""),
)
_HEALTH = """, e AS (SELECT count(*) AS edges FROM edges), n AS (SELECT count(*) AS nodes, avg(confidence) AS mean_confidence, max(date_diff('second', ts, {now})) / 86400 AS oldest_days,
    min(date_diff('second', ts, {now})) / 86400 AS newest_days, avg(date_diff('second', ts, {now})) / 86400 AS mean_days FROM memories),
  mutual AS (SELECT count(*) AS mutual FROM edges a JOIN edges b ON a.source_id = b.target_id AND a.target_id = b.source_id WHERE a.source_id <> a.target_id),
  isolated AS (SELECT count(*) AS isolated FROM memories WHERE id NOT IN (SELECT id FROM degree)), groups_ AS (SELECT count(*) AS communities FROM (SELECT source FROM memories GROUP BY 1 HAVING count(*) > 1)),
  base AS (SELECT *, edges / (nodes * (nodes - 1)) AS density, mutual / edges AS reciprocity FROM n, e, mutual, isolated, groups_)""".format(now=NOW)
_add(
    "health_of_groups",
    lambda c: analytics.health_report(c.memories, c.links, C.AS_OF, _by_source(c)).select(
        "nodes", "edges", "isolated", "communities", "components", "acyclic", *[F.round(x, 7).alias(x) for x in ("density", "reciprocity", "mean_confidence", "oldest_days", "newest_days", "mean_days", "score")], "grade"
    ),
    _sql("mlg", _HEALTH.replace(", e AS", f""", reach AS (SELECT source_id AS a, target_id AS b FROM edges UNION SELECT a, target_id FROM reach JOIN edges ON source_id = b),
      strong AS (SELECT count(DISTINCT component) AS components, bool_and(alone) AS acyclic FROM (SELECT m.id, least(m.id, min(r.b)) AS component, min(r.b) IS NULL AS alone FROM memories m
        LEFT JOIN (SELECT x.a, x.b FROM reach x JOIN reach y ON x.a = y.b AND x.b = y.a) r ON r.a = m.id GROUP BY m.id)), e AS""", 1) + """
      , scored AS (SELECT *, greatest(0, least(100, density * 20 - isolated / nodes * 15 + CASE WHEN communities BETWEEN 3 AND 10 THEN 10 WHEN communities > 10 THEN 5 ELSE 0 END + reciprocity * 10
        + CASE WHEN mean_confidence > 0.8 THEN 10 WHEN mean_confidence > 0.6 THEN 5 ELSE 0 END)) AS score FROM base, strong)
      SELECT nodes, edges, isolated, communities, components, acyclic, round(density, 7) AS density, round(reciprocity, 7) AS reciprocity, round(mean_confidence, 7) AS mean_confidence, round(oldest_days, 7) AS oldest_days,
        round(newest_days, 7) AS newest_days, round(mean_days, 7) AS mean_days, round(score, 7) AS score,
        CASE WHEN score >= 80 THEN 'Excellent' WHEN score >= 60 THEN 'Good' WHEN score >= 40 THEN 'Fair' WHEN score >= 20 THEN 'Poor' ELSE 'Critical' END AS grade FROM scored""", True),
)
_add(
    "advice_on_groups",
    lambda c: analytics.recommendations(c.memories, c.links, _by_source(c)).select("kind", "issue", "severity", F.round("evidence", 9).alias("evidence")),
    _sql("mlg", _HEALTH + """, more AS (SELECT (SELECT count(*) FROM memories WHERE confidence < 0.6) AS low, (SELECT max(in_degree) FROM degree) AS hub,
        (SELECT count(*) FROM memories, (SELECT max(epoch(ts)) AS last, min(epoch(ts)) AS first FROM memories) WHERE last - epoch(ts) < (last - first) * 0.1) AS fresh),
      steps AS (SELECT source_id AS a, target_id AS b FROM edges),
      cycles AS (SELECT (SELECT count(*) FROM steps WHERE a = b) + (SELECT count(*) FROM steps x JOIN steps y ON x.b = y.a AND y.b = x.a WHERE x.b > x.a)
        + (SELECT count(*) FROM steps x JOIN steps y ON x.b = y.a JOIN steps z ON y.b = z.a AND z.b = x.a WHERE x.b > x.a AND y.b > x.a AND y.b <> x.b) AS cycles),
      r AS (SELECT unnest([
        CASE WHEN density < 0.05 THEN {'kind': 'connectivity', 'issue': 'low density', 'severity': 'medium', 'evidence': density} END,
        CASE WHEN isolated > nodes * 0.1 THEN {'kind': 'connectivity', 'issue': 'isolated memories', 'severity': 'high', 'evidence': isolated::DOUBLE} END,
        CASE WHEN cycles > 0 THEN {'kind': 'structure', 'issue': 'cycles', 'severity': 'low', 'evidence': cycles::DOUBLE} END,
        CASE WHEN low > nodes * 0.2 THEN {'kind': 'quality', 'issue': 'low confidence', 'severity': 'medium', 'evidence': low::DOUBLE} END,
        CASE WHEN communities < 2 THEN {'kind': 'structure', 'issue': 'few communities', 'severity': 'low', 'evidence': communities::DOUBLE} END,
        CASE WHEN communities >= 2 AND communities > nodes * 0.4 THEN {'kind': 'structure', 'issue': 'fragmented communities', 'severity': 'medium', 'evidence': communities::DOUBLE} END,
        CASE WHEN fresh < nodes * 0.05 THEN {'kind': 'recency', 'issue': 'stale', 'severity': 'medium', 'evidence': fresh::DOUBLE} END,
        CASE WHEN hub > nodes * 0.3 THEN {'kind': 'structure', 'issue': 'bottleneck', 'severity': 'medium', 'evidence': hub::DOUBLE} END]) AS x FROM base, more, cycles)
      SELECT x.kind AS kind, x.issue AS issue, x.severity AS severity, round(x.evidence, 9) AS evidence FROM r WHERE x IS NOT NULL"""),
)
_add("health_report", lambda c: analytics.health_report(c.memories, c.links, C.AS_OF))
_add("recommendations", lambda c: analytics.recommendations(c.memories, c.links))
_add("optimized_memories", lambda c: analytics.optimized(c.memories, c.links, c.context_members, C.AS_OF)[0].select("id", "source", "confidence"))

# exchange and upserts

_add(
    "export_collection",
    lambda c: exchange.collection_export(c.tables(), LINKED).links.select("id"),
    _sql("ml", f"SELECT id FROM links WHERE source_id IN (SELECT id FROM memories WHERE source = '{LINKED}') AND target_id IN (SELECT id FROM memories WHERE source = '{LINKED}')"),
)
_add(
    "latest_version",
    lambda c: store.latest(c.table("events").select(F.col("user_id").cast("string").alias("id"), F.col("event_id").alias("version"), "event_type")),
    "SELECT CAST(user_id AS VARCHAR) AS id, max(event_id) AS version, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id",
)

_TIMES = ("2024-01-15 00:00:00", "2024-02-10 12:00:00", "2024-06-01 00:00:00")
_AT = ", ".join(f"TIMESTAMP '{t}'" for t in _TIMES)


@_query("access_history", """WITH a AS (SELECT CAST(user_id AS VARCHAR) AS memory_id, ts FROM events) SELECT memory_id, max(nth) AS accesses, CAST(sum(since) AS BIGINT) AS span, count(DISTINCT first) AS firsts FROM (
  SELECT memory_id, row_number() OVER w AS nth, floor(epoch(ts) - epoch(lag(ts) OVER w)) AS since, min(ts) OVER (PARTITION BY memory_id) AS first FROM a WINDOW w AS (PARTITION BY memory_id ORDER BY ts)) GROUP BY memory_id""")
def _access_history(c: CorpusCatalog) -> DataFrame:
    log = c.table("events").select(F.col("user_id").cast("string").alias("memory_id"), F.col("ts").cast("timestamp_ntz").alias("accessed_at"))
    rows = forgetting.access_history(log)
    return rows.groupBy("memory_id").agg(F.max("nth").alias("accesses"), F.sum("since").cast("bigint").alias("span"), F.countDistinct("first_access").alias("firsts"))


@_query("accesses_as_of", _sql("m", f"""SELECT id, CAST(epoch("at") AS BIGINT) AS "at", access_count + count(user_id) AS access_count, CAST(floor(epoch(greatest(last_accessed, max(e.ts)))) AS BIGINT) AS last
  FROM memories CROSS JOIN (SELECT unnest([{_AT}]) AS "at") LEFT JOIN events e ON CAST(user_id AS VARCHAR) = id AND e.ts <= "at" GROUP BY id, "at", access_count, last_accessed"""))
def _accesses_as_of(c: CorpusCatalog) -> DataFrame:
    """The state of all memories at three times, by the events as a log of accesses."""
    log = c.table("events").select(F.col("user_id").cast("string").alias("memory_id"), F.col("ts").cast("timestamp_ntz").alias("accessed_at"))
    times = c.spark.createDataFrame([(t,) for t in _TIMES], "t string").select(F.col("t").cast("timestamp_ntz").alias("at"))
    rows = forgetting.accesses_as_of(c.memories, log, times)
    return rows.select("id", C.epoch(F.col("at")).alias("at"), "access_count", C.epoch(F.col("last_accessed")).alias("last"))


# streams, run to the end of what is there


def _events(c: CorpusCatalog) -> DataFrame:
    return jobs.read_table(c.spark, c.folder, "events", c.table("events").schema)


def _ended(c: CorpusCatalog, stream: DataFrame, mode: str = "complete") -> DataFrame:
    mark = uuid.uuid4().hex
    return jobs.run_to_end(stream, f"{shared_folder(c.spark)}/lorekeep/streams/{mark}", mode)


@_query("stream_access_counts", "SELECT CAST(user_id AS VARCHAR) AS memory_id, count(*) AS access_count, CAST(floor(epoch(max(ts))) AS BIGINT) AS last FROM events GROUP BY 1")
def _stream_access_counts(c: CorpusCatalog) -> DataFrame:
    log = _events(c).select(F.col("user_id").cast("string").alias("memory_id"), F.col("ts").alias("accessed_at"))
    return _ended(c, jobs.access_counts(log)).select("memory_id", "access_count", C.epoch(F.col("last_accessed")).alias("last"))


@_query("stream_windows", "SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS start, event_type AS key, count(*) AS events FROM events GROUP BY ALL")
def _stream_windows(c: CorpusCatalog) -> DataFrame:
    return _ended(c, jobs.windowed_counts(_events(c))).select(F.unix_seconds("start").alias("start"), "key", "events")


@_query("stream_once_each", "SELECT count(DISTINCT event_id) AS events FROM events")
def _stream_once_each(c: CorpusCatalog) -> DataFrame:
    twice = _events(c).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    return _ended(c, jobs.once_each(twice, ["event_id"], "ts").select("event_id"), "append").agg(F.count(F.lit(1)).alias("events"))


@_query("stream_sliding", """SELECT start, key, count(*) AS events FROM (SELECT event_type AS key, unnest([floor(epoch(ts) / 1800) * 1800, floor(epoch(ts) / 1800) * 1800 - 1800])::BIGINT AS start FROM events) GROUP BY ALL""")
def _stream_sliding(c: CorpusCatalog) -> DataFrame:
    return _ended(c, jobs.windowed_counts(_events(c), slide="30 minutes")).select(F.unix_seconds("start").alias("start"), "key", "events")


@_query("stream_sessions", """WITH s AS (SELECT user_id, ts, coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER w >= 3600000000, true) AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
  n AS (SELECT *, sum(new::INT) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS nth FROM s)
  SELECT user_id AS key, CAST(floor(epoch(min(ts))) AS BIGINT) AS start, CAST(floor(epoch(max(ts))) AS BIGINT) + 3600 AS "end", count(*) AS events FROM n GROUP BY user_id, nth""")
def _stream_sessions(c: CorpusCatalog) -> DataFrame:
    return _ended(c, jobs.session_counts(_events(c))).select("key", F.unix_seconds("start").alias("start"), F.unix_seconds("end").alias("end"), "events")


@_query("stream_expiries", _sql("m", "SELECT id FROM memories WHERE ttl IS NOT NULL AND ts + to_seconds(ttl) < (SELECT max(ts) FROM memories) - INTERVAL 1 HOUR"))
def _stream_expiries(c: CorpusCatalog) -> DataFrame:
    """Timers that ran out by the time that the stream has come to."""
    docs = jobs.read_table(c.spark, c.folder, "documents", c.table("documents").schema)
    memories = docs.selectExpr(
        "CAST(doc_id AS STRING) AS id", "TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, doc_id * 7919) AS timestamp",
        "CASE WHEN doc_id % 3 = 0 THEN (doc_id % 50 + 1) * 86400 END AS ttl",
    )
    return _ended(c, jobs.expiries(memories), "append").select("id")


@_query("stream_upserts", "SELECT CAST(user_id AS VARCHAR) AS id, arg_max(event_type, event_id) AS content, max(event_id) AS access_count FROM events GROUP BY user_id")
def _stream_upserts(c: CorpusCatalog) -> DataFrame:
    """Events as memories of their users, put into a store by micro-batches: the latest of each user."""
    mark = uuid.uuid4().hex
    folder = f"{shared_folder(c.spark)}/lorekeep/streams/{mark}"
    kept = store.GraphStore(c.spark, f"{folder}/store")
    rows = _events(c).selectExpr(
        "CAST(user_id AS STRING) AS id", "event_type AS content", "event_id AS access_count", "TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, event_id) AS timestamp"
    )
    jobs.ingest(rows, kept, f"{folder}/mark").awaitTermination()
    return kept.read("memories").select("id", "content", "access_count")


@_query("stored_index", _sql("mp", _ANY))
def _stored_index(c: CorpusCatalog) -> DataFrame:
    """The memories in a store with a text index, searched by it."""
    kept = store.GraphStore(c.spark, f"{shared_folder(c.spark)}/lorekeep/stores/{uuid.uuid4().hex}")
    kept.put("memories", c.memories)
    kept.build_index()
    return _ids(kept.search(ANY_TEXT))


@_query("reduced_and_stored", f"WITH {_VECTORS} SELECT id AS memory_id, round(list_sum(x[1:8]), 5) AS total, 8::BIGINT AS dimensions FROM v")
def _reduced_and_stored(c: CorpusCatalog) -> DataFrame:
    """Vectors that one job reads from a store, reduces and stores beside the originals."""
    kept = store.GraphStore(c.spark, f"{shared_folder(c.spark)}/lorekeep/stores/{uuid.uuid4().hex}")
    kept.put("vectors", c.vectors)
    engine = MemoryEngine(kept.tables(), store=kept)
    engine.reduce_vectors("truncation", 8)
    small = engine.tables.vectors.where("reduced")
    return small.select("memory_id", F.round(F.aggregate(F.col("vector").cast("array<double>"), F.lit(0.0), lambda s, x: s + x), 5).alias("total"), "dimensions")


from lorekeep.plans import store_queries  # noqa: E402, F401  (adds its queries to those above)
