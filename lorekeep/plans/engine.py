"""One object for all that can be asked of a memory graph. Every method returns DataFrames."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.errors import InvalidOperation
from lorekeep.operators import analytics, filters, forgetting, groups, hybrid, links, reduce, text_search, traverse, vectors
from lorekeep.plans.memory_query import MemoryQuery
from lorekeep.sources.catalog import CorpusCatalog, Tables
from lorekeep.sources.store import GraphStore, table_counts


class MemoryEngine:
    def __init__(self, tables: Tables, embedder: vectors.Embedder | None = None, store: GraphStore | None = None):
        self.tables, self.embedder, self.store = tables, embedder or vectors.HashEmbedder(), store

    @classmethod
    def over_corpus(cls, spark: SparkSession, folder: str) -> MemoryEngine:
        return cls(CorpusCatalog(spark, folder).tables())

    @classmethod
    def over_store(cls, spark: SparkSession, root: str) -> MemoryEngine:
        store = GraphStore(spark, root)
        return cls(store.tables(), store=store)

    def refresh(self) -> MemoryEngine:
        """The tables of the store's current version."""
        if self.store is None:
            raise InvalidOperation("there is no store to read again")
        self.tables = self.store.tables()
        return self

    def register_views(self, prefix: str = "") -> None:
        """All tables as temporary views for SQL."""
        for name, rows in self.tables.frames.items():
            rows.createOrReplaceTempView(prefix + name)

    # searches

    def query(self, query: MemoryQuery) -> DataFrame:
        return query.apply(self.tables.memories)

    def search_text(self, text: str, exact: bool = False, limit: int | None = None) -> DataFrame:
        return self.query(MemoryQuery(text=text, exact=exact, limit=limit))

    def search_source(self, source: str, limit: int | None = None) -> DataFrame:
        return self.query(MemoryQuery(source=source, limit=limit))

    def search_confidence(self, least: float, limit: int | None = None) -> DataFrame:
        return self.query(MemoryQuery(min_confidence=least, order="confidence", limit=limit))

    def search_metadata(self, key: str, value: str | None = None, limit: int | None = None) -> DataFrame:
        return self.query(MemoryQuery(key=key, value=value, limit=limit))

    def search_before(self, when, limit: int | None = None) -> DataFrame:
        return self.query(MemoryQuery(before=when, limit=limit))

    def search_after(self, when, limit: int | None = None) -> DataFrame:
        return self.query(MemoryQuery(after=when, limit=limit))

    def search_between(self, after, before, limit: int | None = None) -> DataFrame:
        return self.query(MemoryQuery(after=after, before=before, limit=limit))

    def search_period(self, year: int, month: int | None = None, day: int | None = None, limit: int | None = None) -> DataFrame:
        return self.query(MemoryQuery(year=year, month=month, day=day, limit=limit))

    def recent(self, k: int = 10) -> DataFrame:
        return filters.most_recent(self.tables.memories, k)

    def important(self, k: int = 10) -> DataFrame:
        return filters.most_important(self.tables.memories, k)

    def similar(self, k: int = 10, **query) -> DataFrame:
        return vectors.search(self.tables.vectors, k, embedder=self.embedder, **query)

    def hybrid(self, query: hybrid.HybridQuery) -> DataFrame:
        return hybrid.search(self.tables.memories, self.tables.vectors, query, self.tables.collection_members)

    def postings(self) -> DataFrame:
        return text_search.postings(self.tables.memories)

    def reduce_vectors(self, method: str, target: int, seed: int = 1) -> reduce.VectorReducer:
        """Fit a reducer on all stored original vectors, and store what it makes of them in one commit."""
        if self.store is None:
            raise InvalidOperation("only a store can keep reduced vectors")
        full = self.tables.vectors.where("NOT reduced")
        reducer = reduce.VectorReducer(method, target, seed).fit(full)
        self.store.put("vectors", reducer.transform(full))
        self.refresh()
        return reducer

    # the graph

    def relationships(self, node: str, direction: str = "both", kind: str | None = None) -> DataFrame:
        rows = {"out": links.outgoing, "in": links.incoming, "both": links.touching}[direction](self.tables.links, node)
        return links.strongest_first(rows if kind is None else links.by_type(rows, kind))

    def between(self, source: str, target: str) -> DataFrame:
        return links.between_nodes(self.tables.links, source, target, self.tables.memories)

    def paths(self, source: str, target: str, max_depth: int = 4) -> DataFrame:
        found = traverse.paths(self.tables.links, source, target, max_depth, self.tables.memories)
        return traverse.described_paths(found, self.tables.links)

    def connected(self, start: str, depth: int = 2, kind: str | None = None) -> tuple[DataFrame, DataFrame]:
        return traverse.connected(self.tables.links, self.tables.memories, start, depth, kind)

    def find_connections(self, start: str, **how) -> DataFrame:
        return traverse.find_connections(self.tables.links, start, **how)

    # groups

    def visible_to(self, agent: str) -> DataFrame:
        return groups.agent_memories(self.tables.agent_grants, self.tables.collection_members, self.tables.memories, agent)

    def in_context(self, context: str) -> DataFrame:
        return groups.context_memories(self.tables.context_members, self.tables.memories, context)

    def in_collection(self, collection: str) -> DataFrame:
        return groups.collection_memories(self.tables.collection_members, self.tables.memories, collection)

    def contribute(self, context: str, rows: DataFrame) -> Tables:
        """The tables with new memories in a context, each linked to the older ones of its topic."""
        t = self.tables
        ids = rows.select("id")
        grown = t.memories.unionByName(rows.select(*t.memories.columns))
        found = groups.same_topic_links(grown, ids)
        new = found.select(
            F.concat_ws("-", F.lit("auto"), "source_id", "target_id").alias("id"), "source_id", "target_id", "relationship_type", F.lit(0.5).alias("weight"),
            F.to_json(F.struct("topic")).alias("metadata"),
        )
        members = t.context_members.unionByName(ids.select(F.lit(context).alias("context_id"), F.col("id").alias("memory_id")))
        return t.replace(memories=grown, links=t.links.unionByName(new), context_members=members)

    # upkeep

    def stats(self) -> DataFrame:
        return table_counts(self.tables)

    def forget(self, policy: forgetting.Policy, now: dt.datetime, cascade: bool = True) -> int:
        """Delete what a policy forgets from the store, and say how many memories that are."""
        if self.store is None:
            raise InvalidOperation("only a store can forget")
        gone = forgetting.candidates(self.tables.memories, policy, now).select("id")
        n = gone.count()
        if n:
            self.store.batch().delete_memories(gone, cascade).commit()
            self.refresh()
        return n

    def verify(self) -> dict[str, DataFrame]:
        """What names something that does not exist."""
        t = self.tables
        return {
            "links": links.orphans(t.links, t.memories),
            "collections": links.member_orphans(t.collection_members, "collection_id", "memory_id", t.memories.select("id")),
            "context_memories": links.member_orphans(t.context_members, "context_id", "memory_id", t.memories.select("id")),
            "context_agents": links.member_orphans(t.context_agents, "context_id", "agent_id", t.agents.select("id")),
        }

    def clean_orphans(self) -> int:
        """Delete links with a missing end from the store, and say how many."""
        if self.store is None:
            raise InvalidOperation("only a store can be cleaned")
        gone = links.orphans(self.tables.links, self.tables.memories).select("id")
        n = gone.count()
        if n:
            self.store.delete("links", gone)
            self.refresh()
        return n

    def health(self, now: dt.datetime) -> DataFrame:
        return analytics.health_report(self.tables.memories, self.tables.links, now)

    def recommendations(self) -> DataFrame:
        return analytics.recommendations(self.tables.memories, self.tables.links)
