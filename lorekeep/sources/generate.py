"""Generated graphs: a small demonstration project, and a synthetic graph of any size."""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.sources.catalog import Tables, from_rows

_START = dt.datetime(2024, 2, 1, 9)
_AREAS = ("requirements", "design", "implementation", "tests", "documentation")
_SAID = {
    "requirements": ["Uploads must resume after a lost connection", "Reports open within two seconds", "Every change is kept for a year", "Guests see published pages only", "Names may hold any script"],
    "design": ["Uploads are cut into chunks with a checksum", "A read model serves the reports", "Changes go to an append-only log", "Rights are checked at the gateway"],
    "implementation": ["Chunk writer with retries", "Report cache with expiry", "Log compactor", "Gateway filter for guests", "Snippet: retry(3, send, chunk)"],
    "tests": ["Upload survives a cut line", "Report stays under two seconds", "Compaction keeps the last state", "Guest gets 403 on drafts", "Issue: retry test is flaky"],
    "documentation": ["Guide to resumable uploads", "How reports are cached", "Who may see what", "Glossary"],
    "discussion": ["Should chunks be larger on fast lines?", "Cache expiry of a minute seems enough", "Compaction at night only", "Guests asked for a search box"],
}
_TYPES = ("implements", "satisfies", "tests", "documents", "discusses", "depends_on", "refines", "blocks", "relates_to")


def demo(spark: SparkSession) -> Tables:
    """27 memories of a project, 25 links of 9 types, 5 collections, 4 agents and a context."""
    memories, of = [], {}
    for area, said in _SAID.items():
        for i, text in enumerate(said):
            key = f"{area[:3]}{i}"
            of.setdefault(area, []).append(key)
            at = _START + dt.timedelta(hours=len(memories))
            meta = json.dumps({"type": area, "priority": "high" if i == 0 else "normal", "component": ("upload", "report", "log", "access", "other")[i], "status": "open" if i % 2 else "done"})
            memories.append((key, text, area if area != "discussion" else "team", 0.7 + 0.05 * (i % 5), 0.5, 0, at, at, None, meta))
    links = []

    def link(a: str, b: str, kind: str) -> None:
        links.append((f"l{len(links)}", a, b, kind, 0.5 + 0.1 * (len(links) % 5), None))

    for i in range(4):
        link(of["design"][i], of["requirements"][i], "satisfies")
        link(of["implementation"][i], of["design"][i], "implements")
        link(of["tests"][i], of["implementation"][i], "tests")
        link(of["discussion"][i], of["design"][i], "discusses")
    for i in range(3):
        link(of["documentation"][i], of["implementation"][i], "documents")
    link(of["implementation"][4], of["implementation"][0], "refines")
    link(of["tests"][4], of["tests"][0], "blocks")
    link(of["design"][1], of["design"][2], "depends_on")
    link(of["design"][3], of["design"][2], "depends_on")
    link(of["requirements"][4], of["documentation"][3], "relates_to")
    link(of["documentation"][3], of["requirements"][4], "relates_to")
    agents = [("analyst", ("requirements", "documentation")), ("architect", ("requirements", "design")), ("developer", ("design", "implementation", "tests")), ("tester", ("implementation", "tests"))]
    return from_rows(
        spark,
        memories=memories,
        links=links,
        collections=[(a, a.title(), f"All about {a}", None) for a in _AREAS],
        collection_members=[(a, m) for a in _AREAS for m in of[a]],
        agents=[(name, name.title(), "", ["read", "write"] if name != "tester" else ["read"], None) for name, _ in agents],
        agent_grants=[(name, c) for name, cs in agents for c in cs],
        contexts=[("project", "Project", "Shared by all", None)],
        context_members=[("project", m) for area in _SAID for m in of[area]],
        context_agents=[("project", name) for name, _ in agents],
    )


SOURCES = ("notebook", "interview", "sensor", "archive")
LINK_TYPES = ("precedes", "explains", "doubts", "quotes", "narrows")


def _uniform(salt: int, *columns: str) -> Column:
    """In [0, 1), the same for the same row."""
    return F.pmod(F.xxhash64(F.lit(salt), *columns), F.lit(1_000_003)) / 1_000_003


def _one_of(values: tuple[str, ...], salt: int, *columns: str) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.floor(_uniform(salt, *columns) * len(values)) + 1).cast("int"))


def synthetic(spark: SparkSession, memories: int, links_each: int = 2, topics: int = 12, seed: int = 1) -> Tables:
    """A deterministic graph of any size, made in parallel from row numbers."""
    rows = spark.range(memories)
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    topic = F.concat(F.lit("topic"), F.floor(_uniform(seed, "id") * topics).cast("string"))
    at = F.timestamp_add("SECOND", F.floor(_uniform(seed + 1, "id") * 30 * 86400).cast("bigint"), start).cast("timestamp_ntz")
    made = rows.select(
        F.col("id").alias("n"), F.concat(F.lit("m"), "id").alias("id"), F.concat(F.lit("Fact "), "id", F.lit(" about "), topic).alias("content"),
        _one_of(SOURCES, seed + 2, "id").alias("source"), (0.7 + 0.3 * _uniform(seed + 3, "id")).alias("confidence"), F.lit(0.5).alias("importance"),
        F.lit(0).cast("bigint").alias("access_count"), at.alias("timestamp"), at.alias("last_accessed"), F.lit(None).cast("bigint").alias("ttl"),
        F.to_json(F.struct(topic.alias("topic"), F.array(topic, F.lit("fact")).alias("keywords"))).alias("metadata"), topic.alias("topic"),
    )
    k = F.explode(F.sequence(F.lit(0), F.lit(links_each - 1))).alias("k")
    ends = made.select("n", "id", k).withColumn("to", F.floor(_uniform(seed + 4, "n", "k") * memories).cast("bigint")).where("to <> n")
    links = ends.select(
        F.concat(F.lit("l"), F.col("n") * links_each + F.col("k")).alias("id"), F.col("id").alias("source_id"), F.concat(F.lit("m"), "to").alias("target_id"),
        _one_of(LINK_TYPES, seed + 5, "n", "k").alias("relationship_type"), (0.1 + 0.9 * _uniform(seed + 6, "n", "k")).alias("weight"), F.lit(None).cast("string").alias("metadata"),
    )
    groups = made.select(F.col("topic").alias("collection_id"), F.col("id").alias("memory_id"))
    sure = made.where("confidence > 0.9").select(F.lit("high_confidence").alias("collection_id"), F.col("id").alias("memory_id"))
    by_source = made.select(F.concat(F.lit("from_"), "source").alias("collection_id"), F.col("id").alias("memory_id"))
    members = groups.unionByName(sure).unionByName(by_source)
    collections = members.select(F.col("collection_id").alias("id")).distinct().select("id", F.col("id").alias("name"), F.lit("").alias("description"), F.lit(None).cast("string").alias("metadata"))
    contexts = made.select(F.col("topic").alias("id")).distinct().select("id", F.concat(F.lit("About "), "id").alias("name"), F.lit("").alias("description"), F.lit(None).cast("string").alias("metadata"))
    names = ("researcher", "reviewer", "curator")
    agents = spark.createDataFrame([(r, r.title(), "", ["read"], None) for r in names], "id string, name string, description string, capabilities array<string>, metadata string")
    each = F.explode(F.array(*map(F.lit, names))).alias("agent_id")
    grants = collections.select(each, F.col("id").alias("collection_id")).where(F.pmod(F.xxhash64("agent_id", "collection_id"), F.lit(2)) == 0)
    return from_rows(spark).replace(
        memories=made.drop("n", "topic"), links=links, collections=collections, collection_members=members, agents=agents, agent_grants=grants, contexts=contexts,
        context_members=made.select(F.col("topic").alias("context_id"), F.col("id").alias("memory_id")),
        context_agents=contexts.select(F.col("id").alias("context_id"), each),
    )


def group_memories(memories: DataFrame, by: Column) -> DataFrame:
    """collection_id, memory_ids for any expression."""
    return memories.select(by.alias("collection_id"), "id").groupBy("collection_id").agg(F.sort_array(F.collect_set("id")).alias("memory_ids"))
