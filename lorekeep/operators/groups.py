"""Collections, agents and contexts: membership joins and access."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def collection_memories(members: DataFrame, memories: DataFrame, collection: str) -> DataFrame:
    ids = members.where(F.col("collection_id") == collection).select(F.col("memory_id").alias("id"))
    return memories.join(ids, "id", "left_semi")


def collection_sizes(members: DataFrame) -> DataFrame:
    return members.groupBy("collection_id").agg(F.countDistinct("memory_id").alias("members"))


def agent_memories(grants: DataFrame, members: DataFrame, memories: DataFrame, agent: str) -> DataFrame:
    """Memories in any collection that an agent may read, each once."""
    allowed = grants.where(F.col("agent_id") == agent).select("collection_id").distinct()
    ids = members.join(allowed, "collection_id", "left_semi").select(F.col("memory_id").alias("id"))
    return memories.join(ids, "id", "left_semi")


def agent_collections(grants: DataFrame, collections: DataFrame, agent: str) -> DataFrame:
    ids = grants.where(F.col("agent_id") == agent).select(F.col("collection_id").alias("id"))
    return collections.join(ids, "id", "left_semi")


def agent_contexts(context_agents: DataFrame, contexts: DataFrame, agent: str) -> DataFrame:
    ids = context_agents.where(F.col("agent_id") == agent).select(F.col("context_id").alias("id"))
    return contexts.join(ids, "id", "left_semi")


def context_memories(context_members: DataFrame, memories: DataFrame, context: str) -> DataFrame:
    ids = context_members.where(F.col("context_id") == context).select(F.col("memory_id").alias("id"))
    return memories.join(ids, "id", "left_semi")


def agents_in_context(context_agents: DataFrame, agents: DataFrame, context: str) -> DataFrame:
    ids = context_agents.where(F.col("context_id") == context).select(F.col("agent_id").alias("id"))
    return agents.join(ids, "id", "left_semi")


def has_access(grants: DataFrame, agent: str, collection: str) -> bool:
    return not grants.where((F.col("agent_id") == agent) & (F.col("collection_id") == collection)).isEmpty()


def grant(grants: DataFrame, agent: str, collection: str) -> DataFrame:
    """The grants and one more; granting twice changes nothing."""
    one = grants.sparkSession.createDataFrame([(agent, collection)], "agent_id string, collection_id string")
    return grants.select("agent_id", "collection_id").unionByName(one).distinct()


def revoke(grants: DataFrame, agent: str, collection: str) -> DataFrame:
    return grants.where(~((F.col("agent_id") == agent) & (F.col("collection_id") == collection)))


def has_capability(agents: DataFrame, capability: str) -> DataFrame:
    return agents.where(F.array_contains("capabilities", capability))


def grant_counts(agents: DataFrame, grants: DataFrame) -> DataFrame:
    counted = grants.groupBy(F.col("agent_id").alias("id")).agg(F.countDistinct("collection_id").alias("collections"))
    return agents.select("id").join(counted, "id", "left").select("id", F.coalesce("collections", F.lit(0)).alias("collections"))


def context_sizes(contexts: DataFrame, members: DataFrame, context_agents: DataFrame) -> DataFrame:
    """id, memories, agents of each context."""
    m = members.groupBy(F.col("context_id").alias("id")).agg(F.countDistinct("memory_id").alias("memories"))
    a = context_agents.groupBy(F.col("context_id").alias("id")).agg(F.countDistinct("agent_id").alias("agents"))
    rows = contexts.select("id").join(m, "id", "left").join(a, "id", "left")
    return rows.select("id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("memories", "agents")])


def context_summary(members: DataFrame, memories: DataFrame) -> DataFrame:
    """For each context: memories, their mean confidence, and how many have which topic (a map)."""
    topic = F.coalesce(F.get_json_object("metadata", "$.topic"), F.lit("unknown"))
    rows = members.select("context_id", F.col("memory_id").alias("id")).distinct()
    rows = rows.join(memories.select("id", "confidence", topic.alias("topic")), "id")
    by_topic = rows.groupBy("context_id", "topic").agg(F.count(F.lit(1)).alias("n"), F.sum("confidence").alias("confidence"))
    return by_topic.groupBy("context_id").agg(
        F.sum("n").alias("memories"),
        (F.sum("confidence") / F.sum("n")).alias("mean_confidence"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("topic", "n")))).alias("topics"),
    )


def same_topic_links(memories: DataFrame, new_ids: DataFrame) -> DataFrame:
    """Links that a contribution gets: from each new memory to all older ones of its topic.

    ``new_ids``: first column the ids that join a context.
    """
    topic = F.get_json_object("metadata", "$.topic")
    all_ = memories.select(F.col("id"), topic.alias("topic")).where("topic is not null")
    new = all_.join(new_ids.select(F.col(new_ids.columns[0]).alias("id")), "id", "left_semi")
    old = all_.join(new.select("id"), "id", "left_anti").withColumnRenamed("id", "target_id")
    return new.withColumnRenamed("id", "source_id").join(old, "topic").select("source_id", "target_id", F.lit("related_to").alias("relationship_type"), "topic")
