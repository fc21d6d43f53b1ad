"""Link lookup, joins of links with memories, and degrees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.errors import NotFound


def outgoing(links: DataFrame, node: str) -> DataFrame:
    return links.where(F.col("source_id") == node)


def incoming(links: DataFrame, node: str) -> DataFrame:
    return links.where(F.col("target_id") == node)


def touching(links: DataFrame, node: str) -> DataFrame:
    """Outgoing and incoming links; a link to itself once."""
    return links.where((F.col("source_id") == node) | (F.col("target_id") == node))


def by_type(links: DataFrame, kind: str, source: str | None = None, target: str | None = None) -> DataFrame:
    rows = links.where(F.col("relationship_type") == kind)
    if source is not None:
        rows = outgoing(rows, source)
    return rows if target is None else incoming(rows, target)


def strongest_first(links: DataFrame) -> DataFrame:
    return links.orderBy(F.desc("weight"), "id")


def require(memories: DataFrame, *ids: str) -> None:
    """Raise NotFound unless every id is a memory."""
    found = {r["id"] for r in memories.where(F.col("id").isin(*ids)).select("id").distinct().collect()}
    if missing := sorted(set(ids) - found):
        raise NotFound(f"no memory {', '.join(missing)}")


def between_nodes(links: DataFrame, source: str, target: str, memories: DataFrame | None = None) -> DataFrame:
    """Links from ``source`` to ``target``; with ``memories`` both must exist."""
    if memories is not None:
        require(memories, source, target)
    return outgoing(incoming(links, target), source)


def neighbors(links: DataFrame, node: str, direction: str = "out") -> DataFrame:
    """Distinct ids that a node points to (out) or that point to it (in)."""
    if direction == "out":
        return outgoing(links, node).select(F.col("target_id").alias("id")).distinct()
    return incoming(links, node).select(F.col("source_id").alias("id")).distinct()


def with_content(links: DataFrame, memories: DataFrame) -> DataFrame:
    """Links with the content of either end; an unknown end shows its id."""
    rows = links
    for end in ("source", "target"):
        ends = memories.select(F.col("id").alias(f"{end}_id"), F.col("content").alias(f"{end}_content"))
        rows = rows.join(ends, f"{end}_id", "left")
        unknown = F.concat(F.lit("Unknown (ID: "), F.col(f"{end}_id"), F.lit(")"))
        rows = rows.withColumn(f"{end}_content", F.coalesce(f"{end}_content", unknown))
    return rows


def attached(links: DataFrame, memories: DataFrame) -> DataFrame:
    """Links both ends of which are memories."""
    ids = memories.select("id")
    rows = links
    for end in ("source_id", "target_id"):
        rows = rows.join(ids.withColumnRenamed("id", end), end, "left_semi")
    return rows.select(*links.columns)


def orphans(links: DataFrame, memories: DataFrame) -> DataFrame:
    """Links with a missing end, and which ends exist."""
    rows = links
    for end in ("source", "target"):
        ids = memories.select(F.col("id").alias(f"{end}_id"), F.lit(True).alias(f"{end}_exists")).distinct()
        rows = rows.join(ids, f"{end}_id", "left").withColumn(f"{end}_exists", F.coalesce(f"{end}_exists", F.lit(False)))
    return rows.where("NOT (source_exists AND target_exists)").select(*links.columns, "source_exists", "target_exists")


def member_orphans(bridge: DataFrame, group: str, member: str, existing: DataFrame) -> DataFrame:
    """For each group, how many members don't exist (first column of ``existing``: ids)."""
    ids = existing.select(F.col(existing.columns[0]).alias(member))
    return bridge.dropDuplicates([group, member]).join(ids, member, "left_anti").groupBy(group).agg(F.count(F.lit(1)).alias("missing"))


def type_counts(links: DataFrame) -> DataFrame:
    return links.groupBy("relationship_type").agg(F.count(F.lit(1)).alias("links"))


def degrees(links: DataFrame) -> DataFrame:
    """id, in_degree, out_degree, degree of every node that a link names; one shuffle, combined before."""
    ends = F.explode(
        F.array(
            F.struct(F.col("source_id").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")),
            F.struct(F.col("target_id").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")),
        )
    )
    rows = links.select(ends.alias("e")).groupBy("e.id").agg(F.sum("e.i").alias("in_degree"), F.sum("e.o").alias("out_degree"))
    return rows.withColumn("degree", F.col("in_degree") + F.col("out_degree"))


def centrality_importance(memories: DataFrame, links: DataFrame, damped: bool = False) -> DataFrame:
    """id and importance from the number of links c: min(1, 1 + ln(c) / 5), and 0.2 without links.

    The formula is 1 for any c of 1 or more; ``damped`` takes min(1, (1 + ln(c)) / 5) instead.
    """
    c = F.coalesce(F.col("degree"), F.lit(0))
    grown = F.greatest(F.log(F.greatest(c, F.lit(1)).cast("double")), F.lit(0.0))
    value = (1 + grown) / 5 if damped else 1 + grown / 5
    rows = memories.select("id").join(degrees(links).select("id", "degree"), "id", "left")
    return rows.select("id", F.when(c > 0, F.least(F.lit(1.0), value)).otherwise(0.2).alias("importance"))


def graph_edges(links: DataFrame, collection_members: DataFrame, agent_grants: DataFrame, context_members: DataFrame, context_agents: DataFrame) -> DataFrame:
    """All edges of the graph of records as src_kind, src, edge_kind, dst_kind, dst; memberships once."""

    def edge(rows: DataFrame, src_kind: str, src: str, kind, dst_kind: str, dst: str) -> DataFrame:
        return rows.select(F.lit(src_kind).alias("src_kind"), F.col(src).alias("src"), kind.alias("edge_kind"), F.lit(dst_kind).alias("dst_kind"), F.col(dst).alias("dst"))

    out = edge(links, "memory", "source_id", F.col("relationship_type"), "memory", "target_id")
    for rows, src_kind, src, kind, dst_kind, dst in (
        (collection_members, "collection", "collection_id", "contains", "memory", "memory_id"),
        (agent_grants, "agent", "agent_id", "has_access", "collection", "collection_id"),
        (context_members, "context", "context_id", "contains", "memory", "memory_id"),
        (context_agents, "agent", "agent_id", "participates", "context", "context_id"),
    ):
        out = out.unionByName(edge(rows.dropDuplicates([src, dst]), src_kind, src, F.lit(kind), dst_kind, dst))
    return out
