"""Paths and neighbourhoods, as loops of joins over the frontier.

Every step joins the links with the frontier only, and what has been visited never comes back. Loops of
more than a few steps write the frontier to the shared folder, which cuts the lineage.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.operators.links import require
from lorekeep.session import materialize

#: After so many steps the frontier is written.
CUT = 4


def _pairs(links: DataFrame) -> DataFrame:
    return links.select("source_id", "target_id").distinct()


def half_paths(steps: DataFrame, start: str, avoid: str, depth: int, back: bool = False) -> list[DataFrame]:
    """(path, end) of all simple paths of 0, 1, ... ``depth`` steps from a node, or into it; none goes on from ``avoid``."""
    near, far = ("target_id", "source_id") if back else ("source_id", "target_id")
    steps = steps.where(F.col(far) != start)
    fronts = [steps.sparkSession.range(1).select(F.array(F.lit(start)).alias("path"), F.lit(start).alias("end"))]
    for d in range(1, depth + 1):
        here = fronts[-1].where(F.col("end") != avoid).withColumnRenamed("end", near).join(steps, near).where(~F.array_contains("path", F.col(far)))
        grown = F.concat(F.array(far), "path") if back else F.concat("path", F.array(far))
        front = here.select(grown.alias("path"), F.col(far).alias("end"))
        fronts.append(materialize(front, "frontier") if d % CUT == 0 or d == depth else front)
    return fronts


def paths(links: DataFrame, source: str, target: str, max_depth: int, memories: DataFrame | None = None) -> DataFrame:
    """Every directed path of at most ``max_depth`` links that visits no node twice: path (array), length.

    Half paths grow from both ends and meet in the node in the middle, so the frontiers are those of half the depth. Parallel
    links are one step, a path ends when it reaches the target, and a node reaches itself by
    the path of itself alone. With ``memories`` both ends must exist.
    """
    if memories is not None:
        require(memories, source, target)
    spark = links.sparkSession
    start = spark.range(1).select(F.array(F.lit(source)).alias("path"), F.lit(0).alias("length"))
    if source == target:
        return start
    if max_depth < 1:
        return start.where("false")
    steps = _pairs(links)
    ahead = half_paths(steps, source, target, (max_depth + 1) // 2)
    back = half_paths(steps, target, source, max_depth // 2, back=True)
    found = []
    for length in range(1, max_depth + 1):
        here, there = ahead[(length + 1) // 2], back[length // 2].select(F.col("path").alias("rest"), "end")
        apart = F.size(F.array_intersect("path", "rest")) == 1  # the node where they meet
        found.append(here.join(there, "end").where(apart).select(F.concat("path", F.slice("rest", F.lit(2), F.size("rest"))).alias("path"), F.lit(length).alias("length")))
    return reduce(DataFrame.unionByName, found)


def path_links(found: DataFrame, links: DataFrame) -> DataFrame:
    """Links, parallel ones included, on any step of the paths; each once."""
    pairs = F.arrays_zip(F.slice("path", F.lit(1), F.size("path") - 1).alias("source_id"), F.slice("path", F.lit(2), F.size("path") - 1).alias("target_id"))
    steps = found.where("length > 0").select(F.explode(pairs).alias("p")).select("p.source_id", "p.target_id").distinct()
    return links.join(steps, ["source_id", "target_id"], "left_semi")


def described_paths(found: DataFrame, links: DataFrame) -> DataFrame:
    """path, length, total_weight and its links in order, parallel ones included."""
    steps = found.select("path", "length", F.posexplode(F.slice("path", F.lit(1), F.greatest(F.size("path") - 1, F.lit(0)))).alias("at", "source_id"))
    steps = steps.withColumn("target_id", F.element_at("path", F.col("at") + 2))
    met = steps.join(links.select("source_id", "target_id", "id", "weight"), ["source_id", "target_id"])
    return met.groupBy("path", "length").agg(
        F.sum("weight").alias("total_weight"), F.transform(F.sort_array(F.collect_list(F.struct("at", "id"))), lambda x: x["id"]).alias("links")
    )


def k_hop_nodes(links: DataFrame, seeds: DataFrame, depth: int, kind: str | None = None) -> DataFrame:
    """(seed, id, hop): all nodes within ``depth`` links of each seed (first column), and how near.

    All seeds go in one job. The result doesn't depend on the order of links.
    """
    steps = _pairs(links if kind is None else links.where(F.col("relationship_type") == kind))
    seed = F.col(seeds.columns[0])
    seen = seeds.select(seed.alias("seed"), seed.alias("id"), F.lit(0).alias("hop")).distinct()
    front = seen
    for hop in range(1, depth + 1):
        reached = front.join(steps, F.col("id") == F.col("source_id")).select("seed", F.col("target_id").alias("id")).distinct()
        front = reached.join(seen, ["seed", "id"], "left_anti").withColumn("hop", F.lit(hop))
        if hop % CUT == 0:
            front, seen = materialize(front, "frontier"), materialize(seen, "seen")
        seen = seen.unionByName(front)
    return seen


def k_hop_links(links: DataFrame, seeds: DataFrame, depth: int, kind: str | None = None) -> DataFrame:
    """Links that leave a node nearer than ``depth``, each once."""
    use = links if kind is None else links.where(F.col("relationship_type") == kind)
    if depth < 1:
        return use.where("false")
    inner = k_hop_nodes(links, seeds, depth - 1, kind).select(F.col("id").alias("source_id")).distinct()
    return use.join(inner, "source_id", "left_semi").select(*links.columns)


def connected(links: DataFrame, memories: DataFrame, start: str, depth: int, kind: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Memories within reach of one, itself included, and the links on the way."""
    require(memories, start)
    seeds = links.sparkSession.range(1).select(F.lit(start).alias("seed"))
    ids = k_hop_nodes(links, seeds, depth, kind).select("id").distinct()
    return memories.join(ids, "id", "left_semi"), k_hop_links(links, seeds, depth, kind)


def shortest_path(links: DataFrame, source: str, target: str, max_depth: int) -> DataFrame:
    """One path of the fewest links, the first in order of its node ids; no row if there is none."""
    spark = links.sparkSession
    front = spark.range(1).select(F.lit(source).alias("id"), F.array(F.lit(source)).alias("path"))
    if source == target:
        return front.select("path", F.lit(0).alias("length"))
    steps, seen, found = _pairs(links), front.select("id"), []
    for depth in range(1, max_depth + 1):
        grown = front.join(steps, F.col("id") == F.col("source_id")).select(F.col("target_id").alias("id"), F.concat("path", F.array("target_id")).alias("path"))
        front = grown.join(seen, "id", "left_anti").groupBy("id").agg(F.min("path").alias("path"))
        if depth % CUT == 0:
            front, seen = materialize(front, "frontier"), materialize(seen, "seen")
        seen = seen.unionByName(front.select("id"))
        found.append(front.where(F.col("id") == target).select("path", F.lit(depth).alias("length")))
    return reduce(DataFrame.unionByName, found).orderBy("length").limit(1) if found else front.select("path", F.lit(0).alias("length")).where("false")


def find_connections(links: DataFrame, start: str, direction: str = "out", kinds: list[str] | None = None, max_depth: int = 1, limit: int | None = None) -> DataFrame:
    """Links around a node in a direction (out, in or both), of some types, within a depth."""
    use = links if not kinds else links.where(F.col("relationship_type").isin(*kinds))
    turned = use.withColumns({"source_id": F.col("target_id"), "target_id": F.col("source_id")})
    walk = {"out": use, "in": turned, "both": use.unionByName(turned)}[direction]
    seeds = links.sparkSession.range(1).select(F.lit(start).alias("seed"))
    found = k_hop_links(walk.select(*links.columns), seeds, max_depth).select("id").distinct()
    rows = use.join(found, "id", "left_semi").orderBy(F.desc("weight"), "id")
    return rows if limit is None else rows.limit(limit)
