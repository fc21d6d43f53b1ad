"""Forgetting: which memories may go, and what is left when they do."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.functions.columns import clamp_unit, instant, seconds_between, shift_seconds

DAY = 86_400
When = dt.datetime | str | Column


@dataclass(frozen=True)
class Policy:
    """kind: age, importance, access, hybrid or ttl; the bounds that its kind uses; at most ``limit`` rows."""

    kind: str
    max_age_seconds: int | None = None
    max_importance: float | None = None
    max_access_count: int | None = None
    min_idle_seconds: int | None = None
    limit: int | None = None


def age_policy(days: float, limit: int | None = None) -> Policy:
    return Policy("age", max_age_seconds=int(days * DAY), limit=limit)


def importance_policy(most: float, limit: int | None = None) -> Policy:
    return Policy("importance", max_importance=most, limit=limit)


def access_policy(most: int, idle_days: float, limit: int | None = None) -> Policy:
    return Policy("access", max_access_count=most, min_idle_seconds=int(idle_days * DAY), limit=limit)


def hybrid_policy(importance: float, count: int, idle_days: float, limit: int | None = None) -> Policy:
    return Policy("hybrid", max_importance=importance, max_access_count=count, min_idle_seconds=int(idle_days * DAY), limit=limit)


def ttl_policy(limit: int | None = None) -> Policy:
    return Policy("ttl", limit=limit)


def candidates(memories: DataFrame, policy: Policy, now: When) -> DataFrame:
    """Memories that a policy forgets, first those that it forgets first; ties by id."""
    now = instant(now)
    idle = F.col("last_accessed") < shift_seconds(now, -(policy.min_idle_seconds or 0))
    unimportant = F.col("importance") <= F.lit(policy.max_importance)
    unused = F.col("access_count") <= F.lit(policy.max_access_count)
    if policy.kind == "age":
        rows, order = memories.where(F.col("timestamp") < shift_seconds(now, -policy.max_age_seconds)), F.col("timestamp")
    elif policy.kind == "importance":
        rows, order = memories.where(unimportant), F.col("importance")
    elif policy.kind == "access":
        rows, order = memories.where(unused & idle), F.col("access_count")
    elif policy.kind == "hybrid":
        rows, order = memories.where(unimportant & unused & idle), F.col("importance")
    elif policy.kind == "ttl":
        left = F.col("ttl") - seconds_between(F.col("last_accessed"), now)
        rows, order = memories.where(left < 0), left
    else:
        raise ValueError(f"unknown policy {policy.kind}")
    rows = rows.orderBy(order, "id")
    return rows if policy.limit is None else rows.limit(policy.limit)


def forget(memories: DataFrame, policy: Policy | None, now: When) -> DataFrame:
    """The memories that stay; all of them without a policy."""
    if policy is None:
        return memories
    return memories.join(candidates(memories, policy, now).select("id"), "id", "left_anti")


def forget_with_links(memories: DataFrame, links: DataFrame, policy: Policy | None, now: When) -> tuple[DataFrame, DataFrame]:
    """The memories that stay, and the links that don't touch a forgotten one."""
    if policy is None:
        return memories, links
    gone = candidates(memories, policy, now).select("id")
    return memories.join(gone, "id", "left_anti"), without_touching(links, gone)


def without_touching(links: DataFrame, gone: DataFrame) -> DataFrame:
    """Links no end of which is in ``gone`` (first column: ids)."""
    ids = gone.select(F.col(gone.columns[0]).alias("id"))
    rows = links
    for end in ("source_id", "target_id"):
        rows = rows.join(ids.withColumnRenamed("id", end), end, "left_anti")
    return rows.select(*links.columns)


def record_accesses(memories: DataFrame, accesses: DataFrame) -> DataFrame:
    """Memories with the accesses (memory_id, accessed_at) of a log added to count and last time."""
    seen = accesses.groupBy(F.col("memory_id").alias("id")).agg(F.count(F.lit(1)).alias("_n"), F.max("accessed_at").alias("_last"))
    rows = memories.join(seen, "id", "left")
    return rows.withColumns({"access_count": F.col("access_count") + F.coalesce("_n", F.lit(0)), "last_accessed": F.greatest("last_accessed", "_last")}).select(*memories.columns)


def set_importance(memories: DataFrame, values: DataFrame) -> DataFrame:
    """Memories with the importance of ``values`` (id, importance), clamped to [0, 1]."""
    new = values.select("id", clamp_unit(F.col("importance")).alias("_new"))
    return memories.join(new, "id", "left").withColumn("importance", F.coalesce("_new", "importance")).select(*memories.columns)


def set_ttl(memories: DataFrame, values: DataFrame) -> DataFrame:
    """Memories with the time to live of ``values`` (id, ttl in seconds; null clears it)."""
    new = values.select("id", F.col("ttl").alias("_new"), F.lit(True).alias("_set"))
    rows = memories.join(new, "id", "left")
    return rows.withColumn("ttl", F.when(F.col("_set"), F.col("_new")).otherwise(F.col("ttl"))).select(*memories.columns)


def access_history(log: DataFrame) -> DataFrame:
    """The log (memory_id, accessed_at) with running figures: nth, first_access, since (seconds since the one before).

    Accesses of a memory at the same time are told apart by nothing, so each has its own nth, in any order. Rows without an id or a
    time are left out.
    """
    order = Window.partitionBy("memory_id").orderBy("accessed_at")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = log.where("memory_id IS NOT NULL AND accessed_at IS NOT NULL").select("memory_id", "accessed_at")
    since = seconds_between(F.lag("accessed_at").over(order), F.col("accessed_at"))
    return rows.select("memory_id", "accessed_at", F.count(F.lit(1)).over(so_far).alias("nth"), F.min("accessed_at").over(so_far).alias("first_access"), since.alias("since"))


def accesses_as_of(memories: DataFrame, log: DataFrame, times: DataFrame) -> DataFrame:
    """id, at, access_count, last_accessed: what was known of each memory at each of ``times`` (at), which are few.

    Counts begin with those that a memory has, and last_accessed with its own. Each access falls to the first of the
    times that is not before it, so the log is summed up once, by memory and time, and the sums run over the
    times; an access at the very time counts. Memories without accesses have a row for each time too.
    """
    marks = times.select("at").where("at IS NOT NULL").distinct()
    spans = F.broadcast(marks.withColumn("after", F.lag("at").over(Window.orderBy("at"))))  # the given times
    due = (F.col("accessed_at") <= F.col("at")) & (F.col("after").isNull() | (F.col("accessed_at") > F.col("after")))
    counted = log.where("memory_id IS NOT NULL").join(spans, due).groupBy(F.col("memory_id").alias("id"), "at").agg(F.count(F.lit(1)).alias("n"), F.max("accessed_at").alias("latest"))
    rows = memories.select("id", "access_count", "last_accessed").crossJoin(F.broadcast(marks)).join(counted, ["id", "at"], "left")
    so_far = Window.partitionBy("id").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    count = F.col("access_count") + F.sum(F.coalesce("n", F.lit(0))).over(so_far)
    return rows.select("id", "at", count.alias("access_count"), F.greatest("last_accessed", F.max("latest").over(so_far)).alias("last_accessed"))
