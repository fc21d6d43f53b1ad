"""Rates of record operations over a store: operations a second, hit rates, average results.

Operations go in batches, as a cluster runs them: a thousand lookups are one join, and the rate counts
each of them.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.operators import text_search, traverse
from lorekeep.session import shared_folder
from lorekeep.sources.catalog import CorpusCatalog
from lorekeep.sources.store import GraphStore

LOOKUPS, WALKS = 5_000, 500


def _timed(run: Callable[[], object]) -> tuple[float, object]:
    began = time.perf_counter()
    got = run()
    return max(1e-9, time.perf_counter() - began), got


def record_rates(spark: SparkSession, folder: str) -> dict[str, float]:
    """Rates of putting, finding, linking, searching and walking, over the memories of a folder.

    Every second id that is looked up exists.
    """
    c = CorpusCatalog(spark, folder)
    store = GraphStore(spark, f"{shared_folder(spark)}/lorekeep/rates/{uuid.uuid4().hex}")
    out: dict[str, float] = {}

    def note(name: str, seconds: float, n: int, **more: float) -> None:
        out[f"{name}_per_sec"] = round(n / seconds, 1)
        out.update({f"{name}_{k}": round(v, 4) for k, v in more.items()})

    took, _ = _timed(lambda: store.put("memories", c.memories))
    note("memory_put", took, rows := store.read("memories").count())
    took, _ = _timed(lambda: store.put("links", c.links))
    note("link_put", took, store.read("links").count())
    asked = spark.range(LOOKUPS).select(F.when(F.col("id") % 2 == 0, (F.col("id") % rows).cast("string")).otherwise(F.concat(F.lit("no"), "id")).alias("id"), F.col("id").alias("nth"))
    took, hits = _timed(lambda: asked.join(store.read("memories"), "id").count())
    note("memory_get", took, LOOKUPS, hit_rate=hits / LOOKUPS)
    ends = asked.select(F.col("id").alias("source_id"), "nth")
    took, hits = _timed(lambda: ends.join(store.read("links"), "source_id").agg(F.countDistinct("nth"), F.count(F.lit(1))).first())
    note("link_lookup", took, LOOKUPS, hit_rate=hits[0] / LOOKUPS, average_results=hits[1] / LOOKUPS)
    store.build_index()
    index = store.read("postings")
    words = index.select("stem").distinct().orderBy(F.xxhash64("stem")).limit(1000)
    took, found = _timed(lambda: index.join(F.broadcast(words), "stem").select("stem", "memory_id").distinct().count())
    note("text_search", took, words.count(), average_results=found / max(1, words.count()))
    took, found = _timed(lambda: text_search.search_any(store.read("memories"), "the").count())
    note("text_scan", took, rows, results=found)
    seeds: DataFrame = c.memories.orderBy(F.xxhash64("id")).limit(WALKS).select("id")
    took, near = _timed(lambda: traverse.k_hop_nodes(store.read("links"), seeds, 2).count())
    note("walk", took, WALKS, average_nodes=near / WALKS)
    return out
