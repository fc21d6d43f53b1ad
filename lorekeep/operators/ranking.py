"""Ranked text search: BM25 over postings that lie in order of their impact.

A posting of a stem in a memory has its term frequency and the memory's length; what it adds to a score, but
for the rarity of the stem, is its impact. Impacts are cut into bands. A search for the best k reads the highest
bands first and stops when what was read bounds all the rest: no memory that is still unseen, and none seen in part that lies
below, can reach the k-th score. Then only the memories that still can are scored whole. With files that are sorted by
stem and band, each step reads the row groups of some stems and bands.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.functions.text import MIN_BYTES, SEPARATOR, stem
from lorekeep.operators.text_search import query_stems
from lorekeep.session import discard, materialize

#: Bands of impacts, and the bands down to which a search reads, step by step.
BANDS = 32
STEPS = (24, 20, 16, 12, 8, 4, 0)
#: Scores are rounded to so many places, so that ties are ties on every machine.
PLACES = 6
#: Memories that are scored whole by broadcast of their ids; more go by a shuffle.
MOST_NEAR = 100_000


@dataclass(frozen=True)
class Bm25:
    """How strongly further occurrences count (k1) and how much long memories are held back (b)."""

    k1: float = 1.2
    b: float = 0.75


class RankedIndex:
    """Postings with impacts, and what a score needs to know of the corpus.

    ``postings`` has stem, memory_id, tf, length, impact, band; ``memories`` and ``mean_length`` are those of the memories with a
    token. Memories without one, with null or empty content, are in no posting and match nothing.
    """

    def __init__(self, postings: DataFrame, memories: int, mean_length: float, formula: Bm25):
        self.postings, self.memories, self.mean_length, self.formula = postings, memories, mean_length, formula
        #: Postings that the last search read.
        self.read = 0

    @staticmethod
    def build(memories: DataFrame, formula: Bm25 | None = None) -> RankedIndex:
        """Count stems and lengths row by row; written in ranges of stem and band, which is the one shuffle of postings."""
        formula = formula or Bm25()
        said = materialize(_counted(memories), "said", codec="zstd")
        r = said.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean")).first()
        n, mean = r["n"], r["mean"] or 1.0
        rows = said.select("memory_id", "length", F.inline("counts")).withColumn("impact", _impact(formula, mean)).select("stem", "memory_id", "tf", "length", "impact")
        # impacts lie between 0 and k1 + 1
        band = F.least(F.lit(BANDS - 1), F.floor(F.col("impact") / (formula.k1 + 1) * BANDS)).cast("int")
        rows = rows.withColumn("band", band).repartitionByRange("stem", "band").sortWithinPartitions("stem", F.desc("band"), "memory_id")
        index = RankedIndex(materialize(rows, "impacts", free_shuffles=True, codec="zstd"), n, mean, formula)
        discard(said)
        return index

    def rarity(self, wanted: list[str]) -> dict[str, float]:
        """The weight of each stem that some memory has; one row a stem of the query."""
        return _rarity(self.postings.where(F.col("stem").isin(wanted)), self.memories) if wanted else {}

    def scores(self, query: str) -> DataFrame:
        """memory_id, score of every memory that has a stem of the query."""
        return self._summed(self._weighted(self.rarity(query_stems(query))))

    def search(self, query: str, k: int = 10) -> DataFrame:
        """memory_id, score, rank of the best ``k`` memories, ties by id; reads bands from the top until they suffice."""
        weight = self.rarity(query_stems(query))
        rows, self.read = self._weighted(weight), 0
        near = None
        for lowest in STEPS if weight else ():
            some = rows.where(F.col("band") >= lowest)
            known = materialize(some.groupBy("memory_id").agg(F.sum("adds").alias("score"), F.collect_set("stem").alias("seen"), F.count(F.lit(1)).alias("postings")), "known")
            self.read = known.agg(F.sum("postings")).first()[0] or 0
            if lowest == 0:
                break
            top = known.orderBy(F.desc("score"), "memory_id").limit(k).agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n")).first()
            below = lowest / BANDS * (self.formula.k1 + 1)  # what is not read yet has less impact
            rest = {s: w * below for s, w in weight.items()}
            slack = 10.0**-PLACES
            if top["n"] == k and top["least"] > sum(rest.values()) + slack:
                # of those seen, who can still reach the k-th score
                missing = sum((F.when(F.array_contains("seen", s), 0.0).otherwise(x) for s, x in rest.items()), F.lit(0.0))
                near = materialize(known.where(F.col("score") + missing >= top["least"] - slack).select("memory_id"), "near")
                break
        if near is not None:
            n = near.count()
            left = rows.join(F.broadcast(near) if n <= MOST_NEAR else near, "memory_id", "left_semi")
            self.read += left.where(F.col("band") < lowest).count()
            rows = left
        best = self._summed(rows).orderBy(F.desc("score"), "memory_id").limit(k)
        ranked = best.agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("low"), "memory_id"))).alias("r"))  # k rows
        return ranked.select(F.posexplode("r").alias("at", "x")).select("x.memory_id", (-F.col("x.low")).alias("score"), (F.col("at") + 1).alias("rank"))

    def _weighted(self, weight: dict[str, float]) -> DataFrame:
        return _weighted(self.postings, weight)

    @staticmethod
    def _summed(rows: DataFrame) -> DataFrame:
        return rows.groupBy("memory_id").agg(F.round(F.sum("adds"), PLACES).alias("score"))


def scan_scores(memories: DataFrame, query: str, formula: Bm25 | None = None) -> DataFrame:
    """memory_id, score as by :meth:`RankedIndex.scores`, from one reading of the texts that keeps the query's postings only."""
    formula = formula or Bm25()
    wanted = query_stems(query)
    said = materialize(_counted(memories, wanted), "said", codec="zstd")
    r = said.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean")).first()
    postings = said.select("memory_id", "length", F.inline("counts")).withColumn("impact", _impact(formula, r["mean"] or 1.0))
    return RankedIndex._summed(_weighted(postings, _rarity(postings, r["n"]) if wanted else {}))


def _counted(memories: DataFrame, wanted: list[str] | None = None) -> DataFrame:
    """memory_id, length (tokens), counts (stem, tf; of the stems ``wanted``, or all) of the memories with a token.

    Rows that share an id are one memory.
    """
    words = F.filter(F.split(F.lower("content"), f"[{SEPARATOR}]+"), lambda w: F.octet_length(w) >= MIN_BYTES)
    stems = lambda rows: rows.select(F.col("id").alias("memory_id"), F.transform(words, stem).alias("stems")).where(F.size("stems") > 0)
    shared = materialize(memories.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id"), "shared_ids")
    if shared.isEmpty():
        said = stems(memories)
    else:
        once = memories.join(shared, "id", "left_anti")
        several = stems(memories.join(shared, "id", "left_semi")).groupBy("memory_id").agg(F.flatten(F.collect_list("stems")).alias("stems"))
        said = stems(once).unionByName(several)
    kept = F.col("stems") if wanted is None else F.filter("stems", lambda s: s.isin(wanted)) if wanted else F.slice("stems", 1, 0)
    in_order = said.select("memory_id", F.size("stems").alias("length"), F.array_sort(kept).alias("stems"))
    # where another stem begins among the sorted ones
    begins = F.filter(F.sequence(F.lit(1), F.size("stems")), lambda i: (i == 1) | (F.get("stems", i - 1) != F.get("stems", i - 2)))
    begins = F.when(F.size("stems") > 0, begins).otherwise(F.array().cast("array<int>"))
    cut = in_order.select("memory_id", "length", "stems", begins.alias("begins"))
    tf = lambda i, at: (F.coalesce(F.get("begins", at + 1), F.size("stems") + 1) - i).cast("bigint")
    counts = F.transform("begins", lambda i, at: F.struct(F.get("stems", i - 1).alias("stem"), tf(i, at).alias("tf")))
    return cut.select("memory_id", "length", counts.alias("counts"))


def _impact(formula: Bm25, mean: float) -> Column:
    held = formula.k1 * (1 - formula.b + formula.b * F.col("length") / mean)
    return F.col("tf") * (formula.k1 + 1) / (F.col("tf") + held)


def _rarity(postings: DataFrame, memories: int) -> dict[str, float]:
    """The weight of each stem of some postings."""
    rows = postings.groupBy("stem").agg(F.count(F.lit(1)).alias("n")).collect()
    return {r["stem"]: math.log(1 + (memories - r["n"] + 0.5) / (r["n"] + 0.5)) for r in rows}


def _weighted(postings: DataFrame, weight: dict[str, float]) -> DataFrame:
    """The postings of some stems, and what each adds to a score."""
    if not weight:
        return postings.where("false").withColumn("adds", F.lit(0.0))
    of = F.create_map(*[F.lit(x) for pair in weight.items() for x in pair])
    return postings.where(F.col("stem").isin(list(weight))).withColumn("adds", of[F.col("stem")] * F.col("impact"))
