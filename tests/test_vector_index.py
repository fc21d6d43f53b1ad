"""The stored vector index: recall, what it reads, and how it changes."""

from __future__ import annotations

import os
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorekeep.errors import ComputationError, InvalidOperation
from lorekeep.operators import vectors
from lorekeep.sources.catalog import CorpusCatalog
from lorekeep.sources.store import GraphStore
from lorekeep.sources.vector_index import Codes, VectorIndex, k_means, unit

TABLES = "/root/testdata/sf0.1"


def table(spark, x, first=0):
    return spark.createDataFrame([(f"v{i + first:04}", [float(a) for a in v]) for i, v in enumerate(x)], "memory_id string, vector array<float>")


def clusters(rng, groups, each, dims, spread=0.3):
    return np.concatenate([c + spread * rng.normal(size=(each, dims)) for c in rng.normal(size=(groups, dims))])


def found(index, queries, k=10):
    out = {}
    for r in index.search(queries, k).collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["memory_id"], r["score"]))
    return {q: sorted(x) for q, x in out.items()}


def exact(x, names, q, k):
    score = np.round(unit(x) @ (q / np.linalg.norm(q)), 6)
    return sorted(range(len(x)), key=lambda i: (-score[i], names[i]))[:k]


def test_codes_come_close():
    rng = np.random.default_rng(1)
    x = unit(rng.normal(size=(3000, 16)))
    centers = k_means(x, 4, 8, 1)
    of = ((x[:, None] - centers) ** 2).sum(2).argmin(1)
    rest = x - centers[of]
    codes = Codes(np.arange(4, dtype=np.int32), centers, [k_means(rest[:, a : a + 2], 256, 8, a) for a in range(0, 16, 2)])
    cell, code = codes.encode(5 * x)
    assert (cell == of).all() and code.shape == (3000, 8) and code.dtype == np.uint8
    tables, q = codes.tables(x[:7]), x[:7]
    guess = np.stack([sum(tables[j, i][code[:, j]] for j in range(8)) + (q[i] @ centers.T)[cell] for i in range(7)])
    assert np.abs(guess - q @ x.T).max() < 0.15 and np.corrcoef(guess.ravel(), (q @ x.T).ravel())[0, 1] > 0.98


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="the generated tables are not here")
def test_recall_and_share_read(spark, tmp_path):
    """On vectors that form no groups: at least 0.9 of the nearest, with at most a fifth of the full vectors."""
    rows = CorpusCatalog(spark, TABLES).vectors.select("memory_id", "vector")
    asked = rows.where("CAST(memory_id AS BIGINT) % 100 = 0").select(F.col("memory_id").alias("query_id"), "vector")
    index = VectorIndex(GraphStore(spark, str(tmp_path / "s")), cell_rows=256, probes=1.0, candidates=2)
    index.build(rows)
    want = {(r["query_id"], r["memory_id"]) for r in vectors.top_k(rows, asked, 10).collect()}
    got = {(r["query_id"], r["memory_id"]) for r in index.search(asked, 10).collect()}
    block = [(r["query_id"], r["vector"]) for r in asked.collect()]
    read = index.candidates_of(index.codes(), block, 10).select("memory_id").distinct().count()
    n = rows.count()
    assert len(want & got) >= 0.9 * len(want), len(want & got) / len(want)
    assert read <= 0.2 * n, read / n


def test_groups_are_found_in_few_cells(spark, tmp_path):
    rng = np.random.default_rng(2)
    x = clusters(rng, 12, 60, 24)
    index = VectorIndex(GraphStore(spark, str(tmp_path / "s")), parts=12, cell_rows=40, probes=0.25, candidates=3)
    index.build(table(spark, x))
    sizes = index.sizes()
    assert sum(sizes.values()) == len(x) and max(sizes.values()) <= 80 and len(sizes) >= 9
    names = [f"v{i:04}" for i in range(len(x))]
    asked = table(spark, x[::30]).withColumnRenamed("memory_id", "query_id")
    hits = total = 0
    for q, rows in found(index, asked).items():
        best = exact(x, names, x[30 * int(q[1:])], 10)
        hits += len({m for _, m, _ in rows} & {names[i] for i in best})
        total += len(best)
    assert hits >= 0.9 * total


def test_changes(spark, tmp_path):
    rng = np.random.default_rng(3)
    x = clusters(rng, 4, 50, 8)
    store = GraphStore(spark, str(tmp_path / "s"))
    index = VectorIndex(store, parts=4, cell_rows=64, probes=1.0, candidates=8)
    with pytest.raises(InvalidOperation):
        index.search(table(spark, x[:1]).withColumnRenamed("memory_id", "query_id"), 1)
    with pytest.raises(ComputationError):
        index.build(table(spark, x).limit(0))
    index.build(table(spark, x))
    now = {f"v{i:04}": v for i, v in enumerate(x)}

    def holds():
        asked = table(spark, x[::40]).withColumnRenamed("memory_id", "query_id")
        names = sorted(now)
        y = np.array([now[m] for m in names]).astype(np.float32).astype(float)
        for q, rows in found(index, asked, 5).items():
            best = exact(y, names, np.float32(x[40 * int(q[1:])]).astype(float), 5)
            assert [m for _, m, _ in rows] == [names[i] for i in best]
        assert sorted(r["memory_id"] for r in store.read("codes").collect()) == names

    holds()
    index.remove(spark.createDataFrame([("v0000",), ("v0041",), ("nobody",)], "memory_id string"))
    del now["v0000"], now["v0041"]
    holds()
    moved = clusters(rng, 1, 30, 8)
    index.put(table(spark, moved, first=10))
    now |= {f"v{i + 10:04}": v for i, v in enumerate(moved)}
    holds()
    cells = len(index.sizes())
    more = clusters(rng, 1, 300, 8, spread=0.6)  # they crowd into few cells, which are split
    index.put(table(spark, more, first=1000))
    now |= {f"v{i + 1000:04}": v for i, v in enumerate(more)}
    assert max(index.sizes().values()) <= 128 and len(index.sizes()) > cells
    holds()
    with pytest.raises(Exception, match="unlike dimensions"):
        index.put(table(spark, [[1.0, 2.0]]))
    index.clear()
    assert index.sizes() == {} and found(index, table(spark, x[:2]).withColumnRenamed("memory_id", "query_id")) == {}
    index.put(table(spark, x[:20]))
    assert sum(index.sizes().values()) == 20


def test_equal_vectors_are_not_split_for_ever(spark, tmp_path):
    index = VectorIndex(GraphStore(spark, str(tmp_path / "s")), parts=2, cell_rows=10, probes=1.0)
    index.build(table(spark, [[1.0, 2.0, 3.0]] * 50))
    assert sum(index.sizes().values()) == 50


def test_a_search_reads_the_codes_of_its_cells(spark, tmp_path):
    """Partitions of other cells are pruned, and the scan of codes has no vectors."""
    x = clusters(np.random.default_rng(4), 10, 30, 8)
    store = GraphStore(spark, str(tmp_path / "s"))
    index = VectorIndex(store, parts=4, cell_rows=20, probes=2)
    index.build(table(spark, x))
    index.remove(spark.createDataFrame([("v0001",)], "memory_id string"))
    index.put(table(spark, x[:3]))
    codes = index.codes()
    plan = index.candidates_of(codes, [("q", x[0].tolist())], 3)._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.split("\n") if "cell#" in line and "FileScan" in line]
    assert scans and all("vector" not in line for line in scans)
    assert all(len(re.findall(r"\d+", re.search(r"cell#\d+ IN \(([^)]*)\)", line)[1])) == 2 for line in scans if "PartitionFilters" in line and " IN (" in line)
    assert any(" IN (" in line for line in scans)


def test_a_search_that_probes_all_cells_is_exact(spark, tmp_path):
    """Codes of two bytes and one candidate a row: what they rank too low is compared all the same."""
    x = np.random.default_rng(9).normal(size=(500, 16))
    index = VectorIndex(GraphStore(spark, str(tmp_path / "s")), parts=2, cell_rows=120, probes=1.0, candidates=1)
    rows = table(spark, x)
    index.build(rows)
    asked = rows.limit(12).withColumnRenamed("memory_id", "query_id")
    key = lambda df: sorted((r["query_id"], r["rank"], r["memory_id"]) for r in df.collect())
    assert key(index.search(asked, 7)) == key(vectors.top_k(rows, asked, 7))
