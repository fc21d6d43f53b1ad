"""Vector search, embeddings, reduction and hybrid search."""

from __future__ import annotations

import datetime as dt
import math
import os

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from lorekeep.errors import ComputationError, InvalidOperation, NotFound
from lorekeep.functions import vector as V
from lorekeep.operators import hybrid, ml, reduce, vectors
from lorekeep.plans.engine import MemoryEngine
from lorekeep.sources.catalog import from_rows
from lorekeep.sources.store import GraphStore

NOW = dt.datetime(2024, 3, 1)


def table(spark, named):
    return from_rows(spark, vectors=[(k, [float(x) for x in v], "m", len(v), {}, False) for k, v in named.items()]).vectors


def turned(degrees, size=1.0):
    """A vector of the plane, at an angle, with a third component of 0."""
    return [size * math.cos(math.radians(degrees)), size * math.sin(math.radians(degrees)), 0.0]


#: Angles in the plane, one vector out of it, and one longer than the others.
ANGLES = {"east": 0, "north": 90, "west": 180, "near": 20, "far": 130}


@pytest.fixture(scope="module")
def compass(spark):
    return table(spark, {**{k: turned(a) for k, a in ANGLES.items()}, "long": turned(55, 7.0), "up": [0.0, 0.0, 2.0]})


def test_nearest(compass):
    order = lambda df: [r["memory_id"] for r in df.orderBy("rank").collect()]
    top = vectors.search(compass, 1, vector=turned(0)).first()
    assert (top["memory_id"], top["score"]) == ("east", 1.0)
    assert order(vectors.search(compass, 9, vector=turned(60))) == ["long", "north", "near", "east", "far", "up", "west"][:1] + sorted(["north", "near", "east", "far", "up", "west"], key=lambda k: (-round(math.cos(math.radians(60 - ANGLES[k])), 6) if k != "up" else 0.0, k))
    assert vectors.search(compass, 99, vector=turned(0)).count() == 7
    assert order(vectors.search(compass, 2, similar_to="near")) == ["east", "long"]
    assert order(vectors.search(compass, 2, similar_to="near", exclude_self=False)) == ["near", "east"]
    assert set(order(vectors.search(compass, 7, vector=turned(0), min_score=0.5))) == {"east", "near", "long"}
    assert order(vectors.search(compass, 1, vector=turned(50, 6.0), metric="euclidean")) == ["long"]
    assert order(vectors.search(compass, 1, vector=turned(50, 0.9), metric="euclidean")) == ["near"]
    with pytest.raises(InvalidOperation):
        vectors.search(compass, 1)
    with pytest.raises(NotFound):
        vectors.search(compass, 1, similar_to="nobody")


def test_arithmetic(spark):
    lit = lambda v: F.array(*[F.lit(float(x)) for x in v])
    one = lambda c: spark.range(1).select(c).first()[0]
    assert abs(one(V.cosine(lit([1, 0, 0, 0]), lit([1, 1, 0, 0]))) - 2**-0.5) < 1e-12
    assert one(V.cosine(lit([0, 0]), lit([1, 1]))) == 0.0
    assert abs(one(V.norm(V.normalize(lit([3, 4])))) - 1) < 1e-12
    assert one(V.normalize(lit([0, 0]))) == [0.0, 0.0]
    assert one(V.is_normalized(lit([0.6, 0.8]))) and not one(V.is_normalized(lit([3, 4])))
    assert one(V.euclidean(lit([0, 0]), lit([3, 4]))) == 5.0
    with pytest.raises(Exception, match="unlike dimensions"):
        one(V.cosine(lit([1]), lit([1, 2])))


def plain_embedding(text, dims):
    state, out = sum(text.encode()) % 2**64, []
    for _ in range(dims):
        state = (state * 6364136223846793005 + 1) % 2**64
        out.append((state % 1000) / 500 - 1)
    size = sum(x * x for x in out) ** 0.5
    return [x / size for x in out]


def test_hash_embedding(spark):
    texts = ["abc", "cba", "été", ""]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    got = {r["text"]: r["v"] for r in vectors.HashEmbedder(16).embed(rows, "text", "v").collect()}
    for t in texts:
        assert np.allclose(got[t], plain_embedding(t, 16))
    assert got["abc"] == got["cba"]


def test_reduction(spark):
    rng = np.random.default_rng(8)
    named = {f"v{i}": [float(x) for x in v] for i, v in enumerate(rng.normal(size=(33, 4)) @ rng.normal(size=(4, 13)) + 0.01 * rng.normal(size=(33, 13)))}
    rows = table(spark, named)
    for method in reduce.METHODS:
        small = reduce.VectorReducer(method, 5).fit(rows).transform(rows)
        got = {r["memory_id"]: r for r in small.collect()}
        assert all(len(r["vector"]) == 5 and r["reduced"] and r["model"] == "m_reduced" and r["dimensions"] == 5 for r in got.values())
        assert got["v0"]["metadata"] == {"original_dimensions": "13", "reduction_method": method, "target_dimensions": "5"}
        if method == "truncation":
            assert np.allclose(got["v3"]["vector"], named["v3"][:5], atol=1e-6)
        if method == "pca":
            x = np.array(list(named.values()), np.float32).astype(float)
            values = np.sort(np.linalg.eigvalsh(np.cov(x.T, bias=True)))[::-1][:5]
            y = np.array([got[k]["vector"] for k in named])
            assert np.allclose(np.var(y, axis=0), values, atol=1e-6) and np.allclose(y.mean(0), 0, atol=1e-6)
    with pytest.raises(InvalidOperation):
        reduce.VectorReducer("pca", 13).fit(rows)
    with pytest.raises(ComputationError):
        reduce.VectorReducer("pca", 2).fit(rows.where("false"))
    with pytest.raises(ComputationError):
        reduce.VectorReducer("pca", 2).fit(table(spark, {"a": [1, 2, 3], "b": [1, 2, 3, 4]}))


@pytest.mark.parametrize("method", reduce.METHODS)
def test_reduction_as_a_pipeline_stage(spark, tmp_path, method):
    """Fitted, saved and loaded, in a pipeline and alone: the reducer's own vectors, and null where there is none."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(40, 9)).astype(np.float32).astype(float)
    named = {f"v{i:02}": list(v) for i, v in enumerate(x)}
    rows = table(spark, named)
    want = {r["memory_id"]: r["vector"] for r in reduce.VectorReducer(method, 3, 7).fit(rows).transform(rows).collect()}
    made = rows.select("memory_id", F.col("vector").alias("x y")).unionByName(spark.createDataFrame([("none", None)], "memory_id string, `x y` array<float>"))
    stage = ml.VectorReduction(inputCol="x y", outputCol="small", method=method, target=3, seed=7)
    Pipeline(stages=[stage]).write().save(str(tmp_path / "unfitted"))
    fitted = Pipeline.load(str(tmp_path / "unfitted")).fit(made)
    fitted.write().save(str(tmp_path / "fitted"))
    stage.fit(made).write().save(str(tmp_path / "alone"))
    again = [PipelineModel.load(str(tmp_path / "fitted")), ml.VectorReductionModel.load(str(tmp_path / "alone"))]
    for model in (fitted, *again):
        got = {r["memory_id"]: r["small"] for r in model.transform(made).collect()}
        assert got.pop("none") is None and got.keys() == want.keys()
        assert all(np.allclose(got[k], want[k], atol=1e-9) for k in want)
    assert (again[1].getMethod(), again[1].getTarget(), again[1].getSeed()) == (method, 3, 7)
    if method == "pca":  # axes are orthogonal, and components uncorrelated around 0
        y = np.array([got[k] for k in sorted(got)])
        cov = np.cov(y.T, bias=True)
        assert np.allclose(again[1].basis.T @ again[1].basis, np.eye(3)) and np.allclose(cov, np.diag(np.diag(cov)), atol=1e-9)
    with pytest.raises(Exception, match="unlike dimensions"):
        again[1].transform(table(spark, {"a": [1.0, 2.0]}).withColumnRenamed("vector", "x y")).collect()


def test_exact_against_brute_force_and_recall(spark):
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(8, 16))
    x = np.concatenate([c + 0.4 * rng.normal(size=(60, 16)) for c in centers]).astype(np.float32).astype(float)
    rows = table(spark, {f"v{i:03}": v for i, v in enumerate(x)})
    asked = rows.where("CAST(substring(memory_id, 2) AS INT) % 20 = 0").select(F.col("memory_id").alias("query_id"), "vector")
    exact = {}
    for r in vectors.top_k(rows, asked, 5).collect():
        exact.setdefault(r["query_id"], {})[r["rank"]] = r["memory_id"]
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q, found in exact.items():
        score = np.round(unit @ unit[int(q[1:])], 6)
        best = sorted(range(len(x)), key=lambda i: (-score[i], f"v{i:03}"))[:5]
        assert [found[k] for k in range(1, 6)] == [f"v{i:03}" for i in best]
    index = vectors.InvertedFile(cells=12).fit(rows)
    assert index.probes < 12
    near = index.search(index.index(rows), asked, 5).collect()
    hits = sum(r["memory_id"] in exact[r["query_id"]].values() for r in near)
    assert hits / (5 * len(exact)) >= 0.9


@pytest.mark.skipif(not os.path.isdir("/root/testdata"), reason="the generated tables are not here")
@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01", "sf0.1"])
def test_recall_on_the_tables(spark, folder):
    """The registered search, whose vectors form no groups, against the exact one."""
    from lorekeep.plans import registry

    folder = f"/root/testdata/{folder}"
    found, exact = ({(r["query_id"], r["memory_id"]) for r in registry.QUERIES[name](spark, folder).collect()} for name in ("inverted_file_topk", "cosine_topk"))
    assert len(found & exact) >= 0.9 * len(exact) > 0


def test_reduce_and_store(spark, tmp_path):
    store = GraphStore(spark, str(tmp_path / "s"))
    store.put("vectors", table(spark, {f"v{i}": [float((i + j) % 10) for j in range(20)] for i in range(10)}))
    engine = MemoryEngine(store.tables(), store=store)
    engine.reduce_vectors("pca", 5)
    kept = store.read("vectors")
    assert kept.count() == 20 and {(r["reduced"], len(r["vector"]), r["dimensions"]) for r in kept.collect()} == {(False, 20, 20), (True, 5, 5)}
    engine.reduce_vectors("truncation", 3)
    assert {(r["reduced"], len(r["vector"])) for r in store.read("vectors").collect()} == {(False, 20), (True, 3)}
    with pytest.raises(InvalidOperation):
        MemoryEngine(store.tables()).reduce_vectors("pca", 5)


@pytest.fixture(scope="module")
def basis(spark):
    """Three axes, and a vector at 45 degrees between two of them."""
    return table(spark, {"one": [1, 0, 0], "two": [0, 3, 0], "three": [0, 0, 1], "four": [0.25, 0.25, 0]})


def test_choice_of_vectors(spark, basis):
    made = [("one", "x", "s", 0.5, 0.5, 0, NOW, NOW, None, '{"embedding_vector": [9, 9, 9]}'), ("two", "x", "s", 0.5, 0.5, 0, NOW, NOW, None, "{}"), ("new", "abc", "s", 0.5, 0.5, 0, NOW, NOW, None, None)]
    memories = from_rows(spark, memories=made).memories
    got = {r["memory_id"]: r for r in vectors.choose_vectors(memories, basis, vectors.HashEmbedder(3)).collect()}
    assert got["one"]["origin"] == "metadata" and got["one"]["vector"] == [9.0, 9.0, 9.0]
    assert got["two"]["origin"] == "stored" and got["new"]["origin"] == "computed"


def test_hybrid(spark, basis):
    said = {"one": "alpha beta", "two": "beta gamma", "three": "gamma delta", "four": "alpha"}
    memories = from_rows(spark, memories=[(k, t, f"s{len(t)}", 0.9 if k != "four" else 0.2, 0.5, 0, NOW, NOW, None, f'{{"k":"{k}"}}') for k, t in said.items()]).memories
    query = hybrid.HybridQuery(text="alpha", vector=(1.0, 0.0, 0.0), vector_limit=2)
    score = lambda **how: {r["id"]: r["score"] for r in hybrid.search(memories, basis, hybrid.replace(query, **how)).collect()}
    assert score(method="sum") == {"one": 2.0, "four": 1.707107}
    assert score(method="max") == {"one": 1.0, "four": 1.0}
    assert score(method="weighted", keyword_weight=3.0) == {"one": 1.0, "four": round((3 + 0.707107) / 4, 6)}
    assert set(score(metadata=(("k", "one"), ("k", "two")))) == {"one"}
    assert score(metadata=(("k", "one"), ("k", "two")), match="all") == {}
    assert set(score(min_confidence=0.5)) == {"one"}
    assert set(score(text=None, required=("beta",))) == {"one"}
    assert set(score(text=None, prefilter=True, min_confidence=0.5)) == {"one", "two"} or score(text=None, prefilter=True, min_confidence=0.5)["one"] == 1.0
    parts = {r["id"]: r["component_scores"] for r in hybrid.search(memories, basis, query).collect()}
    assert parts["one"] == {"keyword": 1.0, "vector": 1.0}
    with pytest.raises(InvalidOperation):
        hybrid.search(memories, basis, hybrid.HybridQuery())


def test_the_best_rows_so_far_are_few_and_right():
    """Many blocks of rows with ties and equal scores: what is held stays bounded, and ties go by id."""
    rng, best, rows = np.random.default_rng(5), vectors.Best(6, 4), []
    for block in range(200):
        scores = np.round(rng.random((6, 50)), 2) if block % 2 else np.full((6, 50), 0.99)
        ids = np.array([str(x) for x in rng.permutation(50) + 50 * block], object)
        best.add(np.arange(6), scores, ids)
        assert best.held <= 4 * 4 * 6
        rows.append((scores, ids))
    scores, ids = np.concatenate([s for s, _ in rows], 1), np.concatenate([i for _, i in rows])
    got = list(zip(*best.shrink(), strict=True))
    want = [(q, *x) for q in range(6) for x in sorted(zip(-scores[q], ids, strict=True))[:4]]
    assert [(q, -s, i) for q, s, i in got] == want


def test_an_inverted_file_gives_each_query_its_best_of_the_cells_it_reads(spark):
    """Whatever the block of queries; the same as by comparing each query with each row of its cells."""
    rng = np.random.default_rng(6)
    rows = spark.createDataFrame([(str(i), rng.normal(size=8).tolist()) for i in range(700)], "memory_id string, vector array<double>")
    asked = rows.where("CAST(memory_id AS INT) % 10 = 0").withColumnRenamed("memory_id", "query_id")
    file = vectors.InvertedFile(cells=8, probes=3).fit(rows)
    index = file.index(rows)
    got = {(r["query_id"], r["memory_id"]): r["rank"] for r in file.search(index, asked, 5).collect()}
    x = {r["memory_id"]: (np.array(r["vector"]), r["cell"]) for r in index.collect()}
    want = {}
    for q in (r["query_id"] for r in asked.collect()):
        v = x[q][0]
        cells = set(np.argsort(-(v @ file.centers.T), kind="stable")[:3])
        near = sorted((-round(float(v @ w / np.linalg.norm(v) / np.linalg.norm(w)), 6), i) for i, (w, c) in x.items() if c in cells)[:5]
        want |= {(q, i): n for n, (_, i) in enumerate(near, 1)}
    assert got == want
