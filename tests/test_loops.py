"""Loops over graphs end with the right answer, however long the way, in one task and by joins."""

from __future__ import annotations

import itertools
import os
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from lorekeep.operators import analytics
from lorekeep.sources.catalog import CorpusCatalog


def tables(spark, pairs, nodes=()):
    ids = sorted({x for p in pairs for x in p} | set(nodes))
    edges = spark.createDataFrame([(a, b, w) for (a, b), w in pairs.items()] if isinstance(pairs, dict) else [(a, b, 1.0) for a, b in pairs], "source_id string, target_id string, weight double")
    return edges, spark.createDataFrame([(i,) for i in ids], "id string")


def reach(pairs, nodes):
    near = defaultdict(set)
    for a, b in pairs:
        near[a].add(b)
    out = {}
    for v in nodes:
        seen, front = {v}, [v]
        while front:
            for w in near[front.pop()] - seen:
                seen.add(w)
                front.append(w)
        out[v] = seen
    return out


def plain_components(pairs, nodes):
    far = reach(pairs, nodes)
    return {v: min(w for w in far[v] if v in far[w]) for v in nodes}


def shapes():
    rng = random.Random(1)
    ring = [(f"r{i:03}", f"r{(i + 1) % 600:03}") for i in range(600)]
    chain = [(f"c{i:04}", f"c{i + 1:04}") for i in range(1000)]
    lasso = [(f"p{i:03}", f"p{i + 1:03}") for i in range(100)] + [("p100", "p050"), ("p070", "q0"), ("q0", "q1"), ("q1", "p070"), ("q1", "z")]
    mixed = list({(f"n{rng.randrange(60):02}", f"n{rng.randrange(60):02}") for _ in range(95)})
    two = ring[:50] + [("r050", "r000"), ("r020", "s00")] + [(f"s{i:02}", f"s{(i + 1) % 30:02}") for i in range(30)]
    return {"ring": ring, "chain": chain, "lasso": lasso, "mixed": mixed, "two": two, "ring and chain": ring + chain + [("c0500", "r100")], "none": []}


@pytest.mark.parametrize("local", [analytics.MOST_LOCAL, 0])
@pytest.mark.parametrize("name", list(shapes()))
def test_strong_components(spark, monkeypatch, name, local):
    monkeypatch.setattr(analytics, "MOST_LOCAL", local)
    pairs = shapes()[name]
    edges, nodes = tables(spark, pairs, ["alone"])
    want = plain_components(pairs, [r["id"] for r in nodes.collect()])
    got = analytics.strong_components(edges, nodes).collect()
    assert len(got) == len(want) and {r["id"]: r["component"] for r in got} == want
    if local:
        assert analytics.is_acyclic(edges) == (all(v == c for v, c in want.items()) and not any(a == b for a, b in pairs))


def plain_core(pairs, k):
    near = defaultdict(set)
    for a, b in pairs:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    while weak := [v for v in near if len(near[v]) < k]:
        for v in weak:
            for w in near.pop(v):
                near[w].discard(v) if w in near else None
    return set(near)


def test_k_core(spark, monkeypatch):
    rng = random.Random(2)
    chain = shapes()["chain"]
    dense = list({(f"d{rng.randrange(30):02}", f"d{rng.randrange(30):02}") for _ in range(120)})
    for pairs, local in ((chain, 500_000), (chain + dense, 500_000), (chain[:9] + dense, 0)):
        monkeypatch.setattr(analytics, "MOST_LOCAL", local)
        edges, _ = tables(spark, pairs)
        for k in (2, 3, 5):
            assert {r["id"] for r in analytics.k_core(edges, k).collect()} == plain_core(pairs, k)


def grouped(seed, groups, each, inside=0.6, between=2):
    """Pairs with weights inside groups, and a few weak ones between them."""
    rng = random.Random(seed)
    out = {(f"g{g}n{a}", f"g{g}n{b}"): rng.random() for g in range(groups) for a, b in itertools.permutations(range(each), 2) if rng.random() < inside}
    for g in range(groups):
        for _ in range(between):
            out[f"g{g}n{rng.randrange(each)}", f"g{(g + 1) % groups}n{rng.randrange(each)}"] = 0.05
    return out | {("g0n2", "g0n2"): 1.0}


def plain_modularity(of, pairs, resolution=1.0):
    total = 2 * sum(pairs.values())
    strength = Counter()
    for (a, b), w in pairs.items():
        strength[of[a]] += w
        strength[of[b]] += w
    return 2 * sum(w for (a, b), w in pairs.items() if of[a] == of[b]) / total - resolution * sum(x * x for x in strength.values()) / total**2


def of_rows(df):
    return {r["id"]: r["community"] for r in df.collect()}


def test_labels_settle(spark):
    pairs = grouped(3, 4, 6)
    edges, nodes = tables(spark, pairs, ["alone"])
    once = of_rows(analytics.label_propagation(edges, nodes))
    assert once["alone"] == "alone" and set(once) == {r["id"] for r in nodes.collect()}
    # a fixed point: no node has more weight around it under another label
    for v in once:
        weight = Counter()
        for (a, b), w in pairs.items():
            if a != b and v in (a, b):
                weight[once[b if v == a else a]] += w
        assert not weight or max(weight.values()) <= weight[once[v]] + 1e-8


def test_communities_are_the_planted_groups(spark):
    pairs = grouped(5, 5, 8)
    edges, nodes = tables(spark, pairs, ["alone"])
    found = analytics.communities(edges, nodes)
    of = of_rows(found)
    assert of == {v: v if v == "alone" else f"{v[:2]}n0" for v in of} and len(of) == 41
    assert abs(analytics.modularity(found, edges) - plain_modularity(of, pairs)) < 1e-9
    # nothing is gained by moving one node, and the order of rows doesn't matter
    for v in of:
        for c in set(of.values()):
            assert plain_modularity(of | {v: c}, pairs) <= plain_modularity(of, pairs) + 1e-9
    assert of_rows(analytics.communities(edges.repartition(7), nodes.repartition(3))) == of
    assert len(set(of_rows(analytics.communities(edges, nodes, resolution=12.0)).values())) > 6
    assert of_rows(analytics.communities(edges.limit(0), nodes)) == {v: v for v in of}


@pytest.mark.skipif(not os.path.isdir("/root/testdata"), reason="the generated tables are not here")
def test_modularity_on_the_tables(spark):
    c = CorpusCatalog(spark, "/root/testdata/sf0.001")
    edges = analytics.materialize(analytics.simple_graph(c.links, c.memories), "edges")
    ours, theirs = (analytics.modularity(f(edges, c.memories), edges) for f in (analytics.communities, analytics.label_propagation))
    assert ours >= theirs and ours > 0.4, (ours, theirs)


@pytest.mark.parametrize(("room", "single"), [(1 << 23, 8), (1, 1)])
def test_path_lengths_by_bits_of_many_searches(monkeypatch, room, single):
    """A hub, a long chain, a loop, a start twice and more than 64 starts; a block of searches visits each edge once a hop."""
    monkeypatch.setattr(analytics._Reach, "ROOM", room)
    monkeypatch.setattr(analytics._Reach, "SINGLE", single)
    some = random.Random(3)
    pairs = {(some.randrange(90), some.randrange(90)) for _ in range(150)} | {(i, 90) for i in range(0, 60, 2)} | {(90, 91)} | {(i, i + 1) for i in range(91, 140)} | {(5, 5)}
    source, target = map(np.array, zip(*sorted(pairs), strict=True))
    graph = analytics._Graph([str(i) for i in range(141)], source, target, np.ones(len(source)))
    reach = analytics._Reach(graph)
    assert reach.words == (16 if room > 1 else 1)
    starts = np.array([*range(0, 141, 2), 4] if room > 1 else [*range(60), 4], np.int64)
    far = analytics._hops(graph, starts)[0]
    assert list(reach.hops(starts)) == np.bincount(far[far > 0])[1:].tolist()


def plain_betweenness(pairs, nodes):
    """Shares of shortest paths, by listing every path."""
    near = defaultdict(list)
    for (a, b), w in pairs.items():
        if a != b:
            near[a].append((b, w))
    x = dict.fromkeys(nodes, 0.0)
    for s in nodes:
        paths = defaultdict(list)
        front = [((s,), 0.0)]
        while front:
            path, d = front.pop()
            for w, length in near[path[-1]]:
                if w not in path:
                    paths[w].append(((*path, w), d + length))
                    front.append(paths[w][-1])
        for found in paths.values():
            least = min(d for _, d in found)
            short = [p for p, d in found if d == least]
            for p in short:
                for v in p[1:-1]:
                    x[v] += 1 / len(short)
    n = len(nodes)
    return {v: c / ((n - 1) * (n - 2)) for v, c in x.items()}


@pytest.mark.parametrize("weighted", [False, True])
def test_betweenness_by_joins(spark, monkeypatch, weighted):
    rng = random.Random(4)
    pairs = {(f"n{a}", f"n{b}"): rng.choice([0.25, 0.5, 1.0]) for a, b in itertools.permutations(range(9), 2) if rng.random() < 0.3}
    edges, nodes = tables(spark, pairs, ["alone"])
    want = plain_betweenness(pairs if weighted else dict.fromkeys(pairs, 1.0), [r["id"] for r in nodes.collect()])
    far = reach(pairs, want)
    for most, block in ((2_000_000, 10**9), (0, 60)):
        monkeypatch.setattr(analytics, "MOST_EDGES", most)
        monkeypatch.setattr(analytics, "MOST_PAIRS", block)
        got = {r["id"]: r["betweenness"] for r in analytics.betweenness(edges, nodes, weighted).collect()}
        assert got.keys() == want.keys() and all(abs(got[v] - want[v]) < 1e-12 for v in want)
        stats = analytics.path_statistics(edges, nodes).first()
        assert stats["pairs"] == sum(len(x) - 1 for x in far.values()) and 1 <= stats["mean_length"] <= stats["diameter"] <= 9
        assert {r["id"] for r in analytics.bridges(edges, nodes).collect()} == {v for v, b in plain_betweenness(dict.fromkeys(pairs, 1.0), list(want)).items() if b > 0.1}


def test_edges_without_length(spark, monkeypatch):
    """Weights of 0, and cycles of them, end alike in both ways, and as if they were very short."""
    pairs = {("a", "b"): 0.0, ("b", "a"): 0.0, ("b", "c"): 1.0, ("a", "c"): 1.5, ("c", "d"): 0.0, ("d", "c"): -2.0, ("d", "e"): 1.0, ("c", "e"): 0.5}
    edges, nodes = tables(spark, pairs)
    want = plain_betweenness({k: max(w, analytics.LEAST_LENGTH) for k, w in pairs.items()}, [r["id"] for r in nodes.collect()])
    for most in (2_000_000, 0):
        monkeypatch.setattr(analytics, "MOST_EDGES", most)
        got = {r["id"]: r["betweenness"] for r in analytics.betweenness(edges, nodes, True).collect()}
        assert all(abs(got[v] - want[v]) < 1e-12 for v in want)


def test_topics_of_communities(spark):
    members = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "x"), ("d", "d")], "id string, community string")
    memories = spark.createDataFrame([("a", '{"topic": "t"}'), ("b", '{"topic": "t"}'), ("c", None), ("d", '{"topic": "u"}')], "id string, metadata string")
    got = {(r["community"], r["topic"]): (r["memories"], round(r["share"], 6)) for r in analytics.community_topics(members, memories).collect()}
    assert got == {("x", "t"): (2, 0.666667), ("x", "unknown"): (1, 0.333333)}


@pytest.mark.parametrize("weighted", [False, True])
def test_searches_of_many_sources_at_once(weighted):
    """A block of sources gives what its sources give one by one, with lengths from 1e-9 to 1000."""
    rng = np.random.default_rng(3)
    n, m = 400, 1200
    source, target = rng.integers(0, n, m), rng.integers(0, n, m)
    _, once = np.unique(source * n + target, return_index=True)
    source, target = source[once], target[once]
    length = rng.integers(1, 4, len(source)) / 101.0 if weighted else np.ones(len(source))
    if weighted:
        length[::50], length[7::50] = 1e3, analytics.LEAST_LENGTH
    graph = analytics._Graph([str(i) for i in range(n)], source, target, length)
    want = np.zeros(n)
    for s in range(n):
        for v, x in analytics._from_source(graph, s).items():
            want[v] += x
    got = sum(analytics._depend_on(graph, np.arange(at, min(at + 90, n)), weighted) for at in range(0, n, 90))
    assert np.allclose(got, want, rtol=1e-9, atol=1e-9)


def test_links_that_go_round_are_searched_one_by_one():
    """From 0 a length of 1e9 leads to 1 and 2, which edges of 1e-9 join in both directions."""
    graph = analytics._Graph(list("0123"), np.array([0, 1, 2, 2]), np.array([1, 2, 1, 3]), np.array([1e9, 1e-9, 1e-9, 1.0]))
    assert analytics._levels_by_length(graph, np.array([0]))[1].tolist() == [0]
    assert analytics._depend_on(graph, np.array([0, 1]), True).tolist() == [0.0, 2.0, 1.0 + 1.0, 0.0]


def test_a_round_of_halves_writes_one_table(spark, monkeypatch):
    """Communities of two triangles: the moves of a round are no table of their own."""
    pairs = [("a", "b"), ("b", "c"), ("c", "a"), ("d", "e"), ("e", "f"), ("f", "d"), ("c", "d")]
    edges = spark.createDataFrame([(a, b, 1.0) for a, b in pairs], "source_id string, target_id string, weight double")
    nodes = spark.createDataFrame([(x,) for x in "abcdef"], "id string")
    written = []
    keep = analytics.materialize
    monkeypatch.setattr(analytics, "materialize", lambda df, name, **more: written.append(name) or keep(df, name, **more))
    found = of_rows(analytics.communities(edges, nodes))
    assert found == dict(zip("abcdef", "aaaddd", strict=True))
    assert "moves" not in written and written.count("scored") > written.count("labels")


@pytest.mark.skipif(not os.path.isdir("/root/testdata"), reason="the generated tables are not here")
def test_communities_need_few_rounds(spark, monkeypatch):
    """3,000 links: the end of the first level and all coarser levels take no round of joins each."""
    c = CorpusCatalog(spark, "/root/testdata/sf0.01")
    edges = analytics.materialize(analytics.simple_graph(c.links, c.memories), "edges")
    written = []
    keep = analytics.materialize
    monkeypatch.setattr(analytics, "materialize", lambda df, name, **more: written.append(name) or keep(df, name, **more))
    found = keep(analytics.communities(edges, c.memories), "found")
    assert written.count("scored") <= 8, written
    assert found.count() == c.memories.count() and analytics.modularity(found, edges) > 0.5
    # levels by rounds alone come out as good
    monkeypatch.setattr(analytics, "MOST_IN_TURN", 100)
    monkeypatch.setattr(analytics, "MOST_COARSE", 100)
    assert analytics.modularity(analytics.communities(edges, c.memories), edges) > 0.5


@pytest.mark.skipif(not os.path.isdir("/root/testdata"), reason="the generated tables are not here")
def test_order_lines_are_dealt_out_by_order_alone(spark):
    """The pairs of suppliers that share orders: no shuffle by order and supplier in front of those by order."""
    plan = CorpusCatalog(spark, "/root/testdata/sf0.001").supplier_links._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(l_orderkey" in plan and not re.search(r"hashpartitioning\(l_orderkey#\d+L?, l_suppkey", plan), plan
