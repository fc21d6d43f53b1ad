"""Links, traversal, groups and analytics."""

from __future__ import annotations

import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from lorekeep.errors import NotFound
from lorekeep.operators import analytics, forgetting, groups, links, traverse
from lorekeep.sources.catalog import from_rows
from lorekeep.sources.generate import demo, synthetic

NOW = dt.datetime(2024, 3, 1)


def memory(i, at=NOW, confidence=0.5, topic="t"):
    return (i, f"about {i}", "s", confidence, 0.5, 0, at, at, None, f'{{"topic":"{topic}"}}')


def graph(spark, pairs, nodes=None, weights=None):
    nodes = nodes or sorted({x for p in pairs for x in p})
    made = [(f"l{i:04}", a, b, "k", (weights or {}).get((a, b), 1.0), None) for i, (a, b) in enumerate(pairs)]
    return from_rows(spark, memories=[memory(n) for n in nodes], links=made)


def rows(df):
    return sorted(map(tuple, df.collect()))


KINDS = ["blocks", "quotes", "renames"]


def wheel():
    """A hub and nine places on a rim: (id, from, to, type, weight), some of them twice."""
    out = [(f"spoke{n}", "hub", f"rim{n}", KINDS[n % 3], (n * 4 % 9 + 1) / 10) for n in range(9)]
    out += [(f"arc{n}", f"rim{n}", f"rim{(n + 2) % 9}", KINDS[n % 2], (n * 5 % 7 + 1) / 8) for n in range(9)]
    return [*out, ("back", "rim3", "hub", "quotes", 0.95), ("again", "hub", "rim3", "renames", 0.2)]


def test_lookup(spark):
    """Links by end, type and weight, against the list that they were made of."""
    made = wheel()
    g = from_rows(spark, memories=[memory(i) for i in ["hub", *[f"rim{n}" for n in range(9)]]], links=[(*r, None) for r in made])
    ids = lambda df: sorted(r["id"] for r in df.collect())
    plain = lambda keep: sorted(r[0] for r in made if keep(r))
    for node in ("hub", "rim3", "rim8"):
        assert ids(links.outgoing(g.links, node)) == plain(lambda r: r[1] == node)  # noqa: B023
        assert ids(links.incoming(g.links, node)) == plain(lambda r: r[2] == node)  # noqa: B023
        strongest = [r["id"] for r in links.strongest_first(links.touching(g.links, node)).collect()]
        touching = [r for r in made if node in r[1:3]]
        assert sorted(strongest) == sorted(r[0] for r in touching)
        weight = {r[0]: r[4] for r in made}
        assert [weight[i] for i in strongest] == sorted((r[4] for r in touching), reverse=True)
        for kind in KINDS:
            assert ids(links.by_type(g.links, kind, source=node)) == plain(lambda r: r[3] == kind and r[1] == node)  # noqa: B023
    for kind in KINDS:
        assert ids(links.by_type(g.links, kind)) == plain(lambda r: r[3] == kind)  # noqa: B023
    pairs = [r[1:3] for r in made]
    assert sorted(tuple(r["path"]) for r in traverse.paths(g.links, "rim3", "rim0", 4).collect()) == plain_paths(pairs, "rim3", "rim0", 4)
    with pytest.raises(NotFound):
        links.between_nodes(g.links, "hub", "axle", g.memories)


#: A diamond with a tail, a cycle, a parallel link, a loop, an orphan end and a node apart.
PAIRS = [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "e"), ("e", "a"), ("a", "b"), ("c", "c"), ("d", "gone")]


def plain_paths(pairs, s, t, depth):
    out = []

    def walk(path):
        if path[-1] == t:
            out.append(tuple(path))
            return
        if len(path) <= depth:
            for b in sorted({y for x, y in pairs if x == path[-1]}):
                if b not in path:
                    walk([*path, b])

    walk([s])
    return sorted(out)


def test_paths(spark):
    g = graph(spark, PAIRS, ["a", "b", "c", "d", "e", "z"])
    for s, t, depth in itertools.product("ae", "dez", (1, 5)):
        found = sorted(tuple(r["path"]) for r in traverse.paths(g.links, s, t, depth).collect())
        assert found == plain_paths(PAIRS, s, t, depth), (s, t, depth)
    both = traverse.paths(g.links, "a", "d", 2)
    assert sorted(r["id"] for r in traverse.path_links(both, g.links).collect()) == ["l0000", "l0001", "l0002", "l0003", "l0006"]
    told = {tuple(r["path"]): r for r in traverse.described_paths(both, g.links).collect()}
    assert told[("a", "b", "d")]["links"] == ["l0000", "l0006", "l0002"] and told[("a", "b", "d")]["total_weight"] == 3.0
    assert traverse.shortest_path(g.links, "a", "e", 5).first()["path"] == ["a", "b", "d", "e"]
    assert traverse.shortest_path(g.links, "a", "z", 5).isEmpty()
    assert traverse.shortest_path(g.links, "a", "a", 5).first()["path"] == ["a"]


def test_paths_from_both_ends(spark):
    """At depth 8 the same paths as by walking from one end, with a fraction of the frontier."""
    rng = random.Random(40)
    nodes = [f"n{i:02}" for i in range(60)]
    pairs = sorted({(rng.choice(nodes), rng.choice(nodes)) for _ in range(150)})
    g = graph(spark, pairs, nodes)
    steps = g.links.select("source_id", "target_id").distinct()
    ends = [(a, b) for a, b in [("n00", "n41"), ("n07", "n30"), ("n12", "n03")]]
    for s, t in ends:
        found = sorted(tuple(r["path"]) for r in traverse.paths(g.links, s, t, 8).collect())
        assert found == plain_paths(pairs, s, t, 8)
    s, t = ends[0]
    both = sum(f.count() for f in [*traverse.half_paths(steps, s, t, 4), *traverse.half_paths(steps, t, s, 4, back=True)])
    one = sum(f.count() for f in traverse.half_paths(steps, s, t, 8))
    assert both < one / 4, (both, one)


def test_hops(spark):
    g = graph(spark, PAIRS, ["a", "b", "c", "d", "e", "z"])
    seeds = spark.createDataFrame([("a",), ("z",)], "seed string")
    before = 0
    for depth in range(6):
        found = rows(traverse.k_hop_nodes(g.links, seeds, depth))
        assert len(found) >= before
        before = len(found)
    assert [r for r in found if r[0] == "a"] == [("a", "a", 0), ("a", "b", 1), ("a", "c", 1), ("a", "d", 2), ("a", "e", 3), ("a", "gone", 3)]
    assert sorted(r["id"] for r in traverse.k_hop_links(g.links, seeds, 1).collect()) == ["l0000", "l0001", "l0006"]
    near, on_way = traverse.connected(g.links, g.memories, "d", 1)
    assert sorted(r["id"] for r in near.collect()) == ["d", "e"] and on_way.count() == 2
    assert [r["id"] for r in traverse.find_connections(g.links, "d", "in", max_depth=1).collect()] == ["l0002", "l0003"]


def test_integrity(spark):
    g = graph(spark, PAIRS, ["a", "b", "c", "d", "e", "z"])
    assert [(r["id"], r["source_exists"], r["target_exists"]) for r in links.orphans(g.links, g.memories).collect()] == [("l0008", True, False)]
    assert links.attached(g.links, g.memories).count() == 8
    shown = {r["id"]: r["target_content"] for r in links.with_content(g.links, g.memories).collect()}
    assert shown["l0008"] == "Unknown (ID: gone)" and shown["l0000"] == "about b"
    degrees = {r["id"]: (r["in_degree"], r["out_degree"]) for r in links.degrees(g.links).collect()}
    assert degrees["c"] == (2, 2) and degrees["a"] == (1, 3) and "z" not in degrees
    importance = {r["id"]: r["importance"] for r in links.centrality_importance(g.memories, g.links).collect()}
    assert importance["z"] == 0.2 and importance["a"] == 1.0
    kept, left = forgetting.forget_with_links(g.memories.withColumn("importance", F.when(F.col("id") == "d", 0.1).otherwise(0.9)), g.links, forgetting.importance_policy(0.2), NOW)
    assert kept.count() == 5 and sorted(r["id"] for r in left.collect()) == ["l0000", "l0001", "l0005", "l0006", "l0007"]


def test_groups(spark):
    t = from_rows(
        spark,
        memories=[memory("m1", topic="x"), memory("m2", topic="y"), memory("m3", topic="x")],
        collections=[("c", "C", "", None)], collection_members=[("c", "m1"), ("c", "m2"), ("c", "lost"), ("c", "m1")],
        agents=[("a", "A", "", ["read"], None)], agent_grants=[("a", "c")],
        contexts=[("k", "K", "", None)], context_members=[("k", "m1"), ("k", "m2"), ("k", "m3")], context_agents=[("k", "a")],
    )
    assert sorted(r["id"] for r in groups.agent_memories(t.agent_grants, t.collection_members, t.memories, "a").collect()) == ["m1", "m2"]
    assert groups.context_memories(t.context_members, t.memories, "k").count() == 3
    assert groups.agents_in_context(t.context_agents, t.agents, "k").count() == 1
    assert groups.has_access(t.agent_grants, "a", "c") and not groups.has_access(groups.revoke(t.agent_grants, "a", "c"), "a", "c")
    assert groups.grant(t.agent_grants, "a", "c").count() == 1
    summary = groups.context_summary(t.context_members, t.memories).first()
    assert summary["memories"] == 3 and summary["topics"] == {"x": 2, "y": 1} and summary["mean_confidence"] == 0.5
    assert rows(links.member_orphans(t.collection_members, "collection_id", "memory_id", t.memories.select("id"))) == [("c", 1)]
    assert rows(groups.same_topic_links(t.memories, spark.createDataFrame([("m3",)], "id string")).select("source_id", "target_id")) == [("m3", "m1")]
    assert links.graph_edges(t.links, t.collection_members, t.agent_grants, t.context_members, t.context_agents).count() == 3 + 1 + 3 + 1


def plain_rank(pairs, nodes, rounds, d=0.85):
    n, rank = len(nodes), {x: 1 / len(nodes) for x in nodes}
    out = {x: sum(1 for a, _ in pairs if a == x) for x in nodes}
    for _ in range(rounds):
        idle = sum(rank[x] for x in nodes if not out[x])
        rank = {x: (1 - d) / n + d * (sum(rank[a] / out[a] for a, b in pairs if b == x) + idle / n) for x in nodes}
    return rank


def random_pairs(n, m, seed):
    rng = random.Random(seed)
    return sorted({(f"n{rng.randrange(n)}", f"n{rng.randrange(n)}") for _ in range(m)} - {(f"n{i}", f"n{i}") for i in range(n)})


def test_pagerank(spark):
    pairs = random_pairs(12, 20, 1)
    nodes = [f"n{i}" for i in range(12)]
    g = graph(spark, pairs, nodes)
    edges = analytics.simple_graph(g.links, g.memories)
    want = plain_rank(pairs, nodes, 7)
    for r in analytics.pagerank(edges, g.memories, 7).collect():
        assert abs(r["rank"] - want[r["id"]]) < 1e-9


def plain_betweenness(pairs, nodes):
    out = dict.fromkeys(nodes, 0.0)
    step = {x: sorted({b for a, b in pairs if a == x}) for x in nodes}
    for s in nodes:
        for t in nodes:
            if s == t:
                continue
            best, found, front = None, [], [[s]]
            while front and best is None:
                nxt = []
                for p in front:
                    for b in step[p[-1]]:
                        if b not in p:
                            (found if b == t else nxt).append([*p, b])
                if found:
                    best = len(found[0])
                front = nxt
            for p in found:
                for x in p[1:-1]:
                    out[x] += 1 / len(found)
    n = len(nodes)
    return {x: v / ((n - 1) * (n - 2)) for x, v in out.items()}


def test_betweenness_and_components(spark):
    pairs, nodes = random_pairs(9, 18, 3), [f"n{i}" for i in range(9)]
    g = graph(spark, pairs, nodes)
    edges = analytics.simple_graph(g.links, g.memories)
    want = plain_betweenness(pairs, nodes)
    for r in analytics.betweenness(edges, g.memories).collect():
        assert abs(r["betweenness"] - want[r["id"]]) < 1e-9
    reach = {x: {x} for x in nodes}
    for _ in nodes:
        for a, b in pairs:
            for x in nodes:
                if a in reach[x]:
                    reach[x].add(b)
    strong = {x: min(y for y in nodes if y in reach[x] and x in reach[y]) for x in nodes}
    assert {r["id"]: r["component"] for r in analytics.strong_components(edges, g.memories).collect()} == strong
    assert analytics.is_acyclic(edges) == (len(set(strong.values())) == len(nodes))
    joined = [(s, t) for s in nodes for t in reach[s] if s != t]
    assert analytics.path_statistics(edges, g.memories).first()["pairs"] == len(joined)


def test_cores_and_clusters(spark):
    clique = [(f"c{i}", f"c{j}") for i in range(4) for j in range(i)]
    g = graph(spark, [*clique, ("c0", "t1"), ("t1", "t2")])
    edges = analytics.simple_graph(g.links, g.memories)
    assert sorted(r["id"] for r in analytics.k_core(edges, 3).collect()) == ["c0", "c1", "c2", "c3"]
    assert analytics.k_core(edges, 4).isEmpty()
    assert analytics.core_abstractions(edges, (3,)).first()["size"] == 4
    found = {r["id"]: r["community"] for r in analytics.communities(edges, g.memories).collect()}
    assert len({found[f"c{i}"] for i in range(4)}) == 1
    stats = analytics.community_stats(spark.createDataFrame(list(found.items()), "id string, community string"), g.memories, edges)
    assert stats.where("size >= 4").first()["topic_concentration"] == 1.0


def test_sequences(spark, monkeypatch):
    rng = random.Random(5)
    times = sorted(rng.randrange(200_000) for _ in range(120))
    made = [memory(f"m{i}", at=dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)) for i, s in enumerate(times)]
    m = from_rows(spark, memories=made).memories
    base = int(dt.datetime(2024, 1, 1, tzinfo=dt.UTC).timestamp())
    want, start = {}, None
    for i, s in enumerate(times):
        if start is None or s - start > 3600:
            start = s
        want[f"m{i}"] = base + start
    assert {r["id"]: r["start"] for r in analytics.sequence_windows(m).collect()} == want
    monkeypatch.setattr(analytics, "MOST_SECONDS", 3)
    assert {r["id"]: r["start"] for r in analytics.sequence_windows(m).collect()} == want
    g = from_rows(spark, memories=made, links=[(f"l{i}", f"m{i}", f"m{i + 1}", "next", 1.0, None) for i in range(119)])
    found = analytics.temporal_sequences(g.memories, analytics.simple_graph(g.links, g.memories))
    sizes = [list(want.values()).count(s) for s in set(want.values())]
    assert found.count() == sum(3 <= n <= 10 for n in sizes)


def test_health(spark):
    t = demo(spark)
    assert (t.memories.count(), t.links.count(), t.collections.count(), t.agents.count(), t.contexts.count()) == (27, 25, 5, 4, 1)
    assert t.links.select("relationship_type").distinct().count() == 9
    report = analytics.health_report(t.memories, t.links, NOW).first()
    assert report["nodes"] == 27 and report["edges"] == 25 and 0 <= report["score"] <= 100
    assert "low density" in {r["issue"] for r in analytics.recommendations(t.memories, t.links).collect()}
    scores = analytics.forgetting_scores(t.memories, t.links, t.context_members, NOW).collect()
    assert len(scores) == 27 and all(r["context_references"] == 1 for r in scores)
    m, l, k = analytics.optimized(t.memories, t.links, t.context_members, NOW)
    assert m.where("source <> 'abstraction'").count() == 25 and k.count() == 25 and links.orphans(l, m).isEmpty()


def test_synthetic_is_deterministic(spark):
    a, b = synthetic(spark, 200), synthetic(spark, 200)
    assert rows(a.links.select("id", "source_id", "target_id", "weight")) == rows(b.links.select("id", "source_id", "target_id", "weight"))
    assert a.memories.agg(F.min("confidence")).first()[0] >= 0.7 and links.orphans(a.links, a.memories).isEmpty()
