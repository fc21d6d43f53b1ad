"""The optimised graph keeps its bridges."""

from __future__ import annotations

import datetime as dt
import itertools
import random

from lorekeep.operators import analytics
from lorekeep.sources.catalog import from_rows

NOW = dt.datetime(2024, 3, 1)


def test_a_bridge_is_not_the_most_forgettable(spark):
    made = [(f"m{i}", f"about {i}", "s", 0.4 if i == 5 else 0.5, 0.5, 0, NOW, NOW, None, None) for i in range(10)]
    chain = [(f"l{i}", f"m{i}", f"m{i + 1}", "k", 1.0, None) for i in range(9)]
    t = from_rows(spark, memories=made, links=chain)
    left = {r["id"] for r in analytics.optimized(t.memories, t.links, t.context_members, NOW)[0].collect()}
    assert {m[0] for m in made} - left == {"m0"}
    without = analytics.optimized(t.memories, t.links, t.context_members, NOW, with_betweenness=False)[0].collect()
    assert {m[0] for m in made} - {r["id"] for r in without} == {"m5"}


def test_scores_against_brute_force(spark):
    """Every term of the registered score, betweenness by weight and PageRank to convergence among them."""
    from test_loops import plain_betweenness

    rng = random.Random(6)
    ids = [f"m{i}" for i in range(9)]
    made = [(v, f"about {v}", "s", rng.random(), 0.5, 0, NOW - dt.timedelta(days=rng.randrange(1, 60)), NOW, None, None) for v in ids]
    pairs = {(a, b): rng.choice([0.25, 0.5, 1.0]) for a, b in itertools.permutations(ids, 2) if rng.random() < 0.25}
    t = from_rows(
        spark, memories=made, links=[(f"l{i}", a, b, "k", w, None) for i, ((a, b), w) in enumerate(pairs.items())],
        contexts=[("c", "C", "", None)], context_members=[("c", v) for v in ids[:4]],
    )
    n, rank = len(ids), dict.fromkeys(ids, 1 / len(ids))
    out = {a: sum(w for (x, _), w in pairs.items() if x == a) for a in ids}
    for _ in range(200):
        idle = sum(rank[v] for v in ids if not out[v])
        rank = {v: 0.15 / n + 0.85 * (sum(rank[a] * w / out[a] for (a, b), w in pairs.items() if b == v) + idle / n) for v in ids}
    between = plain_betweenness(pairs, ids)
    oldest = max((NOW - m[6]).total_seconds() for m in made)
    for r in analytics.forgetting_scores(t.memories, t.links, t.context_members, NOW).collect():
        v = r["id"]
        recency = 1 - (NOW - made[ids.index(v)][6]).total_seconds() / oldest
        central = (sum(b == v for _, b in pairs) / (n - 1) + rank[v] + between[v]) / 3
        want = 0.4 * (1 - recency) + 0.3 * (1 - made[ids.index(v)][3]) + 0.3 * (1 - central)
        assert abs(r["score"] - want) < 1e-5 and r["context_references"] == int(v in ids[:4])
