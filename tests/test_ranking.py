"""Ranked text search, and accesses as of a time, against plain loops."""

from __future__ import annotations

import datetime as dt
import math
import random
from collections import Counter

import pytest

from lorekeep.functions.text import _stem_of
from lorekeep.operators import forgetting, ranking
from lorekeep.operators.ranking import RankedIndex
from lorekeep.sources.catalog import from_rows

NOW = dt.datetime(2024, 3, 1)


def said(rng, common, rare):
    return " ".join(rng.choice(common) if rng.random() < 0.9 else rng.choice(rare) for _ in range(rng.randrange(3, 60)))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(30)
    common = [f"w{c}x" for c in "abcdefghijklmnopqrst"] + ["of", "it"]
    rare = [f"{c}{d}zz" for c in "abcdef" for d in "ghijkl"]
    out = {f"m{i:04}": said(rng, common, rare) for i in range(1500)}
    for i in range(0, 60, 3):  # a few that say a word over and over
        out[f"m{i:04}"] = " ".join(["agzz"] * (i // 3 + 2) + out[f"m{i:04}"].split()[:5])
    return out | {"empty": "", "short": "of it"}


@pytest.fixture(scope="module")
def index(spark, texts):
    rows = [(i, t, "s", 0.5, 0.5, 0, NOW, NOW, None, "{}") for i, t in texts.items()] + [("none", None, "s", 0.5, 0.5, 0, NOW, NOW, None, "{}")]
    return RankedIndex.build(from_rows(spark, memories=rows).memories)


def plain_scores(texts, query):
    stems = {i: [_stem_of(w) for w in t.lower().split() if len(w) >= 3] for i, t in texts.items()}
    stems = {i: s for i, s in stems.items() if s}
    mean = sum(map(len, stems.values())) / len(stems)
    out = Counter()
    for q in {_stem_of(w) for w in query.lower().split() if len(w) >= 3}:
        having = {i: s.count(q) for i, s in stems.items() if q in s}
        weight = math.log(1 + (len(stems) - len(having) + 0.5) / (len(having) + 0.5))
        for i, tf in having.items():
            out[i] += weight * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(stems[i]) / mean))
    return {i: round(x, 6) for i, x in out.items()}


@pytest.mark.parametrize("query", ["agzz", "agzz wax", "agzz bhzz wbx", "wax wbx wcx", "nowhere", "", "agzz agzz nowhere"])
def test_best_by_bm25(index, texts, query):
    want = plain_scores(texts, query)
    got = {r["memory_id"]: r["score"] for r in index.scores(query).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 2e-6 for i in want)
    for k in (1, 10):
        best = index.search(query, k).collect()
        order = sorted(want, key=lambda i: (-want[i], i))[:k]
        assert [r["rank"] for r in best] == list(range(1, len(order) + 1))
        assert [r["score"] for r in best] == pytest.approx([want[i] for i in order], abs=2e-6)
        assert {r["memory_id"] for r in best} == set(order) or abs(want[order[-1]] - sorted(want.values())[-k - 1]) < 2e-6


def test_a_search_stops_early(index, texts):
    """A rare word said over and over is found in the highest bands; the many postings of a common one below are left."""
    all_of = lambda *words: index.postings.where(index.postings["stem"].isin(list(words))).count()
    index.search("agzz", 5).collect()
    assert 5 <= index.read <= 0.7 * all_of("agzz")
    index.search("agzz wax", 5).collect()
    assert index.read <= 0.7 * all_of("agzz", "wax")


def test_accesses_as_of(spark):
    rng = random.Random(31)
    memories = [(f"m{i}", "x", "s", 0.5, 0.5, i, NOW, NOW + dt.timedelta(days=i % 3), None, "{}") for i in range(8)]
    log = [(f"m{rng.randrange(7)}", NOW + dt.timedelta(hours=rng.randrange(200))) for _ in range(120)] + [(None, NOW), ("nobody", NOW), ("m1", None)]
    times = [NOW, NOW + dt.timedelta(hours=50), NOW + dt.timedelta(hours=50), NOW + dt.timedelta(hours=199), NOW - dt.timedelta(days=9), None]
    rows = from_rows(spark, memories=memories).memories
    accesses = spark.createDataFrame(log, "memory_id string, accessed_at timestamp_ntz")
    got = forgetting.accesses_as_of(rows, accesses, spark.createDataFrame([(t,) for t in times], "at timestamp_ntz")).collect()
    want = set()
    for t in {t for t in times if t}:
        for m in memories:
            seen = [at for i, at in log if i == m[0] and at and at <= t]
            want.add((m[0], t, m[5] + len(seen), max([m[7], *seen])))
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    history = forgetting.access_history(accesses).collect()
    assert len(history) == 121
    for m in {r["memory_id"] for r in history}:
        own = sorted((r for r in history if r["memory_id"] == m), key=lambda r: r["nth"])
        at = sorted(t for i, t in log if i == m and t)
        assert [r["accessed_at"] for r in own] == at and [r["nth"] for r in own] == list(range(1, len(at) + 1))
        assert {r["first_access"] for r in own} == {at[0]} and [r["since"] for r in own] == [None, *[(b - a).total_seconds() for a, b in zip(at, at[1:], strict=False)]]


def test_scores_without_an_index(spark, texts, index, monkeypatch):
    """One reading of the texts gives the index's scores and writes the postings of the query only; rows that share an id are one memory."""
    row = lambda i, t: (i, t, "s", 0.5, 0.5, 0, NOW, NOW, None, "{}")
    whole = from_rows(spark, memories=[row(i, t) for i, t in texts.items()] + [row("none", None)]).memories
    words = {i: t.split() for i, t in texts.items()}
    halves = from_rows(spark, memories=[row(i, " ".join(w[k::2])) for i, w in words.items() for k in (0, 1)]).memories
    written, keep = {}, ranking.materialize
    monkeypatch.setattr(ranking, "materialize", lambda df, name, **more: written.setdefault(name, keep(df, name, **more)))
    for query in ("agzz bhzz wbx", "nowhere", ""):
        want = plain_scores(texts, query)
        for memories in (whole, halves):
            written.clear()
            got = {r["memory_id"]: r["score"] for r in ranking.scan_scores(memories, query).collect()}
            assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 2e-6 for i in want)
            stems = {r["stem"] for r in written["said"].selectExpr("inline(counts)").collect()}
            assert "counted" not in written and stems <= {_stem_of(w) for w in query.split()}
    written.clear()
    built = RankedIndex.build(halves)
    assert "counted" not in written and built.postings.select("stem", "memory_id", "tf", "length").exceptAll(index.postings.select("stem", "memory_id", "tf", "length")).isEmpty()
