"""The near-duplicate stage of the pipeline, against all pairs."""

from __future__ import annotations

import random

import numpy as np
import pytest

import corpus_pipeline
from lorekeep.errors import ComputationError
from lorekeep.llm import shingle_check, simhash_dedup


def grams(text, size=5):
    w = (text or "").lower().split()
    return {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()


def plain_kept(rows, similarity=0.8):
    sets, parent = [grams(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] == sets[b] or len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]) > 0:
                parent[find(a)] = find(b)
    low = {}
    for k, (i, _) in enumerate(rows):
        low[find(k)] = min(low.get(find(k), i), i)
    return set(low.values())


def planted():
    """Pairs of a similarity of 0.7 to 0.95, by words changed at a distance from each other."""
    rng, rows = random.Random(11), []
    for i in range(120):
        words = [f"w{rng.randrange(10**6)}" for _ in range(200)]
        rows.append((1000 + i, " ".join(words)))
        for k in range(1 + i % 7):
            words[10 + 25 * k] = "changed"
        rows.append((5000 + i, " ".join(words)))
    return rows + [(1, None), (2, ""), (3, " \n"), (4, "two words"), (5, "Two  WORDS"), (6, "word " * 9000)]


@pytest.mark.parametrize("block", [1_000_000, 300])
def test_stage_finds_planted_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(shingle_check, "BLOCK", block)
    rows = planted()
    docs = spark.createDataFrame([*rows, (None, rows[0][1])], "doc_id bigint, text string").repartition(3)
    left = corpus_pipeline.dissimilar_documents(spark, docs, "")
    kept = [r["doc_id"] for r in left.collect()]
    want = plain_kept(rows)
    assert kept.count(None) == 1 and {i for i in kept if i is not None} == want
    assert any(5000 + i not in want for i in range(120)) and any(5000 + i in want for i in range(120))


@pytest.mark.parametrize("block, rounds", [(1_000_000, 8), (400, 30), (400, 2)])
def test_chains_and_crowds_in_blocks(spark, monkeypatch, block, rounds):
    """Chains of copies whose ends are unlike, a crowd around one text, and two crowds that one copy joins."""
    monkeypatch.setattr(shingle_check, "BLOCK", block)
    monkeypatch.setattr(shingle_check, "ROUNDS", rounds)
    rng, rows = random.Random(14), []
    said = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    chain = said(260)
    rows += [(100 + i, " ".join(chain[6 * i : 6 * i + 120])) for i in range(20)]
    crowd = said(150)
    for i in range(60):
        words = list(crowd)
        words[rng.randrange(150)] = f"new{i}"
        rows.append((300 + i, " ".join(words)))
    rows += [(500 + i, " ".join(crowd[:110] + said(40))) for i in range(10)] + [(600, " ".join(crowd[:138] + said(12)))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    kept = {r["doc_id"] for r in simhash_dedup.drop_near_copies(docs).collect()}
    assert kept == plain_kept(rows)


def test_large_components_need_no_hub():
    sets = [shingle_check.shingles(" ".join(f"w{i + k}" for k in range(100)).encode()) for i in range(60)]
    found = shingle_check.similar_pairs(sets, 0.8)
    assert len(found) == 59 and shingle_check.similar_pairs(sets[::30], 0.8) == []


def test_the_plan_finds_what_it_predicts():
    """Pairs at the very bound, by fingerprints that differ as the formula says, are found in the planned share."""
    import numpy as np

    assert abs(simhash_dedup.differing(0.8) - 0.1515) < 1e-3
    rng = np.random.default_rng(3)
    flat = np.full((simhash_dedup.WORDS, 64, 64), 0.25)
    flat[:, np.arange(64), np.arange(64)] = 0.5
    for n in (1e3, 1e6, 1e9):
        plans = simhash_dedup.plan_search(flat * n, int(n), 0.8)
        assert 1 <= len(plans) <= simhash_dedup.WORDS
        differ = rng.random((4000, len(plans), 64)) < simhash_dedup.differing(0.8)
        found = np.zeros(4000, bool)
        for k, parts in enumerate(plans):
            for bits, t in parts:
                found |= differ[:, k, bits].sum(axis=1) <= t
        assert found.mean() >= 0.994, n


def test_wide_fingerprints_differ_as_the_formula_says():
    rng = random.Random(12)
    shares = []
    for _ in range(60):
        common, own = [f"c{rng.random()}" for _ in range(320)], [f"o{rng.random()}" for _ in range(80)]
        a, b = ({hash_of(x) for x in common + own[k::2]} for k in (0, 1))
        words = [simhash_dedup.wide_simhash(as_array(x)) for x in (a, b)]
        shares.append(sum((int(x) ^ int(y)).bit_count() for x, y in zip(*words, strict=True)) / (64 * simhash_dedup.WORDS))
    assert abs(sum(shares) / len(shares) - simhash_dedup.differing(0.8)) < 0.01


def hash_of(x):
    import xxhash

    return xxhash.xxh64_intdigest(x.encode(), 42)


def as_array(x):
    import numpy as np

    return np.array(sorted(x), np.uint64)


def test_short_texts_and_odd_rows(spark):
    """Texts of 5 to 40 words with single words changed at the end, ties of ids, null ids, clashing columns."""
    from pyspark.sql import functions as F

    rng, rows = random.Random(13), []
    for i in range(150):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(5, 40))]
        rows += [(1000 + i, " ".join(words)), (3000 + i, " ".join([*words, "more"])), (5000 + i, " ".join(words[:-1] + ["other"]))]
    docs = spark.createDataFrame([*rows, (None, rows[0][1]), (None, None)], "doc_id bigint, text string")
    names = ["node", "root", "fp", "kept", "low", "copies", "component_id", "key", "n"]
    got = simhash_dedup.drop_near_copies(docs.withColumns({c: F.lit("x") for c in names}))
    assert got.columns == ["doc_id", "text", *names]
    left = got.collect()
    assert all(r[c] == "x" for r in left for c in names)
    kept, want = {r["doc_id"] for r in left if r["doc_id"] is not None}, plain_kept(rows)
    assert sum(r["doc_id"] is None for r in left) == 2
    # pairs at the very bound may be missed, none may be made up
    assert want <= kept and len(kept - want) <= 0.02 * len(rows)
    groups = simhash_dedup.similar_groups(docs).collect()
    assert len(groups) == len(rows) + 2 and {r["component_id"] for r in groups} - {None} == kept
    assert simhash_dedup.similar_groups(docs.where("false")).count() == 0


def test_a_search_that_would_miss_is_an_error():
    """No plan shows pairs of a low similarity among very many fingerprints; the pipeline's own is shown up to 10^10."""
    even = np.full((simhash_dedup.WORDS, simhash_dedup.BITS, simhash_dedup.BITS), 0.25)
    even[:, np.arange(simhash_dedup.BITS), np.arange(simhash_dedup.BITS)] = 0.5
    assert simhash_dedup.plan_search(even * 10**9, 10**9, 0.8)
    for n, similarity in ((10**9, 0.6), (10**8, 0.5)):
        with pytest.raises(ComputationError):
            simhash_dedup.plan_search(even * n, n, similarity)


def test_rows_near_by_two_words_alone_are_no_candidates(spark):
    """Among millions of texts some are near on two words by chance; such links would join all groups to one."""
    some = np.random.default_rng(5)
    fps = some.integers(0, 2**64, (60, simhash_dedup.WORDS), np.uint64)
    fps[1, :2] = fps[0, :2] ^ np.uint64((1 << 14) - 1)  # near on two words, 28 of 128 bits, and nowhere else
    flips = np.uint64(1) << some.integers(0, 64, (6, simhash_dedup.WORDS), np.uint64)
    fps[3] = fps[2] ^ np.bitwise_or.reduce(flips, axis=0)  # some 6 of 64 bits differ in each word
    rows = [(i, [int(x) for x in row.view(np.int64)]) for i, row in enumerate(fps)]
    found = simhash_dedup.close_pairs(spark.createDataFrame(rows, "node bigint, fp array<bigint>"), 0.8).collect()
    assert {frozenset((r["node"], r["root"])) for r in found} == {frozenset((2, 3))}
