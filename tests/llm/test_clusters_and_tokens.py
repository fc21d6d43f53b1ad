"""Centroid clustering, alignment of tokenizers and removal of repeated bytes: brute force and edge cases."""

from __future__ import annotations

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorekeep.llm import centroids, queries, suffix_dedup, token_alignment

#: Names that operators use themselves, as further columns of the input.
CLASH = ("v", "cluster", "upper", "near", "low", "rest", "used", "distance", "chunk", "anchor", "seen", "sid", "route", "hot", "segment", "size", "group", "pair", "total", "corpus", "best", "link", "times", "removed", "kept", "of", "b")


def clashing(df):
    return df.withColumns({c: F.lit("x") for c in CLASH})


# centroid clustering


def plain_clusters(rows, k=centroids.CENTROIDS, rounds=centroids.ROUNDS):
    """(id, cluster, distance) by comparing everything, with Python's integers; and the centroids."""
    big = float(centroids.LARGEST)
    kept = [(i, [math.floor(max(-big, min(big, 64 * x))) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    at = [v for _, v in sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))[:k]]
    for turn in range(rounds + 1):
        found = []
        for i, v in kept:
            d = [sum((a - b) ** 2 for a, b in zip(v, c, strict=True)) for c in at]
            j = d.index(min(d))
            found.append((i, j, d[j], v))
        if turn < rounds:
            for j in range(len(at)):
                own = [v for _, c, _, v in found if c == j]
                if own:
                    at[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    return Counter((i, j, d) for i, j, d, _ in found), at


def vectors(n, seed, spread=1.0, kinds=40):
    """Vectors on a coarse grid, so that distances tie and rows repeat."""
    rng = np.random.default_rng(seed)
    base = np.round(rng.normal(size=(kinds, 64)) * spread * 2) / 64
    return [(i, [float(x) for x in base[rng.integers(kinds)] + np.round(rng.normal(size=64)) / 64 * (i % 3)]) for i in range(n)]


def test_clusters(spark):
    rows = [*vectors(400, 1), (7, [0.5] * 64), (7, [0.5] * 64), (None, [0.25] * 64), (None, [0.25] * 64), (900, None), (901, []), (902, [1.0] * 63), (903, [1.0] * 65)]
    rows += [(904, [float("nan")] * 64), (905, [float("inf")] + [0.0] * 63), (906, [None] + [0.0] * 63), (907, [1e30] * 64), (908, [-3e9] * 64)]
    df = clashing(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(3))
    want, at = plain_clusters(rows)
    got = centroids.cluster(df).collect()
    assert Counter((r["vec_id"], r["cluster"], r["distance"]) for r in got) == want
    for r in got:
        assert r["cluster_inertia"] == sum(d * n for (_, j, d), n in want.items() if j == r["cluster"])
        assert r["inertia"] == sum(d * n for (_, _, d), n in want.items())
        assert r["centroid_sha256"] == hashlib.sha256(",".join(map(str, at[r["cluster"]])).encode()).hexdigest()


def test_bounds_spare_comparisons(spark):
    """On vectors that form groups most are certified by their bounds alone, and nothing changes."""
    rows = vectors(1500, 3, spread=30.0, kinds=16)
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(2)
    state, _ = centroids.assigned(centroids.kept_vectors(df))
    used = Counter(r["used"] for r in state.collect())
    assert used[0] > 0.5 * len(rows)
    assert Counter((r["vec_id"], r["cluster"], r["distance"]) for r in state.collect()) == plain_clusters(rows)[0]


@pytest.mark.parametrize("seed", range(6))
def test_bounds_of_many_rounds(seed):
    """Centroids that wander, and lists that get shorter: always the nearest, ties to the smaller number."""
    rng = np.random.default_rng(seed)
    k = int(rng.integers(1, 24))
    v, at = rng.integers(-6, 7, (300, 5)), rng.integers(-6, 7, (k, 5))
    bounds = min(k - 1, 6)
    state = centroids.Bounds.unknown(v, bounds)
    for turn in range(12):
        state.assign(at)
        d2 = ((v[:, None] - at) ** 2).sum(2)
        assert (state.cluster == d2.argmin(1)).all()
        assert (state.upper**2 >= d2[np.arange(300), state.cluster] * (1 - 1e-9)).all()
        moved = at + rng.integers(-1, 2, at.shape) * (rng.random((k, 1)) < 0.4)
        if turn % 4 == 3:
            bounds = max(0, bounds - 1)
            state.narrow(bounds)
        state.moved(centroids.outwards(((moved - at) ** 2).sum(1), 1))
        at = moved


def test_few_and_no_vectors(spark):
    rows = [(i, [float(i)] * 64) for i in range(3)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    assert Counter((r["vec_id"], r["cluster"], r["distance"]) for r in centroids.cluster(df).collect()) == plain_clusters(rows)[0]
    empty = centroids.cluster(df.limit(0))
    assert empty.collect() == [] and empty.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


# alignment of tokenizers

TEXTS = [
    "The cat's pyjamas, 1999!  Two  spaces", "été à Århus", "    indented\n\n\ncode()  ", "日本語🙂 mixed with words", "", None, "<|endoftext|> and </s><s><unk> are text", "▁ and \u0000 and <0x41>", " ", "\n", "a" * 300 + " " * 40 + "b",
    "same text", "same text", "naïve ñandú " * 50, "tab\tand\r\nline", " no-break　space", "ﬁ ligature ½ Å",
]


def plain_tokens(tok, text):
    """(A ids, B ids), none if their bytes differ from space + text."""
    if not text:
        return [], []
    a, b = tok.a.encode(" " + text, add_special_tokens=False).ids, tok.b.encode(text)
    same = all(b"".join(names[i] for i in ids) == (" " + text).encode() for ids, names in ((a, tok.a_bytes), (b, tok.b_bytes)))
    return (a, b) if same else ([], [])


def plain_alignment(tok, texts):
    ends = lambda ids, names: list(np.cumsum([len(names[i]) for i in ids]))
    found = []
    for text in texts:
        a, b = plain_tokens(tok, text)
        ea, eb = ends(a, tok.a_bytes), ends(b, tok.b_bytes)
        links = [(x, y) for x, p in zip(a, ea, strict=True) for y, q in zip(b, eb, strict=True) if p == q]
        groups, i, j = [], 0, 0
        for cut in sorted(set(ea) & set(eb)):
            p, q = ea.index(cut) + 1, eb.index(cut) + 1
            groups.append(",".join(map(str, a[i:p])) + "|" + ",".join(map(str, b[j:q])))
            i, j = p, q
        found.append((len(a), len(b), links, groups))
    counts = Counter(x for _, _, links, _ in found for x in links)
    best = {}
    for (_, y), n in counts.items():
        best[y] = max(best.get(y, 0), n)
    return [(n_a, n_b, len(g), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for n_a, n_b, links, g in found]


def test_alignment(spark):
    tok = token_alignment.tokenizers(queries.VOCABULARY_A, queries.VOCABULARY_B)
    want = plain_alignment(tok, TEXTS)
    rows = [*enumerate(TEXTS), (None, "same text")]
    df = clashing(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3))
    got = token_alignment.align(df, queries.VOCABULARY_A, queries.VOCABULARY_B).collect()
    assert len(got) == len(rows) and sum(r["doc_id"] is None for r in got) == 1
    want = plain_alignment(tok, [t for _, t in rows])
    for r in got:
        k = r["doc_id"] if r["doc_id"] is not None else len(TEXTS)
        assert tuple(r[1:]) == want[k], rows[k]
    assert [r[1:] for r in got if r["doc_id"] in (4, 5)] == [(0, 0, 0, 0, 0, 0, "")] * 2
    assert token_alignment.align(df.limit(0), queries.VOCABULARY_A, queries.VOCABULARY_B).collect() == []


def test_parts_of_long_texts():
    """A text that is encoded in parts has the tokens of the whole."""
    tok = token_alignment.tokenizers(queries.VOCABULARY_A, queries.VOCABULARY_B)
    rng = random.Random(5)
    said = ["word", "it's", "été", "日本語", "12,345", "\n", "  ", "\t", "code();", "🙂", "x" * 30, "</s>"]
    text = " ".join(rng.choice(said) for _ in range(3000))
    cut = token_alignment.parts(text, 200)
    assert len(cut) > 20 and " ".join(cut) == text
    a, b = tok.encode(cut)
    assert ([x for p in a for x in p], [x for p in b for x in p]) == plain_tokens(tok, text)
    assert token_alignment.parts("日" * 5000, 100) == ["日" * 5000]
    whole = token_alignment._encoded(tok, [("ab " * 600_000).encode(), b"", b"\xff\xfe broken"])
    assert len(whole[0][0]) and [len(x) for x in whole[0][1:]] == [0, 0]


# repeated bytes


def plain_removal(rows, length):
    """For each row (spans, what is left), by a table of all windows."""
    said = [(math.inf if i is None else i, (t or "").encode() if not isinstance(t, bytes) else t) for i, t in rows]
    least = {}
    for i, t in said:
        for p in range(len(t) - length + 1):
            w = t[p : p + length]
            least[w] = min(i, least.get(w, math.inf))
    out = []
    for i, t in said:
        gone = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if least[t[p : p + length]] < i:
                gone[p : p + length] = b"\1" * length
        spans = [(p, next((q for q in range(p, len(t)) if not gone[q]), len(t))) for p in range(len(t)) if gone[p] and (p == 0 or not gone[p - 1])]
        out.append((len(t), spans, bytes(c for c, g in zip(t, gone, strict=True) if not g)))
    return out


def held_against_plain(spark, rows, length):
    numbered = [(i, t, n) for n, (i, t) in enumerate(rows)]
    df = clashing(spark.createDataFrame(numbered, "doc_id bigint, text string, n int").repartition(3))
    got = suffix_dedup.remove_repeated(df, length=length).collect()
    want = Counter((i, n, tuple(spans), kept) for (i, _), (n, spans, kept) in zip(rows, plain_removal(rows, length), strict=True))
    assert Counter((r["doc_id"], r["n_bytes"], tuple((s["start"], s["end"]) for s in r["removed"]), bytes(r["kept"])) for r in got) == want
    return want


@pytest.mark.parametrize(("length", "letters"), [(50, "ab"), (9, "abcd é"), (25, "ab\u0000日")])
def test_repeated_bytes(spark, length, letters):
    rng = random.Random(length)
    phrases = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 3 * length))) for _ in range(25)]
    rows = [(i, "".join(rng.choice(phrases) if rng.random() < 0.5 else rng.choice(letters) for _ in range(rng.randrange(12)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "x" * (length - 1)), (103, "a" * 5000), (104, "a" * 4000 + "b"), (3, rows[3][1]), (5, phrases[0] * 2), (None, rows[7][1] * 2), (None, rows[7][1] * 2), (-4, phrases[1] * 3)]
    want = held_against_plain(spark, rows, length)
    assert any(spans for _, _, spans, _ in want)


def test_hot_strings(spark):
    """A string that begins very many different segments, and a passage in a third of all documents."""
    rng = random.Random(11)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    phrase, passage = word(22), word(400)
    rows = [(i, "".join(phrase + word(40) for _ in range(60)) + (passage if i % 3 == 0 else "") + word(50)) for i in range(200)]
    assert sum(t.count(phrase) for _, t in rows) > suffix_dedup.HOT
    want = held_against_plain(spark, rows, suffix_dedup.LENGTH)
    assert sum(bool(spans) for _, _, spans, _ in want) >= 66


def test_nothing_repeated(spark):
    df = spark.createDataFrame([(1, "short"), (2, "short")], "doc_id bigint, text string")
    assert sorted((r["doc_id"], bytes(r["kept"]), r["removed"]) for r in suffix_dedup.remove_repeated(df).collect()) == [(1, b"short", []), (2, b"short", [])]
    assert suffix_dedup.remove_repeated(df.limit(0)).collect() == []


@pytest.mark.parametrize("seed", range(8))
def test_prefix_groups(seed):
    """The boundaries of the transform against suffixes compared as strings."""
    rng = np.random.default_rng(seed)
    n, length = int(rng.integers(1, 400)), int(rng.integers(1, 60))
    text = np.append(rng.integers(0, int(rng.integers(2, 5)), n), 0).astype(np.int16)
    order = suffix_dedup.sorted_suffixes(text, length)
    divided = suffix_dedup.prefix_groups(text, order, length)
    whole = [text[p : p + length].tolist() for p in order]
    said = [tuple(x[: x.index(0) + 1] if 0 in x else x) for x in whole]  # nothing counts behind a 0
    assert said == sorted(said)
    for k in range(1, len(said)):
        same = said[k] == said[k - 1] and len(said[k]) == length and 0 not in said[k]
        assert divided[k] == (not same)
