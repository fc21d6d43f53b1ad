"""Exact, near and line deduplication, mixing, and the pipeline, against brute force."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lorekeep.llm import exact_dedup, mixing, simhash_dedup, substring_dedup

from test_near_copies import plain_kept

#: Names that operators use themselves, as further columns of the input.
CLASH = (
    "keep_id", "group_size", "kept", "text_sha256", "fp", "h", "key", "_key", "sha", "_sha", "best", "_best", "frequent", "digest", "copies", "run", "pos", "src", "skey", "docs",
    "row", "spans", "removed", "unit", "start", "end", "first", "n", "size", "taken", "target", "node", "component_id", "_id", "_kept", "text_",
)


def table(spark, rows, schema="doc_id bigint, text string, source string", clash=True):
    df = spark.createDataFrame(rows, schema)
    return df.withColumns({c: F.lit("x") for c in CLASH}) if clash else df


def said(rng, n):
    return " ".join(rng.choice(["stone", "river", "garden", "window", "letter", "summer"]) + str(rng.randrange(9)) for _ in range(n))


ODD = [(1, None, "a"), (2, "", "a"), (3, "  \n ", None), (4, "word " * 20_000, "b"), (5, "x" * 50_000, "b"), (6, "Same Text", "a"), (7, "same text", "a"), (7, "same text", "a"), (None, "same text", None), (None, "no id", "c"), (8, "É été", "c"), (9, "é été", "c")]


# exact


def plain_groups(rows):
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(low(t), []).append(i)
    out = []
    for i, t, *_ in rows:
        ids = groups[low(t)]
        keep = max((x for x in ids if x is not None), default=None)
        out.append((i, keep, len(ids), i == keep, hashlib.sha256(low(t).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("tracked", [4, 1024])
def test_exact_groups(spark, tracked):
    rng = random.Random(1)
    rows = [*ODD, *[(100 + i, rng.choice(["HOT text", "hot TEXT", said(rng, 3), f"rare {i % 40}"]), "s") for i in range(300)]]
    got = exact_dedup.exact_groups(table(spark, rows).repartition(7), tracked=tracked)
    assert sorted(map(tuple, got.collect()), key=str) == plain_groups(rows)
    left = exact_dedup.drop_exact_copies(table(spark, rows).repartition(7), tracked=tracked)
    assert left.columns == table(spark, rows).columns
    left = left.collect()
    assert all(r[c] == "x" for r in left for c in CLASH)
    kept = sorted(((r["doc_id"], r["text"]) for r in left), key=str)
    texts = Counter(hashlib.sha256((t or "").encode()).hexdigest() for _, t in kept)
    want = {(k, sha) for i, k, _, stays, sha in plain_groups(rows) if stays}
    assert len(kept) == len(want) and max(texts.values()) == 1


# near


def plain_near(rows, size=4, distance=4):
    fps = []
    for i, t, *_ in rows:
        w = (t or "").encode().lower().split()
        grams = [b" ".join(w[k : k + size]) for k in range(max(1, len(w) - size + 1))] if w else []
        hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        fps.append((i, sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if grams else 0))
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a][1] ^ fps[b][1]).bit_count() <= distance and find(a) != find(b):
                parent[find(a)] = find(b)
    lowest = {}
    for k, (i, _) in enumerate(fps):
        if i is not None:
            lowest[find(k)] = min(lowest.get(find(k), i), i)
    return sorted(((i, f"{fp:016x}", lowest.get(find(k))) for k, (i, fp) in enumerate(fps)), key=str)


def near_rows(seed):
    rng = random.Random(seed)
    rows = [r for r in ODD if r[1] is None or len(r[1]) < 40_000]
    base = [said(rng, 120) for _ in range(6)]
    for i in range(160):
        words = base[i % 6].split()
        for _ in range(rng.randrange(0, 5)):
            words[rng.randrange(len(words))] = f"new{rng.randrange(99)}"
        rows.append((100 + i, " ".join(words).upper() if i % 7 == 0 else " ".join(words), "s"))
    return rows


@pytest.mark.parametrize("block", [20_000, 6])
def test_near_groups(spark, monkeypatch, block):
    monkeypatch.setattr(simhash_dedup, "BLOCK", block)
    rows = near_rows(2)
    got = simhash_dedup.near_groups(table(spark, rows).repartition(5))
    assert sorted(map(tuple, got.collect()), key=str) == plain_near(rows)


def test_every_allocation_keeps_the_links():
    """Any thresholds that the dynamic program may choose meet all close pairs, on correlated bits too."""
    rng = np.random.default_rng(3)
    fps = rng.integers(0, 2**63, 300, dtype=np.uint64)
    fps = np.concatenate([fps, fps ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64))])
    fps[:200] |= np.uint64(0xFF00)
    bits = np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(float)
    both = bits.T @ bits
    close = {(a, b) for a in range(len(fps)) for b in np.flatnonzero(np.bitwise_count(fps ^ fps[a]) <= 4) if a < b}
    for scale in (1, 1e3, 1e6, 1e9):
        _, parts = simhash_dedup.allocate(both * scale, int(len(fps) * scale), 4)
        used = [b for bits_, _ in parts for b in bits_]
        assert len(used) == len(set(used)) and sum(t for _, t in parts) - (5 if scale < 0 else 0) >= 0
        for a, b in close:
            assert any(sum(int(fps[a] ^ fps[b]) >> k & 1 for k in bits_) <= t for bits_, t in parts)


def test_large_buckets():
    rng = np.random.default_rng(4)
    center = rng.integers(0, 2**63, 1, dtype=np.uint64)[0]
    group = np.unique(np.array([center ^ sum(np.uint64(1) << np.uint64(b) for b in rng.integers(0, 64, 2)) for _ in range(400)], np.uint64))
    a, b = simhash_dedup._links(np.zeros(len(group), np.int64), group, [group], 4)
    assert len(a) == len(group) - 1  # a tree, and not all pairs
    node, root = simhash_dedup._minima(a, b)
    assert set(root) == {group.min()} and len(node) == len(group) - 1


@pytest.mark.parametrize("local", [1_000_000, 0])
def test_components(spark, monkeypatch, local):
    monkeypatch.setattr(simhash_dedup, "MOST_LOCAL", local)
    rng = random.Random(5)
    assert simhash_dedup.components(spark.createDataFrame([], "node bigint, root bigint")).isEmpty()
    edges = [(i, i + 1) for i in range(0, 60)] + [(-5, i) for i in range(400, 1700)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(70)]
    got = {r["node"]: r["root"] for r in simhash_dedup.components(spark.createDataFrame(edges, "node bigint, root bigint")).collect()}
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in parent if find(x) != x}


# lines


def plain_units(text):
    """(start, end, words) of the units that have a word."""
    out, at, text = [], 0, text or ""
    for k, c in enumerate([*text, "\n"]):
        if c == "\n" or c == " " and k and text[k - 1] in ".!?":
            if text[at:k].split():
                out.append((at, k, text[at:k].lower().split()))
            at = k + 1
    return out


def plain_lines(rows, least):
    """(row, id, unit, start, end, words, first id, first unit) of what goes: every place is held against every earlier one."""
    of = {k: plain_units(t) for k, (_, t, *_) in enumerate(rows)}
    rank = {k: (rows[k][0] is None, rows[k][0] or 0, k) for k in of}
    said = {k: [" ".join(words) for _, _, words in found] for k, found in of.items()}
    places = {}
    for k, lines in said.items():
        for u, line in enumerate(lines):
            places.setdefault(line, []).append((k, u))
    best = {}
    for k, lines in said.items():
        for u, line in enumerate(lines):
            for j, v in places[line]:
                if (rank[j], v) >= (rank[k], u) or u and v and lines[u - 1] == said[j][v - 1]:
                    continue  # not earlier, or not where a common stretch begins
                n = 0
                while u + n < len(lines) and v + n < len(said[j]) and lines[u + n] == said[j][v + n]:
                    n += 1
                if sum(len(of[k][u + i][2]) for i in range(n)) >= least:
                    for i in range(n):
                        best[k, u + i] = min(best.get((k, u + i), (rank[j], v + i)), (rank[j], v + i))
    return [(k, rows[k][0], u, *of[k][u][:2], len(of[k][u][2]), rows[r[2]][0], v) for (k, u), (r, v) in best.items()]


def cut_out(text, spans):
    keep, at = [], 0
    for a, b in sorted(spans):
        keep.append(text[at:a])
        at = b + 1
    left = "".join(keep) + (text + "\n")[at:]
    return left[:-1] if left.endswith("\n") else left


def line_rows():
    rng = random.Random(6)
    shared = [said(rng, 12) for _ in range(5)]
    rows = [(1000 + i, "\n".join(rng.choice([shared[0].upper(), rng.choice(shared), said(rng, 9), "short line", ""]) for _ in range(6)), "s") for i in range(80)]
    rows += [*ODD, (5000, "  ".join(shared[1].split()) + "\n" + shared[1], "s")]
    joined = [f"{said(rng, 9)}. {shared[2]}. {said(rng, 3)}! {shared[3]}", f"{shared[2]}. Well. {said(rng, 10)}", f"{shared[2]}.", f"{shared[2]}. Oh. {shared[3]}. {said(rng, 8)}"]
    rows += [(6000 + i, f"{said(rng, 5)}\n{j}", "s") for i, j in enumerate([*joined, joined[0], joined[3]])]
    # rows without an id, and rows that repeat one, are documents of their own
    rows += [(None, f"{shared[4]}\n{shared[0]}", None)] * 2 + [(7000, f"{shared[4]}\n{shared[1]}\n{said(rng, 4)}", "s")] * 2
    alone = said(rng, 30)
    return [*rows, (None, alone, "s"), (None, alone, "s"), (8000, f"{alone} x", "s"), (8000, f"{alone} x", "s")]


@pytest.mark.parametrize("least", [1, substring_dedup.RUN_WORDS])
def test_lines(spark, least):
    rows = line_rows()
    docs = table(spark, rows).coalesce(1)
    want = plain_lines(rows, least)
    found = substring_dedup.repeated_lines(docs, run_words=least)
    assert sorted(map(tuple, found.collect()), key=str) == sorted((r[1:] for r in want), key=str)
    clean = substring_dedup.remove_lines(docs, run_words=least)
    assert clean.columns == [*docs.columns, "removed_"]
    clean = clean.collect()
    assert all(r[c] == "x" for r in clean for c in CLASH)
    spans = {}
    for k, _, _, a, b, *_ in want:
        spans.setdefault(k, []).append((a, b))
    expected = [(i, t if k not in spans else cut_out(t, spans[k]), sorted(spans.get(k, []))) for k, (i, t, _) in enumerate(rows)]
    assert sorted(((r["doc_id"], r["text"], [tuple(x) for x in r["removed_"]]) for r in clean), key=str) == sorted(expected, key=str)
    assert substring_dedup.repeated_lines(docs.where("false")).count() == 0 and substring_dedup.remove_lines(docs.where("false")).count() == 0


def test_passage_of_lines_that_others_had_first(spark):
    """Each line of a copied passage was in a document of its own before; the copy goes all the same."""
    rng = random.Random(12)
    lines = [said(rng, 15) for _ in range(10)]
    rows = [*((i, line, "s") for i, line in enumerate(lines)), (100, "\n".join(lines), "s"), (101, "\n".join(lines), "s")]
    found = substring_dedup.repeated_lines(table(spark, rows)).collect()
    assert sorted((r["doc_id"], r["unit"], r["keep_doc_id"], r["keep_unit"]) for r in found) == [(101, u, 100, u) for u in range(10)]
    left = {r["doc_id"]: r["text"] for r in substring_dedup.remove_lines(table(spark, rows)).collect()}
    assert left[101] == "" and left[100] == rows[10][1]


@given(st.lists(st.integers(1, 30), max_size=30), st.integers(1, 40))
@settings(max_examples=200, deadline=None)
def test_stretches(words, least):
    """Every stretch with enough words is covered by those that are hashed and lie in it, and these are the shortest."""
    found = substring_dedup.stretches(words, least)
    assert found == sorted(set(found)) and all(sum(words[a : b + 1]) >= least for a, b in found)
    for a in range(len(words)):
        for b in range(a, len(words)):
            if sum(words[a : b + 1]) >= least:
                assert set(range(a, b + 1)) == {u for p, q in found if a <= p and q <= b for u in range(p, q + 1)}
    assert len(found) <= 2 * len(words)


# mixing


def plain_targets(sizes, weights):
    """Shares by weight in small steps, until none is above 3 times its size."""
    left, open_, out = sum(sizes), {i for i, s in enumerate(sizes) if s}, [0.0] * len(sizes)
    while open_:
        total = sum(weights[i] for i in open_)
        over = {i for i in open_ if left * weights[i] / total > 3 * sizes[i]}
        if not over:
            for i in open_:
                out[i] = left * weights[i] / total
            return out
        for i in over:
            out[i] = 3.0 * sizes[i]
        left -= sum(out[i] for i in over)
        open_ -= over
    return out


def test_mix(spark):
    rng = random.Random(7)
    rows = [(i, said(rng, rng.randrange(0, 900)) + " x", rng.choice(["a", "b", "é", "Z", None, "tiny"] if i < 20 else ["a", "b", "é", "Z", None])) for i in range(400)]
    rows += [r for r in ODD]
    docs = table(spark, rows)
    got = mixing.mix(docs).collect()
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").encode().split())
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = dict(zip(names, plain_targets([sizes[s] for s in names], [1 + k % 3 for k in range(len(names))]), strict=True))
    taken = Counter()
    assert len(got) == len(rows)
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"] and r["source_size"] == sizes[r["source"]]
        assert abs(r["target"] - want[r["source"]]) < 1e-6
        taken[r["source"]] += r["taken"]
    for s in names:
        assert abs(taken[s] - want[s]) <= 0.5, (s, taken[s], want[s])
    again = mixing.mix(docs.repartition(9)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


@pytest.mark.parametrize("many, words", [(200, 55), (3000, 3)])
def test_small_sources_meet_their_targets(spark, many, words):
    rng = random.Random(10)
    rows = [(i, "w " * rng.randrange(1, 2 * words), f"s{rng.randrange(many):05d}") for i in range(2 * many)]
    got = mixing.mix(table(spark, rows)).collect()
    target, taken, size = {}, Counter(), Counter()
    for r in got:
        target[r["source"]] = r["target"]
        taken[r["source"]] += r["taken"]
        size[r["source"]] += r["size"]
        assert 0 <= r["taken"] <= 3 * r["size"]
    names = sorted(size)
    want = plain_targets([size[s] for s in names], [1 + k % 3 for k in range(len(names))])
    assert all(abs(target[s] - w) < 1e-6 and abs(taken[s] - w) <= 0.5 for s, w in zip(names, want, strict=True))
    assert abs(sum(want) - sum(size.values())) < 1e-3


def test_rows_without_an_id_are_spread(spark, monkeypatch):
    """Null ids, repeated ids and equal rows: the runs stay short, and rows of each kind are all there."""
    monkeypatch.setattr(mixing, "COPIES", 16)
    rows = [(None, "w " * (1 + i % 90), "a") for i in range(900)] + [(5, "v " * 7, "a")] * 300 + [(6, "", "b")] * 3 + [(i, "u " * 9, "b") for i in range(50)]
    docs = table(spark, rows)
    got = mixing.mix(docs).collect()
    assert Counter((r["doc_id"], r["size"], r["source"]) for r in got) == Counter((i, len(t.split()), s) for i, t, s in rows)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(t.split())
    for s, want in zip("ab", plain_targets([sizes["a"], sizes["b"]], [1, 2]), strict=True):
        assert abs(sum(r["taken"] for r in got if r["source"] == s) - want) <= 0.5
    words = mixing.word_counts(docs, "doc_id", "text", "source")
    sources, _ = mixing.plan(words)
    where = mixing.placed(words, sources).collect()
    covered = Counter()
    for r in where:
        covered.update((r["src"], k) for k in range(r["start"], r["start"] + r["size"]))
    assert max(covered.values()) == 1 and len(covered) == sum(sizes.values())


def test_mixed_blocks_hold_what_the_mix_counts(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(f"d{i}w{k}" for k in range(rng.randrange(0, 90))), rng.choice("abc")) for i in range(60)]
    docs = table(spark, rows)
    blocks = mixing.mixed_blocks(docs, block=16).collect()
    seen = Counter(w.split("w")[0] for r in blocks for w in r["text"].split())
    for r in mixing.mix(docs, block=16).collect():
        assert seen[f"d{r['doc_id']}"] == r["taken"]
    assert len({(r["source"], r["slot"]) for r in blocks}) == len(blocks)


def test_permutation():
    for n in (1, 2, 3, 10, 1000, 4097):
        assert sorted(mixing.permute(np.arange(n), n, 77).tolist()) == list(range(n))
    assert mixing.permute(np.arange(100), 100, 1).tolist() != mixing.permute(np.arange(100), 100, 2).tolist()
    for n in (1, 5, 77, 4097):
        x = np.arange(n)
        assert (mixing.unpermute(mixing.permute(x, n, 5), n, 5) == x).all()
    for slots in (100, 3, 5000):
        shard, n = mixing.draw_shards(slots, 7, 1, 2)
        assert n.sum() == slots and len(set(shard)) == len(shard) and set(shard) <= set(range(7))


def test_slots_give_the_goal():
    rng = np.random.default_rng(6)
    size = rng.integers(1, 400, 3000)
    goal = np.minimum(3 * size, rng.integers(0, 900, 3000))
    key = mixing._source_key(np.arange(3000), 1)
    blocks, slots, last = mixing._slots_of(size, goal, 16, key)
    for i in range(3000):
        s = np.arange(slots[i])
        index = mixing.permute(s % blocks[i], np.full(len(s), blocks[i]), mixing._pass_key(np.full(len(s), key[i]), s // blocks[i]))
        words = np.minimum(16, size[i] - 16 * index)
        if last[i]:
            assert 0 < last[i] <= words[-1]
            words[-1] = last[i]
        assert words.sum() == goal[i]


@pytest.mark.parametrize("rows", [ODD, []], ids=["odd", "empty"])
def test_odd_rows(spark, rows):
    docs = table(spark, rows)
    n = len(rows)
    assert exact_dedup.exact_groups(docs).count() == n and simhash_dedup.near_groups(docs).count() == n and mixing.mix(docs).count() == n
    assert sorted(map(tuple, simhash_dedup.near_groups(docs).collect()), key=str) == plain_near(rows)
    assert sorted(map(tuple, substring_dedup.repeated_lines(docs.coalesce(1)).collect()), key=str) == sorted((r[1:] for r in plain_lines(rows, substring_dedup.RUN_WORDS)), key=str)


def test_pipeline(spark, tmp_path):
    import corpus_pipeline
    from lorekeep.llm import decontaminate, quality
    from lorekeep.session import materialize

    rng = random.Random(9)
    bench = [(i, said(rng, 30)) for i in range(3)]
    docs, labels = [], []
    for i in range(240):
        text = said(rng, 60)
        if i % 6 == 0:
            text = text.upper().replace(" ", "$$$ ")
        elif i % 6 == 1 and i > 6:
            text = docs[i - 6][1]
        elif i % 6 == 2:
            text = f"{text} {bench[i % 3][1]}"
        docs.append((i, text, "en", f"s{i % 3}", len(text)))
        labels.append((i, int(i % 6 != 0), 0))
    for name, rows, schema in (
        ("documents", docs, "doc_id bigint, text string, lang string, source string, n_chars bigint"),
        ("benchmark", bench, "item_id bigint, text string"),
        ("labels", labels, "doc_id bigint, quality int, toxic int"),
    ):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    now, columns = spark.read.parquet(str(tmp_path / "documents.parquet")), ["doc_id", "text", "lang", "source", "n_chars"]
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = now.collect()
        now = materialize(stage(spark, now, str(tmp_path)), name)
        rows = now.collect()
        kept[name] = (before, rows)
        if name != "mixing":
            assert now.columns == columns
    ids = lambda rows: {r["doc_id"] for r in rows}
    before, after = kept["quality_classifier"]
    assert ids(after) == {i for i in ids(before) if i % 6}
    before, after = kept["exact_dedup"]
    assert ids(after) == {i for i, _, _, stays, _ in plain_groups([(r["doc_id"], r["text"]) for r in before]) if stays}
    before, after = kept["simhash_dedup"]
    assert ids(after) == plain_kept([(r["doc_id"], r["text"]) for r in before])
    before, after = kept["decontamination"]
    assert ids(before) - ids(after) == {i for i in ids(before) if i % 6 == 2}
    assert ids(kept["mixing"][1]) == ids(after)
    total = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(str, total.collect())) == sorted(map(str, kept["mixing"][1]))
    assert decontaminate and quality
