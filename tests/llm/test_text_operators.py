"""Token counts, chat formatting, toxicity, language models, decontamination, quality: brute force and edge cases."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import regex
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lorekeep.llm import chat_format, common, decontaminate, lm_scoring, quality, queries, token_counts, toxicity

SCHEMA = "doc_id bigint, text string"
#: Names that operators use themselves, as further columns of the input.
CLASH = ("keep_id", "size", "score", "fp", "h", "_key", "digest", "target", "row", "word", "words", "times", "n", "n_tokens", "item_id", "start", "i", "t", "grade", "toxic", "_top")


def table(spark, rows, clash=True):
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumns({c: F.lit("x") for c in CLASH}) if clash else df


ODD = [(1, None), (2, ""), (3, "   \n\t "), (4, "word " * 20_000), (5, "x" * 50_000), (6, "same text of all"), (7, "same text of all"), (7, "same text of all"), (None, "no id here"), (8, "naïve ñandú 日本語 🙂")]


def by_id(df):
    return {r["doc_id"]: r for r in df.collect() if r["doc_id"] is not None}


# token counts


def plain_count(text, scores):
    """The fewest tokens among the best segmentations, from scratch for each pre-token."""
    total = 0
    for piece in regex.findall(token_counts.PATTERN, text):
        raw = piece.encode()
        best = [(0.0, 0)]
        for end in range(1, len(raw) + 1):
            options = [(best[at][0] + scores[raw[at:end]], -(best[at][1] + 1)) for at in range(end) if raw[at:end] in scores]
            s, n = max(options)
            best.append((s, -n))
        total += best[-1][1]
    return total


def test_token_counts(spark):
    scores = token_counts.zipf_scores(token_counts.read_ranks(queries.VOCABULARY))
    texts = [(i, t) for i, t in enumerate(["The cat's pyjamas, 1999!  Two  spaces", "été à Århus", "    indented\n\n\ncode()  ", "日本語🙂", "", "a" * 90 + " " * 40])]
    got = by_id(token_counts.token_counts(table(spark, texts), queries.VOCABULARY))
    for i, text in texts:
        assert got[i]["n_tokens"] == plain_count(text, scores), text
        assert got[i]["n_chars"] == len(text) and got[i]["n_pretokens"] == len(regex.findall(token_counts.PATTERN, text))


def test_trie_agrees_with_a_unigram_model():
    """On a small vocabulary without ties, against the library's own unigram segmentation."""
    from tokenizers import Tokenizer, models

    pieces = {"a": -3.1, "b": -3.3, "c": -3.7, "ab": -4.2, "bc": -4.9, "abc": -6.4, "ca": -5.3, "cab": -7.9}
    model = Tokenizer(models.Unigram([("<unk>", -99.0), *pieces.items()], 0, False))
    trie = token_counts.Pieces({k.encode(): v for k, v in pieces.items()})
    rng = random.Random(1)
    said = list({"".join(rng.choice("abc") for _ in range(rng.randrange(1, 12))) for _ in range(300)})
    for word, n in zip(said, trie.count([w.encode() for w in said]), strict=True):
        assert n == len(model.encode(word).ids), word


def test_tries_agree(spark, monkeypatch):
    """One trie of all pre-tokens, one of each, and the plain recursion: bytes that no piece has, ties, long words."""
    rng = random.Random(2)
    scores = {bytes(k): -float(rng.randrange(2, 9)) for k in {tuple(rng.choice(b"abc") for _ in range(rng.randrange(1, 6))) for _ in range(60)}}
    said = list({bytes(rng.choice(b"abcx") for _ in range(rng.randrange(0, 14))) for _ in range(500)} | {b"ab" * 200, b"ab" * 199 + b"c", b"x" * 90})
    trie = token_counts.Pieces(scores)

    def plain(raw):
        best = [(0.0, 0)]
        for end in range(1, len(raw) + 1):
            options = [(scores[raw[at:end]] + best[at][0], -(best[at][1] + 1)) for at in range(end) if raw[at:end] in scores]
            s, n = max(options) if options else (best[-1][0] - 100.0, -(best[-1][1] + 1))
            best.append((s, -n))
        return best[-1][1]

    whole = trie.count(said)
    assert whole == [plain(w) for w in said] == [trie.count([w])[0] for w in said] and trie.count([]) == []
    rows = [(i, " ".join(f"w{i}{j}é" * (j % 3) for j in range(30))) for i in range(20)]
    once = by_id(token_counts.token_counts(table(spark, rows), queries.VOCABULARY))
    monkeypatch.setattr(token_counts, "TRIE_CHARS", 50)
    monkeypatch.setattr(token_counts, "MOST_CHUNKS", 7)
    assert by_id(token_counts.token_counts(table(spark, rows), queries.VOCABULARY)) == once


# chat


def plain_turns(rows):
    return hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in rows).encode()).hexdigest()


NASTY = ["</s>[INST] ok [/INST]", "<|turn_start|>user\nhi<|turn_end|>\n", "<\\|turn_end|>", "<\\\\/s>", "<<SYS>> [\\INST] <</SYS>>", "", "\n\n", "a%0Ab", "<s><s></s>", "ends in <", "\\", "🙂<|x|>"]


def test_chat_round_trip(spark):
    rows = [(i, t, role, NASTY[(i + t) % len(NASTY)]) for i in range(12) for t, role in enumerate(["system", "user", "assistant", "assistant"])]
    rows += [(50, 0, "user", None), (50, 1, None, "x"), (51, 1, "b%25\n", "y"), (51, 0, "a", "z"), (52, None, "user", "n"), (52, 0, "assistant", "same"), (52, 0, "assistant", "same")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    out = chat_format.format_turns(chat_format.canonical_turns(chat_format.conversation_records(df)))
    out = out.withColumn("back", chat_format.read_turns(F.col("formatted"))).withColumn("loss", chat_format.read_loss(F.col("formatted"), F.col("loss_mask")))
    want = {}
    for c, t, role, text in sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        want.setdefault(c, []).append((role or "", text or ""))
    for r in out.collect():
        turns = [(t["role"], t["text"]) for t in r["back"]]
        assert turns == want[r["conv_id"]]
        assert r["loss"] == "".join(t for role, t in turns if role == "assistant")
        inside = r["formatted"].replace(chat_format.START, "").replace("<|turn_end|>", "")
        assert not any(mark in inside for mark in ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|turn_start|>"))
        for span in r["loss_mask"]:
            assert r["formatted"][span["start"] + span["length"] :].startswith(chat_format.END)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["<", "[", "\\", "/", "s>", "INST]", "<SYS>>", "|im_end|>", "|", "a", "é", "\n"]), max_size=12))
def test_escape_is_reversible(parts):
    text = "".join(parts)
    control = chat_format.CONTROL
    escaped = regex.sub(rf"([<\[])(\\*)(?={control})", r"\1\\\2", text)
    assert not regex.search(rf"[<\[](?={control})", escaped)
    assert regex.sub(rf"([<\[])\\(\\*)(?={control})", r"\1\2", escaped) == text


def test_odd_conversations(spark):
    """A null conversation id, a very long text, columns with the names that are used inside."""
    long = "tale </s> " * 30_000
    rows = [(None, 0, "user", "q"), (None, 1, "assistant", "a"), (1, 0, "user", long), (1, 1, "assistant", long)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    records = chat_format.conversation_records(df).withColumns({c: F.lit("x") for c in ("mark", "written", "_mark", "_written", "layout", "w")})
    out = chat_format.format_turns(chat_format.canonical_turns(records))
    got = {r["conv_id"]: r for r in out.withColumn("back", chat_format.read_turns(F.col("formatted"))).collect()}
    assert [t["text"] for t in got[None]["back"]] == ["q", "a"] and [t["text"] for t in got[1]["back"]] == [long, long]
    assert all(r[c] == "x" for r in got.values() for c in ("mark", "written", "_mark", "_written", "w")) and got[1]["layout"] == "messages"


def test_lists_of_another_shape(spark):
    """Elements are judged by the fields that a row fills, and a list with other fields is no layout."""
    both = spark.createDataFrame(
        [(1, [("user", "q", None, None)]), (2, [(None, None, "user", "q")]), (3, [(None, "q", "user", None)])],
        "id int, messages array<struct<role:string,content:string,from:string,value:string>>",
    )
    got = {r["id"]: r for r in chat_format.canonical_turns(both).collect()}
    assert got[1]["layout"] == "messages" and got[2]["layout"] is None and got[3]["layout"] is None
    other = spark.createDataFrame([(1, [("q", 1)])], "id int, messages array<struct<said:string,n:int>>")
    assert chat_format.canonical_turns(other).first()["layout"] is None


def test_layouts(spark):
    lines = [
        '{"id": 1, "messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}',
        '{"id": 2, "conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}',
        '{"id": 3, "prompt": "q", "completion": "a"}',
        '{"id": 4, "instruction": "q", "input": "", "output": "a"}',
        '{"id": 5, "instruction": "q", "output": "a"}',
        '{"id": 6, "system": "s", "prompt": "q", "response": "a"}',
        '{"id": 7, "question": "q", "answer": "a"}',
        '{"id": 8, "prompt": "q"}',
        '{"id": 9, "messages": []}',
        "broken",
    ]
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    record = F.from_json("line", chat_format.record_schema())
    got = {r["id"]: r for r in chat_format.canonical_turns(df.select(F.get_json_object("line", "$.id").alias("id"), record.alias("r")).select("id", "r.*")).collect()}
    said = lambda i: [(t["role"], t["text"]) for t in got[i]["turns"]]
    for i in ("1", "2", "3", "5", "7"):
        assert said(i) == [("user", "q"), ("assistant", "a")]
    assert said("4") == [("user", "q\n"), ("assistant", "a")] and got["4"]["layout"] == "instruction_input"
    assert said("6") == [("system", "s"), ("user", "q"), ("assistant", "a")]
    assert got["8"]["turns"] is None and got["8"]["layout"] is None and said("9") == []
    assert chat_format.format_turns(chat_format.canonical_turns(df.select(F.lit("x").alias("other")))).first()["formatted"] is None


# toxicity


def words(rng, n):
    return " ".join(rng.choice(["stone", "river", "garden", "window", "letter", "summer", "market", "bridge"]) + rng.choice(["", "s", "ing"]) for _ in range(n))


def test_toxicity_learns_and_holds_out(spark):
    rng = random.Random(2)
    docs, labels = [], []
    for i in range(600):
        bad = i % 4 == 0
        said = words(rng, 60).split()
        if bad:
            for _ in range(5):
                said[rng.randrange(len(said))] = rng.choice(["vileskunk", "rottenbrat", "dumbgoblin"])
        docs.append((i, " ".join(said)))
        labels.append((i, 1 if rng.random() > 0.1 else 0, int(bad)))
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = by_id(toxicity.toxicity(table(spark, docs), marks))
    held = [i for i, _ in docs if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sorted(i for i in got if got[i]["held_out"]) == held
    right = sum(got[i]["predicted"] == (i % 4 == 0) for i in held) / len(held)
    assert right > 0.95
    # held-out labels change nothing
    flipped = marks.withColumn("toxic", F.when(toxicity.is_held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = by_id(toxicity.toxicity(table(spark, docs), flipped))
    assert all(abs(again[i]["score"] - got[i]["score"]) < 1e-12 for i in got)


def test_windows_cover_all_words():
    rng = random.Random(3)
    for n in (0, 1, 7, 300):
        said = [w.encode() for w in words(rng, n).split()]
        assert [w for x in toxicity.windows(said) for w in x.split()] == said
    assert [w for x in toxicity.windows([b"x" * 500, b"y"]) for w in x.split()] == [b"x" * 500, b"y"]
    text = b"ab " * 700_000 + b"y" * 3_000_000 + b" z"
    assert b"".join(text[s] for s in common.pieces(text, 1 << 20)) == text


@pytest.mark.parametrize("size", [1, 7, 100, 1 << 20])
def test_pieces_change_nothing(monkeypatch, size):
    """Windows of compression and features of quality are those of the whole text, wherever it is cut."""
    rng = random.Random(5)
    weights = np.random.default_rng(5).normal(size=quality.BUCKETS)
    for text in (b"", b" ", words(rng, 200).encode(), b"a a  b\nb b " * 40 + b"x" * 300 + b" " + "é naïve É".encode() * 9):
        whole, score = toxicity.windows(toxicity.words_of(text)), quality.score_text(text, weights)
        with monkeypatch.context() as m:
            m.setattr(toxicity, "CHUNK", size)
            m.setattr(quality, "CHUNK", size)
            assert [w for some in toxicity.all_windows(text) for w in some] == whole
            assert abs(quality.score_text(text, weights) - score) < 1e-9


def plain_toxicity(text, model):
    """The score by whole windows, compressed one by one, and the sums written out."""
    said = [w for w in "".join(c if c.isalnum() and c.isascii() or ord(c) > 127 else " " for c in (text or "").lower()).split()]
    cut, now = [], []
    for w in said:
        # a word belongs to a window if it begins within 38 bytes
        if now and len("  ".join(now).encode()) + 2 > toxicity.WINDOW - 2:
            cut.append(now)
            now = []
        now.append(w)
    if now:
        cut.append(now)
    size = lambda book, w: len(
        zstandard.ZstdCompressor(level=toxicity.LEVEL, dict_data=zstandard.ZstdCompressionDict(book, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_dict_id=False).compress(w)
    )
    saved = [size(model.ordinary, w) - size(model.ordinary + model.toxic, w) for w in ((" " + "  ".join(c) + " ").encode() for c in cut)]
    saved = [min(max(s, 0), toxicity.TOP) for s in saved]
    over = [sum(s >= k for s in saved) for k in range(1, toxicity.TOP + 1)]
    x = [math.log1p(n) for n in over] + [n / max(1, len(saved)) for n in over] + [max(saved, default=0)]
    z = sum((a - m) / s * w for a, m, s, w in zip(x, model.mean, model.spread, model.weights, strict=False)) + model.weights[-1]
    return 1 / (1 + math.exp(-z))


def toxic_rows(n=400):
    rng = random.Random(2)
    docs, labels = [], []
    for i in range(n):
        said = words(rng, 60).split()
        for _ in range(5 if i % 4 == 0 else 0):
            said[rng.randrange(len(said))] = rng.choice(["vileskunk", "rottenbrat", "dumbgoblin"])
        docs.append((i, " ".join(said)))
        labels.append((i, 1, int(i % 4 == 0)))
    return docs, labels


def test_toxicity_against_brute_force(spark):
    docs, labels = toxic_rows()
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    odd = [(1000 + k, t) for k, (_, t) in enumerate(ODD)] + [(None, "vileskunk it is"), (7, "again seven"), (2000, "dumbgoblin " * 9000)]
    df = table(spark, docs + odd)
    model = toxicity.fit(*toxicity.sample_labelled(df, marks, "doc_id", "text"))
    got = sorted(((r["doc_id"], r["score"]) for r in toxicity.toxicity(df, marks).collect()), key=str)
    want = sorted(((i, plain_toxicity(t, model)) for i, t in docs + odd), key=str)
    assert [i for i, _ in got] == [i for i, _ in want]
    assert all(abs(a - b) < 1e-9 for (_, a), (_, b) in zip(got, want, strict=True))


def test_samples_are_bounded(spark):
    """Rows that repeat an id bring one text to the driver, and no more bytes than asked for."""
    rows = [(5, "t" * (10 + i % 50)) for i in range(3000)] + [(i, "u" * 30) for i in range(100, 200)] + [(7, None), (None, "n")]
    marks = spark.createDataFrame([(5, 1), (7, 0), *[(i, i % 2) for i in range(100, 200)]], "doc_id bigint, label int")
    got = common.sample_texts(table(spark, rows), marks, "doc_id", "text", 10_000)
    assert len(got) == 102 and (b"t" * 10, 1) in got and (b"", 0) in got
    few = common.sample_texts(table(spark, rows), marks, "doc_id", "text", 100)
    assert 0 < sum(len(t) for t, _ in few) <= 100 and set(few) <= set(got)


# language models


def plain_losses(texts, words, vocabulary, smooth):
    """-log P(word | word before) of a class model: frequent words are classes, all others share one."""
    index = {w: i for i, w in enumerate(words, 2)}
    size = len(words) + 2
    said = [lm_scoring.tokenize(t) for t in texts]
    pair, second, first = Counter(), Counter(), Counter()
    for ws in said:
        ids = [1, *[index.get(w, 0) for w in ws]]
        pair.update(zip(ids, ids[1:], strict=False))
    for (a, b), n in pair.items():
        first[a] += n
        second[b] += n
    total = sum(pair.values())
    rare = Counter(w for ws in said for w in ws if w not in index)
    kinds = len(vocabulary - set(words))

    def loss(a, w):
        a, b = index.get(a, 0) if a is not None else 1, index.get(w, 0)
        p = (pair[a, b] + smooth * (second[b] + 1) / (total + size)) / (first[a] + smooth)
        return -math.log(p) - (0 if b else math.log((rare[w] + 1) / (sum(rare.values()) + kinds)))

    return loss


def test_cross_entropy(spark):
    rng = random.Random(4)
    rows = [(i, words(rng, rng.randrange(0, 40)) + rng.choice(["", ".", " Ünïcode!"])) for i in range(40)] + [(99, None), (98, "..."), (97, "once only"), (97, "stone twice"), (None, "stone once"), (None, "")]
    targets = spark.createDataFrame([(i,) for i in [*range(0, 40, 3), 3, None, 1234]], "doc_id bigint")
    size = 12
    got = sorted(map(tuple, lm_scoring.cross_entropy_difference(table(spark, rows), targets, frequent=size).collect()), key=str)
    raw = [(i, (t or "").encode()) for i, t in rows]
    count = Counter(w for _, t in raw for w in lm_scoring.tokenize(t))
    top = [w for w, _ in sorted(count.items(), key=lambda x: (-x[1], x[0]))[: size - 2]]
    assert len(top) == size - 2 < len(count)
    back = plain_losses([t for _, t in raw], top, set(count), lm_scoring.SMOOTH)
    goal = plain_losses([t for i, t in raw if i is not None and i < 40 and i % 3 == 0], top, set(count), lm_scoring.SMOOTH)
    want = []
    for i, text in raw:
        said = lm_scoring.tokenize(text)
        pairs = list(zip([None, *said], said, strict=False))
        a, b = (sum(f(*p) for p in pairs) / len(pairs) if pairs else None for f in (goal, back))
        want.append((i, len(pairs), a, b, a - b if pairs else 0.0))
    for x, y in zip(got, sorted(want, key=str), strict=True):
        assert x[:2] == y[:2] and (x[2] is None) == (y[2] is None)
        assert all(a is None or abs(a - b) < 1e-4 for a, b in zip(x[2:], y[2:], strict=True))


def test_what_is_gathered_grows_with_the_corpus(spark):
    """Every word of every document has its own count: a document whose words occur once more scores apart."""
    rows = [(i, " ".join(f"word{i}x{k}" for k in range(30))) for i in range(40)] + [(100, " ".join(f"word7x{k}" for k in range(30)))]
    got = by_id(lm_scoring.cross_entropy_difference(table(spark, rows), spark.createDataFrame([(1,)], "doc_id bigint"), frequent=12))
    assert got[7]["background_loss"] < got[8]["background_loss"] and abs(got[8]["background_loss"] - got[9]["background_loss"]) < 0.5
    assert got[1]["target_loss"] < got[8]["target_loss"]


# decontamination


def distance(a, b):
    """The least edits that turn ``a`` into some stretch of ``b``."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def edited(rng, text, n):
    out = list(text)
    for _ in range(n):
        at = rng.randrange(len(out))
        kind = rng.randrange(3)
        if kind == 0:
            out[at] = rng.choice("qzxj")
        elif kind == 1:
            del out[at]
        else:
            out.insert(at, rng.choice("qzxj"))
    return "".join(out)


def plain_fold(text):
    return "".join(map(chr, decontaminate.normalize(text)[0]))


def test_decontamination_against_brute_force(spark):
    rng = random.Random(6)
    items = [(i, words(rng, 9 + i) + ".") for i in range(6)]
    docs = []
    for i in range(90):
        body = words(rng, 30)
        if i % 3 == 0:
            item = items[i % 6][1]
            passage = edited(rng, item, rng.randrange(0, 16))
            body = f"{body}\n {passage.upper() if i % 2 else passage.replace(' ', '  ')} {words(rng, 10)}"
        docs.append((i, body))
    found = decontaminate.contaminated(table(spark, docs), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    want = set()
    index = decontaminate.Index.build(items, decontaminate.Q, decontaminate.RATE)
    for i, text in docs:
        for k, (item_id, item) in enumerate(items):
            if distance(plain_fold(item), plain_fold(text)) <= index.edits[k]:
                want.add((i, item_id))
    assert {(r["doc_id"], r["item_id"]) for r in found} == want and len(want) > 10
    texts = dict(docs)
    for r in found:
        passage = plain_fold(texts[r["doc_id"]][r["start"] : r["end"]])
        k = r["item_id"]
        assert distance(plain_fold(items[k][1]), passage) == r["edits"] <= index.edits[k]
    left = decontaminate.drop_contaminated(table(spark, docs), spark.createDataFrame(items, "item_id bigint, text string"))
    assert {r["doc_id"] for r in left.collect()} == set(texts) - {i for i, _ in want}


def test_short_items(spark):
    """Items of every length up to 60: found verbatim, and with as many edits as the rate allows."""
    rng = random.Random(16)
    said = words(rng, 40)
    items = [(m, said[7 * m % 80 :][:m]) for m in range(1, 61)] + [(100, "42 is it"), (101, "  "), (102, None)]
    docs = [(0, "so 42 is it, they said")]
    for m, item in items[:60]:
        k = int(decontaminate.RATE * len(plain_fold(item.strip())))
        docs += [(m, f"0123 {item} 4567"), (1000 + m, "98" + edited(rng, item, k) + "76"), (2000 + m, "98" + edited(rng, item, k + 3) + "76")]
    found = decontaminate.contaminated(table(spark, docs), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    want = set()
    for i, text in docs:
        for k, item in items:
            fold, whole = plain_fold((item or "").strip()), plain_fold(text)
            if 0 < len(fold) < decontaminate.Q:  # whole words
                hit = regex.search(rf"(?<![^\W_]){regex.escape(fold)}(?![^\W_])", whole) is not None
            else:
                hit = bool(fold) and distance(fold, whole) <= int(decontaminate.RATE * len(fold))
            if hit:
                want.add((i, k))
    assert {(r["doc_id"], r["item_id"]) for r in found} == want
    assert {(m, m) for m, item in items[:60] if item.strip()} | {(0, 100)} <= want and (0, 2) not in want
    assert decontaminate.drop_contaminated(table(spark, docs), spark.createDataFrame(items[-3:], "item_id bigint, text string")).count() == len(docs) - 1


def test_decontamination_in_blocks(spark, monkeypatch):
    rng = random.Random(7)
    items = [(i, words(rng, 12)) for i in range(8)]
    docs = [(i, words(rng, 400) + " " + items[i % 8][1] + " " + words(rng, 400)) for i in range(16)]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    whole = sorted(map(tuple, decontaminate.contaminated(table(spark, docs), bench).collect()))
    monkeypatch.setattr(decontaminate, "INDEX_CHARS", 150)
    assert sorted(map(tuple, decontaminate.contaminated(table(spark, docs), bench).collect())) == whole
    assert decontaminate.drop_contaminated(table(spark, docs), bench).count() == 0
    long = "filler words of no import " * 20_000
    text = long + items[0][1] + long
    hits = list(decontaminate._search([(0, text)], decontaminate.Index.build(items[:1], decontaminate.Q, decontaminate.RATE)))
    assert {h[2:4] for h in hits} == {(len(long), len(long) + len(items[0][1]))}
    # a short item at the end of a slice and in the middle of words that slices cut
    size = decontaminate.SLICE_CHARS
    text = "y" * (size - 1) + "xab" + "y" * 500 + " xab " + "z" * (2 * size - 500) + "xab"
    hits = list(decontaminate._search([(0, text)], decontaminate.Index.all([(1, "xab"), (2, "ab")], decontaminate.Q, decontaminate.RATE)[-1]))
    assert [h[1:] for h in hits] == [(1, size + 503, size + 506, 0)]


def test_items_without_an_id(spark):
    """Null and repeated item ids beside each other, null document ids, ties of passages."""
    rng = random.Random(9)
    text = words(rng, 14)
    items = spark.createDataFrame([(None, text), (3, text), (3, text), (None, words(rng, 14)), (4, None), (None, "  ")], "item_id bigint, text string")
    docs = [(1, f"so {text} it"), (None, f"{text}"), (1, f"so {text} it"), (2, "nothing of it")]
    got = Counter((r["doc_id"], r["item_id"], r["start"], r["edits"]) for r in decontaminate.contaminated(table(spark, docs), items).collect())
    assert got == Counter({(1, None, 3, 0): 2, (1, 3, 3, 0): 2, (None, None, 0, 0): 1, (None, 3, 0, 0): 1})
    left = decontaminate.drop_contaminated(table(spark, docs), items)
    assert [r["doc_id"] for r in left.collect()] == [2] and left.columns == ["doc_id", "text", *CLASH]


# quality


def test_quality(spark):
    rng = random.Random(8)
    docs, labels = [], []
    for i in range(300):
        said = words(rng, 40)
        bad = i % 5
        if bad == 0:
            said = said.upper().replace(" ", "!! ")
        elif bad == 1:
            said = " ".join(x for w in said.split()[:8] for x in [w] * 12)
        docs.append((i, said))
        if i < 200:
            labels.append((i, 0 if bad < 2 else 1, int(i % 7 == 0)))
    ratings = quality.ratings_from_labels(spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    got = by_id(quality.grade(table(spark, docs), ratings))
    new = range(200, 300)
    assert sum(got[i]["kept"] == (i % 5 >= 2) for i in new) >= 98
    assert all(0 <= got[i]["tail_probability"] <= 1 and 0 <= got[i]["expected_grade"] <= 2 for i in got)
    kept = {r["doc_id"] for r in quality.keep_good(table(spark, docs), ratings).collect()}
    assert kept == {i for i in got if got[i]["kept"]}


def plain_quality(text, model):
    """Expected grade and tail probability with every feature written out."""
    raw = (text or "").encode()
    kind = [48 if 48 <= b < 58 else 65 if 65 <= b < 91 else 97 if 97 <= b < 123 or b >= 128 else 32 if b in (9, 11, 12, 13, 32) else b for b in raw]
    said = raw.lower().split()
    grams = lambda x, n, salt: [sum(c << 8 * i for i, c in enumerate(x[k : k + n])) + (salt << 24) for k in range(len(x) - n + 1)]
    groups = [grams(raw, 3, 0), grams(kind, 1, 11), grams(kind, 2, 12), grams(kind, 3, 13), [int(a == b) + (14 << 24) for a, b in zip(said, [b"", *said], strict=False)]]
    score = 0.0
    for group, much in zip(groups, quality.GROUPS, strict=True):
        score += much * sum(model.weights[(x % 2**32) * 2654435761 % 2**32 >> 17] for x in group) / (len(group) + quality.PRIOR)
    tails = [1 / (1 + math.exp(min(40, max(-40, t - score)))) for t in model.thresholds]
    return sum(tails), tails[0]


def test_quality_against_brute_force(spark):
    rng = random.Random(8)
    docs = [(i, words(rng, 40) if i % 2 else words(rng, 40).upper().replace(" ", "!! ")) for i in range(80)] + ODD + [(99, "naïve É 12,5\t" * 300)]
    ratings = spark.createDataFrame([(i, i % 2 + int(i % 6 == 1)) for i in range(60)] + [(None, 1), (5, None), (61, None)], "doc_id bigint, grade int")
    df = table(spark, docs)
    model = quality.fit_ratings(df, ratings)
    got = sorted(((r["doc_id"], r["expected_grade"], r["tail_probability"], r["kept"]) for r in quality.grade(df, ratings).collect()), key=str)
    want = sorted(((i, *plain_quality(t, model)) for i, t in docs), key=str)
    for (i, a, b, kept), (j, c, d) in zip(got, want, strict=True):
        assert i == j and abs(a - c) < 1e-6 and abs(b - d) < 1e-6 and kept == (b >= 0.5)


def test_ordinal_fit_orders_grades():
    rng = np.random.default_rng(1)
    texts = [(("!" * g) + " plain words go here ").encode() * 6 for g in rng.integers(0, 3, 200)]
    grades = np.array([t.count(b"!") // 6 for t in texts])
    model = quality.fit(texts, grades)
    tails = model.tails(np.array([quality.score_text(t, model.weights) for t in texts]))
    assert (np.diff(model.thresholds) > 0).all() and (np.diff(tails, axis=1) <= 0).all()
    assert (np.round(tails.sum(1)) == grades).mean() > 0.95


# rows that are odd


def r_of(rows, doc_id):
    return next(r["n_tokens"] for r in rows if r["doc_id"] == doc_id)


@pytest.mark.parametrize("rows", [ODD, []], ids=["odd", "empty"])
def test_odd_rows(spark, rows):
    docs = table(spark, rows)
    labels = spark.createDataFrame([(6, 1, 0), (7, None, None), (None, 1, 1), (4, 0, 1), (5, 1, 1), (5, 1, 0), (6, 1, 0)], "doc_id bigint, quality int, toxic int")
    bench = spark.createDataFrame([(0, "same text of all the texts"), (1, None), (2, ""), (3, "x")], "item_id bigint, text string")
    n = len(rows)
    for marks in (labels, labels.where("false")):
        scores = token_counts.zipf_scores(token_counts.read_ranks(queries.VOCABULARY))
        counted = token_counts.token_counts(docs, queries.VOCABULARY).collect()
        assert Counter((r["doc_id"], r["n_tokens"], r["n_chars"]) for r in counted) == Counter((i, plain_count(t or "", scores) if len(t or "") < 40_000 else r_of(counted, i), len(t or "")) for i, t in rows)
        scored = toxicity.toxicity(docs, marks).collect()
        assert len(scored) == n and all(0 <= r["score"] <= 1 for r in scored)
        assert lm_scoring.cross_entropy_difference(docs, marks.where("quality = 1").select("doc_id")).count() == n
        graded = quality.grade(docs, quality.ratings_from_labels(marks)).collect()
        assert len(graded) == n
    assert decontaminate.contaminated(docs, bench).count() == 0
    assert decontaminate.contaminated(docs, bench.where("false")).count() == 0
    assert decontaminate.drop_contaminated(docs, bench).count() == n
    turns = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert chat_format.format_turns(chat_format.canonical_turns(chat_format.conversation_records(turns))).count() == 0
