"""Filters, text search, the query builder and derived columns, on literal rows."""

from __future__ import annotations

import datetime as dt
import math
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lorekeep.functions import columns as C
from lorekeep.functions import metadata as M
from lorekeep.functions import text as X
from lorekeep.operators import filters, forgetting, links, text_search
from lorekeep.plans.memory_query import MemoryQuery, search_combined
from lorekeep.sources.catalog import from_rows

NOW = dt.datetime(2024, 3, 1)


def memory(i, content, source="s", confidence=0.5, importance=0.5, count=0, at=NOW, last=None, ttl=None, metadata="{}"):
    return (i, content, source, confidence, importance, count, at, last or at, ttl, metadata)


WORDS = ["kettle", "kettles", "oboe", "plum", "ravine", "sorted", "sorting", "umbra", "of", "to", "vexed"]
SOURCES, KINDS = ["bench", "field", "log", "mail"], ["draft", "final", "note"]


def notes():
    """37 generated notes: (id, text, source, confidence, kind, day)."""
    rng = random.Random(20)
    out = []
    for n in range(37):
        text = " ".join(rng.choice(WORDS).title() if rng.random() < 0.3 else rng.choice(WORDS) for _ in range(rng.randrange(1, 7)))
        out.append((f"n{n:02}", text, rng.choice(SOURCES), rng.randrange(21) / 20, rng.choice(KINDS), rng.randrange(50)))
    return out


NOTES = notes()


@pytest.fixture(scope="module")
def noted(spark):
    return from_rows(
        spark,
        memories=[memory(i, text, source, sure, metadata=f'{{"kind": "{kind}"}}', at=NOW + dt.timedelta(days=day, minutes=int(i[1:]))) for i, text, source, sure, kind, day in NOTES],
        links=[(f"k{n}", f"n{n:02}", f"n{n * 7 % 37:02}", "cites", 0.5, None) for n in range(0, 37, 2)],
    )


def plain_stems(text):
    out = set()
    for w in plain_tokens(text):
        cut = 1 if w.endswith("s") and len(w) > 3 else 3 if w.endswith("ing") and len(w) > 5 else 2 if w.endswith("ed") and len(w) > 4 else 0
        out.add(w[: len(w) - cut])
    return out


def plain_ids(keep):
    return sorted(i for i, *rest in NOTES if keep(*rest))


def ids(df):
    return sorted(r["id"] for r in df.select("id").collect())


ASKED = ["plum", "Kettles", "sorting plum", "ravine of umbra", "to", "", "vex oboe", "nothing here"]


@pytest.mark.parametrize("query", ASKED)
def test_search(noted, query):
    """Scan and index, for any word and for all, against sets of stems."""
    wanted = plain_stems(query)
    some = plain_ids(lambda text, *_: bool(wanted & plain_stems(text)))
    every = plain_ids(lambda text, *_: bool(wanted) and wanted <= plain_stems(text))
    index = text_search.postings(noted.memories)
    found = lambda how: sorted(r[0] for r in text_search.search_postings(index, query, how).collect())
    assert ids(text_search.search_any(noted.memories, query)) == found("any") == some
    assert ids(text_search.search_all(noted.memories, query)) == found("all") == every


def test_filters(noted):
    m = noted.memories
    assert ids(filters.by_source(m, "log")) == plain_ids(lambda _t, source, *_: source == "log")
    for least in (0.0, 0.35, 0.9, 1.0):
        assert ids(filters.min_confidence(m, least)) == plain_ids(lambda _t, _s, sure, *_: sure >= least)  # noqa: B023
        assert ids(filters.min_confidence(m, least, bucketed=True)) == plain_ids(lambda _t, _s, sure, *_: int(sure * 10 + 1e-9) >= int(least * 10 + 1e-9))  # noqa: B023
    assert ids(filters.with_value(m, "kind", "draft")) == plain_ids(lambda *r: r[3] == "draft")
    got = ids(text_search.search_required(m, "plum oboe", ["Kettle"], ["umbra"]))
    assert got == plain_ids(lambda text, *_: bool({"plum", "oboe"} & plain_stems(text)) and "kettle" in plain_stems(text) and "umbra" not in plain_stems(text))


def test_index_without_some(noted):
    index = text_search.postings(noted.memories)
    gone = noted.memories.where("source = 'mail'").select("id")
    left = text_search.remove_from_index(index, gone)
    assert sorted(r[0] for r in text_search.search_postings(left, "plum").collect()) == plain_ids(lambda text, source, *_: "plum" in plain_stems(text) and source != "mail")


def test_combined(noted):
    m = noted.memories
    got = search_combined(m, text="sorted", source="field", key="kind", value="note")
    assert ids(got) == plain_ids(lambda text, source, _c, kind, _d: "sort" in plain_stems(text) and (source, kind) == ("field", "note"))
    assert ids(search_combined(m)) == []
    newest = sorted(NOTES, key=lambda r: (r[5], r[0]), reverse=True)
    assert ids(MemoryQuery().apply(m)) == sorted(r[0] for r in NOTES)
    assert [r["id"] for r in MemoryQuery(limit=5).apply(m).collect()] == [r[0] for r in newest[:5]]
    assert [r["id"] for r in MemoryQuery(order="oldest", limit=4).apply(m).collect()] == [r[0] for r in newest[::-1][:4]]
    sure = MemoryQuery(order="confidence", limit=6).apply(m).collect()
    assert [r["confidence"] for r in sure] == sorted((r[3] for r in NOTES), reverse=True)[:6]
    assert ids(MemoryQuery().in_period(2024, 3, 9).apply(m)) == plain_ids(lambda *r: r[4] == 8)
    assert ids(MemoryQuery().in_period(2024, 4).apply(m)) == plain_ids(lambda *r: r[4] >= 31)
    both = {"plum", "ravine"}
    assert ids(MemoryQuery().with_text("plum ravine", exact=True).apply(m)) == plain_ids(lambda text, *_: both <= plain_stems(text))
    span = (NOW + dt.timedelta(days=10), NOW + dt.timedelta(days=20))
    assert ids(MemoryQuery().with_time_range(*span).apply(m)) == sorted(i for i, *_, day in NOTES if span[0] <= NOW + dt.timedelta(days=day, minutes=int(i[1:])) < span[1])
    assert ids(MemoryQuery(text="Nowhere", source="log").apply(m)) == []


def test_links(noted):
    for n in (2, 10, 14):
        assert [r[0] for r in links.neighbors(noted.links, f"n{n:02}").collect()] == [f"n{n * 7 % 37:02}"]
        assert sorted(r[0] for r in links.neighbors(noted.links, f"n{n:02}", "in").collect()) == [f"n{k:02}" for k in range(0, 37, 2) if k * 7 % 37 == n]


def test_metadata(spark):
    rows = [
        memory("e1", "x", metadata='{"topic":"climate","tags":["important","verified"]}'),
        memory("e2", "x", metadata='{"topic":"science","rank":3}'),
        memory("e3", "x", metadata='{"topic":"climate","verified":true,"rank":"3"}'),
        memory("e4", "x", metadata=None),
        memory("e5", "x", metadata="not json"),
    ]
    m = from_rows(spark, memories=rows).memories
    assert ids(filters.with_key(m, "topic")) == ["e1", "e2", "e3"]
    assert ids(filters.with_key(m, "verified")) == ["e3"]
    assert ids(filters.with_value(m, "topic", "climate")) == ["e1", "e3"]
    assert ids(filters.with_value(m, "rank", "3")) == ["e3"]
    assert {r["id"]: r["v"] for r in m.select("id", M.string_value(F.col("metadata"), "topic").alias("v")).collect()}["e4"] is None


def test_time(spark):
    day = dt.timedelta(days=1)
    m = from_rows(spark, memories=[memory("e1", "x", at=NOW), memory("e2", "x", at=NOW - day), memory("e3", "x", at=NOW - 7 * day)]).memories
    assert [r["id"] for r in filters.most_recent(m, 2).collect()] == ["e1", "e2"]
    assert ids(filters.before(m, NOW - day / 2)) == ["e2", "e3"]
    assert ids(filters.after(m, NOW - 2 * day)) == ["e1", "e2"]
    assert ids(filters.between(m, NOW - 2 * day, NOW - day / 2)) == ["e2"]
    assert ids(filters.between(m, NOW - day, NOW)) == ["e1", "e2"]
    assert ids(filters.between(m, NOW - day, NOW, inclusive=False)) == []
    assert ids(filters.by_year(m, 2024)) == ["e1", "e2", "e3"]
    assert ids(filters.by_month(m, 2024, 2)) == ["e2", "e3"]
    assert ids(filters.by_month(m, 2023, 12)) == []
    assert ids(filters.by_day(m, 2024, 2, 29)) == ["e2"]
    assert ids(filters.by_hour(m, 0)) == ["e1", "e2", "e3"]
    assert ids(filters.by_hour(m, 99)) == []
    assert filters.time_rollup(m).where("year is null").first()["memories"] == 3


def test_importance_and_access(spark):
    rows = [memory("e1", "x", importance=0.9, count=10), memory("e2", "x", importance=0.5, count=5), memory("e3", "x", importance=0.2, count=1)]
    m = from_rows(spark, memories=rows).memories
    assert ids(filters.min_importance(m, 0.5)) == ["e1", "e2"]
    assert [r["id"] for r in filters.most_important(m, 2).collect()] == ["e1", "e2"]
    raised = forgetting.set_importance(m, spark.createDataFrame([("e3", 0.8)], "id string, importance double"))
    assert ids(filters.min_importance(raised, 0.7)) == ["e1", "e3"]
    assert [r["id"] for r in filters.most_important(raised, 2).collect()] == ["e1", "e3"]
    assert ids(filters.min_access(m, 5)) == ["e1", "e2"]
    assert ids(filters.min_access(m, 8)) == ["e1"]
    assert ids(filters.min_access(m, 8, bucketed=True)) == ["e1", "e2", "e3"]
    log = spark.createDataFrame([("e3", NOW + dt.timedelta(hours=i)) for i in range(4)], "memory_id string, accessed_at timestamp_ntz")
    seen = {r["id"]: r for r in forgetting.record_accesses(m, log).collect()}
    assert seen["e3"]["access_count"] == 5 and seen["e3"]["last_accessed"] == NOW + dt.timedelta(hours=3) and seen["e1"]["access_count"] == 10


def test_expiry(spark):
    rows = [memory("e1", "x", ttl=1), memory("e2", "x", ttl=60), memory("e3", "x", ttl=120), memory("e4", "x"), memory("e5", "x", ttl=1, at=NOW + dt.timedelta(days=1))]
    m = from_rows(spark, memories=rows).memories
    later = NOW + dt.timedelta(seconds=2)
    assert ids(filters.expired(m, later)) == ["e1"]
    assert ids(filters.expired(m, NOW + dt.timedelta(seconds=1))) == []
    left = {r[0]: r[1] for r in m.select("id", C.time_remaining(F.col("timestamp"), F.col("ttl"), C.instant(later))).collect()}
    assert left["e1"] == 0 and left["e2"] == 58 and left["e4"] is None
    assert {r["id"]: r["ttl"] for r in forgetting.set_ttl(m, spark.createDataFrame([("e1", None), ("e4", 9)], "id string, ttl bigint")).collect()}["e1"] is None


def test_columns(spark):
    x = [0.75, 1.5, -0.5, math.nan, None]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in x], "x double").select(C.clamp_unit(F.col("x"))).collect()]
    assert got == [0.75, 1.0, 0.0, 0.0, 0.0]
    row = spark.range(1).select(C.label(F.lit("x" * 31)), C.label(F.lit("é" * 30)), C.tenth(F.lit(0.99)), C.access_bucket(F.lit(12345))).first()
    assert row[0] == "x" * 27 + "..." and row[1] == "é" * 30 and row[2] == 9 and row[3] == 10


def plain_tokens(text: str) -> set[str]:
    out, word = set(), ""
    for c in text + " ":
        if c.isspace() or c in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~":
            if len(word.lower().encode()) >= 3:
                out.add(word.lower())
            word = ""
        else:
            word += c
    return out


def test_tokens(spark):
    for text in ("Où es-tu, été?", "the-cat's  pajamas", "a bc def", "tab\tnew\nline here"):
        assert set(spark.range(1).select(X.tokens(F.lit(text))).first()[0]) == plain_tokens(text)
    stem = lambda w: spark.range(1).select(X.stem(F.lit(w))).first()[0]
    assert [stem(w) for w in ("cats", "was", "running", "sing", "walked", "red", "où")] == ["cat", "was", "runn", "sing", "walk", "red", "où"]


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.sampled_from(["alpha", "betas", "beta", "gamma", "of", "it"]), min_size=0, max_size=4))
def test_all_is_within_any(noted, words):
    m = noted.memories.withColumn("content", F.concat("content", F.lit(" alpha beta ")))
    query = " ".join(words)
    everything, some = set(ids(text_search.search_all(m, query))), set(ids(text_search.search_any(m, query)))
    assert everything <= some
