"""The store, exports, the engine, streams and the command line."""

from __future__ import annotations

import datetime as dt
import glob
import json
import os
import re

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lorekeep import cli
from lorekeep.errors import ImportFormatError, InvalidOperation
from lorekeep.operators import forgetting, text_search
from lorekeep.plans.engine import MemoryEngine
from lorekeep.plans.memory_query import MemoryQuery
from lorekeep.sources import exchange
from lorekeep.sources.catalog import KEYS, SCHEMAS, from_rows
from lorekeep.sources.generate import demo
from lorekeep.sources.store import Batch, GraphStore, latest, merge_update
from lorekeep.streaming import jobs
from lorekeep.streaming.jobs import upsert_into

NOW = dt.datetime(2024, 3, 1)


def memory(i, content="x", importance=0.5, at=NOW, ttl=None):
    return (i, content, "s", 0.5, importance, 0, at, at, ttl, "{}")


@pytest.fixture
def store(spark, tmp_path):
    return GraphStore(spark, str(tmp_path / "store"))


def test_batches(spark, store):
    rows = from_rows(
        spark,
        memories=[memory("m1"), memory("m2")], links=[("l", "m1", "m2", "k", 1.0, None)], collections=[("c", "C", "", None)],
        agents=[("a", "A", "", [], None)], contexts=[("k", "K", "", None)],
    )
    counts = lambda: {r["table"]: r["rows"] for r in store.stats().collect()}
    assert set(counts().values()) == {0}
    batch = store.batch()
    for name in ("memories", "links", "collections", "agents", "contexts"):
        batch.put(name, getattr(rows, name))
    assert set(counts().values()) == {0}
    batch.commit()
    assert counts() == {"memories": 2, "links": 1, "collections": 1, "agents": 1, "contexts": 1}
    with pytest.raises(InvalidOperation):
        batch.commit()
    other = store.batch().delete("memories", rows.memories.select("id"))
    other.abort()
    assert counts()["memories"] == 2
    store.put("memories", from_rows(spark, memories=[memory("m1", "new")]).memories)
    assert store.get("memories", "m1").first()["content"] == "new" and store.read("memories", 1).where("content = 'new'").isEmpty()
    store.batch().delete_memories(spark.createDataFrame([("m1",)], "id string")).commit()
    assert counts()["memories"] == 1 and counts()["links"] == 0
    store.compact()
    store.vacuum()
    assert counts()["memories"] == 1 and sorted(r["id"] for r in store.ids("memories").collect()) == ["m2"]


def test_readers_see_whole_commits(spark, store, monkeypatch):
    """At every step of a commit a reader sees the version before or the one after."""
    store.put("memories", from_rows(spark, memories=[memory("m1"), memory("m2")]).memories)
    seen = []
    look = lambda: seen.append(sorted(r["id"] for r in GraphStore(spark, store.root).ids("memories").collect()))
    write, create = Batch._write, GraphStore._create
    monkeypatch.setattr(Batch, "_write", lambda self, rows, name, kind: (look(), write(self, rows, name, kind), look())[1])
    monkeypatch.setattr(GraphStore, "_create", lambda self, version, manifest: (look(), create(self, version, manifest), look())[1])
    store.batch().put("memories", from_rows(spark, memories=[memory("m3")]).memories).delete("memories", spark.createDataFrame([("m1",)], "id string")).commit()
    assert len(seen) == 6 and seen[:5] == [["m1", "m2"]] * 5 and seen[5] == ["m2", "m3"]


def test_two_commits_at_once(spark, store, monkeypatch):
    """A commit that finds another one in its place goes after it, and neither is lost."""
    store.put("memories", from_rows(spark, memories=[memory("m1"), memory("m2")]).memories)
    create, once = GraphStore._create, []

    def late(self, version, manifest):
        if not once:
            once.append(True)
            GraphStore(spark, store.root).put("memories", from_rows(spark, memories=[memory("m1", "theirs"), memory("m4")]).memories)
        return create(self, version, manifest)

    monkeypatch.setattr(GraphStore, "_create", late)
    assert store.batch().put("memories", from_rows(spark, memories=[memory("m3"), memory("m1", "ours")]).memories).commit() == 3
    got = {r["id"]: r["content"] for r in store.read("memories").collect()}
    assert got == {"m1": "ours", "m2": "x", "m3": "x", "m4": "x"} and store.version() == 3
    assert not create(store, 3, {"tables": {}, "applied": {}})


def test_commits_write_changes_only(spark, store, monkeypatch):
    """A commit adds folders of what it changes; after a number of them the table is written anew, once."""
    monkeypatch.setattr("lorekeep.sources.store.MOST_CHANGES", 4)
    store.put("memories", from_rows(spark, memories=[memory(f"m{i}") for i in range(20)]).memories)
    lengths, want = [], {f"m{i}": "x" for i in range(20)}
    for i in range(9):
        batch = store.batch().put("memories", from_rows(spark, memories=[memory(f"m{i}", f"new{i}")]).memories)
        want[f"m{i}"] = f"new{i}"
        if i == 6:
            batch.delete("memories", spark.createDataFrame([("m3",), ("m6",)], "id string"))
            del want["m3"], want["m6"]
        batch.commit()
        steps = store.manifest(store.version())["memories"]
        lengths.append(len(steps))
        assert spark.read.parquet(f"{store.root}/{steps[-1][1]}").count() in (1, 2, 20, 19, 18)
    assert max(lengths) <= 4 and lengths.count(1) >= 2
    assert {r["id"]: r["content"] for r in store.read("memories").collect()} == want
    store.compact()
    store.vacuum()
    assert {r["id"]: r["content"] for r in store.read("memories").collect()} == want and store.version() > 0


def test_stored_text_index(spark, store):
    """Postings follow the memories through puts and deletes, and find what a scan of the texts finds."""
    store.load(demo(spark))
    with pytest.raises(InvalidOperation):
        store.search("uploads")
    store.build_index()
    store.put("memories", from_rows(spark, memories=[memory("req0", "Nothing of the sort"), memory("x", "Uploaded chunks are tested")]).memories)
    store.batch().delete_memories(spark.createDataFrame([("imp0",)], "id string")).commit()
    store.batch().delete("memories", spark.createDataFrame([("team",)], "source string")).commit()
    for text in ("uploads", "chunk tests", "the", "sorts reports", "nowhere", ""):
        for match, scan in (("any", text_search.search_any), ("all", text_search.search_all)):
            ids = sorted(r["id"] for r in store.search(text, match).collect())
            assert ids == sorted(r["id"] for r in scan(store.read("memories"), text).collect()), (text, match)
    assert sorted(r["id"] for r in store.search("uploads").collect())
    store.compact()
    assert store.search("uploads").count() == text_search.search_any(store.read("memories"), "uploads").count()


def pushed(df) -> list[str]:
    """The filters that each scan of a plan is handed."""
    plan = df._jdf.queryExecution().executedPlan().toString().partition("== Initial Plan ==")[0]
    return re.findall(r"PushedFilters: \[(.*?)\], ReadSchema", plan)


def test_conditions_reach_every_step(spark, store):
    """After several commits a lookup hands its key, and a search its stems, to each scan of rows."""
    store.put("memories", from_rows(spark, memories=[memory(f"m{i}", f"word{i} common") for i in range(50)]).memories)
    store.build_index()
    store.put("memories", from_rows(spark, memories=[memory("m1", "changed"), memory("m60", "word60")]).memories)
    store.batch().delete("memories", spark.createDataFrame([("m2",)], "id string")).commit()
    store.put("memories", from_rows(spark, memories=[memory("m3", "again"), memory("m2", "back")]).memories)
    found = store.get("memories", "m1")
    assert [(r["id"], r["content"]) for r in found.collect()] == [("m1", "changed")]
    rows = [f for f in pushed(found) if "EqualTo(id,m1)" in f]
    steps = store.manifest(store.version())["memories"]
    assert len(rows) == sum(kind != "delete" for kind, _ in steps) == 3
    hits = text_search.search_postings(store.read("postings"), "word60")
    assert [r["memory_id"] for r in hits.collect()] == ["m60"]
    puts = [f for f in pushed(hits) if "stem" in f]
    assert len(puts) == sum(kind != "delete" for kind, _ in store.manifest(store.version())["postings"]) and all("word60" in f for f in puts)
    links = from_rows(spark, links=[("e1", "m1", "m3", "supports", 0.5, None)]).links
    store.put("links", links)
    assert any("EqualTo(id,e1)" in f for f in pushed(store.get("links", "e1")))


def test_lookups_skip_row_groups(spark, store):
    """A table written anew lies in ranges of its key, so that a lookup reads one of them."""
    store.put("memories", from_rows(spark, memories=[memory(f"m{i:05}") for i in range(4000)]).memories)
    store.compact(files=4)
    ((_, folder),) = store.manifest(store.version())["memories"]
    ranges = []
    for path in glob.glob(f"{store.root}/{folder}/*.parquet"):
        meta = pq.ParquetFile(path).metadata
        for g in range(meta.num_row_groups):
            ids = meta.row_group(g).column(0)
            ranges.append((ids.statistics.min, ids.statistics.max))
    assert len(ranges) > 1 and all(a[1] < b[0] for a, b in zip(sorted(ranges), sorted(ranges)[1:], strict=False))
    assert store.get("memories", "m00007").count() == 1 and store.get("memories", "m99999").count() == 0


def test_index_and_commits_at_once(spark, store, monkeypatch):
    """Memories that are put, deleted or written anew while an index is built are found all the same."""
    store.put("memories", from_rows(spark, memories=[memory("m1", "first text"), memory("m2", "second text")]).memories)
    create = GraphStore._create
    meanwhile = [
        lambda: GraphStore(spark, store.root).put("memories", from_rows(spark, memories=[memory("m3", "third text"), memory("m1", "nothing")]).memories),
        lambda: GraphStore(spark, store.root).batch().delete("memories", spark.createDataFrame([("m2",)], "id string")).commit(),
        lambda: GraphStore(spark, store.root).compact(),
    ]

    def late(self, version, manifest):
        if meanwhile:
            meanwhile.pop(0)()
        return create(self, version, manifest)

    monkeypatch.setattr(GraphStore, "_create", late)
    store.build_index()
    assert not meanwhile
    assert sorted(r["id"] for r in store.search("text").collect()) == ["m3"] and store.search("nothing").count() == 1


def test_put_that_began_before_the_index(spark, store, monkeypatch):
    store.put("memories", from_rows(spark, memories=[memory("m1", "first text")]).memories)
    write, once = Batch._write, []

    def late(self, rows, name, kind="base"):
        if kind == "put" and name == "memories" and not once:
            once.append(True)
            GraphStore(spark, store.root).build_index()
        return write(self, rows, name, kind)

    monkeypatch.setattr(Batch, "_write", late)
    store.put("memories", from_rows(spark, memories=[memory("m2", "second text")]).memories)
    assert sorted(r["id"] for r in store.search("text").collect()) == ["m1", "m2"]


def test_batches_count_once(spark, store, monkeypatch):
    """A batch that crashed behind its commit, and is run again, adds nothing; one that crashed before it is applied."""
    write = upsert_into(store, application="feed")
    write(from_rows(spark, memories=[memory("m1", "one")]).memories, 0)
    create = GraphStore._create

    def crash(self, version, manifest):
        raise RuntimeError("lost before the manifest")

    monkeypatch.setattr(GraphStore, "_create", crash)
    with pytest.raises(RuntimeError):
        write(from_rows(spark, memories=[memory("m1", "two")]).memories, 1)
    monkeypatch.setattr(GraphStore, "_create", create)
    assert store.version() == 1 and store.applied("feed") == 0
    write(from_rows(spark, memories=[memory("m1", "two")]).memories, 1)
    after = store.version()
    write(from_rows(spark, memories=[memory("m1", "two")]).memories, 1)
    write(from_rows(spark, memories=[memory("m1", "one")]).memories, 0)
    assert store.version() == after == 2 and store.applied("feed") == 1 and store.applied("other") == -1
    assert [r["content"] for r in store.read("memories").collect()] == ["two"]
    store.put("memories", from_rows(spark, memories=[memory("m2")]).memories)
    assert store.applied("feed") == 1


def same(a, b):
    for name in SCHEMAS:
        if name == "vectors":
            continue
        x, y = (t.frames[name].select(*sorted(SCHEMAS[name].names)).orderBy(*KEYS[name]).collect() for t in (a, b))
        assert x == y, name


def test_export_and_import(spark, tmp_path):
    t = demo(spark)
    exchange.export_json(t, str(tmp_path / "one"))
    same(t, exchange.import_json(spark, str(tmp_path / "one")))
    exchange.export_lines(t, str(tmp_path / "lines"))
    same(t, exchange.import_lines(spark, str(tmp_path / "lines")))
    part = exchange.import_json(spark, str(tmp_path / "one"), partial=True)
    assert part.agents.isEmpty() and part.contexts.isEmpty() and part.memories.count() == 27
    one = exchange.collection_export(t, "design")
    assert one.memories.count() == 4 and sorted(r["relationship_type"] for r in one.links.collect()) == ["depends_on", "depends_on"]
    assert exchange.backup(t, str(tmp_path), dt.datetime(2024, 5, 6, 7, 8, 9)).endswith("memory_backup_20240506_070809.json")
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.json").write_text("{}")
    with pytest.raises(ImportFormatError):
        exchange.import_json(spark, str(tmp_path / "bad"))
    assert exchange.proto_metadata('{"a": 1, "b": true, "c": ["x", 2]}') == '{"a": 1.0, "b": true, "c": ["x", 2.0]}'


def test_a_document_has_a_line_for_each_record(spark, tmp_path):
    """Many files, none of whose lines grows with the graph, are one JSON document; one in a single string is read too."""
    t = demo(spark)
    odd = from_rows(spark, memories=[memory('a"\\\n\u2028', 'two\nlines "x"'), memory(None, None)]).memories
    t = t.replace(memories=t.memories.unionByName(odd))
    exchange.export_json(t, str(tmp_path / "lines"))
    files = sorted((tmp_path / "lines").rglob("*.txt"))
    whole = json.loads("".join(f.read_text() for f in files))
    ids = lambda rows: {r["id"] or "" for r in rows.collect()}
    assert set(whole["memories"]) == ids(t.memories) and set(whole["links"]) == ids(t.links) and whole["version"] == exchange.VERSION
    assert len(whole["collection_members"]) == t.collection_members.count()
    assert max(len(line) for f in files for line in f.read_text().split("\n")) < 1_000
    same(t, exchange.import_json(spark, str(tmp_path / "lines")))
    with pytest.raises(ValueError):
        exchange.export_json(t.replace(memories=t.memories.union(t.memories)), str(tmp_path / "twice"))
    kept = demo(spark)
    maps = {n: {r["id"]: {k: v for k, v in json.loads(j).items()} for r, j in zip(rows.collect(), rows.toJSON().collect(), strict=True)} for n, rows in exchange.records(kept).items()}
    (tmp_path / "single").mkdir()
    (tmp_path / "single" / "x.json").write_text(json.dumps({"version": "1.0"} | maps))
    same(kept, exchange.import_json(spark, str(tmp_path / "single")))


def test_versions_and_updates(spark):
    log = spark.createDataFrame([("a", 1, "x"), ("a", 3, "z"), ("b", 2, "y"), ("a", 2, "w")], "id string, version int, v string")
    assert sorted(map(tuple, latest(log).collect())) == [("a", 3, "z"), ("b", 2, "y")]
    old = from_rows(spark, memories=[memory("m1", "old")]).memories
    new = spark.createDataFrame([("m1", "", 0.9), ("m2", "fresh", 0.0)], "id string, content string, confidence double")
    got = {r["id"]: r for r in merge_update(old, new).collect()}
    assert got["m1"]["content"] == "old" and got["m1"]["confidence"] == 0.9 and got["m2"]["content"] == "fresh"


def test_engine(spark, store):
    store.load(demo(spark))
    engine = MemoryEngine.over_store(spark, store.root)
    assert engine.query(MemoryQuery(text="uploads")).count() >= 2
    assert engine.search_source("tests").count() == 5 and engine.recent(3).count() == 3
    assert engine.visible_to("tester").count() == 10 and engine.in_context("project").count() == 27
    assert engine.relationships("des1", "out").first()["relationship_type"] in ("satisfies", "depends_on")
    assert all(rows.isEmpty() for rows in engine.verify().values())
    assert engine.paths("tes0", "req0", 4).first()["path"] == ["tes0", "imp0", "des0", "req0"]
    grown = engine.contribute("project", from_rows(spark, memories=[memory("fresh")]).memories)
    assert grown.context_members.count() == 28
    assert engine.forget(forgetting.age_policy(28), NOW) > 0 and engine.tables.memories.count() < 27
    store.put("links", from_rows(spark, links=[("bad", "nobody", "tes0", "k", 1.0, None)]).links)
    assert engine.refresh().clean_orphans() >= 1 and engine.verify()["links"].isEmpty()
    engine.register_views("v_")
    assert spark.sql("select count(*) from v_agents").first()[0] == 4


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(cli, "build_session", lambda: spark)
    root = str(tmp_path / "s")
    for words in (["demo"], ["stats"], ["query", "--text", "cache"], ["get", "memories", "req0"], ["list", "agents"], ["connected", "imp0"], ["paths", "tes0", "des0"], ["verify"], ["export", str(tmp_path / "out")], ["delete", "req0"], ["clean-orphans"]):
        assert cli.main([root, *words]) == 0
    assert "architect" in capsys.readouterr().out
    assert GraphStore(spark, root).read("memories").count() == 26
    assert cli.main([str(tmp_path / "t"), "import", str(tmp_path / "out")]) == 0
    assert GraphStore(spark, str(tmp_path / "t")).read("memories").count() == 27


def test_streams(spark, tmp_path, store):
    events = [(i, NOW + dt.timedelta(minutes=7 * i), i % 3, "view" if i % 2 else "click") for i in range(60)]
    rows = spark.createDataFrame(events, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string")
    rows.repartition(4).write.parquet(str(tmp_path / "log"))
    log = jobs.read_log(spark, str(tmp_path / "log"), rows.schema, files_per_trigger=1)
    counted = jobs.access_counts(log.select(F.col("user_id").alias("memory_id"), F.col("ts").alias("accessed_at")))
    got = jobs.run_to_end(counted, str(tmp_path / "c1"))
    assert sorted(tuple(r) for r in got.collect()) == [(u, 20, max(e[1] for e in events if e[2] == u)) for u in range(3)]
    windows = jobs.run_to_end(jobs.windowed_counts(log), str(tmp_path / "c2"))
    assert windows.agg(F.sum("events")).first()[0] == 60
    slid = jobs.run_to_end(jobs.windowed_counts(log, slide="30 minutes"), str(tmp_path / "c3"))
    assert slid.agg(F.sum("events")).first()[0] == 120
    sessions = jobs.run_to_end(jobs.session_counts(jobs.read_log(spark, str(tmp_path / "log"), rows.schema), gap="30 minutes"), str(tmp_path / "c4"))
    assert sessions.count() == 3


def test_ingest_and_expiry(spark, tmp_path, store):
    source = str(tmp_path / "new")
    first = from_rows(spark, memories=[memory("m1", "old"), memory("m2", "x", ttl=60)]).memories
    again = from_rows(spark, memories=[memory("m1", "new", at=NOW + dt.timedelta(days=1)), memory("m3", at=NOW + dt.timedelta(days=2))]).memories
    first.coalesce(1).write.parquet(source)
    jobs.ingest(jobs.read_log(spark, source, SCHEMAS["memories"]), store, str(tmp_path / "ck")).awaitTermination()
    again.coalesce(1).write.mode("append").parquet(source)
    jobs.ingest(jobs.read_log(spark, source, SCHEMAS["memories"]), store, str(tmp_path / "ck")).awaitTermination()
    got = {r["id"]: r["content"] for r in store.read("memories").collect()}
    assert got == {"m1": "new", "m2": "x", "m3": "x"}


def plain_expiries(batches, late):
    """What the timers say: batch by batch, with the watermark that the batches before have set."""
    state, mark, out = {}, None, []
    for batch in [*batches, []]:
        for i, at, ttl in batch:
            if mark is not None and at < mark:
                continue
            due = dt.datetime.max if ttl is None else at + dt.timedelta(seconds=ttl)
            if i not in state or (at, due) > state[i]:
                state[i] = (at, due)
        for i, (_, due) in sorted(state.items()):
            if mark is not None and due <= mark and due < dt.datetime.max:
                out.append((i, due))
                del state[i]
        if batch:
            newest = max(at for _, at, _ in batch) - late
            mark = newest if mark is None else max(mark, newest)
    return sorted(out)


def test_timers_follow_the_latest_row(spark, tmp_path):
    """A ttl that is cleared, shortened, lengthened or set by an older row, in rows out of order."""
    day = lambda d, h=0: NOW + dt.timedelta(days=d, hours=h)
    batches = [
        [("cleared", day(0), 3600), ("short", day(0), 10 * 86400), ("long", day(0), 86400), ("plain", day(0), 7200), ("again", day(0), 3600), ("never", day(0), None)],
        [("cleared", day(0, 0.5), None), ("short", day(0, 1), 3600), ("long", day(0, 1), 20 * 86400), ("tie", day(0, 1), 60), ("tie", day(0, 1), None)],
        [("new", day(1), 2 * 86400), ("new", day(0, 23), 60), ("edge", day(1), 86400)],
        [("clock", day(2), None), ("late", day(0), 5)],
        [("again", day(3), 3600), ("clock", day(3, 12), None)],
        [("clock", day(5), None)],
    ]
    source = tmp_path / "memories"
    for k, batch in enumerate(batches):
        rows = spark.createDataFrame(batch, "id string, timestamp timestamp_ntz, ttl bigint").coalesce(1)
        rows.write.parquet(str(tmp_path / f"part{k}"))
        (name,) = glob.glob(str(tmp_path / f"part{k}" / "*.parquet"))
        source.mkdir(exist_ok=True)
        os.rename(name, source / f"{k}.parquet")
        os.utime(source / f"{k}.parquet", (1_700_000_000 + k, 1_700_000_000 + k))  # read in this order
    stream = jobs.read_log(spark, str(source), "id string, timestamp timestamp_ntz, ttl bigint", files_per_trigger=1)
    got = jobs.run_to_end(jobs.expiries(stream, "2 hours"), str(tmp_path / "ck"), "append").collect()
    want = plain_expiries(batches, dt.timedelta(hours=2))
    assert sorted((r["id"], r["expired_at"]) for r in got) == want
    assert {"plain", "short", "again", "new", "edge"} == {i for i, _ in want}


def test_timers_beyond_the_times_of_pandas(spark, tmp_path):
    """Nanoseconds end in 2262; rows and timers may be later, and rows without a time or an id don't matter."""
    far = lambda d: dt.datetime(2777, 5, 1) + dt.timedelta(days=d)
    rows = [("early", NOW, 60), ("far", far(0), 86400), ("later", far(4), 10**9), ("clock", far(5), None), ("none", None, 60)]
    spark.createDataFrame(rows, "id string, timestamp timestamp_ntz, ttl bigint").coalesce(1).write.parquet(str(tmp_path / "memories"))
    stream = jobs.read_log(spark, str(tmp_path / "memories"), "id string, timestamp timestamp_ntz, ttl bigint")
    got = jobs.run_to_end(jobs.expiries(stream, "2 hours"), str(tmp_path / "ck"), "append").collect()
    assert sorted((r["id"], r["expired_at"]) for r in got) == [("early", NOW + dt.timedelta(seconds=60)), ("far", far(1))]


def test_a_table_streams_as_a_file_and_as_a_folder(spark, tmp_path):
    rows = spark.range(50)
    rows.repartition(3).write.parquet(str(tmp_path / "many" / "events.parquet"))
    rows.coalesce(1).write.parquet(str(tmp_path / "part"))
    (name,) = glob.glob(str(tmp_path / "part" / "*.parquet"))
    os.makedirs(tmp_path / "one")
    os.rename(name, tmp_path / "one" / "events.parquet")
    for kind in ("many", "one"):
        stream = jobs.read_table(spark, str(tmp_path / kind), "events", "id bigint")
        assert jobs.run_to_end(stream, str(tmp_path / f"ck-{kind}"), "append").count() == 50
