"""Export to and import from JSON.

One form is a JSON document of maps from id to record, the other is JSON Lines, one folder a table. Both are
written and read in parallel: the document has a line for each record, and its lines lie in the files below a folder, a folder for each kind, in order of their names.
"""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorekeep.errors import ImportFormatError
from lorekeep.operators.links import attached
from lorekeep.sources.catalog import AGENTS, COLLECTIONS, CONTEXTS, KEYS, LINKS, MEMORIES, SCHEMAS, Tables, from_rows

VERSION = "1.0"
_IDS = T.ArrayType(T.StringType())


def _with(schema: T.StructType, **extra: T.DataType) -> T.StructType:
    return T.StructType([*schema.fields, *[T.StructField(k, v) for k, v in extra.items()]])


DOCUMENT = T.StructType(
    [
        T.StructField("version", T.StringType()),
        T.StructField("memories", T.MapType(T.StringType(), MEMORIES)),
        T.StructField("links", T.MapType(T.StringType(), LINKS)),
        T.StructField("collections", T.MapType(T.StringType(), _with(COLLECTIONS, member_ids=_IDS))),
        T.StructField("agents", T.MapType(T.StringType(), _with(AGENTS, collection_ids=_IDS))),
        T.StructField("contexts", T.MapType(T.StringType(), _with(CONTEXTS, member_ids=_IDS, agent_ids=_IDS))),
    ]
)


def _gathered(rows: DataFrame, bridge: DataFrame, group: str, member: str, name: str) -> DataFrame:
    lists = bridge.groupBy(F.col(group).alias("id")).agg(F.sort_array(F.collect_set(member)).alias(name))
    return rows.join(lists, "id", "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))


def records(tables: Tables) -> dict[str, DataFrame]:
    """The five kinds of records with their memberships inside."""
    contexts = _gathered(tables.contexts, tables.context_members, "context_id", "memory_id", "member_ids")
    return {
        "memories": tables.memories,
        "links": tables.links,
        "collections": _gathered(tables.collections, tables.collection_members, "collection_id", "memory_id", "member_ids"),
        "agents": _gathered(tables.agents, tables.agent_grants, "agent_id", "collection_id", "collection_ids"),
        "contexts": _gathered(contexts, tables.context_agents, "context_id", "agent_id", "agent_ids"),
    }


#: Memberships by the kind of record that they belong to.
_MEMBERSHIPS = {"collection_members": "collections", "agent_grants": "agents", "context_members": "contexts", "context_agents": "contexts"}


def export_document(tables: Tables) -> DataFrame:
    """The lines (section, value) of a JSON document of all records, in order over the partitions.

    Memories, links, collections, agents and contexts are maps from id to record, and memberships are lists of pairs, so that no line grows
    with the graph. Records that share an id are an error, as a map has each key once.
    """
    kinds = [*DOCUMENT.names[1:], *_MEMBERSHIPS]
    rows = None
    for at, name in enumerate(kinds):
        df = tables.frames[name].select(*SCHEMAS[name].names)
        df = df.distinct() if name in _MEMBERSHIPS else df
        key = F.to_json(F.struct(*KEYS[name])) if name in _MEMBERSHIPS else F.coalesce("id", F.lit(""))
        one = df.select(F.lit(at).alias("kind"), key.alias("key"), F.to_json(F.struct(*df.columns)).alias("record"))
        rows = one if rows is None else rows.unionByName(one)
    # the first of each kind has no comma before it
    keys = rows.groupBy("kind", "key").agg(F.count(F.lit(1)).alias("n")).groupBy("kind").agg(F.min("key").alias("first"), F.max("n").alias("n"))
    first = {r["kind"]: r for r in keys.collect()}  # nine rows
    if twice := [kinds[k] for k, r in first.items() if r["n"] > 1]:
        raise ValueError(f"records of {', '.join(sorted(twice))} share an id")
    comma = F.lit(False)
    for k, r in first.items():
        comma = comma | ((F.col("kind") == k) & (F.col("key") > r["first"]))
    named = F.when(F.col("kind") < len(kinds) - len(_MEMBERSHIPS), F.concat(_quoted(F.col("key")), F.lit(":"))).otherwise("")
    lines = rows.select("kind", F.lit(1).alias("part"), "key", F.concat(F.when(comma, ",").otherwise(""), named, "record").alias("value"))
    opened = [(at, _opening(at, name, kinds)) for at, name in enumerate(kinds)] + [(len(kinds), "]}")]
    fixed = tables.memories.sparkSession.createDataFrame(opened, "kind int, value string").select("kind", F.lit(0).alias("part"), F.lit("").alias("key"), "value")
    section = F.element_at(F.array(*[F.lit(f"{at}_{name}") for at, name in enumerate([*kinds, "end"])]), F.col("kind") + 1)
    return fixed.unionByName(lines).withColumn("section", section).orderBy("section", "part", "key").select("section", "value")


def _quoted(text: Column) -> Column:
    """A JSON string."""
    entry = F.to_json(F.struct(text.alias("k")))
    return F.substring(entry, F.lit(6), F.length(entry) - 6)


def _opening(at: int, name: str, kinds: list[str]) -> str:
    """The line before the records of a kind."""
    before = f'{{"version":"{VERSION}"' if at == 0 else "]" if kinds[at - 1] in _MEMBERSHIPS else "}"
    return f'{before},"{name}":{"[" if name in _MEMBERSHIPS else "{"}'


def _records_in(lines: DataFrame, name: str) -> DataFrame:
    """The records of a kind, from the lines of a document (section, value)."""
    mine = lines.where(F.col("section").rlike(f"^[0-9]+_{name}$") & ~F.col("value").rlike(r'^([}\]]|\{"version")'))
    record = F.regexp_replace("value", "^,", "")
    if name not in _MEMBERSHIPS:
        entry = F.from_json(F.concat(F.lit("{"), record, F.lit("}")), T.MapType(T.StringType(), SCHEMAS[name]))
        return mine.select(F.explode(entry).alias("k", "r")).select("r.*")
    return mine.select(F.from_json(record, SCHEMAS[name]).alias("r")).select("r.*")


def export_json(tables: Tables, path: str) -> None:
    """Text files that, one after the other by the names of their folders and files, are one JSON document."""
    export_document(tables).write.mode("overwrite").partitionBy("section").text(path)


def export_lines(tables: Tables, path: str) -> None:
    """JSON Lines, one folder a kind of record."""
    for name, rows in records(tables).items():
        rows.write.mode("overwrite").json(f"{path}/{name}")


def _tables(spark: SparkSession, found: dict[str, DataFrame]) -> Tables:
    bridge = lambda rows, ids, group, member: rows.select(F.col("id").alias(group), F.explode(ids).alias(member)).distinct()
    given = {
        "memories": found["memories"],
        "links": found["links"],
        "collections": found["collections"].select(*COLLECTIONS.names),
        "collection_members": bridge(found["collections"], "member_ids", "collection_id", "memory_id"),
    }
    if "agents" in found:
        given["agents"] = found["agents"].select(*AGENTS.names)
        given["agent_grants"] = bridge(found["agents"], "collection_ids", "agent_id", "collection_id")
        given["contexts"] = found["contexts"].select(*CONTEXTS.names)
        given["context_members"] = bridge(found["contexts"], "member_ids", "context_id", "memory_id")
        given["context_agents"] = bridge(found["contexts"], "agent_ids", "context_id", "agent_id")
    return from_rows(spark).replace(**given)


def import_json(spark: SparkSession, path: str, partial: bool = False) -> Tables:
    """The tables of an exported document; ``partial`` leaves agents and contexts out.

    A document in lines, as :func:`export_json` writes it, is read line by line; any other text is one JSON document a file.
    """
    names = ["memories", "links", "collections"] + ([] if partial else ["agents", "contexts"])
    lines = spark.read.text(path)
    if "section" in lines.columns:
        given = {n: _records_in(lines, n) for n in [*names, *[m for m, kind in _MEMBERSHIPS.items() if kind in names]]}
        return from_rows(spark).replace(**given)
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", DOCUMENT, {"mode": "PERMISSIVE"}).alias("d")).where("d.version is not null")
    if raw.isEmpty():
        raise ImportFormatError(f"no export in {path}")
    return _tables(spark, {n: raw.select(F.explode(f"d.{n}").alias("k", "r")).select("r.*") for n in names})


def import_lines(spark: SparkSession, path: str, partial: bool = False) -> Tables:
    names = ["memories", "links", "collections"] + ([] if partial else ["agents", "contexts"])
    return _tables(spark, {n: spark.read.schema(DOCUMENT[n].dataType.valueType).json(f"{path}/{n}") for n in names})


def collection_export(tables: Tables, collection: str) -> Tables:
    """One collection, its members, and the links both ends of which are members."""
    members = tables.collection_members.where(F.col("collection_id") == collection)
    ids = members.select(F.col("memory_id").alias("id")).distinct()
    memories = tables.memories.join(ids, "id", "left_semi")
    empty = {name: rows.where("false") for name, rows in tables.frames.items()}
    return Tables(empty).replace(
        memories=memories, links=attached(tables.links, memories), collections=tables.collections.where(F.col("id") == collection), collection_members=members
    )


def backup_name(now: dt.datetime) -> str:
    return now.strftime("memory_backup_%Y%m%d_%H%M%S.json")


def backup(tables: Tables, folder: str, now: dt.datetime) -> str:
    path = f"{folder.rstrip('/')}/{backup_name(now)}"
    export_json(tables, path)
    return path


def without_dangling(tables: Tables) -> Tables:
    """The tables without links that lack an end, as a graph is rebuilt from a store."""
    return tables.replace(links=attached(tables.links, tables.memories))


def proto_metadata(metadata: str) -> str:
    """Metadata as a struct of doubles, strings, booleans and lists gives it back: integers become doubles."""

    def turn(x):
        if isinstance(x, bool) or x is None or isinstance(x, str):
            return x
        if isinstance(x, (int, float)):
            return float(x)
        return [turn(y) for y in x] if isinstance(x, list) else {k: turn(v) for k, v in x.items()}

    return json.dumps(turn(json.loads(metadata)))
