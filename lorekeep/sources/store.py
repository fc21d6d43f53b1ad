"""A store of graph tables as versioned Parquet folders.

A commit writes what it changes, and only that, into folders of its own, and then one file
``<root>/manifest-<n>`` that lists for each table its base and the changes since, in order, and for each
application the last batch it applied. The version of a store is the highest manifest. A manifest appears whole, by a
rename that fails if another commit was first, so readers see all of a commit or none of it and two
commits at once both count: the second one adds its changes to the first one's manifest. On object stores a rename is
no exclusive create; there a store takes one writer at a time.

Reading merges base and changes. Keys stay columns of the merge, so conditions on them reach the scan of each
step; files are sorted by key and have Bloom filters of it, so a lookup reads the row groups that may hold it.
Tables in ``APPENDED`` have no second row of a key without a delete between, so conditions on all their columns
reach the scans. A table with ``MOST_CHANGES`` steps is written anew by the commit that finds it so. All files go
through Spark's file systems.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.errors import InvalidOperation
from lorekeep.operators import text_search
from lorekeep.sources import catalog
from lorekeep.sources.catalog import Tables

#: The tables of a graph, and what is stored for searches.
SCHEMAS, KEYS = catalog.SCHEMAS | catalog.INDEX_SCHEMAS, catalog.KEYS | catalog.INDEX_KEYS
#: Changes that a table gathers before a commit writes it anew.
MOST_CHANGES = 16

#: Tables whose puts come behind deletes of the same keys: rows that no later delete names are what is there.
APPENDED = ("postings", "codes")
#: The columns by which files are sorted, and that have Bloom filters; the key if a table isn't named.
SORTED = {"postings": ("stem", "memory_id"), "links": ("id",), "codes": ("memory_id",)}

#: Columns by whose values the files of a table lie in folders.
PARTITIONED = {"codes": ("cell",)}

#: [kind, folder] for each step: a base first, if there is one, then puts and deletes.
Steps = list[list[str]]


class GraphStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # manifests

    def _path(self, name: str):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def version(self) -> int:
        """The current version, 0 for a store that nothing was committed to."""
        fs, path = self._path("manifest-*")
        found = fs.globStatus(path)
        return max((int(x.getPath().getName().rpartition("-")[2]) for x in found or ()), default=0)

    def manifest(self, version: int) -> dict[str, Steps]:
        """For each table the folders that make it up."""
        return self._whole(version)["tables"]

    def applied(self, application: str) -> int:
        """The last batch that an application committed, -1 if none."""
        return self._whole(self.version())["applied"].get(application, -1)

    def _whole(self, version: int) -> dict[str, dict]:
        if not version:
            return {"tables": {}, "applied": {}}
        fs, path = self._path(f"manifest-{version}")
        stream = fs.open(path)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _create(self, version: int, manifest: dict[str, dict]) -> bool:
        """Write a manifest whole; False if there is one of that version."""
        fs, new = self._path(f"new-{uuid.uuid4().hex}")
        _, path = self._path(f"manifest-{version}")
        stream = fs.create(new, False)
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        try:
            if fs.getUri().getScheme() == "file":  # a local rename replaces what is there, a link doesn't
                nio = self.spark.sparkContext._jvm.java.nio.file
                nio.Files.createLink(nio.Path.of(path.toUri().getPath(), self._none()), nio.Path.of(new.toUri().getPath(), self._none()))
                return True
            return not fs.exists(path) and fs.rename(new, path)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in str(e.java_exception):
                return False
            raise
        finally:
            fs.delete(new, False)

    def _none(self):
        return self.spark.sparkContext._gateway.new_array(self.spark.sparkContext._jvm.java.lang.String, 0)

    # reads

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """A table of the current or a given version; empty if it was never written."""
        return self.rows_of(name, self.manifest(self.version() if version is None else version).get(name, []))

    def rows_of(self, name: str, steps: Steps) -> DataFrame:
        """The rows that some steps leave: the last put of a key, unless a later delete names it."""
        schema, key = SCHEMAS[name], list(KEYS[name])
        rows, changed = None, False
        for step, (kind, folder) in enumerate(steps):
            if kind == "delete":
                if rows is not None:
                    gone = self.spark.read.parquet(f"{self.root}/{folder}")
                    rows = rows.join(gone, gone.columns, "left_anti")
                continue
            put = self.spark.read.schema(schema).parquet(f"{self.root}/{folder}").withColumn("_step", F.lit(step))
            changed |= kind == "put" and name not in APPENDED
            rows = put if rows is None else rows.unionByName(put)
        if rows is None:
            return self.spark.createDataFrame([], schema)
        if changed:
            others = [c for c in schema.names if c not in key] or [F.lit(0).alias("_none")]
            rows = rows.groupBy(*key).agg(F.max_by(F.struct(*others), "_step").alias("_row")).select(*key, "_row.*")
        return rows.select(*schema.names)

    def tables(self) -> Tables:
        now = self.manifest(self.version())
        return Tables({name: self.rows_of(name, now.get(name, [])) for name in catalog.SCHEMAS})

    def ids(self, name: str) -> DataFrame:
        return self.read(name).select(*KEYS[name])

    def get(self, name: str, *key: str) -> DataFrame:
        """The row of a key, if there is one."""
        rows = self.read(name)
        for column, value in zip(KEYS[name], key, strict=False):
            rows = rows.where(F.col(column) == value)
        return rows

    def stats(self) -> DataFrame:
        return table_counts(self.tables())

    def search(self, text: str, match: str = "any") -> DataFrame:
        """The memories that match a text, by the stored postings; see :meth:`build_index`."""
        now = self.manifest(self.version())
        if "postings" not in now:
            raise InvalidOperation("the store has no text index; build it first")
        hits = text_search.search_postings(self.rows_of("postings", now["postings"]), text, match)
        return self.rows_of("memories", now.get("memories", [])).join(hits.withColumnRenamed("memory_id", "id"), "id", "left_semi")

    # writes

    def batch(self) -> Batch:
        return Batch(self)

    def put(self, name: str, rows: DataFrame) -> None:
        self.batch().put(name, rows).commit()

    def delete(self, name: str, keys: DataFrame) -> None:
        self.batch().delete(name, keys).commit()

    def load(self, tables: Tables) -> None:
        """Put all rows of some tables in one commit; postings are the store's own affair."""
        batch = self.batch()
        for name, rows in tables.frames.items():
            if name != "postings":
                batch.put(name, rows)
        batch.commit()

    def build_index(self) -> None:
        """Store the postings of all memories, sorted by stem; later commits, and those made meanwhile, keep them up to date."""
        batch = self.batch()
        batch.index_of = self.manifest(self.version()).get("memories", [])
        batch.commit()

    def compact(self, files: int | None = None) -> None:
        """Write the current version anew, in files of the size of a shuffle partition, or in so many a table."""
        batch = self.batch()
        for name, steps in self.manifest(self.version()).items():
            batch.fold(name, steps, files)
        batch.commit()

    def vacuum(self) -> None:
        """Delete older manifests and the folders that only they name."""
        now = self.version()
        kept = {folder for steps in self.manifest(now).values() for _, folder in steps}
        fs, path = self._path("manifest-*")
        for found in fs.globStatus(path) or ():
            version = int(found.getPath().getName().rpartition("-")[2])
            if version >= now:
                continue
            for steps in self.manifest(version).values():
                for _, folder in steps:
                    if folder not in kept:
                        fs.delete(self._path(folder)[1], True)
            fs.delete(found.getPath(), False)


def _by_key(name: str) -> list[str]:
    return list(SORTED.get(name, KEYS[name]))


class Batch:
    """Staged puts and deletes; nothing shows before ``commit``, and ``abort`` drops them."""

    def __init__(self, store: GraphStore):
        self.store, self.steps, self.folded, self.open = store, [], {}, True
        #: The steps of the memories that a new text index is made of, if one is.
        self.index_of: Steps | None = None

    def _stage(self, kind: str, name: str, rows: DataFrame) -> Batch:
        if not self.open:
            raise InvalidOperation("the batch has ended")
        if name not in SCHEMAS:
            raise InvalidOperation(f"no table {name}")
        self.steps.append((kind, name, rows))
        return self

    def put(self, name: str, rows: DataFrame) -> Batch:
        """Insert rows or replace those of the same key; the last put of a key wins."""
        schema = SCHEMAS[name]
        fields = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema]
        return self._stage("put", name, rows.select(*fields))

    def delete(self, name: str, keys: DataFrame) -> Batch:
        """Delete the rows whose keys (the key columns, or their first) are in ``keys``."""
        on = [c for c in keys.columns if name in SCHEMAS and c in SCHEMAS[name].names]
        if not on:
            raise InvalidOperation(f"no column of {name} to delete by")
        return self._stage("delete", name, keys.select(*on).distinct())

    def delete_memories(self, ids: DataFrame, cascade: bool = True) -> Batch:
        """Delete memories and, with ``cascade``, the links, vectors and memberships that name them."""
        ids = ids.select(F.col(ids.columns[0]).alias("id")).distinct()
        self.delete("memories", ids)
        if cascade:
            for end in ("source_id", "target_id"):
                self.delete("links", ids.withColumnRenamed("id", end))
            for name in ("vectors", "collection_members", "context_members"):
                self.delete(name, ids.withColumnRenamed("id", "memory_id"))
        return self

    def fold(self, name: str, steps: Steps, files: int | None = None) -> None:
        """Write the table that some steps make up as a new base for them, in ranges of its key."""
        rows = self.store.rows_of(name, steps)
        order = [*PARTITIONED.get(name, ()), *_by_key(name)]
        ranged = rows.repartitionByRange(files, *order) if files else rows.repartitionByRange(*order)
        self.folded[name] = (steps, self._write(ranged, name))

    def _write(self, rows: DataFrame, name: str, kind: str = "base") -> str:
        folder = f"data/{uuid.uuid4().hex}/{name}"
        writer = rows.write
        if kind != "delete":
            first = _by_key(name)[0]
            inner = list(PARTITIONED.get(name, ()))
            if inner and kind == "put":  # few files a folder
                rows = rows.repartition(*inner)
            writer = rows.sortWithinPartitions(*inner, *_by_key(name)).write.option(f"parquet.bloom.filter.enabled#{first}", "true")
            if inner:
                writer = writer.partitionBy(*inner)
        writer.parquet(f"{self.store.root}/{folder}")
        return folder

    def _postings(self, kind: str, folder: str) -> list[tuple[str, str, str]]:
        """What a written step of the memories means for the postings, written too."""
        store = self.store
        if kind == "delete":
            rows = store.spark.read.parquet(f"{store.root}/{folder}")
            ids = rows if "id" in rows.columns else store.read("memories").join(rows, rows.columns, "left_semi")
        else:
            rows = ids = store.spark.read.schema(SCHEMAS["memories"]).parquet(f"{store.root}/{folder}")
        out = [("delete", "postings", self._write(ids.select(F.col("id").alias("memory_id")).distinct(), "postings", "delete"))]
        if kind != "delete":
            out.append(("put", "postings", self._write(text_search.postings(rows), "postings", "put")))
        return out

    def _index(self, steps: Steps) -> str:
        made = text_search.postings(self.store.rows_of("memories", steps))
        return self._write(made.repartitionByRange(*_by_key("postings")), "postings")

    def commit(self, application: str | None = None, batch_id: int = 0) -> int:
        """Write what is staged and make it the next version, after whatever was committed meanwhile.

        With an ``application`` the manifest keeps the number of its batch, and a batch whose number, or a later one, is
        there adds nothing: a batch that is run again after a crash counts once.
        """
        if not self.open:
            raise InvalidOperation("the batch has ended")
        store, self.open = self.store, False
        if application is not None and store.applied(application) >= batch_id:
            return store.version()
        wrote = [(kind, name, self._write(rows, name, kind)) for kind, name, rows in self.steps]
        indexed: list[tuple[str, str, str]] | None = None
        base, of = None, self.index_of
        if of is not None:
            base = self._index(of)
        while True:
            now = store.version()
            whole = store._whole(now)
            if application is not None and whole["applied"].get(application, -1) >= batch_id:
                return now
            manifest = whole["tables"]
            if of is not None:
                memories = manifest.get("memories", [])
                if memories[: len(of)] != of:  # written anew meanwhile
                    base, of = self._index(memories), memories
                late = [x for kind, folder in memories[len(of) :] for x in self._postings(kind, folder)]
                manifest["postings"] = [["base", base], *[[kind, folder] for kind, _, folder in late]]
            for name, (steps, folder) in self.folded.items():
                if manifest.get(name, [])[: len(steps)] == steps:  # else another commit folded them
                    manifest[name] = [["base", folder], *manifest.get(name, [])[len(steps) :]]
            if indexed is None and "postings" in manifest:  # an index may have come since the batch began
                indexed = [x for kind, name, folder in wrote if name == "memories" for x in self._postings(kind, folder)]
            for kind, name, folder in [*wrote, *(indexed or ())]:
                manifest[name] = [*manifest.get(name, []), [kind, folder]]
            if application is not None:
                whole["applied"][application] = batch_id
            if store._create(now + 1, whole):
                break
            indexed = None
        long = [name for name, steps in manifest.items() if len(steps) > MOST_CHANGES and name not in self.folded]
        if long:
            after = Batch(store)
            for name in long:
                after.fold(name, manifest[name])
            after.commit()
        return now + 1

    def abort(self) -> None:
        self.steps, self.folded, self.open = [], {}, False


def latest(log: DataFrame, keys: tuple[str, ...] = ("id",), version: str = "version") -> DataFrame:
    """The row of the highest version of each key in an append-only log."""
    names = [c for c in log.columns if c not in keys]
    return log.groupBy(*keys).agg(F.max_by(F.struct(*names), version).alias("_row")).select(*keys, "_row.*").select(*log.columns)


def table_counts(tables: Tables) -> DataFrame:
    """table, rows for each of the five kinds of records."""
    names = ("memories", "links", "collections", "agents", "contexts")
    counted = [getattr(tables, n).agg(F.lit(n).alias("table"), F.count(F.lit(1)).alias("rows")) for n in names]
    return reduce(DataFrame.unionByName, counted)


def merge_update(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Rows of ``old`` with the fields of ``new`` that say something.

    An empty string keeps the old text, and a number must be above 0 to count. Rows that ``old`` lacks
    are added.
    """
    other = new.select(*[F.col(c).alias(f"_{c}") for c in new.columns])
    met = old.join(other, F.col(key) == F.col(f"_{key}"), "full")
    fields = []
    for name, kind in old.dtypes:
        if name not in new.columns:
            fields.append(F.col(name))
        elif kind == "string":
            fields.append(F.when(F.coalesce(F.col(f"_{name}"), F.lit("")) != "", F.col(f"_{name}")).otherwise(F.col(name)).alias(name))
        elif kind in ("double", "float", "bigint", "int"):
            fields.append(F.when(F.col(f"_{name}") > 0, F.col(f"_{name}")).otherwise(F.col(name)).alias(name))
        else:
            fields.append(F.coalesce(f"_{name}", name).alias(name))
    return met.select(*fields)
