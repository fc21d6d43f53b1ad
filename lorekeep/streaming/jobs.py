"""Structured Streaming over logs of accesses and new memories."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from lorekeep.sources.store import GraphStore


def read_log(spark: SparkSession, path: str, schema: T.StructType | str, files_per_trigger: int | None = None, pattern: str | None = None) -> DataFrame:
    """A stream of the Parquet files of a folder."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.parquet(path)


def read_table(spark: SparkSession, folder: str, name: str, schema: T.StructType | str) -> DataFrame:
    """A stream of one Parquet table of a folder, be it a file or a folder of files."""
    # a stream reads a single file by a pattern only
    return read_log(spark, f"{folder.rstrip('/')}/{name}.parque[t]", schema)


def access_counts(accesses: DataFrame) -> DataFrame:
    """memory_id, access_count, last_accessed so far; for update or complete mode."""
    return accesses.groupBy("memory_id").agg(F.count(F.lit(1)).alias("access_count"), F.max("accessed_at").alias("last_accessed"))


def windowed_counts(events: DataFrame, ts: str = "ts", by: str = "event_type", size: str = "1 hour", slide: str | None = None, late: str = "2 hours") -> DataFrame:
    """start, key, events in tumbling or sliding windows; rows later than ``late`` are dropped."""
    rows = events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    counted = rows.groupBy(F.window("_ts", size, slide), F.col(by).alias("key")).agg(F.count(F.lit(1)).alias("events"))
    return counted.select(F.col("window.start").alias("start"), "key", "events")


def session_counts(events: DataFrame, ts: str = "ts", by: str = "user_id", gap: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """start, end, key, events of sessions that end after ``gap`` without an event."""
    rows = events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    counted = rows.groupBy(F.session_window("_ts", gap).alias("w"), F.col(by).alias("key")).agg(F.count(F.lit(1)).alias("events"))
    return counted.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "key", "events")


def once_each(events: DataFrame, keys: list[str], ts: str, late: str = "2 hours") -> DataFrame:
    """Each key once, however often it is delivered within ``late``."""
    return events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late).dropDuplicatesWithinWatermark(keys).drop("_ts")


#: Keyed state with timers needs this store of states.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Expiry(StatefulProcessor):
    """The latest row of an id, and a timer: at the end of its time to live, or, if it has none, when older rows are late anyway."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.latest = handle.getValueState("latest", "at bigint, due bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        known = self.latest.get()
        at, due = known or (None, None)
        mark = timerValues.getCurrentWatermarkInMs()
        for row in rows:
            own = row["at"]
            if own is None or own < mark:  # too late, also where Spark's own filter is a batch behind
                continue
            ends = None if row["ttl"] is None else own + row["ttl"] * 1000
            # of rows at the same time the one that lives longest counts, without a ttl for ever
            if at is None or own > at or own == at and due is not None and (ends is None or ends > due):
                at, due = own, ends
        if at is not None:
            for timer in list(self.handle.listTimers()) if known else []:  # a new id has none
                self.handle.deleteTimer(timer)
            self.latest.update((at, due))
            self.handle.registerTimer(max(at + 1 if due is None else due, mark + 1))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        _, due = self.latest.get()
        self.latest.clear()
        return iter(()) if due is None else iter((Row(id=key[0], due=due),))

    def close(self) -> None:
        pass


def expiries(memories: DataFrame, late: str = "1 hour") -> DataFrame:
    """id, expired_at: memories whose time to live ran out, by a timer for each id.

    ``memories`` streams id, timestamp and ttl (seconds). The latest row of an id by its timestamp counts, in
    whatever order rows come: it moves the timer, forward or back, or clears it if it has no ttl. A timer ends
    when the watermark passes its time. Rows later than ``late`` are dropped, so nothing is kept of an id once its timer has ended.
    """
    memories.sparkSession.conf.set(*STATE_STORE)
    rows = memories.select("id", "ttl", F.col("timestamp").cast("timestamp").alias("moment")).withWatermark("moment", late)
    # as milliseconds, since the times of pandas end in the year 2262
    rows = rows.select("id", "ttl", F.unix_millis("moment").alias("at"))
    ended = rows.groupBy("id").transformWithState(Expiry(), "id string, due bigint", "append", "EventTime")
    return ended.select("id", F.timestamp_millis("due").alias("expired_at"))


def upsert_into(store: GraphStore, table: str = "memories", application: str | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink: the rows of a batch replace those of the same id.

    Within a batch the row with the latest timestamp wins. With an ``application`` the store keeps the number of
    its last batch, so that a batch that is run again after a crash commits nothing.
    """

    def write(batch: DataFrame, number: int) -> None:
        latest = batch.groupBy("id").agg(F.max_by(F.struct(*[c for c in batch.columns if c != "id"]), "timestamp").alias("r")).select("id", "r.*")
        store.batch().put(table, latest).commit(application, number)

    return write


def _stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id of the stream that a checkpoint belongs to; a new checkpoint has another one."""
    return json.loads(spark.read.text(f"{checkpoint}/metadata").first()[0])["id"]


def ingest(stream: DataFrame, store: GraphStore, checkpoint: str, application: str | None = None) -> StreamingQuery:
    """Upsert a stream into a store, each batch once; the stream is known by the id in its checkpoint unless it has a name."""

    def write(batch: DataFrame, number: int) -> None:
        upsert_into(store, application=application or _stream_id(store.spark, checkpoint))(batch, number)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_to_end(stream: DataFrame, checkpoint: str, mode: str = "complete") -> DataFrame:
    """All that a stream has to say about the files that are there now, as a batch table of Parquet files beside the checkpoint.

    In append mode rows go to a file sink, each once; in complete mode each batch writes the whole result into
    a folder of its own, and the last one counts. Nothing passes through the driver.
    """
    spark, folder = stream.sparkSession, f"{checkpoint.rstrip('/')}-rows"
    written: list[int] = []
    if mode == "append":
        out = stream.writeStream.format("parquet").option("path", folder).outputMode("append")
    else:

        def write(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{folder}/batch-{number}")
            written.append(number)

        out = stream.writeStream.foreachBatch(write).outputMode(mode)
    out.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    if mode == "append":
        return spark.read.schema(stream.schema).parquet(folder)
    return spark.read.schema(stream.schema).parquet(f"{folder}/batch-{written[-1]}") if written else spark.createDataFrame([], stream.schema)
