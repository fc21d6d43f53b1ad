"""Session construction and the folder that all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(name: str = "lorekeep", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with UTC timestamps and adaptive execution; cluster settings stay with spark-submit."""
    builder = (
        SparkSession.builder.appName(name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the cluster.

    ``spark.checkpoint.dir`` is read from the session. Only a local master, where driver and
    executors are one process, may fall back on a temporary folder; elsewhere the setting is required.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    folder = folder or context.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = os.path.join(tempfile.gettempdir(), f"lorekeep-{os.getuid()}-{context.applicationId}")
    context.setCheckpointDir(folder)
    return folder


#: Whether Spark deletes the shuffle files of a job when it ends.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str, free_shuffles: bool = False, codec: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    It cuts the lineage and outlives a lost executor. The files stay until :func:`clear_materialized`
    or whoever owns the checkpoint folder deletes them. With ``free_shuffles`` the shuffle files behind ``df`` go
    once it is written, and not when the driver collects garbage. ``codec`` is the compression of the files.
    """
    spark = df.sparkSession
    path = f"{own_folder(spark)}/{uuid.uuid4().hex}/{name}"
    before = spark.conf.get(FREE_SHUFFLES, "false")
    if free_shuffles:
        spark.conf.set(FREE_SHUFFLES, "true")
    try:
        (df.write.option("compression", codec) if codec else df.write).parquet(path)
    finally:
        if free_shuffles:
            spark.conf.set(FREE_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table that :func:`materialize` wrote and nothing will read again."""
    files = df.inputFiles()
    if files:
        _delete(df.sparkSession, files[0].rpartition("/")[0])


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def own_folder(spark: SparkSession) -> str:
    """Where this application writes in the shared folder."""
    return f"{shared_folder(spark)}/lorekeep/{spark.sparkContext.applicationId}"


def clear_materialized(spark: SparkSession) -> None:
    """Delete what :func:`materialize` wrote in this application; no DataFrame from before can be read then."""
    _delete(spark, own_folder(spark))
