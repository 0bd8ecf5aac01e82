"""Lineage cuts for loops, and folders that jobs share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Only where that is unset and the master is local, as in tests,
    a local folder is made; executors of a cluster couldn't see it."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tubula-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """The frame without its lineage: a stored table, whose size Spark knows, so that joins with small ones
    need no exchange."""
    return stored(df, "cut")


def stored(df: DataFrame, name: str) -> DataFrame:
    """The frame written as Parquet in the shared folder and read again: this cuts lineage, the files
    outlive executors, and Spark knows the size of what it reads."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def spread(df: DataFrame) -> DataFrame:
    """The frame marked as one that grows with the input: joins sort and merge it. Spark would otherwise broadcast it
    whenever its files are small, though its rows take up to a hundred times as much in the driver's memory."""
    return df.hint("merge")


def discard(*frames: DataFrame | None) -> None:
    """Delete the files of stored frames that nothing reads any more; other frames are left alone."""
    for df in frames:
        if path := getattr(df, "_stored_at", None):
            jvm = df.sparkSession._jvm
            folder = jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)
