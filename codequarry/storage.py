"""Shared storage for intermediate tables: how iterative operators cut their lineage."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors share, and there below the application's id.

    Where that is unset a temporary folder takes its place if driver and executors are one process; a cluster needs the setting.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not base:
        base = "file://" + tempfile.mkdtemp(prefix="codequarry-")
        spark.conf.set("spark.checkpoint.dir", base)
    if "://" not in base:
        base = "file://" + os.path.abspath(base)
    return f"{base.rstrip('/')}/codequarry/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


#: Bytes of a row group of intermediate tables: a writing task holds one in memory.
ROW_GROUP = 32 << 20


def bound_batches(spark: SparkSession, most: int = 4 << 20) -> None:
    """Bound Arrow batches to Python workers by bytes; rows alone don't bound them, as files and texts may be long."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", most)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to shared storage and read it back: a lost executor costs one read, not a recomputation."""
    path = shared_dir(df.sparkSession, name)
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder of shared storage."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def forget(df: DataFrame) -> None:
    """Remove a table that ``cut`` wrote, once nothing reads it any more: iterations keep their last states only."""
    if "_stored_at" in vars(df):
        remove(df.sparkSession, df._stored_at)


def open_fs(uri: str):
    """The file system and the path in it of a URI (local, HDFS, S3 and whatever else Arrow opens)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


#: Bytes that opening a file counts for where a table is many small files; Spark's default, 4 MB, makes a task of every few.
OPENING = 64 << 10


def many_files(spark: SparkSession, load):
    """What ``load`` reads from a tree of many small files: listed by some tasks a core, not by one a folder, and read by tasks of many files each."""
    listing, opening = "spark.sql.sources.parallelPartitionDiscovery.parallelism", "spark.sql.files.openCostInBytes"
    before = spark.conf.get(listing)
    spark.conf.set(listing, min(int(before), 4 * spark.sparkContext.defaultParallelism))
    try:
        out = load()  # lists the files
    finally:
        spark.conf.set(listing, before)
    spark.conf.set(opening, OPENING)  # asked when the files are read
    return out
