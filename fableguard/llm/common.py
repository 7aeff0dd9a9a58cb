"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import tempfile
import uuid

import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words: blank and the ASCII controls tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: So many equal rows are made of one row at once; beyond that the work is dealt over tasks.
BLOCK = 1 << 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is configured a local session takes a temporary one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="fableguard-")
        spark.conf.set("spark.checkpoint.dir", path)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path


def new_folder(spark: SparkSession, what: str) -> str:
    return os.path.join(shared_dir(spark), f"{what}-{uuid.uuid4().hex}")


def saved(df: DataFrame, what: str) -> DataFrame:
    """df, written once to the shared folder and read again: lost executors don't recompute it.

    The shuffle files of the write go when it has ended, as nothing reads them again.
    """
    spark, path = df.sparkSession, new_folder(df.sparkSession, what)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def release(*tables: DataFrame) -> None:
    """Delete saved tables that nothing reads any more."""
    for folder in {os.path.dirname(f) for t in tables for f in t.inputFiles()}:
        store, path = pyarrow.fs.FileSystem.from_uri(folder)
        store.delete_dir(path)


def uniform(*cols: Column) -> Column:
    """A number in [0, 1) that depends on cols alone."""
    return (F.shiftrightunsigned(F.xxhash64(*cols), 11)).cast("double") / F.lit(float(2**53))


def repeated(df: DataFrame, times: str) -> DataFrame:
    """Each row as often as its column ``times`` (0: never) tells, without that column."""
    cols = [c for c in df.columns if c != times]
    blocks = df.where(F.col(times) > BLOCK).withColumn("block_no", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(times) - 1) / BLOCK))))
    blocks = blocks.repartition(*cols, "block_no").withColumn(times, F.least(F.lit(BLOCK), F.col(times) - F.col("block_no") * BLOCK))
    few = df.where(F.col(times).between(1, BLOCK)).select(*cols, F.col(times).cast("long").alias(times))
    whole = few.unionByName(blocks.select(*cols, F.col(times).cast("long").alias(times)))
    return whole.withColumn(times, F.explode(F.array_repeat(F.lit(0), F.col(times).cast("int")))).select(*cols)
