"""The folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """What the session's spark.checkpoint.dir names. Where it is unset a local session takes a temporary folder."""
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


def written(df: DataFrame, what: str) -> DataFrame:
    """df, written once to the shared folder and read again: what lost executors held isn't computed again."""
    path = new_folder(df.sparkSession, what)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> bool:
    """Delete a folder or file through the session's own file system; False if there is none."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
