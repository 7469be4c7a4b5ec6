"""Cutting lineage between the rounds of an iterative plan."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The cluster's shared folder; where none is set, one of our own, if driver and executors are one machine."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        shared = context.getConf().get("spark.checkpoint.dir")
        if not shared and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="automill-"))
    return context.getCheckpointDir()


def keep(df: DataFrame) -> DataFrame:
    """df written to the shared folder, and read again: a lost executor costs a reread, and plans do not grow."""
    path = f"{folder(df.sparkSession)}/kept-{uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._kept_path = path
    return out


def still_there(df: DataFrame) -> bool:
    """Whether the files of a table of ``keep`` have not been deleted since."""
    spark = df.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(df._kept_path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)
