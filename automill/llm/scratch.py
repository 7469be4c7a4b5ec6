"""Tables written between the stages of one operator.

Lineage is cut by writing Parquet to the folder named by ``spark.checkpoint.dir``, which every
executor shares, so a lost executor costs a reread and never a recomputation of the stages before.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_live: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder; without one a folder of our own, where driver and executors are one machine."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("automill.scratch.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="automill-")
        spark.conf.set("automill.scratch.dir", folder)
    return folder.rstrip("/")


def keep(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and return what a reader gets back."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/automill/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)  # snappy's buffers are off the heap and outlive the task
    _live.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._automill_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables of ``keep`` that no later plan reads."""
    for df in tables:
        _delete(df.sparkSession, df._automill_path)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _clear() -> None:
    for spark, path in _live:
        try:
            _delete(spark, path)
        except Exception:  # the session may already be gone
            return
