"""Small side inputs: frequency files, configurations and result tables."""

from __future__ import annotations

import ast
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def frequencies(spark: SparkSession, path: str) -> DataFrame:
    """Pairs 'id value' separated by white space: id, freq."""
    words = F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ")
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.get(words, F.lit(0)).alias("id"), F.get(words, F.lit(1)).cast("double").alias("freq"))


def config(spark: SparkSession, path: str) -> dict:
    """A configuration as JSON or as a Python literal; nothing in it is run."""
    text = spark.read.text(path, wholetext=True).first()[0]
    try:
        return json.loads(text)
    except ValueError:
        return ast.literal_eval(text)


def results(spark: SparkSession, path: str) -> DataFrame:
    """A result table (config, one column per app) in long form: config, app, value."""
    wide = spark.read.csv(path, header=True)
    first = wide.columns[0]
    apps = wide.columns[1:]
    long = wide.select(F.col(first).alias("config"), F.explode(F.create_map(*[x for a in apps for x in (F.lit(a), F.col(f"`{a}`").cast("string"))])).alias("app", "value"))
    return long.where(F.col("value").isNotNull()).withColumn("value", F.expr("try_cast(value AS double)"))


def merge_results(tables: list[DataFrame]) -> DataFrame:
    """Long tables as one: a row per app, a column per config, missing values null."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out.groupBy("app").pivot("config").agg(F.first("value", ignorenulls=True))
