"""The thin query of near-duplicate detection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from automill.llm import near_dedup


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op6_near_dedup": op6_near_dedup}
