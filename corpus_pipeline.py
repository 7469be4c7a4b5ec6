"""From raw documents to a mixed training corpus, in five stages.

Every stage takes what its predecessor kept, and all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from automill.llm import decontaminate, line_dedup, mixing, near_dedup, quality
from automill.llm.queries_models import GOOD, quality_model
from automill.llm.scratch import keep
from automill.llm.text import free_prefix


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality classifier rejects.

    Null text counts as empty, and texts without features, or all texts where there are no labels, get the labels' mean
    or 0.5, which is accepted or not as any score; repeated rows stay or go together; an empty table stays empty.
    """
    return quality.keep_good(docs, quality_model(spark, sf_dir), GOOD)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without runs of words that occur earlier; a document of which nothing is left goes.

    Null and empty texts stay as they are; ``n_chars`` follows the text where it changes.
    """
    runs = f"{free_prefix(docs.columns)}runs"
    out = line_dedup.line_dedup(docs, count_col=runs)
    changed = F.col(runs) > 0
    out = out.where(~changed | (F.btrim("text", F.lit(" \t\r\n\x0b\x0c")) != ""))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(changed, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates; of rows that repeat an id, the one with the greatest text, then by a hash of all columns."""
    name = f"{free_prefix(docs.columns)}id"
    found = keep(near_dedup.near_dedup(docs).select(F.col("doc_id").alias(name), "kept"), "pipeline-near")
    gone = found.where("not kept").select(name).distinct()
    few = gone.count() <= near_dedup.BROADCAST_IDS
    out = docs.join(F.broadcast(gone) if few else gone, F.col("doc_id") == F.col(name), "left_anti")
    again = keep(found.where(F.col(name).isNotNull()).groupBy(name).count().where("count > 1").select(name), "pipeline-again")
    if again.isEmpty():
        return out
    twice = out.join(again, F.col("doc_id") == F.col(name), "left_semi")
    order = F.struct(F.coalesce("text", F.lit("")), F.xxhash64(*docs.columns))
    once = twice.groupBy(F.col("doc_id").alias(name)).agg(F.max_by(F.struct(*docs.columns), order).alias("row"))
    once = once.select(*[F.col("row")[c].alias(c) for c in docs.columns])
    return out.join(again, F.col("doc_id") == F.col(name), "left_anti").unionByName(once)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents in which a window of a benchmark item occurs.

    Null and empty texts have none and stay, as do all rows where the benchmark is empty; repeated rows stay or go together.
    """
    return decontaminate.without_benchmark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's rate says; ``copy`` counts from 0.

    Sources without words, and null or empty texts in them, are not emitted; a null source is one of its own; rows that
    repeat an id are drawn alike. A column ``copy`` of the documents stays, and the count has another name then.
    """
    return mixing.mix(docs)


STAGES = [
    ("quality", good_quality),
    ("line dedup", without_repeats),
    ("near dedup", one_of_each),
    ("decontamination", uncontaminated),
    ("mixing", mixed),
]

#: The classifier can't be expressed in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
