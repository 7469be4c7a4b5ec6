"""Thin queries of the operators that learn or scan with Arrow batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from automill.llm import decontaminate, langid, quality

#: A document's quality is accepted from this score on.
GOOD = 0.3


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(n))


def quality_model(spark: SparkSession, sf_dir: str) -> dict:
    """Learnt from the labelled rows of the training folds."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    return quality.train(docs.where(fold(5) != 0), labels.where(fold(5) != 0))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.classify(_table(spark, sf_dir, "documents"), quality_model(spark, sf_dir))
    return out.select("doc_id", (fold(5) == 0).alias("held_out"), "score", F.when(F.col("score") >= GOOD, 1).otherwise(0).alias("predicted"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    out = langid.predict(docs, langid.train(docs.where(fold(3) != 1)))
    return out.select("doc_id", (fold(3) == 1).alias("held_out"), "lang_pred", "score")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontaminate.find_benchmark(docs, _table(spark, sf_dir, "benchmark"), with_spans=False)
    hit = F.aggregate("__runs", F.lit(0).cast("long"), lambda acc, r: acc + r["b"] - r["a"])
    return out.select(
        "doc_id",
        F.col("__words").alias("n_words"),
        hit.alias("n_hit"),
        F.size("__items").cast("long").alias("n_items"),
        F.sha2(F.array_join("__items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("__runs") > 0).alias("contaminated"),
    )


QUERIES = {f.__name__: f for f in (op3_quality, op7_language_id, op9_decontamination)}

_OP9 = r"""
WITH
i AS (SELECT coalesce(item_id::VARCHAR, '') AS item,
        regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w
      FROM benchmark WHERE text IS NOT NULL),
p AS (SELECT DISTINCT item, array_to_string(w[k + 1 : least(k + 10, len(w))], ' ') AS win, least(len(w), 10) AS n
      FROM i, range(0, 1 + greatest(len(w) - 10, 0)) AS r(k) WHERE len(w) > 0),
d AS (SELECT doc_id, row_number() OVER () AS rid,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w
      FROM documents),
g AS (SELECT rid, s.n, k, array_to_string(w[k + 1 : k + s.n], ' ') AS win
      FROM d CROSS JOIN (SELECT DISTINCT n FROM p) s CROSS JOIN range(0, 1 + greatest(len(w) - s.n, 0)) AS r(k) WHERE len(w) >= s.n),
h AS (SELECT g.rid, g.k, g.n, p.item FROM g JOIN p ON g.n = p.n AND g.win = p.win),
c AS (SELECT rid, count(DISTINCT pos) AS n_hit FROM h, range(k, k + n) AS r(pos) GROUP BY rid),
t AS (SELECT rid, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (rid) LEFT JOIN t USING (rid)
"""

ORACLES = {"op9_decontamination": _OP9}
