"""Thin queries of the native operators and of mixing: the operators' outputs reduced to digests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from automill.llm import chat, exact_dedup, line_dedup, mixing


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"), digest_all=True)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.line_dedup(_table(spark, sf_dir, "documents"))
    text = F.coalesce("text", F.lit(""))
    return out.select(
        "doc_id",
        F.col("__lines_gone").alias("n_removed"),
        F.length(text).cast("long").alias("n_chars"),
        F.sha2(text.cast("binary"), 256).alias("text_sha256"),
    )


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    says = F.lit("\\### Assistant: </turn> ok")
    more = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        says.alias("text"),
    )
    out = chat.format_chats(rows.unionByName(more))
    told = F.array_join(F.transform("parsed", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    out = out.withColumn("loss", chat.masked_text(F.col("formatted"), F.col("mask")))
    return out.select(
        "conv_id",
        F.size("parsed").cast("long").alias("n_turns"),
        F.sha2(told.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "exact",
    )


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_counts(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_exact_dedup, op2_line_dedup, op5_chat_format, op8_mixing)}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP1 = f"""
WITH d AS (SELECT doc_id, {_LOWER} AS t FROM documents)
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY t) AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept,
       sha256(t) AS text_sha256
FROM d
"""

_OP5 = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), w AS (
  SELECT *, (CASE WHEN contains(text, '</turn>') OR contains(text, '### ') OR contains(role, '### ') OR contains(text, '\\') OR contains(text, '\l') OR contains(text, '\h')
                    OR contains(text, '\c') OR contains(role, '\\') OR contains(role, '\l') OR contains(role, '\h')
                    OR contains(role, '\c') OR contains(role, ': ') OR contains(role, '</turn>')
               THEN length(role) + length(text)
                    + length(regexp_replace(role || text, '[^\\<#:]', '', 'g'))
               ELSE length(role) + length(text) END) + 14 AS written
  FROM c
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(written)::BIGINT AS formatted_chars,
       true AS exact
FROM w GROUP BY conv_id
"""

_DRAW = "('0x' || substr(md5(concat(coalesce(doc_id::VARCHAR, ''), ':', {seed}::VARCHAR)), 1, 8))::BIGINT / 4294967296.0::DOUBLE"

_OP8 = f"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS r FROM d GROUP BY source
), w AS (
  SELECT source, source_size, CASE r WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s
), o AS (
  SELECT *, sum(3 * source_size) OVER p - 3 * source_size AS held, sum(weight) OVER q AS w_left, sum(source_size) OVER () AS total, row_number() OVER p AS rk
  FROM w WINDOW p AS (ORDER BY 3.0 * source_size / weight, source ROWS UNBOUNDED PRECEDING),
                q AS (ORDER BY 3.0 * source_size / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
), l AS (
  SELECT coalesce(arg_min((total - held)::DOUBLE / w_left::DOUBLE, rk) FILTER ((total - held)::DOUBLE / w_left::DOUBLE * weight < 3 * source_size), 0) AS level FROM o
), t AS (
  SELECT source, source_size, least((3 * source_size)::DOUBLE, level * weight) AS target FROM w, l
), r AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM t
), k AS (
  SELECT r.source, seed, abs(sum(size * floor(rate)) + sum(CASE WHEN {_DRAW.format(seed='seed')} < rate - floor(rate) THEN size ELSE 0 END) - any_value(target)) AS miss
  FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source, range(16) AS g(seed) GROUP BY r.source, seed
), b AS (
  SELECT source, arg_min(seed, (miss, seed)) AS seed FROM k GROUP BY source
), c AS (
  SELECT doc_id, size, source_size, target,
         (floor(rate) + CASE WHEN {_DRAW.format(seed='b.seed')} < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT AS copies
  FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source JOIN b ON d.source IS NOT DISTINCT FROM b.source
)
SELECT doc_id, size, source_size, target, size * copies AS taken, copies FROM c
"""

ORACLES = {"op1_exact_dedup": _OP1, "op5_chat_format": _OP5, "op8_mixing": _OP8}
