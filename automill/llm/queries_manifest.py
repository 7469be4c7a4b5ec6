"""The thin query of the Merkle manifest, and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from automill.llm import merkle_manifest

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, of which some have lost their line ends since their manifest was made."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    touched = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    text = F.when(touched, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    present = [text if c == "text" else F.col(c) for c in FIELDS]
    return merkle_manifest.build(docs, FIELDS, present=present).prove()


QUERIES = {"op11_merkle_manifest": op11_merkle_manifest}

_FIELD = "coalesce(strlen({0}::VARCHAR) || ':' || {0}::VARCHAR, '-')"
_LEAF = "sha256(concat(" + ", ".join(_FIELD.format(c) for c in FIELDS[:-1]) + ", {0}))"

# A node is (tree, level, place, h): the documents' trees by source, then the tree '' of their roots.
_OP11 = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '-' ELSE '=' || source END AS g, {_LEAF.format(_FIELD.format('text'))} AS leaf,
         {_LEAF.format(_FIELD.format("replace(text, chr(10), '')"))} AS cut,
         list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
           lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS crc
  FROM documents
), r AS (
  SELECT doc_id, g, leaf, CASE WHEN coalesce(crc % 2 = 1, false) THEN cut ELSE leaf END AS now,
         row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p, count(*) OVER (PARTITION BY g) AS n
  FROM d
), up AS (
  SELECT g, 0 AS lv, p, n, leaf AS h FROM r
  UNION ALL
  SELECT g, any_value(lv) + 1, p // 3, any_value((n + 2) // 3), sha256(string_agg(h, '' ORDER BY p)) FROM up WHERE n > 1 GROUP BY g, lv, p // 3
), subs AS (
  SELECT g, h, row_number() OVER (ORDER BY g) - 1 AS p, count(*) OVER () AS n FROM up WHERE n = 1
), top AS (
  SELECT 0 AS lv, p, n, h FROM subs
  UNION ALL
  SELECT any_value(lv) + 1, p // 3, any_value((n + 2) // 3), sha256(string_agg(h, '' ORDER BY p)) FROM top WHERE n > 1 GROUP BY lv, p // 3
), s AS (
  SELECT g, lv, p, n, p // 3 AS run, h FROM up WHERE n > 1
), sib AS (
  SELECT a.g, a.lv, a.p, coalesce(string_agg(b.h, '' ORDER BY b.p) FILTER (b.p < a.p), '') AS l, coalesce(string_agg(b.h, '' ORDER BY b.p) FILTER (b.p > a.p), '') AS t
  FROM s a JOIN s b USING (g, lv, run) GROUP BY a.g, a.lv, a.p
), tsib AS (
  SELECT a.lv, a.p, coalesce(string_agg(b.h, '' ORDER BY b.p) FILTER (b.p < a.p), '') AS l, coalesce(string_agg(b.h, '' ORDER BY b.p) FILTER (b.p > a.p), '') AS t
  FROM top a JOIN top b ON a.lv = b.lv AND a.p // 3 = b.p // 3 WHERE a.n > 1 GROUP BY a.lv, a.p
), fold AS (
  SELECT doc_id, g, leaf, p AS rank, 0 AS lv, p, now AS h, '' AS proof FROM r
  UNION ALL
  SELECT f.doc_id, f.g, f.leaf, f.rank, f.lv + 1, f.p // 3, sha256(concat(x.l, f.h, x.t)), concat(f.proof, x.l, x.t)
  FROM fold f JOIN sib x ON x.g = f.g AND x.lv = f.lv AND x.p = f.p
), half AS (
  SELECT doc_id, f.g, leaf, rank, subs.h AS subroot, subs.p AS sp, f.h AS now, proof
  FROM fold f JOIN subs USING (g) JOIN (SELECT g, lv FROM up WHERE n = 1) e ON e.g = f.g AND e.lv = f.lv
), fold2 AS (
  SELECT doc_id, g, leaf, rank, subroot, 0 AS lv, sp AS p, now AS h, proof FROM half
  UNION ALL
  SELECT doc_id, g, leaf, rank, subroot, f.lv + 1, f.p // 3, sha256(concat(x.l, f.h, x.t)), concat(f.proof, x.l, x.t)
  FROM fold2 f JOIN tsib x ON x.lv = f.lv AND x.p = f.p
)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, f.h AS folded_root, f.h = root AS verified
FROM fold2 f, (SELECT lv, h AS root FROM top WHERE n = 1) z WHERE f.lv = z.lv
"""

ORACLES = {"op11_merkle_manifest": _OP11}
