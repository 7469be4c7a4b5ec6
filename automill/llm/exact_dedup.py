"""Exact deduplication by progressive refinement.

Rows are grouped by length, within that by the hash of a prefix, and only rows of groups that still
have company are hashed in full. The first two refinements need one narrow pass: a (length, prefix)
group of two or more rows is also a length group of two or more. The full hash decides.

Edge cases: null text counts as empty; a null id never outranks another id, and a group of null ids
only has a null ``keep_id``; repeated rows of the kept id are the same document and all stay; an
empty table gives an empty result; columns other than id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from automill.llm.scratch import drop, keep
from automill.llm.text import ascii_lower, filled

#: Characters under the prefix hash.
PREFIX = 256
#: Surviving (length, prefix) groups that are broadcast at most; 12 bytes each.
BROADCAST_GROUPS = 200_000


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, prefix: int = PREFIX, digest_all: bool = False
) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept and text_sha256.

    ``text_sha256`` is null for rows without an equal one, unless ``digest_all`` asks for it.
    The surviving groups are broadcast while they are few, and joined by a shuffle of their keys beyond that, before any full hash.
    """
    rows = docs.select(F.col(id_col).alias("id"), ascii_lower(filled(text_col)).alias("t"))
    shape = (F.octet_length("t").alias("len"), F.xxhash64(F.substring("t", 1, prefix)).alias("ph"))
    company = keep(
        rows.select(*shape).groupBy("len", "ph").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("len", "ph"),
        "exact-company",
    )
    rows = rows.select("id", "t", *shape)
    marked = company.select(F.col("len").alias("len_"), F.col("ph").alias("ph_"), F.xxhash64("len", "ph").alias("key_"), F.lit(True).alias("again"))
    few = company.count() <= BROADCAST_GROUPS
    # The third key makes both sides of the join exchange anew, so a group with a third of all rows can be split.
    same = (F.xxhash64("len", "ph") == F.col("key_")) & (F.col("len") == F.col("len_")) & (F.col("ph") == F.col("ph_"))
    rows = rows.join(F.broadcast(marked) if few else marked, same, "left")
    again = F.coalesce("again", F.lit(False))
    sha = F.sha2(F.col("t").cast("binary"), 256)
    hashed = keep(
        rows.select("id", again.alias("again"), (sha if digest_all else F.when(again, sha)).alias("sha")), "exact-hashes"
    )
    drop(company)
    groups = (
        hashed.where("again").groupBy("sha").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    ).where("group_size > 1")
    # The second key makes both sides of the join exchange anew, so a group with a third of all rows can be split.
    left = hashed.withColumn("key", F.when(F.col("again"), F.xxhash64("sha")))
    right = groups.select(F.col("sha").alias("sha_"), F.xxhash64("sha").alias("key_"), "keep_id", "group_size")
    joined = left.join(right, (F.col("key") == F.col("key_")) & (F.col("sha") == F.col("sha_")), "left")
    keep_id = F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id"))
    return joined.select(
        F.col("id").alias(id_col),
        keep_id.alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.col("id").eqNullSafe(keep_id).alias("kept"),
        (F.col("sha") if digest_all else F.when(F.col("group_size").isNotNull(), F.col("sha"))).alias("text_sha256"),
    )
