"""What is done with reports: order, distinctness, counts, comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from automill.functions.words import pack

KEY = ["stream_id", "offset", "nfa_id", "state_id"]


def ordered(reports: DataFrame) -> DataFrame:
    """By offset, then state; stream and automaton before them. A range sort, whatever the size."""
    return reports.orderBy("stream_id", "nfa_id", "offset", "state_id")


def sorted_parts(reports: DataFrame) -> DataFrame:
    """Ordered within each partition only, without a shuffle."""
    return reports.sortWithinPartitions("stream_id", "nfa_id", "offset", "state_id")


def unique(reports: DataFrame, by_original: bool = False) -> DataFrame:
    """Distinct reports; by_original: clones of a state count as one."""
    if not by_original:
        return reports.distinct()
    same = ["nfa_id", "stream_id", "offset", "original_id"]
    others = [c for c in reports.columns if c not in same]
    return reports.groupBy(*same).agg(*[F.min(c).alias(c) for c in others]).select(reports.columns)


def count(reports: DataFrame) -> DataFrame:
    """n (as they are) and n_distinct."""
    return reports.groupBy(*KEY).agg(F.count(F.lit(1)).alias("c")).agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("n_distinct"))


def packed(reports: DataFrame) -> DataFrame:
    """stream_id and the packed word of each report."""
    return reports.select("stream_id", pack(F.col("group_id"), F.col("state_id"), F.col("offset")).alias("word"))


def differences(a: DataFrame, b: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows that only one side has, with column side ('a' or 'b'). Empty when the two are equal as multisets."""
    columns = columns or KEY
    left, right = a.select(columns), b.select(columns)
    return left.exceptAll(right).withColumn("side", F.lit("a")).unionByName(right.exceptAll(left).withColumn("side", F.lit("b")))


def validate(a: DataFrame, b: DataFrame, columns: list[str] | None = None, show: int = 40) -> tuple[bool, list]:
    """Whether the two are equal, and the first rows in which they differ."""
    found = differences(a, b, columns).orderBy(*(columns or KEY)).limit(show).collect()
    return not found, found


def quick_validate(reports: DataFrame, expected: int, multiplicity: bool = False) -> bool:
    """Whether the count is the expected one; with multiplicity, whether it is at least that."""
    row = count(reports).first()
    return expected <= row["n"] if multiplicity else expected == row["n_distinct"]
