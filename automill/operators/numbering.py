"""Ranks of rows without a window over them: a range partitioning, places within partitions, and counts of partitions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Counts of (partition, group) that are broadcast at most.
BROADCAST_COUNTS = 100_000
_INDEX_BITS = 33  # of monotonically_increasing_id, below the partition's number


def ranked(rows: DataFrame, group: list[str], order: list[Column], keep: Callable[[DataFrame], DataFrame], name: str = "rank") -> DataFrame:
    """The rows with their rank (from 0) by ``order`` within their group, whose columns are not null.

    A group may hold all rows: they are sorted in parts, and a part's first rank is the number of the group's rows in the
    parts before. Rows that ``order`` does not tell apart are ranked in any order, so it should tell all apart.
    """
    dealt = rows.repartitionByRange(*[F.col(c) for c in group], *order).sortWithinPartitions(*[F.col(c) for c in group], *order)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << _INDEX_BITS) - 1))
    dealt = keep(dealt.withColumn("_part", F.spark_partition_id()).withColumn("_place", place))
    counts = dealt.groupBy("_part", *group).agg(F.count(F.lit(1)).alias("_n"), F.min("_place").alias("_least"))
    before = F.sum("_n").over(Window.partitionBy(*group).orderBy("_part")) if group else F.sum("_n").over(Window.orderBy("_part"))
    counts = keep(counts.select("_part", *group, (before - F.col("_n") - F.col("_least")).alias("_shift")))
    if counts.count() <= BROADCAST_COUNTS:
        counts = F.broadcast(counts)
    out = dealt.join(counts, ["_part", *group])
    return out.withColumn(name, F.col("_place") + F.col("_shift")).select(*rows.columns, name)
