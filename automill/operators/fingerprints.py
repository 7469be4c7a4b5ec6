"""Equality of two tables as multisets, by fingerprints of key ranges: rows are looked at only where ranges differ."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from automill.operators.scratch import keep

#: Rows that key ranges are cut by, at most, and ranges.
SAMPLE, RANGES = 4096, 256


def _ranges(df: DataFrame, key: list[str], ranges: int) -> Column:
    """The number of a row's range. Bounds come from a bounded sample of the keys; they decide about the work, not about the result.

    The sample is thinned out by hashes before it is made distinct, and a row's range is found by halving.
    """
    h = F.xxhash64(*key)
    every = max(1, df.agg(F.approx_count_distinct(h)).first()[0] // SAMPLE)
    sample = df.select(*key).where(F.pmod(h, F.lit(every)) == 0).distinct().orderBy(h).limit(SAMPLE).orderBy(*[F.col(c).asc_nulls_first() for c in key]).collect()
    bounds = sample[:: max(1, len(sample) // ranges)][1:]
    own = F.struct(*[F.col(c) for c in key])
    if not bounds:
        return F.lit(0)
    kinds = [df.schema[c].dataType for c in key]
    literal = F.array(*[F.struct(*[F.lit(v).cast(k).alias(c) for c, k, v in zip(key, kinds, b)]) for b in bounds])
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(literal, at + step - 1) <= own, at + step).otherwise(at))


def fingerprints(df: DataFrame, bucket: Column, columns: list[str]) -> DataFrame:
    """bucket, n, mixed and total: the number of rows, and the XOR and the sum of two hashes of them, whatever their order."""
    rows = df.select(bucket.alias("bucket"), F.xxhash64(*columns).alias("h"), F.pmod(F.xxhash64(F.lit(1), *columns), F.lit(1 << 31)).alias("k"))
    return rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.bit_xor("h").alias("mixed"), F.sum("k").alias("total"))


def unequal_ranges(a: DataFrame, b: DataFrame, key: list[str], ranges: int = RANGES) -> tuple[Column, list[int]]:
    """The ranges' expression, and the ranges in which a and b differ. Only a row for each range is shuffled."""
    columns, bucket = a.columns, _ranges(a, key, ranges)
    sides = [fingerprints(df.select(*columns), bucket, columns) for df in (a, b)]
    right = sides[1].select(*[F.col(c).alias(f"{c}_") for c in sides[1].columns])
    both = sides[0].join(right, F.col("bucket") == F.col("bucket_"), "full")
    same = reduce(lambda x, c: x & F.col(c).eqNullSafe(F.col(f"{c}_")), ("mixed", "total"), F.col("n").eqNullSafe(F.col("n_")))
    return bucket, sorted(r[0] for r in both.where(~same).select(F.coalesce("bucket", "bucket_")).collect())


def equal(a: DataFrame, b: DataFrame, key: list[str]) -> bool:
    """Whether a and b have the same rows, each as often; but for a collision of 95 bits of hashes."""
    return not unequal_ranges(keep(a), b, key)[1]


def first_differences(a: DataFrame, b: DataFrame, key: list[str], limit: int = 40, ranges: int = RANGES) -> DataFrame:
    """The first rows, by key and then the other columns, that one side has more often: a's columns, side ('a' or 'b') and n, how much more often.

    Of the ranges that differ, in the order of the key, so many are compared row by row, twice as many each time, until there are enough differences.
    Both sides are written first, as they are read several times.
    """
    columns = a.columns
    a, b = keep(a), keep(b.select(*columns))
    bucket, wrong = unequal_ranges(a, b, key, ranges)
    n = sum(F.when(F.col("side") == s, v).otherwise(0) for s, v in (("a", 1), ("b", -1)))
    order = [F.col(c).asc_nulls_first() for c in [*key, *[c for c in columns if c not in key]]]
    done = 0
    while True:
        done = min(len(wrong), 2 * done + 1)
        here = bucket.isin(wrong[:done]) if wrong else F.lit(False)
        rows = a.select(*columns).where(here).withColumn("side", F.lit("a")).unionByName(b.where(here).withColumn("side", F.lit("b")))
        found = rows.groupBy(*columns).agg(F.sum(n).alias("more")).where("more <> 0")
        found = found.select(*columns, F.when(F.col("more") > 0, "a").otherwise("b").alias("side"), F.abs("more").alias("n")).orderBy(*order).limit(limit)
        found = keep(found).orderBy(*order)  # at most limit rows
        if done >= len(wrong) or found.count() >= limit:
            return found
