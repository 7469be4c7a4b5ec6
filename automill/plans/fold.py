"""Matching in the JVM: a fold over the bytes of a stream, with the deterministic table as constant arrays.

For short streams: no Python worker starts and no payload is copied, but a byte costs more than in the kernels.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from automill.model import Table

#: Entries of a table that is written into a plan, at most.
FOLD_ENTRIES = 100_000


def _constant(values: np.ndarray) -> Column:
    """An array of ints that Spark evaluates once."""
    return F.split(F.lit(",".join(map(str, values.reshape(-1).tolist()))), ",").cast("array<int>")


def hits(table: Table, payload: Column, first: Column) -> Column:
    """array<struct<pos, reports>>: where a report set is reached, and its number."""
    width = table.next.shape[1]
    classes, moves, marks = _constant(table.classes), _constant(table.next), _constant(table.reports)
    n = F.octet_length(payload)
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    start = F.struct(F.when(first, table.first).otherwise(table.later).cast("int").alias("row"), F.array().cast("array<struct<pos: int, reports: int>>").alias("hits"))

    def move(acc: Column, pos: Column) -> Column:
        byte = F.conv(F.hex(F.substring(payload, pos + 1, F.lit(1))), 16, 10).cast("int")
        at = acc["row"] * width + F.element_at(classes, byte + 1) + 1
        found = F.element_at(marks, at)
        more = F.when(found != 0, F.concat(acc["hits"], F.array(F.struct(pos.alias("pos"), found.alias("reports"))))).otherwise(acc["hits"])
        return F.struct(F.element_at(moves, at).alias("row"), more.alias("hits"))

    return F.aggregate(places, start, move)["hits"]


def match(cut: DataFrame, table: Table, group: int) -> DataFrame:
    """stream_id, base, pos, g and s (local state) of segments (stream_id, base, first, payload)."""
    spark = cut.sparkSession
    sets = [(k, s) for k, members in enumerate(table.report_sets) for s in members]
    rows = cut.select("stream_id", "base", F.explode(hits(table, F.col("payload"), F.col("first"))).alias("hit")).select("stream_id", "base", "hit.pos", "hit.reports")
    names = spark.createDataFrame(sets, "reports int, s int")  # bounded by the table's entries
    return rows.join(F.broadcast(names), "reports").select("stream_id", "base", "pos", F.lit(group).alias("g"), "s")
