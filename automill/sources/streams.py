"""Byte streams: where they come from, and how they are cut.

A stream is a row (stream_id, payload); a segment is a row (stream_id, seg_id, base, first, payload).
All of it is column expressions: payloads are cut in the JVM and filters reach the scan below.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Length of the random stream when none is asked for.
RANDOM_BYTES = 1_000_050
#: Bytes of streams in a part, where every byte may become a row that a task sorts or hashes.
PART_BYTES = 1 << 20


def from_files(spark: SparkSession, path: str) -> DataFrame:
    """Whole files, byte for byte; a path that matches none is an error."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("stream_id"), F.col("content").alias("payload"))


def from_ranges(spark: SparkSession, path: str, range_bytes: int = 64 << 20, overlap: int = 0) -> DataFrame:
    """Files by ranges of bytes, a row each, for ``match``; a task reads a run of them. overlap is what a range has of the bytes before it.

    For files of any size, on paths that every executor can open. An overlap of the longest match less one byte is enough
    for automata without cycles; with cycles none is needed.
    """
    from automill.sources import ranges

    ranges.register(spark)
    return spark.read.format("byte_ranges").option("range", range_bytes).option("overlap", overlap).load(path)


def from_column(df: DataFrame, id_col: str, data_col: str) -> DataFrame:
    """A string column as UTF-8, or a binary column as it is. Rows with a null value are no streams."""
    data = F.col(data_col)
    if dict(df.dtypes)[data_col] != "binary":
        data = F.encode(data, "UTF-8")
    return df.where(F.col(data_col).isNotNull()).select(F.col(id_col).cast("string").alias("stream_id"), data.alias("payload"))


def random_stream(spark: SparkSession, n: int = RANDOM_BYTES, seed: int = 0, stream_id: str = "random") -> DataFrame:
    """One stream of n bytes that a seed fixes: hashes of the positions, eight bytes each."""
    words = F.transform(F.sequence(F.lit(0), F.lit((n - 1) // 8)), lambda i: F.format_string("%016x", F.xxhash64(F.lit(seed), i)))
    return spark.range(1).select(F.lit(stream_id).alias("stream_id"), F.substring(F.unhex(F.array_join(words, "")), 1, n).alias("payload"))


def random_streams(rows: DataFrame, id_col: str, seed_col: str, n: int) -> DataFrame:
    """A stream of n random bytes for each row, fixed by the row's seed."""
    words = F.transform(F.sequence(F.lit(0), F.lit((n - 1) // 8)), lambda i: F.format_string("%016x", F.xxhash64(F.col(seed_col), i)))
    return rows.select(F.col(id_col).cast("string").alias("stream_id"), F.substring(F.unhex(F.array_join(words, "")), 1, n).alias("payload"))


def dealt(streams: DataFrame, key: tuple[str, ...] = ("stream_id",), part_bytes: int = PART_BYTES) -> DataFrame:
    """The streams (or segments) dealt by key into parts of about so many bytes, as many as there are bytes for.

    A file of short names is one task's input, and what is made of each of its bytes would be too. The payloads, which are the least of it, are
    shuffled once, and are read twice, as their bytes are counted first.
    """
    total = streams.agg(F.sum(F.octet_length("payload").cast("long"))).first()[0] or 0
    return streams.repartition(max(1, -(-total // part_bytes)), *key)


def slice_streams(streams: DataFrame, start: int, length: int) -> DataFrame:
    """Bytes [start, start + length), cut at the end. Streams that end before start are errors."""
    past = F.raise_error(F.concat(F.lit("slice starts past the end of stream "), "stream_id"))
    cut = F.when(F.octet_length("payload") >= start, F.substring("payload", start + 1, length)).otherwise(past.cast("binary"))
    return streams.withColumn("payload", cut)


def replicate(streams: DataFrame, n: int) -> DataFrame:
    """Every stream n times over, as one stream."""
    return streams.withColumn("payload", repeated(F.col("payload"), n))


def repeated(payload: Column, n: int) -> Column:
    return payload if n == 1 else F.unhex(F.repeat(F.hex(payload), n))


def pad(streams: DataFrame, base: int) -> DataFrame:
    """Zero bytes up to a multiple of base; ``length`` keeps the original length, beyond which reports don't count."""
    size = F.octet_length("payload")
    full = (F.ceil(size / base) * base).cast("int")
    zeros = F.unhex(F.repeat(F.lit("00"), full - size))
    return streams.withColumn("length", size).withColumn("payload", F.concat("payload", zeros))


def segments(streams: DataFrame, segment_bytes: int | None = None, replicas: int = 1, tail: str = "drop") -> DataFrame:
    """Segments of the replicated streams.

    Without segment_bytes a stream is one segment. With it, the remainder behind the last full segment
    is dropped (tail='drop') or a shorter segment (tail='keep'). Replicas are cut where they lie: a
    segment takes its bytes from the stream, so replicas are not built when they need not be.
    """
    if tail not in ("drop", "keep"):
        raise ValueError(f"tail is 'drop' or 'keep', not {tail!r}")
    size = F.octet_length("payload").cast("long")
    total = size * replicas
    step = total if segment_bytes is None else F.lit(segment_bytes).cast("long")
    if segment_bytes is None:
        count = F.when(total > 0, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long"))
    else:
        count = (F.floor if tail == "drop" else F.ceil)(total / F.lit(segment_bytes)).cast("long")
    rows = streams.select("stream_id", "payload", step.alias("step"), count.alias("count"), size.alias("size"))
    ids = F.when(F.col("count") > 0, F.sequence(F.lit(0).cast("long"), F.col("count") - 1))
    rows = rows.select("*", F.explode(ids).alias("seg"))
    base = F.col("seg") * F.col("step")
    if replicas == 1 or segment_bytes is None:
        whole = repeated(F.col("payload"), replicas)
        data = whole if segment_bytes is None else F.substring(whole, (base + 1).cast("int"), F.col("step").cast("int"))
    else:
        start = F.pmod(base, F.col("size"))
        length = F.least(F.col("step"), F.col("size") * replicas - base)
        times = F.ceil((start + length) / F.col("size")).cast("int")
        data = F.substring(F.unhex(F.repeat(F.hex("payload"), times)), (start + 1).cast("int"), length.cast("int"))
    return rows.select("stream_id", F.col("seg").cast("int").alias("seg_id"), base.alias("base"), (F.col("seg") == 0).alias("first"), data.alias("payload"))


def alphabet(streams: DataFrame) -> DataFrame:
    """stream_id and the sorted distinct bytes of each stream."""
    hexed = F.hex("payload")
    pairs = F.array_distinct(F.filter(F.split(hexed, "(?<=\\G..)"), lambda x: x != ""))
    values = F.array_sort(F.transform(pairs, lambda x: F.conv(x, 16, 10).cast("int")))
    return streams.select("stream_id", values.alias("alphabet"))


def positions(segments_: DataFrame, width: int = 1) -> DataFrame:
    """One row per byte: stream_id, seg_id, base, first, pos (in the segment), byte, and byte1 and on, the width - 1 bytes that follow; null past the end."""
    n = F.octet_length("payload")
    rows = segments_.where(n > 0).withColumn("pos", F.explode(F.sequence(F.lit(0), n - 1)))

    def at(j: int) -> Column:
        byte = F.conv(F.hex(F.substring(F.col("payload"), F.col("pos") + 1 + j, F.lit(1))), 16, 10).cast("int")
        return F.when(F.col("pos") + j < n, byte) if j else byte

    return rows.select("stream_id", "seg_id", "base", "first", "pos", *[at(j).alias(f"byte{j}" if j else "byte") for j in range(width)])


def get_byte(payload: Column, position: int) -> Column:
    return F.conv(F.hex(F.substring(payload, position + 1, 1)), 16, 10).cast("int")


def set_byte(payload: Column, position: int, byte: int) -> Column:
    """The payload with one byte replaced."""
    return F.overlay(payload, F.lit(bytearray([byte])), position + 1, 1)


def append(payload: Column, data: bytes) -> Column:
    return F.concat(payload, F.lit(bytearray(data)))
