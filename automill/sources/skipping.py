"""Streams stored in blocks with an index of their 3-grams, so that rare keywords read few blocks.

A block is a partition of the stored table. For each block there is a bitmap of hashed 3-grams (so a gram may seem to be there that is not,
never the other way), built and stored by Spark. A keyword can only match in a block that has all its 3-grams.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from automill.model import Automaton

#: Bits of a block's bitmap, in pieces of 32,768 as Spark's bitmap functions make them.
PIECE, PIECES = 32_768, 32
#: Bytes whose 3-grams are marked at a time.
CHUNK = 1 << 22


def _place(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(PIECE * PIECES))


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """block and gram: the distinct 3-grams of each batch's streams (block, payload), by block. A table of all 3-grams is marked, so a byte costs a few vector steps."""
    seen = np.zeros(1 << 24, bool)
    for batch in batches:
        blocks, payloads = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
        for block in np.unique(blocks):
            mine, parts, size = np.flatnonzero(blocks == block), [], 0
            for k in mine:
                data = payloads[k] or b""
                for i in range(0, len(data) - 2, CHUNK):
                    parts.append(data[i : i + CHUNK + 2])
                    size += len(parts[-1])
                    if size >= CHUNK:
                        _mark(seen, parts)
                        parts, size = [], 0
            _mark(seen, parts)
            found = np.flatnonzero(seen)
            seen[found] = False
            data = np.stack([found >> 16, found >> 8, found], 1).astype(np.uint8)
            places = pa.py_buffer(np.arange(0, 3 * len(found) + 1, 3, dtype=np.int32))
            grams = pa.Array.from_buffers(pa.binary(), len(found), [None, places, pa.py_buffer(data.tobytes())])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), block, np.int32)), grams], ["block", "gram"])


def _mark(seen: np.ndarray, parts: list[bytes]) -> None:
    """Marks the 3-grams of these, but none that lies in two of them."""
    if parts:
        data = np.frombuffer(b"".join(parts), np.uint8).astype(np.int32)
        inside = np.ones(len(data), bool)
        ends = np.cumsum([len(x) for x in parts])
        inside[ends - 1] = inside[ends - 2] = False
        seen[(data[:-2] << 16 | data[1:-1] << 8 | data[2:])[inside[:-2]]] = True


def store(streams: DataFrame, path: str, blocks: int) -> None:
    """Writes streams (stream_id, payload) in so many blocks, dealt by stream, and their index."""
    dealt = streams.select("stream_id", "payload", F.pmod(F.xxhash64("stream_id"), F.lit(blocks)).cast("int").alias("block"))
    dealt.repartition("block").write.partitionBy("block").parquet(f"{path}/streams")
    rows = streams.sparkSession.read.parquet(f"{path}/streams")
    grams = rows.select("block", "payload").mapInArrow(_grams, "block int, gram binary")
    bits = grams.select("block", _place(F.col("gram")).alias("bit")).distinct()
    bits = bits.groupBy("block", F.floor(F.col("bit") / PIECE).cast("int").alias("piece")).agg(F.bitmap_construct_agg(F.col("bit") % PIECE).alias("bitmap"))
    bits.write.parquet(f"{path}/grams")


def load(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The stored streams (with block) and their index."""
    return spark.read.parquet(f"{path}/streams"), spark.read.parquet(f"{path}/grams")


def keywords_of(a: Automaton) -> list[bytes] | None:
    """The keywords of an automaton whose components are chains of single bytes from a start to a report; None for any other automaton."""
    before, out = a.pred(), []
    for s in range(len(a)):
        if before[s]:
            continue
        word, here, seen = [], s, 0
        while True:
            state = a.states[here]
            if state.symbols.bit_count() != 1 or len(a.succ[here]) > 1 or (state.report and a.succ[here]) or (state.start and here != s):
                return None
            word.append(state.symbols.bit_length() - 1)
            seen += 1
            if not a.succ[here]:
                break
            here = a.succ[here][0]
            if len(before[here]) != 1 or seen > len(a):
                return None
        if a.states[s].start and a.states[here].report:
            out.append(bytes(word))
    return out if all(before[s] or a.states[s].start for s in range(len(a))) and len(a) == sum(map(len, out)) else None


def blocks_with(grams: DataFrame, words: list[bytes]) -> list[int] | None:
    """The blocks in which one of the words can occur; None for all, where a word is too short to have a 3-gram."""
    if any(len(w) < 3 for w in words):
        return None
    spark = grams.sparkSession
    wanted = spark.createDataFrame([(k, bytearray(w[i : i + 3])) for k, w in enumerate(words) for i in range(len(w) - 2)], "word int, gram binary").distinct()
    wanted = wanted.select("word", _place(F.col("gram")).alias("bit")).distinct()
    need = wanted.groupBy("word").agg(F.count(F.lit(1)).alias("need"))
    wanted = wanted.select("word", F.floor(F.col("bit") / PIECE).cast("int").alias("piece"), (F.col("bit") % PIECE).alias("at"))
    byte = F.conv(F.hex(F.substring(F.col("bitmap"), F.floor(F.col("at") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    there = byte.bitwiseAND(F.pow(F.lit(2), F.col("at") % 8).cast("int")) != 0
    found = grams.join(F.broadcast(wanted), "piece").where(there).groupBy("block", "word").agg(F.count(F.lit(1)).alias("n"))
    found = found.join(F.broadcast(need), "word").where("n = need").select("block").distinct()
    return sorted(r[0] for r in found.collect())  # numbers of blocks


def candidates(spark: SparkSession, path: str, automata: list[Automaton]) -> tuple[DataFrame, int | None]:
    """The stored streams of the blocks in which the automata can match, and how many blocks these are; all, and None, where the index can't tell."""
    rows, grams = load(spark, path)
    words = [keywords_of(a) for a in automata]
    blocks = None if any(w is None for w in words) else blocks_with(grams, [x for w in words for x in w])
    if blocks is None:
        return rows.drop("block"), None
    return rows.where(F.col("block").isin(blocks) if blocks else F.lit(False)).drop("block"), len(blocks)


def match(spark: SparkSession, path: str, automata: list[Automaton], run: Callable[..., DataFrame] | None = None, **options) -> DataFrame:
    """``operators.match.match`` over the stored streams, reading only blocks in which the automata can match."""
    from automill.operators.match import match as whole

    return (run or whole)(automata, None, candidates(spark, path, automata)[0], **options)
