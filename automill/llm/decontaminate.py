"""Benchmark decontamination with one Aho-Corasick automaton.

Items and texts are normalised alike: A-Z lower-cased, cut into words. The patterns are all windows of ten
consecutive words of an item; an item of fewer words is one pattern. The benchmark's words are numbered, and a
number is written as three characters, the first from an alphabet of its own, so that matches start at words
only; words that the benchmark lacks are three zeros. Every text is read once in this writing, and matches are
mapped back to spans of the original text.

An automaton has at most thirty nodes for each word of the benchmark, so a bound on its words bounds a worker's
memory: ``BLOCK_WORDS`` take some 200 MB. Items are collected only behind that check. A larger benchmark is
dealt by a hash of its items into blocks of about that size. Then the documents are written once with numbers, each block is
a pass over the numbers and texts that keeps hits only, and the hits are joined at the end.

Edge cases: null text has no words and no hits; null items have no windows; items with equal ids are
one item, equal windows of different items count for each; a null item id is the id '' in digests; empty
tables give no hits; other columns pass through, but for those named like the four new ones, which are
replaced: ``prefix`` names these otherwise.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from functools import reduce

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from automill.llm.scratch import keep
from automill.llm.text import free_prefix

#: Words of a window.
WINDOW = 10
#: Words of the benchmark under one automaton, about.
BLOCK_WORDS = 80_000

_TO_BLANK = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_WORDS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def normalised(text: str | None) -> list[bytes]:
    """The words of a text."""
    return (text or "").encode().translate(_TO_BLANK).split()


class Matcher:
    """The automaton of some items, over numbered words."""

    def __init__(self, items: list[tuple[str, str | None]]):
        lines = [(item, normalised(text)) for item, text in items]
        words = sorted({w for _, line in lines for w in line})
        base = max(64, math.ceil(len(words) ** (1 / 3)))
        first, other = 64, 64 + base  # the alphabets' first characters
        self.codes = {w: chr(first + k // base**2) + chr(other + k // base % base) + chr(other + k % base) for k, w in enumerate(words)}
        found: dict[str, set[str]] = {}
        self.least = 0
        for item, line in lines:
            if line:
                self.least = min(self.least or WINDOW, len(line))
            for i in range(max(1, len(line) - WINDOW + 1) if line else 0):
                found.setdefault("".join(map(self.codes.__getitem__, line[i : i + WINDOW])), set()).add(item)
        self.automaton = ahocorasick.Automaton()
        for window, ids in found.items():
            self.automaton.add_word(window, (len(window) // 3, tuple(sorted(ids))))
        if found:
            self.automaton.make_automaton()

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int]], set[str]]:
        """Words of a text, hit runs of words (first, last + 1), and items."""
        code = self.codes.get
        line = [code(w, "\0\0\0") for w in normalised(text)]
        if not self.least or len(line) < self.least:
            return len(line), [], set()
        runs: list[tuple[int, int]] = []
        items: set[str] = set()
        for end, (size, ids) in self.automaton.iter("".join(line)):
            items.update(ids)
            runs.append((end // 3 + 1 - size, end // 3 + 1))
        return len(line), _union(runs, []), items


def spans(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs of words as spans of the original text's characters."""
    data = text.encode()
    places = [(m.start(), m.end()) for m in _WORD.finditer(data.translate(_TO_BLANK))]
    chars = np.append(0, np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80))
    return [(int(chars[places[a][0]]), int(chars[places[b - 1][1]])) for a, b in runs]


_built: list = [None, None]


def _here(shared: Broadcast) -> Matcher:
    """The automaton of a broadcast, built once in each worker, which holds the value it was built from."""
    if _built[0] is not shared.value:
        _built[:] = shared.value, Matcher(shared.value)
    return _built[1]


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_words: int) -> list[DataFrame]:
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.col(text_col).alias("text"))
    items = items.where(F.col("text").isNotNull())
    total = items.agg(F.coalesce(F.sum(F.regexp_count("text", F.lit(_WORDS))), F.lit(0))).first()[0]
    n = max(1, -(-total // block_words))
    return [items if n == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k) for k in range(n)]


def _items(block: DataFrame) -> list[tuple[str, str]]:
    return [(r["item"], r["text"]) for r in block.distinct().collect()]


def find_benchmark(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    *,
    item_col: str = "item_id",
    item_text_col: str = "text",
    with_spans: bool = True,
    block_words: int = BLOCK_WORDS,
    prefix: str = "__",
) -> DataFrame:
    """The documents with ``__words`` (count), ``__runs`` (hit runs of words), ``__items`` and ``__spans`` (of characters)."""
    new = [f"{prefix}{n}" for n in ("words", "runs", "items", "spans")]
    out = docs.select(*[c for c in docs.columns if c not in new])
    blocks = _blocks(benchmark, item_col, item_text_col, block_words)
    if len(blocks) == 1:
        return _pass(out, _items(blocks[0]), text_col, new, with_spans)
    names = free_prefix([*out.columns, *new])
    row, found_runs, found_items = f"{names}row", f"{names}runs", f"{names}items"
    out = keep(out.withColumn(row, F.monotonically_increasing_id()), "benchmark-rows")
    texts = out.select(F.col(row).alias("row"), F.col(text_col).alias("text"))
    hits = [keep(_hits(texts, _items(block)), "benchmark-hits") for block in blocks]
    of_row = reduce(DataFrame.unionByName, hits).groupBy(F.col("row").alias(f"{names}r"))
    of_row = of_row.agg(F.flatten(F.collect_list("runs")).alias(found_runs), F.array_distinct(F.flatten(F.collect_list("items"))).alias(found_items))
    out = out.join(of_row, F.col(row) == F.col(f"{names}r"), "left").drop(row, f"{names}r")
    return _merged(out, text_col, new, with_spans)


def without_benchmark(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents, all columns as they are, in which no window occurs."""
    prefix = free_prefix(docs.columns)
    out = find_benchmark(docs, benchmark, text_col, with_spans=False, prefix=prefix)
    return out.where(F.size(f"{prefix}runs") == 0).select(*docs.columns)


_RUN = pa.struct([("a", pa.int32()), ("b", pa.int32())])
_RUNS = ArrayType(StructType([StructField("a", IntegerType()), StructField("b", IntegerType())]))


def _as_runs(rows: list[list[tuple[int, int]]]) -> pa.Array:
    return pa.array([[{"a": a, "b": b} for a, b in r] for r in rows], pa.list_(_RUN))


def _with(rows: DataFrame, gone: int, new: list[str], each: Callable[[pa.RecordBatch, int], tuple]) -> DataFrame:
    """The rows without their last ``gone`` columns, and with the four new ones that each row gives."""
    kept = rows.schema.fields[: len(rows.columns) - gone]
    schema = StructType([*kept, *[StructField(n, k) for n, k in zip(new, (LongType(), _RUNS, ArrayType(StringType()), _RUNS))]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, runs, items, places = zip(*[each(batch, i) for i in range(batch.num_rows)]) if batch.num_rows else ((),) * 4
            more = [pa.array(n_words, pa.int64()), _as_runs(runs), pa.array([sorted(x) for x in items], pa.list_(pa.string())), _as_runs(places)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *more], [*[f.name for f in kept], *new])

    return rows.mapInArrow(run, schema)


def _pass(rows: DataFrame, items: list, text_col: str, new: list[str], with_spans: bool) -> DataFrame:
    shared, at = rows.sparkSession.sparkContext.broadcast(items), rows.columns.index(text_col)

    def each(batch: pa.RecordBatch, i: int) -> tuple:
        text = batch.column(at)[i].as_py() or ""
        n, runs, found = _here(shared).scan(text)
        return n, runs, found, spans(text, runs) if runs and with_spans else []

    return _with(rows, 0, new, each)


def _hits(texts: DataFrame, items: list) -> DataFrame:
    """row, runs and items of the rows (row, text) in which an item occurs."""
    shared = texts.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_here(shared).scan(batch.column(1)[i].as_py())[1:] for i in range(batch.num_rows)]
            hit = [i for i, (runs, _) in enumerate(found) if runs]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(hit, pa.int64())), _as_runs([found[i][0] for i in hit]), pa.array([sorted(found[i][1]) for i in hit], pa.list_(pa.string()))], ["row", "runs", "items"]
            )

    return texts.mapInArrow(run, StructType([StructField("row", LongType()), StructField("runs", _RUNS), StructField("items", ArrayType(StringType()))]))


def _merged(rows: DataFrame, text_col: str, new: list[str], with_spans: bool) -> DataFrame:
    """The rows, whose last two columns are all blocks' runs and items, with the four columns instead."""
    at, last = rows.columns.index(text_col), len(rows.columns)

    def each(batch: pa.RecordBatch, i: int) -> tuple:
        text = batch.column(at)[i].as_py() or ""
        runs = _union([(r["a"], r["b"]) for r in batch.column(last - 2)[i].as_py() or []], [])
        return len(normalised(text)), runs, batch.column(last - 1)[i].as_py() or [], spans(text, runs) if runs and with_spans else []

    return _with(rows, 2, new, each)


def _union(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for x, y in sorted([*a, *b]):
        if out and x <= out[-1][1]:
            out[-1] = (out[-1][0], max(y, out[-1][1]))
        else:
            out.append((x, y))
    return out
