"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts of lower-cased bigrams and trigrams are gathered for each language on a bounded sample of the
training rows, at most about ``SAMPLE`` for each language, drawn by a hash of the id. The table of
log-probabilities (languages x ``BUCKETS`` floats) is broadcast and every text is scored whole, in
Arrow batches: one gather and one segmented sum for each ``CLASSES`` languages.

Edge cases: null text, or text without a letter, is ``und`` with score 0; with no training rows
everything is ``und``; null languages do not train; ties go to the language that sorts first; repeated
rows are scored alike; an empty table gives an empty result; other columns pass by.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from automill.llm import kernels

BUCKETS = 1 << 15
#: Training rows of a language at most, about; and languages that are counted or scored at a time.
SAMPLE, CLASSES = 4000, 256
ALPHA = 0.5
UNKNOWN = "und"
_GRID = 1 << 30


@lru_cache(maxsize=1)
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """By code point: whether it is a letter, and its lower-case form; white space is a blank."""
    chars = [chr(c) for c in range(0x110000)]
    alpha = np.fromiter(map(str.isalpha, chars), bool, 0x110000)
    lower = np.arange(0x110000, dtype=np.uint32)
    for c in np.flatnonzero(alpha[:0x20000]).tolist():
        low = chars[c].lower()
        if len(low) == 1:
            lower[c] = ord(low)
    lower[np.fromiter(map(str.isspace, chars), bool, 0x110000)] = 32
    return alpha, lower


def ngrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all n-grams, each text's first n-gram (one more at the end), and whether it has a letter.

    Every text is framed by blanks; n-grams stay within a text.
    """
    alpha, lower = _letters()
    chars = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)
    before = np.append(0, np.cumsum((data & 0xC0) != 0x80))
    at = before[offsets]
    if at[-1] != len(chars):  # text that isn't UTF-8: one by one
        parts = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(offsets[:-1], offsets[1:])]
        at = np.append(0, np.cumsum([len(p) for p in parts]))
        chars = np.frombuffer("".join(parts).encode("utf-32-le", "replace"), np.uint32)
    n = len(offsets) - 1
    sizes = np.diff(at)
    has = np.append(0, np.cumsum(alpha[chars]))
    framed = np.full(len(chars) + 2 * n, 32, np.uint32)
    framed[np.arange(len(chars)) + np.repeat(2 * np.arange(n) + 1, sizes)] = lower[chars]
    ends = at[1:] + 2 * np.arange(1, n + 1)
    of = np.repeat(np.arange(n), sizes + 2)
    two = framed[:-1] * np.uint32(0x9E3779B1) + framed[1:] * np.uint32(0x85EBCA77)
    three = two[:-1] * np.uint32(0xC2B2AE3D) + framed[2:] * np.uint32(0x27D4EB2F)
    left = ends[of] - np.arange(len(framed))
    buckets, owners = [], []
    for gram, size in ((two, 2), (three, 3)):
        ok = left[: len(gram)] >= size
        mixed = gram ^ (gram >> np.uint32(15))
        buckets.append(((mixed * np.uint32(0x2C1B3C6D)) >> np.uint32(17))[ok])
        owners.append(of[: len(gram)][ok])
    return buckets, owners, has[at[1:]] > has[at[:-1]]


def _count(classes: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = {c: k for k, c in enumerate(classes)}
        dense = len(classes) <= CLASSES  # the counts of more languages are summed up by Spark
        counts = np.zeros(len(classes) * BUCKETS if dense else 0, np.int64)
        for batch in batches:
            owner = np.array([index.get(x, -1) for x in batch.column(1).to_pylist()], np.int64)
            for i, data, offsets in kernels.slices(batch.column(0)):
                for bucket, of in zip(*ngrams(data, offsets)[:2]):
                    c = owner[i + of]
                    places = (c * BUCKETS + bucket)[c >= 0]
                    if dense:
                        counts += np.bincount(places, minlength=len(counts))
                    else:
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in np.unique(places, return_counts=True)], ["at", "n"])
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["at", "n"])

    return run


def train(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, log-priors and log-probabilities (languages x buckets)."""
    labelled = rows.where(F.col(label_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = labelled.groupBy(label_col).count().collect()
    sizes = {r[0]: r[1] for r in sorted(sizes)}
    classes = list(sizes)
    if not classes:
        return [], np.zeros(0), np.zeros((0, BUCKETS))
    share = F.create_map(*[F.lit(x) for c in classes for x in (c, min(1.0, SAMPLE / sizes[c]) * _GRID)])
    drawn = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit("langid")), F.lit(_GRID)) < F.element_at(share, F.col(label_col))
    sample = labelled.where(drawn).select(F.col(text_col).alias("text"), F.col(label_col).alias("lang"))
    sample = sample.repartition(8)  # dealt in turn: a text that many rows have does not meet in one task
    counts = np.zeros(len(classes) * BUCKETS)
    summed = sample.mapInArrow(_count(classes), "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    counts[summed["at"].to_numpy()] = summed["n"].to_numpy()
    counts = counts.reshape(len(classes), BUCKETS) + ALPHA
    prior = np.log(np.array([sizes[c] for c in classes]) / sum(sizes.values()))
    return classes, prior, np.log(counts / counts.sum(axis=1, keepdims=True))


def predict(rows: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred and score (the posterior probability of the predicted language)."""
    classes, prior, logp = model
    tables = [np.ascontiguousarray(logp[k : k + CLASSES].T, np.float32) for k in range(0, len(classes), CLASSES)]
    shared = rows.sparkSession.sparkContext.broadcast((classes, prior, tables))
    kind = rows.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, first, tables = shared.value
        for batch in batches:
            langs, scores = [], []
            for _, data, offsets in kernels.slices(batch.column(1), 1_000_000):
                (b2, b3), (o2, o3), letters = ngrams(data, offsets)
                n = len(offsets) - 1
                total = np.tile(first, (n, 1)) if names else np.zeros((n, 1))
                for bucket, of in ((b2, o2), (b3, o3)) if names else ():
                    if len(of):
                        starts = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
                        for k, table in enumerate(tables):
                            total[of[starts], k * CLASSES : (k + 1) * CLASSES] += np.add.reduceat(table[bucket], starts, axis=0, dtype=np.float64)
                best = total.argmax(axis=1)
                post = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
                sure = letters & bool(names)
                langs += [names[k] if ok else UNKNOWN for k, ok in zip(best.tolist(), sure.tolist())]
                scores += np.where(sure, post, 0.0).tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [id_col, "lang_pred", "score"])

    return rows.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double")
