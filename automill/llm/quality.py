"""Quality classifier: nearest-neighbour voting among latent-semantic vectors.

A text's features are hashed counts of byte trigrams and of word shapes (classes of the outer
characters, length, repeats of recent words). A truncated singular value decomposition of a bounded
sample of labelled texts, at most about ``SAMPLE``, drawn by a hash of the id, gives latent vectors.
They are broadcast, with their labels and the projection; each text is projected, all cosines to the
sample are computed exactly, in blocks, and the ``NEIGHBOURS`` nearest vote with the power ``SHARP``
of their similarity.

Edge cases: null text counts as empty; a text without features gets the labels' mean, as does
everything when no neighbour is similar; with no labelled rows the score is 0.5; null labels do not
train; of rows that repeat an id, the one with the greatest text trains; ties between neighbours go to the
sample's order, by id; repeated rows are scored alike; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from automill.llm import kernels

#: Labelled texts at most, about; latent dimensions; neighbours; power of the similarity.
SAMPLE, RANK, NEIGHBOURS, SHARP = 3000, 64, 15, 4
#: Hashed features: trigrams and shapes.
GRAMS, SHAPES = 2048, 1024
SHAPE_WEIGHT = 2.0
_GRID = 1 << 30

_CLASS = np.full(256, 7, np.int64)  # other punctuation
_CLASS[ord("a") : ord("z") + 1] = 0
_CLASS[ord("A") : ord("Z") + 1] = 1
_CLASS[ord("0") : ord("9") + 1] = 2
_CLASS[128:] = 3
_CLASS[ord(".")], _CLASS[ord(",")], _CLASS[ord("!")] = 4, 5, 6


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of GRAMS + SHAPES floats per text; each half has length 1, or 0 without features."""
    n = len(offsets) - 1
    of = np.repeat(np.arange(n), np.diff(offsets))
    grams = np.zeros((n, GRAMS), np.float32)
    if len(data) >= 3:
        b = data.astype(np.uint32)
        h = b[:-2] * np.uint32(0x9E3779B1) + b[1:-1] * np.uint32(0x85EBCA77) + b[2:] * np.uint32(0xC2B2AE3D)
        h = ((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(21)
        ok = of[2:] == of[:-2]
        grams = np.bincount((of[:-2] * GRAMS + h)[ok], minlength=n * GRAMS).reshape(n, GRAMS).astype(np.float32)
    shapes = np.zeros((n, SHAPES), np.float32)
    hashes, begin, length, bounds = kernels.words(data, offsets)
    if len(hashes):
        owner = np.repeat(np.arange(n), np.diff(bounds))
        first, last = _CLASS[data[begin]], _CLASS[data[begin + length - 1]]
        second = _CLASS[data[begin + np.minimum(1, length - 1)]]
        size = np.minimum(length // 3, 7)
        codes = [((first * 8 + second) * 8 + last) % 512]
        owners = [owner]
        outer = (first * 8 + last)[1:] + 8 * last[:-1]
        same = owner[1:] == owner[:-1]
        codes += [512 + size, (528 + outer % 256)[same]]
        owners += [owner, owner[1:][same]]
        for gap in (1, 2, 3):
            if len(hashes) > gap:
                again = (hashes[gap:] == hashes[:-gap]) & (owner[gap:] == owner[:-gap])
                again = again.astype(np.int64)
                codes.append(800 + 2 * gap + again)
                owners.append(owner[gap:])
        index = np.concatenate(owners) * SHAPES + np.concatenate(codes)
        shapes = np.bincount(index, minlength=n * SHAPES).reshape(n, SHAPES).astype(np.float32)
    out = np.concatenate([_unit(np.sqrt(grams)), SHAPE_WEIGHT * _unit(np.sqrt(shapes))], axis=1)
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def fit(texts: pa.Array, labels: np.ndarray) -> dict:
    """Mean features, projection, and the labelled texts' latent unit vectors with their labels.

    The leading directions come from a randomised decomposition with a fixed seed, so no square matrix
    of the features is made.
    """
    x = np.zeros((len(texts), GRAMS + SHAPES), np.float32)
    for i, data, offsets in kernels.slices(texts, 500_000):
        x[i : i + len(offsets) - 1] = features(data, offsets)
    mean = x.mean(axis=0) if len(x) else np.zeros(GRAMS + SHAPES, np.float32)
    x -= mean
    basis = np.random.default_rng(7).standard_normal((x.shape[1], RANK + 16), dtype=np.float32)
    for _ in range(4):
        basis, _ = np.linalg.qr(x.T @ (x @ basis))
    small = x @ basis
    _, vectors = np.linalg.eigh(small.T @ small)
    project = np.ascontiguousarray((basis @ vectors[:, ::-1][:, :RANK]).astype(np.float32))
    return {"mean": mean, "project": project, "vectors": _unit(x @ project), "labels": labels.astype(np.float32)}


def _nearest(cosine: np.ndarray, k: int) -> np.ndarray:
    """The k largest of each row; of equal ones at the edge, the first."""
    near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
    edge = np.take_along_axis(cosine, near, 1).min(axis=1, keepdims=True)
    for i in np.flatnonzero((cosine >= edge).sum(axis=1) > k):
        near[i] = np.argsort(-cosine[i], kind="stable")[:k]
    return near


def score(model: dict, rows: np.ndarray) -> np.ndarray:
    """Votes of the nearest labelled vectors for rows of features."""
    labels = model["labels"]
    if not len(labels):
        return np.full(len(rows), 0.5)
    out = np.empty(len(rows))
    for i in range(0, len(rows), 512):
        block = rows[i : i + 512]
        cosine = _unit((block - model["mean"]) @ model["project"]) @ model["vectors"].T
        k = min(NEIGHBOURS, cosine.shape[1])
        near = _nearest(cosine, k)
        weight = np.maximum(np.take_along_axis(cosine, near, 1), 0).astype(np.float64) ** SHARP
        total = weight.sum(axis=1)
        vote = (weight * labels[near]).sum(axis=1) / np.maximum(total, 1e-12)
        known = (total > 1e-9) & (np.abs(block).sum(axis=1) > 0)
        out[i : i + 512] = np.where(known, vote, labels.mean())
    return np.clip(out, 0.0, 1.0)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> dict:
    """Fit on a bounded sample of the labelled rows. Their ids are few, so they are broadcast to find the texts."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).alias("y"))
    share = min(1.0, SAMPLE / max(known.count(), 1)) * _GRID
    drawn = known.where(F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit("quality")), F.lit(_GRID)) < share)
    drawn = drawn.select(F.col(id_col).alias("__label_id"), "y")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(drawn), F.col("id") == F.col("__label_id"))
    rows = rows.groupBy("id", "y").agg(F.max("text").alias("text"))  # of rows that repeat an id, one
    got = rows.select("id", "text", "y").toArrow().sort_by([("id", "ascending"), ("text", "ascending")])
    return fit(got["text"].combine_chunks(), got["y"].to_numpy())


def classify(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and score of every text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), _scores(shared.value, batch.column(1))], [id_col, "score"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, score double")


def _scores(model: dict, texts: pa.Array) -> pa.Array:
    found = [score(model, features(data, offsets)) for _, data, offsets in kernels.slices(texts, 1_000_000)]
    return pa.array(np.concatenate(found) if found else [], pa.float64())


def keep_good(docs: DataFrame, model: dict, least: float, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, that score at least ``least``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.compute.greater_equal(_scores(shared.value, batch.column(at)), least))

    return docs.mapInArrow(run, docs.schema)
