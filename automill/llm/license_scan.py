"""License scans by a positional index of rare words.

Texts are cut into words once. What is kept of a text is which licence words it has, and, if all words of some
template's mandatory phrases are among them, the places of its licence words. Document frequencies of the licence words
come from that index, over all documents. For each template a file's licence words are taken from the rarest on:
their places in the file less their places in the template are candidate positions of the template, and a
candidate must be voted for by ``AGREE`` of the places that these words have in the template. Where it is, every mandatory
phrase must stand, to the word, no further than the template's slack from its place. A template without slack is a
phrase, and all its places are found; placements of another within its slack of each other are one.

A match's score is the share of the template's words, weighted by their rarity, that stand in their places.

Edge cases: null text counts as empty and has no words; a file without licence words has no matches; words of equal
rarity are taken in the order of their spelling; repeated rows give repeated results; long texts are worked on whole,
by places of licence words; an empty table gives an empty result; other columns than id and text are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from automill.llm.license_templates import BASE, NOTICES, Template
from automill.llm.scratch import keep

#: Rarest words of a template that look for its places, and the share of their places that must agree.
RARE, AGREE = 8, 0.5
#: Bytes of a text that are cut into words at a time.
CHUNK = 1 << 20

_TO_BLANK = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_BLANK = re.compile(rb" ")
_FAR = 1 << 62

MATCH = "struct<template: int, label: string, first_word: long, end_word: long, score: double>"


def words(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, so many at a time that no long text is a list of all its words."""
    begin = 0
    while begin < len(text):
        end = begin + CHUNK
        if end < len(text):
            found = _BLANK.search(text, end)
            end = found.start() if found else len(text)
        yield text[begin:end].split()
        begin = end


class Licences:
    """Templates as numbers of words; numbers follow the words' spelling."""

    def __init__(self, templates: list[Template]):
        split = [(t, t.text.encode().translate(_TO_BLANK).split()) for t in templates]
        self.spelling = sorted({w for _, line in split for w in line})
        self.number = {w: k for k, w in enumerate(self.spelling)}
        self.known = frozenset(self.spelling)
        self.labels = [t.label for t in templates]
        self.slack = [t.slack for t in templates]
        self.lines = [np.array([self.number[w] for w in line]) for _, line in split]
        self.keys = [[self._key(t, line, k) for k in t.keys] for t, line in split]
        self.needed = [frozenset(w for key, _ in keys for w in key) for keys in self.keys]

    def _key(self, t: Template, line: list[bytes], key: str) -> tuple[list[int], int]:
        want = key.encode().translate(_TO_BLANK).split()
        for at in range(len(line) - len(want) + 1):
            if line[at : at + len(want)] == want:
                return [self.number[w] for w in want], at
        raise ValueError(f"{t.label}: the text lacks its phrase {key!r}")

    def read(self, text: str | None) -> tuple[int, list[int], list[int], list[int]]:
        """Number of words, licence words that occur, and, where a template can be, all licence words with their places."""
        data = (text or "").encode().translate(_TO_BLANK)
        total, there = 0, set()
        for part in words(data):
            total += len(part)
            there.update(map(self.number.__getitem__, self.known.intersection(part)))
        if not any(need <= there for need in self.needed):
            return total, sorted(there), [], []
        which, where, before = [], [], 0
        for part in words(data):
            for k, w in enumerate(part):
                n = self.number.get(w)
                if n is not None:
                    which.append(n)
                    where.append(before + k)
            before += len(part)
        return total, sorted(there), which, where

    def places(self, which: np.ndarray, where: np.ndarray, idf: np.ndarray) -> list[tuple[int, str, int, int, float]]:
        """All matches of a file, from its licence words and their places in ascending order."""
        order = np.argsort(which, kind="stable")
        kinds, firsts = np.unique(which[order], return_index=True)
        at = dict(zip(kinds.tolist(), np.split(where[order], firsts[1:])))
        out = []
        for k, line in enumerate(self.lines):
            if not self.needed[k] <= at.keys():
                continue
            slack, found = self.slack[k], self._candidates(line, at, idf)
            for key, place in self.keys[k]:
                starts = at[key[0]]
                for j, w in enumerate(key[1:], 1):
                    starts = np.intersect1d(starts, at[w] - j, assume_unique=True)
                near = np.searchsorted(starts, found + place - slack)
                found = found[np.append(starts, _FAR)[near] <= found + place + slack]
            if len(found):
                out += [(k, self.labels[k], s, s + len(line), v) for s, v in self._scored(line, found, which, where, idf, slack)]
        return out

    def _candidates(self, line: np.ndarray, at: dict[int, np.ndarray], idf: np.ndarray) -> np.ndarray:
        """Places of a template by the votes of its rarest words that the file has."""
        have = sorted((w for w in set(line.tolist()) if w in at), key=lambda w: (-idf[w], w))[:RARE]
        slots = [(w, j) for w in have for j in np.flatnonzero(line == w).tolist()]
        found, votes = np.unique(np.concatenate([at[w] - j for w, j in slots]), return_counts=True)
        return found[votes >= math.ceil(AGREE * len(slots))]

    def _scored(self, line: np.ndarray, found: np.ndarray, which: np.ndarray, where: np.ndarray, idf: np.ndarray, slack: int) -> list[tuple[int, float]]:
        """Of placements within slack of each other the best one, the first of equal ones, each with its score."""
        weight = idf[line]
        got = np.zeros(len(found))
        for j, w in enumerate(line.tolist()):
            near = np.minimum(np.searchsorted(where, found + j), len(where) - 1)
            got += weight[j] * ((where[near] == found + j) & (which[near] == w))
        got /= weight.sum()
        out: list[tuple[int, float]] = []
        last = None
        for s, v in zip(found.tolist(), got.tolist()):
            if last is not None and s - last <= slack and slack:
                if v > out[-1][1]:
                    out[-1] = (max(s, 0), v)
            else:
                out.append((max(s, 0), v))
            last = s
        return out


def index(docs: DataFrame, templates: list[Template], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stored index of the texts: id, n_words, ``there`` (licence words), ``which`` and ``where`` (them and their places)."""
    table = Licences(templates)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            read = [table.read(batch.column("text")[i].as_py()) for i in range(batch.num_rows)]
            total, there, which, where = zip(*read) if read else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(total, pa.int64()), pa.array(there, pa.list_(pa.int32())), pa.array(which, pa.list_(pa.int32())), pa.array(where, pa.list_(pa.int64()))],
                ["id", "n_words", "there", "which", "where"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return keep(rows.mapInArrow(run, f"id {kind}, n_words long, there array<int>, which array<int>, where array<long>"), "license-index")


def rarity(indexed: DataFrame, templates: list[Template]) -> np.ndarray:
    """The inverse document frequency of each licence word, over all documents; the words are the templates'."""
    n = indexed.count()
    found = dict(indexed.select(F.explode("there").alias("w")).groupBy("w").count().collect())
    return np.array([math.log((n + 1) / (found.get(w, 0) + 1)) + 1 for w in range(len(Licences(templates).spelling))])


def scan(docs: DataFrame, templates: list[Template] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, n_words and ``matches``, ordered by place: template's number, label, first word, end and score."""
    templates = list(templates or (*BASE, *NOTICES))
    indexed = index(docs, templates, id_col, text_col)
    table, idf = Licences(templates), rarity(indexed, templates)
    kind = pa.list_(pa.struct([("template", pa.int32()), ("label", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which, where, out = batch.column("which"), batch.column("where"), []
            for i in range(batch.num_rows):
                found = table.places(which[i].values.to_numpy(), where[i].values.to_numpy(), idf) if len(which[i]) else []
                out.append([dict(zip(("template", "label", "first_word", "end_word", "score"), m)) for m in sorted(found, key=lambda m: (m[2], m[0]))])
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n_words"), pa.array(out, kind)], ["id", "n_words", "matches"])

    schema = f"id {docs.schema[id_col].dataType.simpleString()}, n_words long, matches array<{MATCH}>"
    return indexed.mapInArrow(run, schema).withColumnRenamed("id", id_col)
