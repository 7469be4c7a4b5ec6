from __future__ import annotations

import math
import random
import re
import string

import numpy as np
import pytest

from automill.llm import license_scan, queries_licenses
from automill.llm.license_templates import BASE, NOTICES, Template
from conftest import SF

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TEMPLATES = [*BASE, *NOTICES]


def cut(text):
    return WORD.findall((text or "").translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase)))


def stands(words, phrase, at):
    return at >= 0 and words[at : at + len(phrase)] == phrase


def brute(texts, templates):
    """Every text's words and matches, by trying all offsets of every template."""
    files = [cut(t) for t in texts]
    lines = [cut(t.text) for t in templates]
    vocabulary = {w for line in lines for w in line}
    df = {w: sum(w in f for f in map(set, files)) for w in vocabulary}
    idf = {w: math.log((len(files) + 1) / (df[w] + 1)) + 1 for w in vocabulary}
    out = []
    for words in files:
        found = []
        there = set(words)
        for k, (t, line) in enumerate(zip(templates, lines)):
            keys = [cut(x) for x in t.keys]
            if not all(set(x) <= there for x in keys):
                continue
            rare = sorted(set(line) & there, key=lambda w: (-idf[w], w))[: license_scan.RARE]
            slots = [j for j, w in enumerate(line) if w in rare]
            places = [next(j for j in range(len(line)) if stands(line, x, j)) for x in keys]
            good = []
            for d in range(-len(line), len(words)):
                votes = sum(0 <= d + j < len(words) and words[d + j] == line[j] for j in slots)
                if votes and votes >= math.ceil(license_scan.AGREE * len(slots)):
                    if all(any(stands(words, x, d + p + e) for e in range(-t.slack, t.slack + 1)) for x, p in zip(keys, places)):
                        v = sum(idf[w] for j, w in enumerate(line) if 0 <= d + j < len(words) and words[d + j] == w) / sum(idf[w] for w in line)
                        good.append((d, v))
            chains = []
            for d, v in good:
                if t.slack and chains and d - chains[-1][-1][0] <= t.slack:
                    chains[-1].append((d, v))
                else:
                    chains.append([(d, v)])
            for c in chains:
                d, v = max(c, key=lambda x: (round(x[1], 12), -x[0]))
                found.append((k, t.label, max(d, 0), max(d, 0) + len(line), round(v, 9)))
        out.append((len(words), sorted(found, key=lambda m: (m[2], m[0]))))
    return out


def scanned(spark, texts, templates=None):
    rows = [(i, t, i, "x") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, id long, matches string")
    got = {r.doc_id: (r.n_words, [(m.template, m.label, m.first_word, m.end_word, round(m.score, 9)) for m in r.matches]) for r in license_scan.scan(df, templates).collect()}
    return [got[i] for i in range(len(texts))]


def test_places(spark):
    """Notices whole, with words between, cut short, next to each other, at both ends; nulls, empty and long texts, repeated rows."""
    r = random.Random(3)
    filler = ["the", "license", "mit", "of", "software", "general", "public", "apache", "version", "2", "0", "and", "to", "copy", "foo", "bär"]
    texts = [None, "", "...", "MIT License", "mit, license; MIT LICENSE mit mit license", "mit\nlicensed under apache-license", "general public", "gnu General\tPublic\u00a0License"]
    for t in TEMPLATES:
        words = t.text.split()
        texts += [t.text, t.text.upper() + ".", " ".join(r.choices(filler, k=30) + words + r.choices(filler, k=30) + words)]
        for gap in (1, 3, 9, 30):
            at = len(words) // 2
            texts.append(" ".join(words[:at] + ["filler"] * gap + words[at:]))
        texts += [" ".join(words[:-1]), " ".join(words[1:]), " ".join(w for w in words if r.random() < 0.8)]
    texts += [" ".join(r.choices(filler, k=r.choice([3, 40, 200]))) for _ in range(60)]
    texts += [texts[4]] * 3 + [" ".join(r.choices(filler[:8], k=3000))]
    assert scanned(spark, texts) == brute(texts, TEMPLATES)


def test_slack_and_keys(spark):
    near = Template("n", "alpha beta gamma delta", ("alpha beta", "gamma delta"), 2)
    with pytest.raises(ValueError, match="lacks"):
        license_scan.Licences([Template("x", "a b", ("b a",))])
    texts = ["alpha beta gamma delta", "alpha beta x x gamma delta", "alpha beta x x x x x gamma delta", "gamma delta alpha beta", "alpha gamma beta delta", "alpha beta gamma delta alpha beta gamma delta"]
    got = scanned(spark, texts, [near])
    assert got == brute(texts, [near])
    assert [len(m) for _, m in got] == [1, 1, 0, 0, 0, 2] and got[0][1][0][-1] == 1


def test_long_text_in_parts(monkeypatch):
    """Where a text is cut for reading does not matter."""
    table = license_scan.Licences(TEMPLATES)
    text = ("mit license " * 50 + "é, " * 40) * 20
    whole = table.read(text)
    monkeypatch.setattr(license_scan, "CHUNK", 7)
    assert table.read(text) == whole and whole[0] == len(cut(text))
    found = table.places(np.array(whole[2]), np.array(whole[3]), np.ones(len(table.spelling)))
    assert len(found) == 1000


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert license_scan.scan(df).collect() == []


@pytest.mark.parametrize("folder", [SF, SF.replace("sf0.001", "sf0.01")])
def test_query(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    want = {}
    for d, (n, found) in zip(docs, brute([d.text for d in docs], TEMPLATES)):
        base = [m for m in found if m[0] < len(BASE)]
        labels = lambda of: ",".join(sorted({m[1] for m in of}))
        starts = [m[2] for m in base]
        want[d.doc_id] = (n, len(base), min(starts, default=None), max(starts, default=None), labels(base), labels(found), max((m[4] for m in found), default=0.0))
    got = {r.doc_id: (*r[1:7], round(r.score, 9)) for r in queries_licenses.op12_license_scan(spark, folder).collect()}
    assert got == want
    assert len({x[4] for x in want.values()}) > 2
