"""Fingerprints of key ranges, folds in the JVM, and stored streams with an index."""

from __future__ import annotations

import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import oracle
from automill.model import build, keywords
from automill.operators import fingerprints
from automill.operators.match import match
from automill.plans import fold
from automill.sources import skipping, streams


@pytest.mark.parametrize("seed", range(3))
def test_first_differences(spark, seed, monkeypatch):
    monkeypatch.setattr(fingerprints, "SAMPLE", 50)
    r = random.Random(seed)
    rows = [(r.choice("abcdef"), r.randrange(50), r.randrange(3)) for _ in range(600)] + [(None, 1, 1), ("a", None, None)]
    other = [x for x in rows if r.random() > 0.05] + [("z", 1, 1), rows[0], rows[0], (None, 0, 0)]
    a, b = (spark.createDataFrame(x, "k string, p int, v int").repartition(5) for x in (rows, other))
    one, two = Counter(rows), Counter(other)
    nulls = lambda t: tuple((v is not None, v if v is not None else 0) for v in t)
    order = lambda t: tuple((x, str(y)) if isinstance(y, str) else (x, y) if x else (x, 0) for x, y in nulls(t))
    want = [(*t, "a" if one[t] > two[t] else "b", abs(one[t] - two[t])) for t in sorted({*one, *two}, key=lambda t: order(t) if t[0] is not None else ((False, ""), *order(t)[1:])) if one[t] != two[t]]
    for limit in (5, 1000):
        got = [tuple(x) for x in fingerprints.first_differences(a, b, ["k", "p"], limit, ranges=16).collect()]
        assert got == want[:limit]
    assert fingerprints.equal(a, a.orderBy(F.rand(1)), ["k", "p"]) and not fingerprints.equal(a, b, ["k", "p"])
    assert not fingerprints.equal(a, a.union(a.limit(1)), ["k"]) and fingerprints.equal(a.limit(0), b.limit(0), ["k"])
    assert fingerprints.first_differences(a, a, ["k", "p"]).collect() == []
    _, wrong = fingerprints.unequal_ranges(a, a.where("k is null or k <> 'c' or p <> 7").union(a.where("k = 'c' and p = 7").limit(0)), ["k", "p"], 16)
    assert len(wrong) <= 1


def test_ranges_of_keys(spark, monkeypatch):
    """the two sides are worked out once each, however often they are read, and ranges are found by halving."""
    df = spark.createDataFrame([(k % 97, k) for k in range(3000)] + [(None, 1)], "k int, p int")
    for ranges, sample in ((16, 50), (256, 4096), (7, 4096)):
        monkeypatch.setattr(fingerprints, "SAMPLE", sample)
        got = df.select("k", "p", fingerprints._ranges(df, ["k", "p"], ranges).alias("r")).collect()
        places = [x.r for x in sorted(got, key=lambda x: (x.k is not None, x.k or 0, x.p))]
        assert places == sorted(places) and places[0] == 0 and min(16, ranges) / 2 <= len(set(places)) == places[-1] + 1 <= 2 * ranges
    made = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    once = df.mapInArrow(run, "k int, p int")
    assert fingerprints.first_differences(once, df, ["k", "p"]).collect() == [] and made.value == 3001


def test_grams(spark, monkeypatch):
    """the distinct 3-grams of batches, without those across two streams, also where a stream is cut into chunks."""
    r = random.Random(4)
    rows = [(r.randrange(3), bytes(r.randrange(256) for _ in range(n))) for n in (0, 1, 2, 3, 4, 9, 10, 11, 50, 200)] + [(7, None), (8, b"\xff\xff\xff")]
    want = {(b, d[i : i + 3]) for b, d in rows if d for i in range(len(d) - 2)}
    batch = pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int32()), pa.array([d for _, d in rows], pa.binary())], ["block", "payload"])
    for chunk in (1, 4, 7, 1 << 22):
        monkeypatch.setattr(skipping, "CHUNK", chunk)
        got = [(b, g) for x in skipping._grams(iter([batch])) for b, g in zip(*(c.to_pylist() for c in x.columns))]
        assert set(got) == want and len(got) == len(want)


def test_fold(spark, monkeypatch):
    """A fold reports what the rules say, and leaves large tables to the kernel."""
    r = random.Random(9)
    data = {str(k): bytes(r.choice(b"abcd\xff") for _ in range(n)) for k, n in enumerate((0, 1, 7, 40))}
    df = spark.createDataFrame([(k, bytearray(v)) for k, v in data.items()], "stream_id string, payload binary")
    automata = [oracle.random_automaton(s, 6) for s in (1, 2, 3)]
    want = {(a.nfa_id, k, p, i) for a in automata for k, v in data.items() for p, i in oracle.reports(a, v)}
    for limit in (fold.FOLD_ENTRIES, 30, 0):
        monkeypatch.setattr(fold, "FOLD_ENTRIES", limit)
        found = match(automata, None, df, strategy="fold").collect()
        assert {(x.nfa_id, x.stream_id, x.offset, x.state_id) for x in found} == want and len(found) == len(want)
    cut = match(automata, None, df, strategy="fold", segment_bytes=3, tail="keep").collect()
    assert {tuple(x) for x in cut} == {tuple(x) for x in match(automata, None, df, segment_bytes=3, tail="keep").collect()}


def test_skipping(spark, tmp_path):
    """Rare keywords read few blocks, with equal results; what the index can't tell reads all."""
    r = random.Random(2)
    text = lambda: " ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(40))
    rows = [(k, text() + (" the needle" if k in (77, 300) else "")) for k in range(400)] + [(900, ""), (901, "ab")]
    data = streams.from_column(spark.createDataFrame(rows, "id long, text string"), "id", "text")
    path = str(tmp_path / "stored")
    skipping.store(data, path, 40)
    rare = keywords("k", ["needle", "haystack"])
    found, n = skipping.candidates(spark, path, [rare])
    assert 1 <= n <= 3 and "block" in found._jdf.queryExecution().toString() and found.count() < 60
    sort = lambda df: sorted(tuple(x) for x in df.collect())
    assert sort(skipping.match(spark, path, [rare])) == sort(match(rare, None, data)) != []
    assert sort(skipping.match(spark, path, [keywords("k", ["zzz"])])) == []
    for other in (keywords("k", ["ab"]), build("x", [{"id": "s", "symbols": "[nm]", "start": "all-input"}, {"id": "t", "symbols": "[e]", "code": "1"}], [("s", "t")])):
        found, n = skipping.candidates(spark, path, [other])
        assert n is None and sort(skipping.match(spark, path, [other])) == sort(match(other, None, data)) != []
    assert skipping.keywords_of(keywords("k", ["abc", "x"])) == [b"abc", b"x"]
    branch = build("b", [{"id": "a", "symbols": "[a]", "start": "all-input"}, {"id": "b", "symbols": "[b]", "code": "1"}, {"id": "c", "symbols": "[c]", "code": "2"}], [("a", "b"), ("a", "c")])
    ring = build("r", [{"id": "a", "symbols": "[a]", "start": "all-input"}, {"id": "b", "symbols": "[b]", "code": "1"}], [("a", "b"), ("b", "a")])
    assert skipping.keywords_of(branch) is None and skipping.keywords_of(ring) is None
