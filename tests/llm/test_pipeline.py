"""Stages of the pipeline against brute force on their own inputs."""

from __future__ import annotations

import sys

import pytest

import brute
import corpus_pipeline as pipeline
from automill.llm import decontaminate, line_dedup
from conftest import SF


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [("documents", docs)]
    for name, stage in pipeline.STAGES:
        out.append((name, pipeline.keep(stage(spark, out[-1][1], SF), "test-stage")))
    return out


def test_columns(stages):
    for _, df in stages[:-1]:
        assert df.columns == stages[0][1].columns
    assert stages[-1][1].columns == [*stages[0][1].columns, "copy"]


def test_quality_keeps_good_documents(spark, stages):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in stages[1][1].collect()}
    good = [i for i, q in labels.items() if q == 1]
    assert sum(i in kept for i in good) >= 0.98 * len(good)
    assert all(r.text == t.text for r, t in zip(stages[1][1].orderBy("doc_id").collect(), stages[0][1].join(stages[1][1].select("doc_id"), "doc_id").orderBy("doc_id").collect()))


def test_line_stage(stages):
    before = [(r.doc_id, r.text) for r in stages[1][1].collect()]
    want = brute.line_dedup(before, line_dedup.MIN_WORDS)
    old = dict(before)
    want = {i: t for i, t in want.items() if t == old[i] or t.strip()}
    assert {r.doc_id: r.text for r in stages[2][1].collect()} == want
    assert all(r.n_chars == len(r.text) for r in stages[2][1].collect())


def test_near_stage(stages):
    components = brute.near_components([(r.doc_id, r.text) for r in stages[2][1].collect()])
    assert {r.doc_id for r in stages[3][1].collect()} == {i for i, (_, c) in components.items() if i == c}


def test_decontamination_stage(spark, stages):
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = decontaminate.normalised(r.text)
        windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
    sizes = {len(x) for x in windows}

    def clean(text):
        w = decontaminate.normalised(text)
        return not any(tuple(w[i : i + n]) in windows for n in sizes for i in range(len(w) - n + 1))

    assert {r.doc_id for r in stages[4][1].collect()} == {r.doc_id for r in stages[3][1].collect() if clean(r.text)}


def test_mixing_stage(stages):
    before = {r.doc_id: r for r in stages[4][1].collect()}
    after = stages[5][1].collect()
    assert {r.doc_id for r in after} <= set(before) and max(r["copy"] for r in after) <= 2
    words = lambda t: len(brute.WORD.findall(t or ""))
    assert sum(words(r.text) for r in after) == pytest.approx(sum(words(r.text) for r in before.values()), rel=0.1)


def test_odd_rows(spark):
    """Nulls everywhere, repeated rows and extra columns go through every stage."""
    rows = [(1, "A fine text with several words in it.", "en", "s", 10, "e"), (1, "A fine text with several words in it.", "en", "s", 10, "e"), (None, None, None, None, None, None), (2, "", "en", None, 0, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string")
    for name, stage in pipeline.STAGES:
        docs = pipeline.keep(stage(spark, docs, SF), "test-odd")
        assert name != "near dedup" or sorted(str(r.doc_id) for r in docs.collect()) == ["1", "2", "None"]
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in pipeline.STAGES:
        empty = stage(spark, empty, SF)
    assert empty.count() == 0


NAMES = ["__id", "__ID2", "__mix_source", "__mix_rate", "__mix_times", "__mix_copy", "copy", "__lines_gone", "__runs", "__row", "__x", "kept", "id", "rest"]


def test_clashing_names(spark):
    """Columns of any name go through all stages and keep their values; the count of copies takes a name that is free."""
    said = "A fine text with several words in it, and more of them. " * 4
    rows = [(i, said + f"Number {i} of {i * 7919}.", "en", f"s{i % 2}", 10, *[f"{n} {i}" for n in NAMES]) for i in range(30)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in NAMES)
    docs = spark.createDataFrame(rows, schema)
    for name, stage in pipeline.STAGES:
        docs = pipeline.keep(stage(spark, docs, SF), "test-names")
        if name != "mixing":
            assert docs.columns == [*schema_names(schema)]
    assert docs.columns[:-1] == schema_names(schema) and docs.columns[-1] not in schema_names(schema)
    found = docs.collect()
    assert found and all(r[n] == f"{n} {r.doc_id}" for r in found for n in NAMES)


def schema_names(schema):
    return [x.split()[0].strip("`") for x in schema.split(", ")]


def test_which_of_repeated_ids(spark):
    """Of rows that repeat an id the one with the greatest text stays, whatever their order."""
    rows = [(1, "b b b b b b", "x"), (1, "c c c c c c", "y"), (1, None, "z"), (2, "d", "u"), (2, "d", "v")]
    for order in (rows, rows[::-1]):
        got = sorted(tuple(r) for r in pipeline.one_of_each(spark, spark.createDataFrame(order, "doc_id long, text string, lang string"), SF).collect())
        assert len(got) == 2 and got[0] == (1, "c c c c c c", "y") and got[1][:2] == (2, "d")
        assert order is rows or got == first
        first = got


def test_engine_does_not_need_this():
    assert not [m for m in ("automill.queries", "automill.operators.match", "automill.cli") if "automill.llm" in open(sys.modules[m].__file__ if m in sys.modules else __import__(m, fromlist=["x"]).__file__).read()]
