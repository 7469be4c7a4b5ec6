"""Automata as tables: built from columns, numbered, and their graphs; against the driver's algorithms and brute force."""

from __future__ import annotations

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from automill import oracles_tables, queries_tables
from automill.model import from_frames, keywords, to_frames
from automill.operators import graph, graph_tables, transforms
from automill.operators.match import match
from automill.operators.numbering import ranked
from automill.operators.scratch import keep
from automill.plans.planner import dag_class
from automill.sources import dictionary
from oracle import random_automaton, reports

AUTOMATA = [random_automaton(s, 9) for s in range(5)] + [random_automaton(s, 8, cycles=False) for s in (50, 51)]


@pytest.fixture(scope="module")
def frames(spark):
    for k, a in enumerate(AUTOMATA):
        a.nfa_id = f"n{k}"
    return tuple(keep(x) for x in to_frames(spark, *AUTOMATA))


def by_state(rows, column):
    out = {}
    for r in rows:
        out.setdefault(r["nfa_id"], {})[r["state_id"]] = r[column]
    return {a: [x[i] for i in sorted(x)] for a, x in out.items()}


def test_ranked(spark):
    r = random.Random(1)
    rows = [(r.choice("aab"), r.randrange(40), i) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, x int, i int").repartition(7)
    got = ranked(df, ["g"], [F.col("x").desc(), F.col("i")], keep).collect()
    for g in "ab":
        want = [(x, i) for _, x, i in sorted((t for t in rows if t[0] == g), key=lambda t: (-t[1], t[2]))]
        assert [(t.x, t.i) for t in sorted((t for t in got if t.g == g), key=lambda t: t.rank)] == want
        assert sorted(t.rank for t in got if t.g == g) == list(range(len(want)))
    assert sorted(t.rank for t in ranked(df, [], [F.col("i")], keep).collect()) == list(range(300))
    assert ranked(df.limit(0), ["g"], [F.col("i")], keep).collect() == []


def test_strong_components(spark, frames):
    got = by_state(graph_tables.strong_components(*frames, keep).collect(), "scc_root")
    for a in AUTOMATA:
        labels = graph.strong_components(a)
        assert got[a.nfa_id] == [labels.index(x) for x in labels]


def test_only_possible_cycles_are_walked(spark, monkeypatch):
    """edges that begin where none ends, or end where none begins, are left out before labels move."""
    ring, inwards, outwards = [(5, 3), (3, 9), (9, 5)], [(k, 3) for k in range(20, 60)], [(9, k) for k in range(60, 90)]
    edges = spark.createDataFrame([("g", *e) for e in [*ring, *inwards, *outwards, (1, 1), (2, 1)]], "nfa_id string, src int, dst int")
    states = edges.select("nfa_id", F.col("src").alias("state_id")).union(edges.select("nfa_id", "dst")).distinct()
    walked, plain = [], graph_tables.propagate

    def propagate(labels, moves, step, keep):
        walked.append(moves.count())
        return plain(labels, moves, step, keep)

    monkeypatch.setattr(graph_tables, "propagate", propagate)
    got = {r.state_id: r.scc_root for r in graph_tables.strong_components(states, edges, keep).collect()}
    assert got == {k: 3 if k in (3, 5, 9) else k for k in [1, 2, 3, 5, 9, *range(20, 90)]} and max(walked) == 3


def test_all_lines_are_in_the_graph_of_orders(spark, tmp_path):
    """lines with any flag, or none, and of any quantity are edges."""
    lines = [(1, 0, "N", 10.0), (1, 0, "R", 40.0), (2, 1, "A", 5.0), (2, 1, "R", 2.0), (2, 0, "A", 5.0), (3, 1, None, 7.0), (3, 1, "R", None), (9, 1, "N", 1.0)]
    spark.createDataFrame(lines, "l_orderkey long, l_suppkey long, l_returnflag string, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(k, k) for k in (1, 2, 3, 4)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    got = {r.state_id: r.scc_root for r in queries_tables.strong_components_orders(spark, str(tmp_path)).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 3, 6: 3}
    with duckdb.connect() as duck:
        for t in ("lineitem", "orders"):
            duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
        assert dict(duck.execute(oracles_tables.ORACLES["strong_components_orders"]).fetchall()) == got


def test_layers_and_classes(spark, frames):
    strong = keep(graph_tables.strong_components(*frames, keep))
    topo = by_state(graph_tables.topological_layers(strong, frames[1], keep).collect(), "topo_order")
    bfs = by_state(graph_tables.bfs_layers(*frames, keep).collect(), "bfs_layer")
    kinds = dict(graph_tables.dag_classes(strong, frames[1]).collect())
    for a in AUTOMATA:
        assert topo[a.nfa_id] == graph.topological_layers(a)
        assert bfs[a.nfa_id] == graph.bfs_layers(a)
        assert kinds[a.nfa_id] == dag_class(a)


def test_labels(spark, frames):
    rows = graph_tables.graph_labels(*frames, keep).collect()
    for column, want in (("cc_id", graph.components), ("cc_local_id", lambda a: graph.local_ids(graph.components(a)))):
        got = by_state(rows, column)
        assert all(got[a.nfa_id] == want(a) for a in AUTOMATA)


@pytest.mark.parametrize("enable", [False, True])
def test_incompatible_pairs(spark, frames, enable):
    got = {}
    for nfa, x, y in graph_tables.incompatible_pairs(*frames, keep, enable).collect():
        got.setdefault(nfa, set()).add((x, y))
    assert got == {a.nfa_id: graph.incompatible_pairs(a, enable=enable) for a in AUTOMATA}


def test_renumber_and_merge(spark, frames):
    states, edges = frames
    new = transforms.renumber(states, edges, F.col("str_id").desc())
    for a in from_frames(*new):
        old = next(x for x in AUTOMATA if x.nfa_id == a.nfa_id)
        assert [s.str_id for s in a.states] == sorted((s.str_id for s in old.states), reverse=True)
        assert {(a.states[x].str_id, a.states[y].str_id) for x, y in a.edges()} == {(old.states[x].str_id, old.states[y].str_id) for x, y in old.edges()}
    part = transforms.renumber(states, edges, F.col("str_id").desc(), boundary=2)[0].where("nfa_id = 'n0'").orderBy("state_id").collect()
    assert [r.str_id for r in part] == ["s8", "s7", *[f"s{i}" for i in range(7)]]
    (one,) = from_frames(*transforms.merge(states, edges, "all"))
    assert [s.str_id for s in one.states] == [s.str_id for a in AUTOMATA for s in a.states]


WORDS = ["the", "then", "he", "hen", "n", "other", "the", "", None, "é", "éa"]


def test_tries(spark):
    """What a trie of a column reports is what the driver's keywords report."""
    rows = spark.createDataFrame([("d", w) for w in WORDS] + [("e", "he"), (None, "he")], "nfa_id string, pattern string")
    states, edges = dictionary.tries(rows, keep)
    made = {a.nfa_id: a for a in from_frames(states, edges)}
    words = sorted({w for w in WORDS if w})
    prefixes = {w.encode()[:k] for w in words for k in range(1, len(w.encode()) + 1)}
    assert len(made["d"]) == len(prefixes) and len(made["e"]) == 2 and set(made) == {"d", "e"}
    data = "other then, he, éa the hen".encode()
    codes = lambda a: {(p, a.states[i].code) for p, i in reports(a, data)}
    assert codes(made["d"]) == codes(keywords("k", words, codes=words))
    streams = spark.createDataFrame([("s", bytearray(data))], "stream_id string, payload binary")
    assert {(r.offset, r.report_code) for r in match(states, edges, streams).where("nfa_id = 'd'").collect()} == codes(made["d"])


def test_gaps_cases_starts_and_repeats(spark):
    rows = [("g", "ab cd", "all-input", False, "x"), ("g", "ab", "all-input", False, "w"), ("g", "ab", "start-of-data", True, "y"), ("g", "AB", "all-input", False, "v")]
    df = spark.createDataFrame(rows, "nfa_id string, pattern string, start string, repeat boolean, code string")
    (a,) = from_frames(*dictionary.tries(df, keep, gap=b" ", fold_case=True))
    found = lambda text: sorted((p, a.states[i].code) for p, i in reports(a, text))
    assert found(b"abab") == [(1, "v"), (1, "y"), (3, "v"), (3, "y")]
    assert found(b"-aBab") == [(2, "v"), (4, "v")]
    assert found(b"-ab..cD") == [(2, "v"), (6, "x")]
    assert found(b"-abcd") == [(2, "v")]


def test_failure_links(spark):
    rows = spark.createDataFrame([("d", w) for w in WORDS], "nfa_id string, pattern string")
    states, _ = dictionary.tries(rows, keep)
    got = {(r.nfa_id, r.state_id): r.failure for r in dictionary.failure_links(rows, states).collect()}
    import hashlib

    name = lambda p: hashlib.md5(b"2:" + p).hexdigest()
    ids = {r.str_id: r.state_id for r in states.collect()}
    prefixes = {w.encode()[:k] for w in WORDS if w for k in range(1, len(w.encode()) + 1)}
    for p in prefixes:
        want = next((ids[name(p[k:])] for k in range(1, len(p)) if p[k:] in prefixes), None)
        assert got["d", ids[name(p)]] == want
    assert len(got) == len(prefixes)
