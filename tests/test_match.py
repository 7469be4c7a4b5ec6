from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

import oracle
from automill.model import build, from_frames, keywords, to_frames
from automill.operators import reports
from automill.operators.match import frontier_profile, match, state_profile
from automill.plans.relational import TooManyRounds
from automill.sources import anml, streams

#: b, then digits, then x or y; another report behind the first digit.
LOOP = """<anml version="1.0"><automata-network id="x"><description>d</description>
<state-transition-element id="end" symbol-set="[xy]"><report-on-match reportcode="fin"/></state-transition-element>
<state-transition-element id="num" symbol-set="\\d" unknown="1"><activate-on-match element="num"/><activate-on-match element="end"/></state-transition-element>
<state-transition-element id="one" symbol-set="[0-9]"><report-on-match reportcode="7"/></state-transition-element>
<state-transition-element id="go" symbol-set="[b]" start="all-input"><activate-on-match element="num"/><activate-on-match element="one"/></state-transition-element>
</automata-network></anml>"""


@pytest.fixture(scope="module")
def data(spark):
    r = random.Random(5)
    rows = {str(k): bytes(r.choice(b"abc") for _ in range(n)) for k, n in enumerate((0, 1, 5, 17, 30))}
    return rows, spark.createDataFrame([(k, bytearray(v)) for k, v in rows.items()], "stream_id string, payload binary")


def got(df):
    rows = [(r.stream_id, r.offset, r.state_id) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("seed", [1, 3])
@pytest.mark.parametrize("options", [{}, {"strategy": "arrow"}, {"strategy": "relational"}, {"memo_k": 2}, {"groups": 2}, {"segment_bytes": 5, "seam": "exact", "tail": "keep"}], ids=str)
def test_strategies(data, seed, options):
    rows, df = data
    a = oracle.random_automaton(seed, cycles=False)
    assert got(match(a, None, df, **options)) == {(k, *x) for k, v in rows.items() for x in oracle.reports(a, v)}


def test_segments_and_replicas(data):
    rows, df = data
    a = oracle.random_automaton(2)
    cut = {(k, *x) for k, v in rows.items() for s in range(0, len(v) // 5 * 5, 5) for x in oracle.reports(a, v[s : s + 5], s == 0, s)}
    assert got(match(a, None, df, segment_bytes=5)) == cut
    every = {(k, *x) for k, v in rows.items() for s in range(0, len(v), 5) for x in oracle.reports(a, v[s : s + 5], True, s)}
    assert got(match(a, None, df, segment_bytes=5, tail="keep", start_scope="every_segment")) == every
    twice = {(k, *x) for k, v in rows.items() for s in range(2) for x in oracle.reports(a, v, True, s * len(v))}
    assert got(match(a, None, df, replicas=2)) == twice
    exact = {(k, *x) for k, v in rows.items() for x in oracle.reports(a, v)}
    assert got(match(a, None, df, segment_bytes=7, seam="exact", tail="keep")) == exact
    assert match(a, None, df, mode="count").first().n == len(exact)


def test_many_passes(data, monkeypatch):
    """Automata that are too large for one broadcast, and large segments that are dealt out anew."""
    from automill.operators import match as module

    rows, df = data
    monkeypatch.setattr(module, "BROADCAST_STATES", 3)
    monkeypatch.setattr(module, "LARGE_SEGMENT", 1)
    a = keywords("k", ["ab", "bc", "abc", "c"])
    want = {(k, *x) for k, v in rows.items() for x in oracle.reports(a, v)}
    assert got(match(a, None, df, groups=4)) == want == got(match(a, None, df, groups=4, segment_bytes=6, seam="exact", tail="keep"))


def test_duplicate_rule(spark):
    """Segments as long as the stream: start-of-data fires in each."""
    a = keywords("s", ["a"], start="start-of-data")
    df = spark.createDataFrame([("x", bytearray(b"ab"))], "stream_id string, payload binary")
    assert {o for _, o, _ in got(match(a, None, df, replicas=3, segment_bytes=2))} == {0, 2, 4}
    assert {o for _, o, _ in got(match(a, None, df, replicas=3, segment_bytes=1))} == {0}
    assert {o for _, o, _ in got(match(keywords("p", ["b"]), None, df, pad_to=8))} == {1}


def test_component_selection(data):
    _, df = data
    a = keywords("k", ["a", "bc", "abc"])
    full = match(a, None, df)
    assert got(match(a, None, df, cc_id=1)) == {(r.stream_id, r.offset, r.state_id) for r in full.where("cc_id = 1").collect()}
    assert got(match(a, None, df, cc_with_state="k2_1")) == {(r.stream_id, r.offset, r.state_id) for r in full.where("cc_id = 2").collect()}
    assert {r.cc_id for r in match(a, None, df, max_cc_states=1).collect()} == {0}
    with pytest.raises(ValueError):
        match(a, None, df, seam="none")


def test_relational_gives_up_on_cycles(spark):
    a = build("l", [{"id": "a", "symbols": "a", "start": "all-input"}, {"id": "b", "symbols": "*", "report": True}], [("a", "b"), ("b", "b")])
    df = spark.createDataFrame([("x", bytearray(b"a" * 20))], "stream_id string, payload binary")
    from automill.operators.scratch import keep
    from automill.plans import planner, relational

    with pytest.raises(TooManyRounds):
        relational.match(streams.segments(df), [g.compiled for g in planner.plan([a], strategy="relational")], False, 0, keep, max_rounds=2)


def test_anml(spark, tmp_path):
    (tmp_path / "loop.anml").write_text(LOOP)
    (tmp_path / "in.txt").write_bytes(b"ab12x b3 by b4y\n")
    states, edges = anml.load(spark, str(tmp_path / "loop.anml"))
    found = match(states, edges, streams.from_files(spark, str(tmp_path / "in.txt")))
    assert sorted((r.offset, r.state_id, r.original_id, r.report_code) for r in found.collect()) == [
        (2, 2, "one", "7"), (4, 0, "end", "fin"), (7, 2, "one", "7"), (13, 2, "one", "7"), (14, 0, "end", "fin"),
    ]
    anml.register(spark)
    assert spark.read.format("anml").load(str(tmp_path)).count() == 4
    assert spark.read.format("anml").option("table", "edges").load(str(tmp_path / "loop.anml")).count() == 4


@pytest.mark.parametrize(
    ("old", "new"),
    [("activate-on-match element=\"end\"", "activate-on-match element=\"nope\""), ("state-transition-element id=\"go\"", "state-transition-element id=\"num\""), ("<description>d</description>", "<counter id=\"c\"/>"), ("automata-network", "network"), ("[xy]", "[xy")],
)
def test_anml_errors(old, new):
    with pytest.raises(ValueError):
        anml.parse(LOOP.replace(old, new).encode())


def test_frames_round_trip(spark):
    a = oracle.random_automaton(4)
    b = from_frames(*to_frames(spark, a))[0]
    assert [(s.str_id, s.symbols, s.start, s.report) for s in a.states] == [(s.str_id, s.symbols, s.start, s.report) for s in b.states]
    assert sorted(a.edges()) == sorted(b.edges())


def test_streams(spark):
    df = spark.createDataFrame([("x", bytearray(b"abcdefg")), ("y", bytearray(b""))], "stream_id string, payload binary")
    cut = lambda *a, **k: [(r.seg_id, r.base, bytes(r.payload)) for r in streams.segments(df, *a, **k).orderBy("stream_id", "seg_id").collect()]
    assert cut() == [(0, 0, b"abcdefg")]
    assert cut(3) == [(0, 0, b"abc"), (1, 3, b"def")]
    assert cut(3, tail="keep") == [(0, 0, b"abc"), (1, 3, b"def"), (2, 6, b"g")]
    assert cut(5, replicas=2) == [(0, 0, b"abcde"), (1, 5, b"fgabc")]
    assert cut(20, replicas=2, tail="keep") == [(0, 0, b"abcdefgabcdefg")]
    assert [bytes(r.payload) for r in streams.slice_streams(df.where("stream_id = 'x'"), 2, 100).collect()] == [b"cdefg"]
    with pytest.raises(Exception, match="past the end"):
        streams.slice_streams(df, 5, 1).collect()
    padded = {r.stream_id: (r.length, bytes(r.payload)) for r in streams.pad(df, 4).collect()}
    assert padded == {"x": (7, b"abcdefg\0"), "y": (0, b"")}
    assert {r.stream_id: r.alphabet for r in streams.alphabet(df).collect()} == {"x": list(b"abcdefg"), "y": []}
    a, b = (bytes(streams.random_stream(spark, 1003, seed=4).first().payload) for _ in range(2))
    assert a == b and len(a) == 1003 and len(set(a)) > 200
    assert bytes(streams.random_stream(spark, 9, seed=5).first().payload) != a[:9]


def test_profiles(data):
    _, df = data
    a = keywords("k", ["ab"])
    n = {r.state_id: r.activations for r in state_profile(a, None, df).collect()}
    assert n[1] == match(a, None, df).count() and n[0] >= n[1]
    compat = {r.state_id: r.activations for r in state_profile(a, None, df, compat=True).collect()}
    assert compat[0] > n[0]
    assert frontier_profile(a, None, df).agg(F.sum(F.col("size") * F.col("positions"))).first()[0] == sum(n.values())


def test_reports(data):
    _, df = data
    a = keywords("k", ["ab", "b"])
    found = match(a, None, df)
    assert reports.validate(found, match(a, None, df, strategy="arrow"))[0]
    same, different = reports.validate(found, found.limit(1))
    assert not same and all(r.side == "a" for r in different)
    row = reports.count(found.union(found)).first()
    assert row.n == 2 * row.n_distinct == 2 * found.count()
    assert reports.quick_validate(found, row.n_distinct) and not reports.quick_validate(found, row.n_distinct + 1)
    assert reports.unique(found.union(found)).count() == row.n_distinct
    twins = found.withColumn("state_id", F.col("state_id") + 7).union(found)
    assert reports.unique(twins, by_original=True).count() == row.n_distinct
    keys = [(r.stream_id, r.offset, r.state_id) for r in reports.ordered(found).collect()]
    assert keys == sorted(keys)


@pytest.mark.parametrize("segment", [3, 64, 1000])
def test_cyclic_streams_in_parts(spark, segment, monkeypatch):
    """Ranges of a stream of a cyclic automaton are matched side by side, whatever their number, as the uncut stream is."""
    from automill.operators import match as module

    monkeypatch.setattr(module, "COMPOSED", 4)
    r = random.Random(segment)
    data = {"a": bytes(r.choice(b"abcd") for _ in range(997)), "b": bytes(r.choice(b"ab") for _ in range(64)), "c": b"", "d": b"a"}
    streams_ = spark.createDataFrame([(k, bytearray(v)) for k, v in data.items()], "stream_id string, payload binary")
    automata = [oracle.random_automaton(s, 6) for s in (3, 4, 60)]
    want = {(a.nfa_id, k, p, i) for a in automata for k, v in data.items() for p, i in oracle.reports(a, v)}
    for strategy in ("auto", "arrow"):
        found = match(automata, None, streams_, segment_bytes=segment, seam="exact", tail="keep", strategy=strategy).collect()
        assert {(r.nfa_id, r.stream_id, r.offset, r.state_id) for r in found} == want and len(found) == len(want)


def test_many_byte_ranges(spark, tmp_path):
    """the number of tasks doesn't follow the number of ranges; each is a row of its own all the same."""
    data = bytes(i % 251 for i in range(20_011))
    (tmp_path / "x.bin").write_bytes(data)
    ranges = streams.from_ranges(spark, str(tmp_path), 7, overlap=3)
    assert ranges.rdd.getNumPartitions() <= 256
    want = [(own, max(0, own - 3), own <= 3, data[max(0, own - 3) : own + 7]) for own in range(0, len(data), 7)]
    assert sorted((r.own, r.base, r.first, bytes(r.payload)) for r in ranges.collect()) == want


def test_dealt(spark):
    """F3, F5, F7, F8: one file's streams are as many parts as their bytes ask for, with the same rows; joins begin with such parts."""
    rows = [(str(k), bytearray(b"ab12") * 5) for k in range(2000)] + [("long", bytearray(b"1") * 9000), ("none", bytearray())]
    df = spark.createDataFrame(rows, "stream_id string, payload binary").coalesce(1)
    dealt = streams.dealt(df, part_bytes=1000)
    assert dealt.rdd.getNumPartitions() == 49 and sorted(map(tuple, dealt.collect())) == sorted((a, bytes(b)) for a, b in rows)
    assert max(dealt.rdd.mapPartitions(lambda p: [sum(len(x.payload) for x in p if x.stream_id != "long")]).collect()) < 3000
    assert streams.dealt(df.limit(0)).count() == 0
    a = build("d", [{"id": "x", "symbols": "[0-9]", "start": "all-input"}, {"id": "y", "symbols": "[0-9]", "code": "two"}], [("x", "y")])
    for k in (2, 3):
        found = match(a, None, df, memo_k=k)
        assert "REPARTITION_BY_NUM" in found._jdf.queryExecution().executedPlan().toString()
        assert found.count() == 2000 * 5 + 8999


def test_byte_ranges(spark, tmp_path):
    """A file in ranges is matched as one stream; ranges that overlap too little are an error, and a folder is its files."""
    r = random.Random(5)
    for name, n in (("x.bin", 10_007), ("y.bin", 300), ("empty", 0), ("_hidden", 9)):
        (tmp_path / name).write_bytes(bytes(r.choice(b"abcd") for _ in range(n)))
    automata = [oracle.random_automaton(2, 6), oracle.random_automaton(51, 6, cycles=False)]
    want = {(a.nfa_id, name, p, i) for a in automata for name in ("x.bin", "y.bin") for p, i in oracle.reports(a, (tmp_path / name).read_bytes())}
    ranges = streams.from_ranges(spark, str(tmp_path), 1000, overlap=5)
    assert ranges.rdd.getNumPartitions() == 12
    found = match(automata, None, ranges).collect()
    assert {(r.nfa_id, r.stream_id.rsplit("/", 1)[1], r.offset, r.state_id) for r in found} == want and len(found) == len(want)
    assert match(automata, None, ranges, mode="count").first().n == len(want)
    with pytest.raises(Exception, match="overlap"):
        match(automata, None, streams.from_ranges(spark, str(tmp_path), 1000, overlap=0)).collect()
    with pytest.raises(Exception, match="no such file"):
        streams.from_ranges(spark, str(tmp_path / "none")).collect()
