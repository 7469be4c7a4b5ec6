"""Sinks, SQL, streaming, benchmarks, side inputs and the command line."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import oracle
from automill import bench, cli, sql
from automill.model import keywords, to_frames
from automill.operators import analysis, sinks, transforms
from automill.operators.match import match
from automill.operators.scratch import keep
from automill.sources import anml, streams, tables
from automill.streaming.carry import advance, match_stream
from automill.plans import planner
from conftest import MIXED

PAIR = """<automata-network id="pair">
<state-transition-element id="left" symbol-set="[xy]" start="all-input"><activate-on-match element="right"/></state-transition-element>
<state-transition-element id="right" symbol-set="[1]"><report-on-match reportcode="p"/></state-transition-element>
</automata-network>"""


def test_sinks(spark, tmp_path):
    states, edges = to_frames(spark, MIXED)
    labels = analysis.graph_labels(spark, [MIXED])
    text = sinks.dot(MIXED)
    assert text.startswith("digraph G {") and "3 -> 3;" in text and "shape=doubleoctagon" in text and "color=orange" in text and "color=yellow" in text
    sinks.write_gr(states, edges, str(tmp_path / "gr"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "gr" / "nfa_id=mixed")).collect()]
    assert lines[0] == "p sp 12 15" and "a 4 4 1" in lines
    sinks.write_tsv(sinks.node_table(states, edges, labels), str(tmp_path / "nodes"))
    nodes = spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "nodes"))
    assert nodes.columns == ["str_id", "matchset", "complete", "complement", "bfs_layer", "start", "alway_enabled", "report", "in_degree", "out_degree"]
    assert nodes.where("str_id = 'c3'").first().matchset == "0" * (255 - 113) + "1" + "0" * 113
    sinks.write_tsv(sinks.edge_table(states, edges), str(tmp_path / "edges"))
    assert spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "edges")).count() == 15
    df = spark.createDataFrame([("x", bytearray(b"abab"))], "stream_id string, payload binary")
    for fmt in ("parquet", "csv", "json"):
        sinks.write_reports(match(keywords("k", ["ab"]), None, df), str(tmp_path / fmt), fmt)
    assert spark.read.parquet(str(tmp_path / "parquet")).count() == 2
    assert len(sinks.show(MIXED).splitlines()) == 12


def test_table_transforms(spark):
    states, edges = to_frames(spark, MIXED)
    labels = transforms.with_components(transforms.component_table(states, edges, keep))
    driver = {(r.state_id, r.cc_id, r.cc_local_id) for r in analysis.graph_labels(spark, [MIXED]).collect()}
    assert {(r.state_id, r.cc_id, r.cc_local_id) for r in labels.collect()} == driver
    assert transforms.small_components(labels, 3).count() == 5
    assert transforms.one_component(labels, cc_id=2).count() == 7 == transforms.one_component(labels, state_id=6).count()
    gone = states.where("str_id = 'c1'").select("nfa_id", "state_id")
    left, kept = transforms.remove_states(states, edges, gone)
    assert left.count() == 11 and kept.count() == 8
    assert transforms.remove_edges(edges, edges.where("src = dst")).count() == 13
    assert transforms.add_edges(edges, edges).count() == 15
    assert transforms.add_states(left, states.join(gone, ["nfa_id", "state_id"], "left_semi")).count() == 12
    new, moved = transforms.renumber(states, edges, F.col("str_id").desc(), boundary=2)
    assert [r.str_id for r in new.orderBy("state_id").collect()][:3] == ["c6", "c5", "a0"] and moved.count() == 15
    sizes = analysis.component_sizes(labels)
    ratio = spark.createDataFrame([("mixed", 2, 0.5), ("mixed", 0, 0.4)], "nfa_id string, cc_id int, ratio double")
    for policy, order in ((0, [0, 1, 2]), (2, [2, 0, 1]), (3, [0, 2, 1])):
        assert [r.cc_id for r in transforms.pack_components(sizes, policy, ratio).orderBy("place").collect()] == order
    assert transforms.pack_components(sizes, 1, seed=3).count() == 3
    row = spark.range(1).select(transforms.round_robin(F.lit(7), 3).alias("a"), transforms.merge_every(F.lit(7), 3).alias("b")).first()
    assert (row.a, row.b) == (1, 2)


def test_hot(spark, tmp_path):
    (tmp_path / "freq").write_text("a0 0.5\n  c1   0.25\n\nc6 0\n")
    freq = tables.frequencies(spark, str(tmp_path / "freq"))
    assert tuple(analysis.hot_counts(freq, 0.1).first()) == (2, 1)
    states, _ = to_frames(spark, MIXED)
    hot = analysis.with_hot_degree(states, freq)
    assert analysis.hot_boundaries(hot, 0.1).first().boundary == 1
    chosen = analysis.assign_hot(analysis.graph_labels(spark, [MIXED]), 4, 2)
    assert chosen.where("hot_degree > 0").count() == 4
    groups = analysis.compatible_group_table(spark, [MIXED])
    assert analysis.compatible_group_summary(groups, hot, 0.1).where("temperature = 'hot'").count() >= 1
    assert analysis.neighbours(to_frames(spark, MIXED)[1], states.where("str_id = 'c1'").select("nfa_id", "state_id")).count() == 5
    assert analysis.find_states(states, original_id="c1").count() == 1


def test_sql(spark):
    sql.register(spark, {"k": keywords("k", ["ab", "b"])})
    rows = spark.sql("SELECT m.* FROM VALUES (X'616261'), (NULL) AS t(p), LATERAL nfa_match(p, 'k') AS m").collect()
    assert [(r.offset, r.state_id) for r in rows] == [(1, 1), (1, 2)]
    assert [r.n for r in spark.sql("SELECT nfa_count(p, 'k') AS n FROM VALUES (X'616261'), (X'') AS t(p)").collect()] == [2, 0]
    assert spark.sql("SELECT hex(parse_symbol_set('[a]')) AS h").first().h.count("0") == 63


def test_chunks_equal_whole():
    a = oracle.random_automaton(7)
    plan, data = planner.plan([a], strategy="arrow"), b"abcabbcabacbabc" * 3
    enabled, base, found = None, 0, set()
    for cut in (data[:7], data[7:7], data[7:20], data[20:]):
        enabled, hits = advance(plan, enabled, cut)
        found |= {(base + p, g.compiled.names[s][0]) for g, hs in zip(plan, hits) for p, s in hs}
        base += len(cut)
    assert found == oracle.reports(a, data)


def test_streaming(spark, tmp_path):
    a, whole = keywords("k", ["abc"]), {"x": b"zzabcabc", "y": b"ababc"}
    rows = [(k, i, bytearray(v[i : i + 2])) for k, v in whole.items() for i in range(0, len(v), 2)]
    source = tmp_path / "in"
    schema = "stream_id string, seq int, payload binary"
    for part in (rows[:3], rows[3:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(source))
    live = spark.readStream.schema(schema).option("maxFilesPerTrigger", 100).parquet(str(source))
    query = match_stream(live, a).writeStream.format("memory").queryName("found").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    got = {(r.stream_id, r.offset, r.state_id) for r in spark.table("found").collect()}
    assert got == {(k, *x) for k, v in whole.items() for x in oracle.reports(a, v)}


def test_bench(spark):
    runs = bench.grid({"x": [1, 2], "y": ["a"]}, ["p", "q", "r"], only={"p", "q"}, exclude={"q"})
    assert runs == [{"app": "p", "x": 1, "y": "a"}, {"app": "p", "x": 2, "y": "a"}]

    def action(e):
        if e["x"] == 2:
            raise TimeoutError
        return 10.0

    stats = bench.statistics(bench.run(spark, runs, action, times=3))
    assert {r.config: (r.n, r.mean) for r in stats.collect()} == {"x=1,y=a": (3, 10.0), "x=2,y=a": (0, -2.0)}
    wide = bench.table(stats, {"p": "P"}, {"x=1,y=a": "one", "x=2,y=a": "two"}).first()
    assert (wide.app, wide.one, wide.two) == ("P", "10.0", "T")
    ratios = bench.normalised(stats, "x=1,y=a")
    assert {r.config: r.geomean for r in bench.geometric_means(ratios).collect()} == {"x=1,y=a": pytest.approx(1.0), "x=2,y=a": None}
    assert bench.best_variant(stats, {"best": ["x=1,y=a", "x=2,y=a"]}).first().mean == 10.0
    logs = spark.createDataFrame([("a", 0, "x"), ("a", 1, "throughput = 3.5"), ("b", 0, "TIMEOUT"), ("c", 0, "x"), ("d", 0, "throughput = ?")], "path string, pos int, value string")
    assert {r.path: r.value for r in bench.read_log(logs, "throughput").collect()} == {"a": 3.5, "b": -2.0, "c": -1.0, "d": -3.0}
    best, all_runs = bench.tune(spark, lambda n: spark.range(n), 1000, lambda df: df.count() > 5, n=[1, 10])
    assert best == {"n": 10} and all_runs.count() == 2
    assert bench.parse_flags("--a=1 --b --c 2") == {"a": "1", "b": "true", "c": "2"}


def test_configs_and_results(spark, tmp_path):
    (tmp_path / "a").write_text("{'apps': [{'name': 'x'}], 'n': 1}")
    (tmp_path / "b").write_text('{"n": true}')
    assert tables.config(spark, str(tmp_path / "a"))["apps"][0]["name"] == "x" and tables.config(spark, str(tmp_path / "b"))["n"] is True
    (tmp_path / "c").write_text("__import__('os').getcwd()")
    with pytest.raises(ValueError):
        tables.config(spark, str(tmp_path / "c"))
    (tmp_path / "r1.csv").write_text("config,A,B\nx,1.5,-1\n")
    (tmp_path / "r2.csv").write_text("config,B,C\ny,2,\n")
    merged = tables.merge_results([tables.results(spark, str(tmp_path / f"r{k}.csv")) for k in (1, 2)])
    assert {r.app: (r.x, r.y) for r in merged.collect()} == {"A": (1.5, None), "B": (-1.0, 2.0)}


def test_cli(spark, tmp_path, capsys):
    (tmp_path / "a.anml").write_text(PAIR)
    (tmp_path / "in").write_bytes(b"x1 x2 z1 ay1")
    args = ["-a", str(tmp_path / "a.anml"), "-i", str(tmp_path / "in")]
    assert cli.main([*args, "--quick-validation", "2", "--validation", "--report-filename", str(tmp_path / "out"), "--motivate-worklist-length"]) == 0
    assert "results = 2" in capsys.readouterr().out and spark.read.parquet(str(tmp_path / "out")).count() == 2
    assert cli.main([*args, "--quick-validation", "3"]) == 1
    assert cli.main([*args, "--duplicate-input-stream", "2", "--precompute-depth", "1", "--quick-validation", "4"]) == 0


def test_cli_hot_and_packing(spark, tmp_path, capsys):
    """Options that change how a match runs, and never what it reports."""
    (tmp_path / "a.anml").write_text(PAIR)
    (tmp_path / "in").write_bytes(b"x1 x2 z1 ay1")
    ids = [s.str_id for s in anml.parse(PAIR.encode()).states]
    (tmp_path / "freq").write_text("".join(f"{name} {0.5 / (k + 1)}\n" for k, name in enumerate(ids)))
    args = ["-a", str(tmp_path / "a.anml"), "-i", str(tmp_path / "in"), "--quick-validation", "2", "--validation"]
    for more in (
        ["--hot-limit-by-bfs", "1"], ["--hot-limit-by-bfs-ratio", "0.5"], ["--hot-cold-filter", str(tmp_path / "freq"), "--cold-threshold", "0.3"],
        ["--packing", "1"], ["--packing", "3", "--packing-file", str(tmp_path / "freq")],
    ):
        assert cli.main([*args, *more]) == 0, more
    with pytest.raises(ValueError):
        cli.main([*args, "--packing", "2"])
    assert cli.main([*args, "--tuning"]) == 0 and "strategy" in capsys.readouterr().out


def test_random_source(spark, tmp_path):
    a = keywords("k", [b"\x00"])
    data = streams.random_stream(spark, 5000, seed=3)
    assert match(a, None, data).count() == bytes(data.first().payload).count(0)


def test_sorted_in_bounded_parts(spark):
    """what a task sorts follows from the bytes of its part, not from the file that they are in."""
    from automill import queries_surface
    from conftest import SF

    assert "REPARTITION_BY_NUM" in queries_surface.sorted_reports(spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_compared_in_bounded_parts(spark):
    """as above, for both sides of a comparison, in either direction."""
    from automill import queries
    from conftest import SF

    assert queries.report_exceptall_validate(spark, SF)._jdf.queryExecution().executedPlan().toString().count("REPARTITION_BY_NUM") >= 2
