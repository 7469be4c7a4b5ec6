"""Command line: ``python -m automill.cli -a rules.anml -i input.bin [options]``."""

from __future__ import annotations

import argparse
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from automill import bench
from automill.operators import analysis, reports, sinks, transforms
from automill.operators.match import frontier_profile, match
from automill.model import Automaton, from_frames
from automill.sources import anml, streams, tables


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="automill", description=__doc__)
    add = p.add_argument
    add("-a", "--automata", required=True, help="ANML file or folder")
    add("-i", "--input", required=True, help="file of bytes, or a path that ends in 'random'")
    add("-g", "--algorithm", default="auto", help="strategy: auto, table, arrow, hybrid, relational, ranges, memo")
    add("--input-start-pos", type=int, default=-1)
    add("--input-len", type=int, default=-1)
    add("--duplicate-input-stream", type=int, default=1)
    add("--split-entire-inputstream-to-chunk-size", type=int, default=-1)
    add("--padding", type=int, default=0)
    add("--max-nfa-size", type=int, default=-1)
    add("--only-exec-ccid", type=int, default=-1)
    add("--only-exec-cc-with-state-id", default=None)
    add("--report-off", action="store_true", help="count only")
    add("--report-filename", default=None, help="folder to write reports to")
    add("--quick-validation", type=int, default=-1, help="expected number of distinct reports")
    add("--validation", action="store_true", help="compare with the 'arrow' strategy")
    add("--group-num", type=int, default=None)
    add("--precompute-depth", type=int, default=0)
    add("--merge-cc", type=int, default=1)
    add("--tuning", action="store_true", help="try strategies and group numbers first, and run the fastest that gives the same number of reports")
    add("--packing", type=int, default=0, choices=(0, 1, 2, 3), help="order of components: as they are, random, by activation ratio, by ratio a state")
    add("--packing-file", default=None, help="pairs 'state frequency' for --packing 2 and 3")
    add("--hot-limit-by-bfs", type=int, default=-1, help="so many states nearest the starts are hot")
    add("--hot-limit-by-bfs-ratio", type=float, default=0.0, help="the same, as a share of all states")
    add("--hot-cold-filter", default=None, help="pairs 'state frequency'; states above --cold-threshold are hot")
    add("--cold-threshold", type=float, default=0.001)
    add("--motivate-worklist-length", action="store_true", help="show the frontier's profile")
    add("--app-name", default=None)
    add("--seam", default="reset", choices=("reset", "exact"))
    add("--tail", default="drop", choices=("drop", "keep"))
    add("--start-scope", default="auto", choices=("auto", "first", "every_segment"))
    add("--seed", type=int, default=0)
    return p


def packed(spark: SparkSession, a: Automaton, policy: int, path: str | None, seed: int) -> Automaton:
    """The automaton with its components in the order of a packing policy; frequencies are summed up by component."""
    parts = transforms.split_components(a)
    rows = [(a.nfa_id, c, len(part)) for c, part in enumerate(parts)]
    sizes = spark.createDataFrame(rows, "nfa_id string, cc_id int, n int")
    freq = None
    if policy in (2, 3):
        if not path:
            raise ValueError("packing by frequency needs a packing file")
        names = spark.createDataFrame([(s.str_id, c) for c, part in enumerate(parts) for s in part.states], "id string, cc_id int")
        freq = tables.frequencies(spark, path).join(names, "id").groupBy(F.lit(a.nfa_id).alias("nfa_id"), "cc_id").agg(F.sum("freq").alias("ratio"))
    order = transforms.pack_components(sizes, policy, freq, seed).orderBy("place").collect()
    return transforms.merge_automata([parts[r.cc_id] for r in order], a.nfa_id)


def hot_states(spark: SparkSession, automata: list[Automaton], o: argparse.Namespace) -> set[str] | None:
    """The ids of the states that the options call hot; None if they say nothing."""
    ids = [(a.nfa_id, i, s.str_id) for a in automata for i, s in enumerate(a.states)]
    names = spark.createDataFrame(ids, "nfa_id string, state_id int, id string")
    if o.hot_cold_filter:
        found = tables.frequencies(spark, o.hot_cold_filter).where(F.col("freq") > o.cold_threshold).join(names, "id", "left_semi")
    elif o.hot_limit_by_bfs >= 0 or o.hot_limit_by_bfs_ratio > 0:
        limit = o.hot_limit_by_bfs if o.hot_limit_by_bfs >= 0 else int(o.hot_limit_by_bfs_ratio * len(ids))
        labels = analysis.assign_hot(analysis.graph_labels(spark, automata), limit, len(ids))
        found = labels.where("hot_degree > 0").join(names, ["nfa_id", "state_id"])
    else:
        return None
    return {r.id for r in found.select("id").distinct().collect()}


def tuned(spark: SparkSession, automata: list[Automaton], data, n_bytes: int, options: dict) -> dict:
    """The fastest of some strategies and group numbers; what they report must be as many as 'arrow' does."""
    want = match(automata, None, data, strategy="arrow", **(options | {"memo_k": 0, "mode": "count"})).first()[0]
    make = lambda strategy, groups: match(automata, None, data, strategy=strategy, **(options | {"groups": groups}))
    best, tried = bench.tune(spark, make, n_bytes, lambda df: df.count() == want, strategy=["auto", "arrow", "hybrid"], groups=[None, 2, 8])
    tried.show(truncate=False)
    return best


def main(args: list[str] | None = None) -> int:
    o = parser().parse_args(args)
    spark = SparkSession.builder.appName(o.app_name or "automill").getOrCreate()
    states, edges = anml.load(spark, o.automata)
    data = streams.random_stream(spark, seed=o.seed) if o.input.endswith("random") else streams.from_files(spark, o.input)
    some = lambda x: None if x == -1 else x
    options = {
        "start": some(o.input_start_pos), "length": some(o.input_len), "replicas": o.duplicate_input_stream,
        "segment_bytes": some(o.split_entire_inputstream_to_chunk_size), "pad_to": o.padding or None, "max_cc_states": some(o.max_nfa_size),
        "cc_id": some(o.only_exec_ccid), "cc_with_state": o.only_exec_cc_with_state_id, "groups": o.group_num, "memo_k": o.precompute_depth,
        "merge_cc": o.merge_cc, "seam": o.seam, "tail": o.tail, "start_scope": o.start_scope,
    }
    automata = from_frames(states, edges)
    if o.packing:
        automata = [packed(spark, a, o.packing, o.packing_file, o.seed) for a in automata]
    options["hot"] = hot_states(spark, automata, o)
    strategy = "hybrid" if options["hot"] is not None and o.algorithm == "auto" else o.algorithm
    analysis.summary(states, analysis.graph_labels(spark, automata)).show(truncate=False)
    n_bytes = data.agg(F.sum(F.octet_length("payload"))).first()[0] * o.duplicate_input_stream
    if o.tuning:
        best = tuned(spark, automata, data, n_bytes, options)
        strategy, options["groups"] = best.get("strategy", strategy), best.get("groups", o.group_num)
    began = time.perf_counter()
    found = match(automata, None, data, strategy=strategy, **options).persist()
    n = found.count()
    print(f"results = {n}\nthroughput = {n_bytes / (time.perf_counter() - began) / 1e6:.3f} MB/s")
    good = True
    if o.quick_validation >= 0:
        good = reports.quick_validate(found, o.quick_validation)
    if o.validation:
        good, different = reports.validate(found, match(automata, None, data, strategy="arrow", **(options | {"memo_k": 0})))
        for row in different:
            print(row)
    if o.motivate_worklist_length:
        frontier_profile(automata[0], None, data).orderBy("group_id", "size").show(200)
    if o.report_filename and not o.report_off:
        sinks.write_reports(found, o.report_filename)
    print("validation = " + ("ok" if good else "FAILED"))
    return 0 if good else 1


if __name__ == "__main__":
    raise SystemExit(main())
