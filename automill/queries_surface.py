"""Queries of what stands around matching: transforms by what they report, sinks, and streams that arrive."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from automill.model import Automaton, build
from automill.operators import fingerprints, match as matching, reports, sinks, transforms
from automill.operators.scratch import folder
from automill.queries import DIGITS, GAP, _streams
from automill.sources import streams
from automill.streaming import carry

#: A letter and one of many successors: single letters, and a set of two ranges.
FAN = build(
    "fan",
    [{"id": "a", "symbols": "[a-z]", "start": "all-input"}, *({"id": f"x{c}", "symbols": f"[{c}]", "code": "one"} for c in "iceup"), {"id": "y", "symbols": "[n-or-t]", "code": "set"}],
    [("a", x) for x in ("xi", "xc", "xe", "xu", "xp", "y")],
)


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


# Transforms, by what the automata report on a table.


def _reported(automaton: Automaton, name: str, data: DataFrame) -> DataFrame:
    found = reports.unique(matching.match(automaton, None, data), by_original=True)
    return found.select(F.lit(name).alias("transform"), "stream_id", "offset", "original_id")


def transforms_keep_reports(spark, sf_dir):
    """Transforms that change the automaton, but nothing that it reports."""
    data = _streams(spark, sf_dir, "events", "event_id", "event_type")
    ways: dict[str, Automaton] = {
        "clone starts": transforms.clone_starts(FAN),
        "limit out-degree": transforms.limit_out_degree(FAN, 2),
        "reorder": transforms.reorder(FAN, lambda s: -s),
        "split and merge": transforms.merge_automata(transforms.split_components(FAN), "fan"),
        "split sets": transforms.split_to_complete(FAN),
    }
    return _union([_reported(a, name, data) for name, a in ways.items()])


def transforms_move_reports(spark, sf_dir):
    """Starts moved a state ahead: a match takes one byte more."""
    data = _streams(spark, sf_dir, "events", "event_id", "event_type")
    ways = {"move starts": transforms.move_starts(FAN), "one start": transforms.one_start_each(FAN)}
    return _union([_reported(a, name, data) for name, a in ways.items()])


def transforms_cut_loops(spark, sf_dir):
    """Without its self loop the gap between the two letters is none or one byte."""
    data = _streams(spark, sf_dir, "events", "event_id", "event_type")
    return _reported(transforms.without_self_loops(GAP), "no loops", data)


# Sinks; each reads what it has written.


def written_reports(spark, sf_dir):
    found = matching.match(DIGITS, None, _streams(spark, sf_dir, "customer", "c_custkey", "c_name"))
    path = f"{folder(spark)}/reports-{uuid4().hex}"
    sinks.write_reports(found, path)
    return spark.read.parquet(path).select("stream_id", "offset", "original_id", "report_code")


def written_frontier(spark, sf_dir):
    path = f"{folder(spark)}/frontier-{uuid4().hex}"
    sinks.write_frontier(matching.frontier_profile(GAP, None, _streams(spark, sf_dir, "events", "event_id", "event_type")), path)
    kinds = "nfa_id string, group_id int, size int, positions long"
    return spark.read.option("header", True).schema(kinds).csv(path)


def sorted_reports(spark, sf_dir):
    """Ordered in parts: how many reports stand before one that is less, in the same part."""
    found = reports.sorted_parts(matching.match(DIGITS, None, streams.dealt(_streams(spark, sf_dir, "customer", "c_custkey", "c_name"))))

    def run(batches):
        import pandas as pd

        last, wrong, n = None, 0, 0
        for b in batches:
            for row in zip(b["stream_id"], b["nfa_id"], b["offset"], b["state_id"]):
                wrong, n, last = wrong + (last is not None and row < last), n + 1, row
        yield pd.DataFrame([(wrong, n)], columns=["wrong", "n"])

    return found.mapInPandas(run, "wrong long, n long").agg(F.sum("wrong").alias("wrong"), F.sum("n").alias("n"))


def report_first_differences(spark, sf_dir):
    """The first forty reports that cutting the names loses, found by fingerprints of ranges."""
    data = streams.dealt(_streams(spark, sf_dir, "customer", "c_custkey", "c_name"))
    a, b = (matching.match(DIGITS, None, data, **how).select("stream_id", "offset", "original_id") for how in ({}, {"segment_bytes": 4, "tail": "keep"}))
    return fingerprints.first_differences(a, b, ["stream_id", "offset"])


def report_equal_sets(spark, sf_dir):
    """Whether two ways of matching report the same."""
    data = _streams(spark, sf_dir, "events", "event_id", "props")
    a, b = (matching.match(DIGITS, None, data, strategy=how).select("stream_id", "offset", "original_id", "report_code") for how in ("auto", "fold"))
    same = fingerprints.equal(a, b, ["stream_id", "offset"])
    return a.agg(F.count(F.lit(1)).alias("n"), F.lit(same).alias("equal"))


# Streams that arrive.


def match_carried(spark, sf_dir):
    """Every name as chunks of three bytes that arrive as a stream; what is pending is carried from one to the next."""
    base = f"{folder(spark)}/carried-{uuid4().hex}"
    cut = streams.segments(_streams(spark, sf_dir, "nation", "n_nationkey", "n_name"), 3, tail="keep")
    cut.select("stream_id", F.col("seg_id").alias("seq"), "payload").write.parquet(f"{base}/in")
    chunks = spark.readStream.schema("stream_id string, seq int, payload binary").parquet(f"{base}/in")
    vowels = build("vowels", [{"id": "v", "symbols": "[AEIOU]", "start": "all-input"}, {"id": "w", "symbols": "[^AEIOU]"}, {"id": "x", "symbols": "[AEIOU]", "report": True}], [("v", "w"), ("w", "x")])
    out = carry.match_stream(chunks, vowels).writeStream.format("parquet").option("checkpointLocation", f"{base}/state")
    out.trigger(availableNow=True).start(f"{base}/out").awaitTermination()
    return spark.read.parquet(f"{base}/out").select("stream_id", "offset", "original_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        transforms_keep_reports, transforms_move_reports, transforms_cut_loops, written_reports, written_frontier, sorted_reports, report_first_differences, report_equal_sets, match_carried,
    )
}
