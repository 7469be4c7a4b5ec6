"""The engine's queries over the test tables, and the SQL that says the same.

Automata are built here; streams are columns of the tables as UTF-8, so offsets count bytes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from automill.functions import words
from automill.model import build, keywords
from automill.operators import match as matching, reports
from automill.sources import streams

# Automata.

KEYWORDS = ("the", "and", "tion", "ch", "é")
DOCS = keywords("docs", KEYWORDS)
EVENTS = keywords("events", ("click", "view", "purchase", "i"))
DIGITS = build(
    "digits",
    [{"id": "d1", "symbols": "[0-9]", "start": "all-input"}, {"id": "d2", "symbols": "\\d", "code": "two"}],
    [("d1", "d2")],
)
PART = keywords("part", ("Brand#1",), start="start-of-data")
#: c, then anything, then k: a wildcard with a self loop keeps a match alive to the end.
GAP = build(
    "gap",
    [{"id": "a", "symbols": "[c]", "start": "all-input"}, {"id": "x", "symbols": "*"}, {"id": "b", "symbols": "[k]", "code": "gap"}],
    [("a", "x"), ("x", "x"), ("x", "b"), ("a", "b")],
)
#: any byte but a newline between two vowels
DOT = build(
    "dot",
    [{"id": "v1", "symbols": "[AEIOU]", "start": "all-input"}, {"id": "any", "symbols": "."}, {"id": "v2", "symbols": "[AEIOU]", "code": "vv"}],
    [("v1", "any"), ("any", "v2")],
)


def _streams(spark: SparkSession, sf_dir: str, table: str, key: str, column: str) -> DataFrame:
    return streams.from_column(spark.read.parquet(f"{sf_dir}/{table}.parquet"), key, column)


def _short(df: DataFrame) -> DataFrame:
    return df.select("stream_id", "offset", "original_id", "report_code")


# Matching.


def match_keyword_documents(spark, sf_dir):
    return _short(matching.match(DOCS, None, _streams(spark, sf_dir, "documents", "doc_id", "text")))


def match_multi_keyword_events(spark, sf_dir):
    return _short(matching.match(EVENTS, None, _streams(spark, sf_dir, "events", "event_id", "event_type")))


def match_class_digits_props(spark, sf_dir):
    return _short(matching.match(DIGITS, None, _streams(spark, sf_dir, "events", "event_id", "props")))


def match_start_of_data_part(spark, sf_dir):
    return _short(matching.match(PART, None, _streams(spark, sf_dir, "part", "p_partkey", "p_brand")))


def match_gap_selfloop_events(spark, sf_dir):
    return _short(matching.match(GAP, None, _streams(spark, sf_dir, "events", "event_id", "event_type")))


def match_wildcard_dot(spark, sf_dir):
    return _short(matching.match(DOT, None, _streams(spark, sf_dir, "nation", "n_nationkey", "n_name")))


def match_count_only(spark, sf_dir):
    return matching.match(DOCS, None, _streams(spark, sf_dir, "documents", "doc_id", "text"), mode="count")


def match_report_codes(spark, sf_dir):
    found = matching.match(DOCS, None, _streams(spark, sf_dir, "documents", "doc_id", "text"))
    return found.groupBy("report_code").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("stream_id").alias("streams"))


SEGMENT = 16


def match_segment_reset(spark, sf_dir):
    data = _streams(spark, sf_dir, "customer", "c_custkey", "c_name")
    return _short(matching.match(DIGITS, None, data, segment_bytes=SEGMENT // 4, tail="keep"))


def match_segment_exact(spark, sf_dir):
    data = _streams(spark, sf_dir, "customer", "c_custkey", "c_name")
    return _short(matching.match(DIGITS, None, data, segment_bytes=SEGMENT // 4, tail="keep", seam="exact"))


def match_tail_dropped(spark, sf_dir):
    data = _streams(spark, sf_dir, "events", "event_id", "props")
    return _short(matching.match(DIGITS, None, data, segment_bytes=4))


def match_duplicated(spark, sf_dir):
    data = _streams(spark, sf_dir, "part", "p_partkey", "p_brand")
    return _short(matching.match(PART, None, data, replicas=3))


def _memo(k: int) -> Callable:
    def query(spark, sf_dir):
        return _short(matching.match(DIGITS, None, _streams(spark, sf_dir, "customer", "c_custkey", "c_name"), memo_k=k))

    return query


def match_relational_dag(spark, sf_dir):
    return _short(matching.match(DIGITS, None, _streams(spark, sf_dir, "customer", "c_custkey", "c_name"), strategy="relational"))


def match_ranges(spark, sf_dir):
    return _short(matching.match(DIGITS, None, _streams(spark, sf_dir, "customer", "c_custkey", "c_name"), strategy="ranges"))


def match_two_hops(spark, sf_dir):
    """Five bytes of a match in two rounds of two moves."""
    data = _streams(spark, sf_dir, "events", "event_id", "event_type")
    return _short(matching.match(keywords("click", ("click",)), None, data, strategy="relational"))


def match_cyclic_by_joins(spark, sf_dir):
    """Joins are asked for, but the automaton has a cycle, and its group goes to the kernel."""
    return _short(matching.match(GAP, None, _streams(spark, sf_dir, "events", "event_id", "event_type"), strategy="relational"))


def match_hot_cold(spark, sf_dir):
    """The first states of every keyword are hot, by the layers behind the starts."""
    data = _streams(spark, sf_dir, "events", "event_id", "event_type")
    return _short(matching.match(EVENTS, None, data, strategy="hybrid"))


def match_hot_starts(spark, sf_dir):
    """The starts alone are hot, whatever is said of the others."""
    data = _streams(spark, sf_dir, "events", "event_id", "event_type")
    return _short(matching.match(EVENTS, None, data, strategy="hybrid", hot=set()))


def match_arrow(spark, sf_dir):
    return _short(matching.match(GAP, None, _streams(spark, sf_dir, "events", "event_id", "event_type"), strategy="arrow"))


def match_grouped(spark, sf_dir):
    found = matching.match(DOCS, None, _streams(spark, sf_dir, "documents", "doc_id", "text"), groups=2)
    return found.groupBy("group_id", "cc_id").agg(F.count(F.lit(1)).alias("n"))


def match_one_component(spark, sf_dir):
    return _short(matching.match(DOCS, None, _streams(spark, sf_dir, "documents", "doc_id", "text"), cc_with_state="k2_0"))


def match_slice(spark, sf_dir):
    data = _streams(spark, sf_dir, "customer", "c_custkey", "c_name")
    return _short(matching.match(DIGITS, None, data, start=9, length=5))


def match_padded(spark, sf_dir):
    tail = build("tail", [{"id": "d", "symbols": "[0-9]", "start": "all-input"}, {"id": "z", "symbols": "[\\x00-\\xff]", "code": "after"}], [("d", "z")])
    return _short(matching.match(tail, None, _streams(spark, sf_dir, "customer", "c_custkey", "c_name"), pad_to=64))


def match_conversation_turns(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    data = rows.select(F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("role"))
    return _short(matching.match(keywords("roles", ("assistant", "user", "s")), None, streams.from_column(data, "id", "role")))


def match_page_tags(spark, sf_dir):
    found = matching.match(keywords("tags", ("<p>", "<li>", "</a>", "&amp;")), None, _streams(spark, sf_dir, "pages", "page_id", "html"))
    return found.groupBy("report_code").agg(F.count(F.lit(1)).alias("n"))


def reports_by_quality(spark, sf_dir):
    found = matching.match(DOCS, None, _streams(spark, sf_dir, "documents", "doc_id", "text"), mode="streams")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").cast("string").alias("stream_id"), "quality")
    return found.join(labels, "stream_id").groupBy("quality").agg(F.sum("n").alias("n"))


def nfa_match_sql(spark, sf_dir):
    from automill import sql

    sql.register(spark, {"dot": DOT})
    spark.read.parquet(f"{sf_dir}/nation.parquet").createOrReplaceTempView("automill_nation")
    return spark.sql(
        "SELECT n_nationkey, m.offset AS pos, m.original_id FROM automill_nation, LATERAL nfa_match(encode(n_name, 'UTF-8'), 'dot') AS m"
    )


# Streams.


def stream_alphabet(spark, sf_dir):
    found = streams.alphabet(_streams(spark, sf_dir, "part", "p_partkey", "p_name"))
    return found.select("stream_id", F.array_join(F.transform("alphabet", lambda x: x.cast("string")), ",").alias("bytes"))


def stream_slice(spark, sf_dir):
    cut = streams.slice_streams(_streams(spark, sf_dir, "customer", "c_custkey", "c_name"), 4, 100)
    return cut.select("stream_id", F.hex("payload").alias("data"))


def stream_chunk(spark, sf_dir):
    cut = streams.segments(_streams(spark, sf_dir, "customer", "c_custkey", "c_name"), 7)
    return cut.select("stream_id", "seg_id", "base", F.hex("payload").alias("data"))


def stream_chunk_replicated(spark, sf_dir):
    cut = streams.segments(_streams(spark, sf_dir, "nation", "n_nationkey", "n_name"), 5, replicas=3, tail="keep")
    return cut.select("stream_id", "seg_id", "base", F.hex("payload").alias("data"))


def stream_pad(spark, sf_dir):
    out = streams.pad(_streams(spark, sf_dir, "nation", "n_nationkey", "n_name"), 16)
    return out.select("stream_id", "length", F.hex("payload").alias("data"))


def stream_kgrams(spark, sf_dir):
    rows = _streams(spark, sf_dir, "nation", "n_nationkey", "n_name")
    rows = rows.withColumn("pos", F.explode(F.sequence(F.lit(0), F.octet_length("payload") - 1)))
    return rows.select("stream_id", "pos", words.gram(F.col("payload"), F.col("pos"), 3).alias("gram")).where("gram is not null")


def stream_point_edit(spark, sf_dir):
    rows = _streams(spark, sf_dir, "region", "r_regionkey", "r_name")
    edited = streams.append(streams.set_byte(F.col("payload"), 1, 0x2A), b"!")
    return rows.select("stream_id", streams.get_byte(F.col("payload"), 0).alias("first"), F.hex(edited).alias("data"), F.octet_length(edited).alias("n"))


# Profiles and reports.


def state_activation_profile(spark, sf_dir):
    return matching.state_profile(DIGITS, None, _streams(spark, sf_dir, "customer", "c_custkey", "c_name"))


def frontier_profile(spark, sf_dir):
    return matching.frontier_profile(GAP, None, _streams(spark, sf_dir, "events", "event_id", "event_type"))


def report_exceptall_validate(spark, sf_dir):
    data = streams.dealt(_streams(spark, sf_dir, "customer", "c_custkey", "c_name"))
    a, b = matching.match(DIGITS, None, data), matching.match(DIGITS, None, data, segment_bytes=4, tail="keep")
    return reports.differences(a, b).select("stream_id", F.col("offset"), "side")


def report_counts(spark, sf_dir):
    return reports.count(matching.match(DOCS, None, _streams(spark, sf_dir, "documents", "doc_id", "text")))


def report_packed(spark, sf_dir):
    return reports.packed(matching.match(DIGITS, None, _streams(spark, sf_dir, "customer", "c_custkey", "c_name")))


def report_top_order(spark, sf_dir):
    found = matching.match(DIGITS, None, _streams(spark, sf_dir, "customer", "c_custkey", "c_name"))
    return reports.ordered(found).select("stream_id", "offset", "state_id").limit(40)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        match_keyword_documents, match_multi_keyword_events, match_class_digits_props, match_start_of_data_part, match_gap_selfloop_events,
        match_wildcard_dot, match_count_only, match_report_codes, match_segment_reset, match_segment_exact, match_tail_dropped,
        match_duplicated, match_relational_dag, match_ranges, match_two_hops, match_cyclic_by_joins, match_hot_cold, match_hot_starts, match_arrow, match_grouped, match_one_component, match_slice, match_padded,
        match_conversation_turns, match_page_tags, reports_by_quality, nfa_match_sql, stream_alphabet, stream_slice, stream_chunk,
        stream_chunk_replicated, stream_pad, stream_kgrams, stream_point_edit, state_activation_profile, frontier_profile,
        report_exceptall_validate, report_counts, report_packed, report_top_order,
    )
} | {f"match_memo_k{k}": _memo(k) for k in (1, 2, 3)}
