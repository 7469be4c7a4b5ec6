"""Queries over automata that are built from columns of the test tables, and over files that are written from them."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import reduce
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from automill import bench
from automill.functions import symbolset
from automill.model import from_frames, keywords, to_frames
from automill.operators import analysis, graph, graph_tables, match as matching, sinks, transforms
from automill.operators.scratch import folder, keep, still_there
from automill.plans import planner
from automill.sources import anml, dictionary, skipping, streams, tables

KEY = ["nfa_id", "state_id"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _path(spark: SparkSession, name: str) -> str:
    return f"{folder(spark)}/{name}-{uuid4().hex}"


# The automata. Their tables are made once for a session and folder of tables.

_made: dict[tuple, tuple[DataFrame, ...]] = {}


def _once(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], tuple[DataFrame, ...]]) -> tuple[DataFrame, ...]:
    key = spark.sparkContext.applicationId, sf_dir, name
    if key not in _made or not all(map(still_there, _made[key])):
        _made[key] = tuple(keep(x) for x in make())
    return _made[key]


def _part_patterns(spark, sf_dir, names: str = "names", types: str = "names") -> DataFrame:
    """Names of parts, found anywhere, and their types, at the beginning and again and again."""
    part = _table(spark, sf_dir, "part")
    one = part.select(F.lit(names).alias("nfa_id"), F.col("p_name").alias("pattern"), F.lit("all-input").alias("start"), F.lit(False).alias("repeat"))
    two = part.select(F.lit(types).alias("nfa_id"), F.col("p_type").alias("pattern"), F.lit("start-of-data").alias("start"), F.lit(True).alias("repeat"))
    return one.unionByName(two).distinct()


def _names(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """One automaton of both: letters in either case, and a blank stands for anything."""
    return _once(spark, sf_dir, "names", lambda: dictionary.tries(_part_patterns(spark, sf_dir), keep, gap=b" ", fold_case=True))


def _three(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Names, types and brands, an automaton each."""
    brands = _table(spark, sf_dir, "part").select(F.lit("brands").alias("nfa_id"), F.col("p_brand").alias("pattern"), F.lit("all-input").alias("start"), F.lit(False).alias("repeat"))
    rows = _part_patterns(spark, sf_dir, types="types").unionByName(brands.distinct())
    return _once(spark, sf_dir, "three", lambda: dictionary.tries(rows, keep, gap=b" ", fold_case=True))


def _words(rows: DataFrame, nfa_id, text: str) -> DataFrame:
    return rows.select(nfa_id.alias("nfa_id"), F.explode(F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0))).alias("pattern")).distinct()


def _components(spark, sf_dir) -> DataFrame:
    return _once(spark, sf_dir, "components", lambda: (transforms.with_components(transforms.component_table(*_names(spark, sf_dir), keep)),))[0]


def _labels(spark, sf_dir) -> DataFrame:
    return _once(spark, sf_dir, "labels", lambda: (graph_tables.graph_labels(*_names(spark, sf_dir), keep),))[0]


def _item_words(spark, sf_dir) -> DataFrame:
    return _words(_table(spark, sf_dir, "benchmark"), F.col("item_id").cast("string"), "text")


def dictionary_states(spark, sf_dir):
    """The trie of all words of all documents."""
    states, _ = dictionary.tries(_words(_table(spark, sf_dir, "documents"), F.lit("words"), "text"), keep)
    return states.select("state_id", "str_id", F.hex("symbol_set").alias("bits"), F.col("start_kind").cast("int").alias("start_kind"), "is_report", "report_code")


def dictionary_edges(spark, sf_dir):
    """A trie for each item of the benchmark."""
    return dictionary.tries(_item_words(spark, sf_dir), keep)[1]


def dictionary_failures(spark, sf_dir):
    rows = _item_words(spark, sf_dir)
    return dictionary.failure_links(rows, dictionary.tries(rows, keep)[0])


def match_dictionary(spark, sf_dir):
    """The benchmark's words of eight letters or more in what is said in conversations."""
    words = _words(_table(spark, sf_dir, "benchmark"), F.lit("words"), "text").where(F.length("pattern") >= 8)
    rows = _table(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("id"), F.lower("text").alias("text"))
    found = matching.match(*dictionary.tries(words, keep), streams.from_column(rows, "id", "text"))
    return found.groupBy("report_code").agg(F.count(F.lit(1)).alias("n"))


def match_indexed(spark, sf_dir):
    """Rare keywords in documents that are stored in blocks with an index of 3-grams."""
    path = _path(spark, "indexed")
    skipping.store(streams.from_column(_table(spark, sf_dir, "documents"), "doc_id", "text"), path, 64)
    return skipping.match(spark, path, [keywords("rare", ("Apache License", "Released under"))]).select("stream_id", "offset", "report_code")


def match_folded(spark, sf_dir):
    """By a fold in the JVM, without Python workers."""
    data = streams.from_column(_table(spark, sf_dir, "events"), "event_id", "event_type")
    words = keywords("events", ("click", "view", "purchase", "i"))
    return matching.match(words, None, data, strategy="fold").select("stream_id", "offset", "original_id", "report_code")


# Statistics.


def nfa_summary(spark, sf_dir):
    states, edges = _names(spark, sf_dir)
    return analysis.summary(states, _components(spark, sf_dir))


def nfa_extended_summary(spark, sf_dir):
    states, edges = _names(spark, sf_dir)
    return analysis.extended_summary(states, edges, _components(spark, sf_dir))


def nfa_degree_hist(spark, sf_dir):
    return analysis.degree_distribution(*_names(spark, sf_dir))


def nfa_in_degree_hist(spark, sf_dir):
    return analysis.in_degree_histogram(*_names(spark, sf_dir))


def nfa_log_degree_hist(spark, sf_dir):
    return analysis.log_degree_histogram(*_names(spark, sf_dir))


def nfa_components(spark, sf_dir):
    return _components(spark, sf_dir)


def nfa_counts(spark, sf_dir):
    return analysis.counts(*_names(spark, sf_dir))


def nfa_layers(spark, sf_dir):
    return _labels(spark, sf_dir)


def nfa_alphabet(spark, sf_dir):
    return analysis.alphabet(_names(spark, sf_dir)[0], "no_wildcard")


def alphabets(spark, sf_dir):
    states = _three(spark, sf_dir)[0]
    return _union([analysis.alphabet(states, kind).select(F.lit(kind).alias("kind"), "nfa_id", "byte") for kind in ("any", "no_wildcard")])


def dag_classes(spark, sf_dir):
    states, edges = _three(spark, sf_dir)
    return graph_tables.dag_classes(keep(graph_tables.strong_components(states, edges, keep)), edges)


def strong_components_orders(spark, sf_dir):
    """A directed graph of customers and suppliers: a customer's returned lines lead back from the supplier, the others lead there."""
    lines = _table(spark, sf_dir, "lineitem").join(_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    buyer, seller = (F.col("o_custkey") * 2).cast("int"), (F.col("l_suppkey") * 2 + 1).cast("int")
    one = lines.where("not l_returnflag <=> 'R'").select(F.lit("orders").alias("nfa_id"), buyer.alias("src"), seller.alias("dst"))
    two = lines.where("l_returnflag = 'R'").select(F.lit("orders").alias("nfa_id"), seller.alias("src"), buyer.alias("dst"))
    edges = keep(one.unionByName(two).distinct())
    states = edges.select("nfa_id", F.col("src").alias("state_id")).union(edges.select("nfa_id", "dst")).distinct()
    return graph_tables.strong_components(states, edges, keep).select("state_id", "scc_root")


def incompatible_pairs(spark, sf_dir):
    return graph_tables.incompatible_pairs(*_names(spark, sf_dir), keep).select("x", "y")


def compatible_groups(spark, sf_dir):
    states, edges = _names(spark, sf_dir)
    pairs = graph_tables.incompatible_pairs(states, edges, keep)
    return analysis.compatible_group_summary(graph_tables.compatible_groups(pairs, _components(spark, sf_dir)), states)


def start_states(spark, sf_dir):
    return analysis.start_states(_names(spark, sf_dir)[0])


def neighbours(spark, sf_dir):
    """Successors and predecessors of a state that is found by its id: an s anywhere."""
    states, edges = _names(spark, sf_dir)
    found = analysis.find_states(states, str_id=hashlib.md5(b"2:s").hexdigest()).select(*KEY)
    return _union([analysis.neighbours(edges, found, out).select(F.lit(out).alias("outgoing"), "neighbour") for out in (True, False)])


def hot_by_layer(spark, sf_dir):
    return analysis.assign_hot(_labels(spark, sf_dir), 5, 2).select("cc_id", "state_id", "hot_degree")


def memo_length_hist(spark, sf_dir):
    groups = [g.compiled for g in planner.plan(from_frames(*_names(spark, sf_dir)), strategy="arrow")]
    return analysis.memo_lengths(analysis.memo_table(spark, groups, 2), 2)


def memo_cutoff(spark, sf_dir):
    groups = [g.compiled for g in planner.plan(from_frames(*_names(spark, sf_dir)), strategy="arrow")]
    return analysis.memo_cutoff(analysis.memo_table(spark, groups, 2))


# Sets of bytes.


def symbolset_ranges(spark, sf_dir):
    bytes_ = symbolset.explode_bytes(_names(spark, sf_dir)[0].select("str_id", "symbol_set"))
    return symbolset.ranges_of(bytes_, "str_id")


def symbolset_cardinality(spark, sf_dir):
    return _names(spark, sf_dir)[0].select("str_id", symbolset.cardinality_column(F.col("symbol_set")).cast("int").alias("n"))


def symbolset_parse(spark, sf_dir):
    """Classes of the letters of every type of event, of all others, and from its last to its first letter."""
    types = _table(spark, sf_dir, "events").select(F.col("event_type").alias("t")).where("t is not null").distinct()
    ends = F.array_sort(F.array(F.substr("t", F.lit(1), F.lit(1)), F.substr("t", F.length("t"))))
    classes = types.select(F.explode(F.array(F.concat(F.lit("["), "t", F.lit("]")), F.concat(F.lit("[^"), "t", F.lit("]")), F.concat(F.lit("["), ends[0], F.lit("-"), ends[1], F.lit("]")))).alias("class"))
    parsed = classes.distinct().select("class", symbolset.parse_symbol_set("class").alias("set"))
    return parsed.select("class", symbolset.cardinality_column(F.col("set")).cast("int").alias("n"), F.hex("set").alias("bits"))


def symbolset_kinds(spark, sf_dir):
    sets = F.col("symbol_set")
    return _names(spark, sf_dir)[0].select("str_id", symbolset.is_wildcard_column(sets).alias("wildcard"), symbolset.is_single_column(sets).alias("single"))


def symbolset_remap(spark, sf_dir):
    """Capitals become small letters."""
    bytes_ = symbolset.explode_bytes(_names(spark, sf_dir)[0].select("str_id", "symbol_set"))
    mapping = spark.range(65, 91).select(F.col("id").cast("int").alias("byte"), (F.col("id") + 32).cast("int").alias("to_byte"))
    return symbolset.remap_bytes(bytes_, mapping)


def symbolset_completeness(spark, sf_dir):
    found = analysis.completeness(_names(spark, sf_dir)[0])
    return found.select("state_id", "n_symbols", "n_ranges", "complete", "complement")


# Transforms.


def _reported(spark, sf_dir, automata, edges=None) -> DataFrame:
    data = streams.from_column(_table(spark, sf_dir, "part"), "p_partkey", "p_name")
    return matching.match(automata, edges, data).select("stream_id", "offset", "report_code").distinct()


def limited_out_degree(spark, sf_dir):
    """What the names report when no state has more than four successors."""
    (a,) = from_frames(*_names(spark, sf_dir))
    return _reported(spark, sf_dir, transforms.limit_out_degree(a, 4))


def split_to_complete(spark, sf_dir):
    (a,) = from_frames(*_names(spark, sf_dir))
    return analysis.completeness_counts(to_frames(spark, transforms.split_to_complete(a))[0])


def renumbered(spark, sf_dir):
    new = transforms.renumber(*_names(spark, sf_dir), *transforms.ORDERS["REPORT"]())
    return new[0].select("state_id", "str_id")


def renumber_policies(spark, sf_dir):
    """The states in the order of each policy."""
    states, edges = _names(spark, sf_dir)
    labels = _labels(spark, sf_dir)
    more = states.join(labels.select(*KEY, "topo_order", "bfs_layer"), KEY).join(analysis.degrees(states, edges).select(*KEY, "out_degree"), KEY)
    more = more.join(analysis.completeness(states).select(*KEY, "complete"), KEY).join(analysis.assign_hot(labels, 5, 2).select(*KEY, "hot_degree"), KEY)
    more = keep(more)
    return _union([transforms.renumber(more, edges, *order())[0].select(F.lit(name).alias("policy"), "state_id", "str_id") for name, order in transforms.ORDERS.items()])


def merged(spark, sf_dir):
    """The types' automaton and the names' as one."""
    rows = _part_patterns(spark, sf_dir, "2", "1")
    return transforms.merge(*dictionary.tries(rows, keep, gap=b" ", fold_case=True), "both")[1]


def induced_subgraph(spark, sf_dir):
    states, edges = _names(spark, sf_dir)
    return transforms.induced(states, edges, states.where("not is_report").select(*KEY))[1]


def cut_by_depth(spark, sf_dir):
    states, edges = _names(spark, sf_dir)
    return transforms.cut_table_by_depth(states, edges, _labels(spark, sf_dir), 0.5)[0].select("state_id", "str_id")


def edited(spark, sf_dir):
    """States and edges taken out, then loops put in twice."""
    states, edges = _names(spark, sf_dir)
    states, edges = transforms.remove_states(states, edges, states.where("substr(str_id, 1, 1) = '7'").select(*KEY))
    more = states.where("state_id % 7 = 0").select("nfa_id", F.col("state_id").alias("src"), F.col("state_id").alias("dst"))
    edges = transforms.remove_edges(transforms.add_edges(edges, more.unionByName(more)), edges.where("dst % 5 = 0"))
    return edges.join(states.select(F.col("state_id").alias("src"), "str_id"), "src").select("src", "dst", "str_id")


def split_parts(spark, sf_dir):
    """Every component as an automaton of its own."""
    states, edges = _names(spark, sf_dir)
    parts, inside = transforms.split_table(states, edges, _components(spark, sf_dir))
    n_edges = inside.groupBy("nfa_id").agg(F.count(F.lit(1)).alias("edges"))
    return parts.groupBy("nfa_id").agg(F.count(F.lit(1)).alias("states")).join(n_edges, "nfa_id", "left").fillna(0, ["edges"])


def component_groups(spark, sf_dir):
    """The components by every way of grouping: their number, their states, their hot states, and places in blocks."""
    states, edges = _names(spark, sf_dir)
    hot = F.count_if((F.col("start_kind") > 0) | (F.col("state_id") % 3 == 0))
    rows = _components(spark, sf_dir).join(states, KEY).groupBy("cc_id").agg(F.count(F.lit(1)).alias("n"), hot.alias("hot"), F.count_if("is_report").alias("reports"))
    sizes = sorted(rows.collect())  # a row for each component
    ways = {
        "count": graph.group_by_count(len(sizes), 4),
        "size": graph.group_by_size([x.n for x in sizes], 100),
        "hot": graph.group_by_size([x.hot for x in sizes], 40, ascending=False),
        "compatible": [sorted({c for c, _ in block}) for block in transforms.pack_compatible([[1] * x.reports for x in sizes], 24)],
    }
    return spark.createDataFrame([(way, g, c) for way, groups in ways.items() for g, group in enumerate(groups) for c in group], "way string, group_id int, cc_id int")


def component_order(spark, sf_dir):
    """Places of components by packing policy, and their numbers by turns and by pairs."""
    states, edges = _names(spark, sf_dir)
    rows = _components(spark, sf_dir).join(states, KEY).groupBy("nfa_id", "cc_id").agg(F.count(F.lit(1)).alias("n"), (F.count_if("is_report") / 100).alias("ratio"))
    rows = keep(rows)
    orders = [transforms.pack_components(rows.drop("ratio"), k, rows.drop("n")).select(F.lit(k).alias("policy"), "cc_id", "place") for k in (0, 2, 3)]
    turn, pair = transforms.round_robin(F.col("cc_id"), 2), transforms.merge_every(F.col("cc_id"), 2)
    return _union(orders).select("policy", "cc_id", "place", turn.cast("int").alias("turn"), pair.alias("pair"))


def small_components(spark, sf_dir):
    labels = _components(spark, sf_dir)
    one = transforms.one_component(labels, state_id=4).select(F.lit("with state 4").alias("kind"), "state_id")
    return transforms.small_components(labels, 12).select(F.lit("at most 12").alias("kind"), "state_id").unionByName(one)


# Sinks.


def gr_output(spark, sf_dir):
    return sinks.gr_lines(*_names(spark, sf_dir)).select("value")


def node_output(spark, sf_dir):
    states, edges = _names(spark, sf_dir)
    return sinks.node_table(states, edges, _labels(spark, sf_dir))


def edge_output(spark, sf_dir):
    return sinks.edge_table(*_names(spark, sf_dir))


def written_edges(spark, sf_dir):
    path = _path(spark, "edges")
    sinks.write_tsv(sinks.edge_table(*_names(spark, sf_dir)), path)
    return spark.read.option("header", True).option("sep", "\t").csv(path).select("edge_from", "edge_to")


def dot_output(spark, sf_dir):
    return sinks.dot_lines(*_names(spark, sf_dir)).select(F.col("place").cast("int").alias("place"), "value")


# Files that are written from the tables.


def _documents_of(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """The three automata as ANML documents, written as a table and loaded again."""
    path = _path(spark, "anml")
    sinks.anml_documents(*_three(spark, sf_dir)).write.parquet(path)
    return anml.from_column(spark.read.parquet(path), "nfa_id", "document")


def random_stream_bytes(spark, sf_dir):
    """A random stream for each nation."""
    rows = streams.random_streams(_table(spark, sf_dir, "nation"), "n_name", "n_nationkey", 10_000)
    return streams.segments(rows, 4096).select("stream_id", "seg_id", F.md5("payload").alias("digest"))


def anml_states(spark, sf_dir):
    states = _documents_of(spark, sf_dir)[0]
    return states.select("nfa_id", "state_id", "str_id", "symbol_set_str", F.col("start_kind").cast("int").alias("start_kind"), "is_report", "report_code")


def anml_edges(spark, sf_dir):
    return _documents_of(spark, sf_dir)[1]


def match_files(spark, sf_dir):
    """What is said in conversations, written as files and read by ranges of bytes."""
    path = _path(spark, "said")
    rows = _table(spark, sf_dir, "conversations").select(F.coalesce("text", F.lit("")).alias("value"))
    rows.write.text(path, lineSep="\n")
    words = dictionary.tries(spark.createDataFrame([("w", x) for x in ("the", "tion", "an")], "nfa_id string, pattern string"), keep)
    found = matching.match(*words, streams.from_ranges(spark, path, 5000, overlap=3))
    return found.groupBy("report_code").agg(F.count(F.lit(1)).alias("n"))


def match_by_options(spark, sf_dir):
    """With the options of a file, which say how long the pieces of a name are."""
    path = _path(spark, "options")
    customers = _table(spark, sf_dir, "customer")
    options = customers.agg((F.max(F.octet_length("c_name")) - 3).alias("segment_bytes"), F.lit("keep").alias("tail"))
    options.select(F.to_json(F.struct("*"))).coalesce(1).write.text(path)
    data = streams.from_column(customers, "c_custkey", "c_name")
    from automill.queries import DIGITS

    return matching.match(DIGITS, None, data, **tables.config(spark, path)).select("stream_id", "offset", "report_code")


def hot_by_file(spark, sf_dir):
    """Frequencies of a file: each state's, its automaton's first cold state, and how many ids are hot."""
    states, path = _names(spark, sf_dir)[0], _path(spark, "frequencies")
    ratio = F.when(F.col("state_id") < 20, 0.5).otherwise(F.col("state_id") % 7 / 10)
    states.select(F.concat_ws(" \t", "str_id", ratio.cast("string"))).write.text(path)
    freq = tables.frequencies(spark, path)
    states = analysis.with_hot_degree(states, freq)
    boundary = analysis.hot_boundaries(states, 0.1)
    return states.join(boundary, "nfa_id").crossJoin(F.broadcast(analysis.hot_counts(freq, 0.1))).select("str_id", "hot_degree", "boundary", "hot", "cold")


def merged_results(spark, sf_dir):
    """Counts of events by type, a configuration for each remainder of the user, in two files."""
    events = _table(spark, sf_dir, "events").withColumn("config", F.concat(F.lit("k="), F.col("user_id") % 3))
    wide = keep(events.groupBy("config").pivot("event_type").count())
    parts = []
    for where in ("config = 'k=0'", "config <> 'k=0'"):
        path = _path(spark, "results")
        wide.where(where).coalesce(1).write.option("header", True).csv(path)
        parts.append(tables.results(spark, path))
    out = tables.merge_results(parts)
    return out.select("app", *[F.col(f"`k={k}`").alias(f"k{k}") for k in range(3)])


# Tables of runs, from events as what was measured.


def _runs(spark, sf_dir) -> DataFrame:
    """What events say as results: a value for each of a user's events; errors have none."""
    k = F.regexp_extract("props", "[0-9]+", 0).cast("double")
    config = F.when(F.col("user_id") % 2 == 0, "x").otherwise("y")
    return _table(spark, sf_dir, "events").select(
        F.concat(F.lit("user "), F.col("user_id") % 10).alias("app"), config.alias("config"), F.col("event_id").alias("repetition"),
        F.when(F.col("event_type") == "error", bench.FAILED).otherwise(k).alias("value"),
    )


def bench_table(spark, sf_dir):
    out = bench.normalised(bench.statistics(_runs(spark, sf_dir)), "x")
    return out.select("app", "config", "n", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), F.round("ratio", 6).alias("ratio"))


def bench_logs(spark, sf_dir):
    """Events as the lines of a log for each user."""
    line = (
        F.when(F.col("event_type") == "error", "Timeout after 5 s").when(F.col("event_type") == "signup", "throughput: fast")
        .when(F.col("event_type") == "click", F.concat(F.lit("throughput = "), F.regexp_extract("props", "[0-9]+", 0))).otherwise(F.col("props"))
    )
    lines = _table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("path"), F.col("event_id").alias("pos"), line.alias("value"))
    return bench.read_log(lines, "throughput")


def bench_grid(spark, sf_dir):
    """Every run of a grid whose action counts events of a type; where there are none, it fails."""
    events = keep(_table(spark, sf_dir, "events").select("event_type", "user_id"))

    def action(e: dict) -> float:
        n = events.where((F.col("event_type") == e["app"]) & (F.col("user_id") % e["k"] == 0)).count()
        if not n:
            raise ValueError(e)
        return n

    return bench.run(spark, bench.grid({"k": [1, 2]}, ["click", "view", "nothing", "error"], exclude={"error"}), action, times=2)


def bench_wide(spark, sf_dir):
    stats = bench.statistics(bench_grid(spark, sf_dir))
    return bench.table(stats, {"nothing": "None", "click": "Clicks", "view": "Views"}, {"k=1": "one", "k=2": "two"})


def bench_geomean(spark, sf_dir):
    ratios = _runs(spark, sf_dir).where("value > 0").select("config", (F.col("value") / 50).alias("ratio"))
    return bench.geometric_means(ratios).select("config", F.round("geomean", 6).alias("geomean"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        dictionary_states, dictionary_edges, dictionary_failures, match_dictionary, match_indexed, match_folded, nfa_summary, nfa_extended_summary, nfa_degree_hist, nfa_in_degree_hist,
        nfa_log_degree_hist, nfa_components, nfa_counts, nfa_layers, nfa_alphabet, alphabets, dag_classes, strong_components_orders, incompatible_pairs,
        compatible_groups, start_states, neighbours, hot_by_layer, memo_length_hist, memo_cutoff, symbolset_ranges, symbolset_cardinality, symbolset_parse,
        symbolset_kinds, symbolset_remap, symbolset_completeness, limited_out_degree, split_to_complete, renumbered, renumber_policies, merged, induced_subgraph,
        cut_by_depth, edited, split_parts, component_groups, component_order, small_components, gr_output, node_output, edge_output, written_edges, dot_output,
        random_stream_bytes, anml_states, anml_edges, match_files, match_by_options, hot_by_file, merged_results, bench_table, bench_logs, bench_grid, bench_wide, bench_geomean,
    )
}
