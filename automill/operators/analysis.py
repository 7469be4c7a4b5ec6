"""Statistics of automata, as DataFrames over the tables; graph labels come from the driver's algorithms."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from automill.functions import symbolset
from automill.model import ALL_INPUT, Automaton
from automill.operators import graph
from automill.plans.relational import memo_table as _memo_table


def degrees(states: DataFrame, edges: DataFrame) -> DataFrame:
    """nfa_id, state_id, in_degree, out_degree; the degrees are true ones."""
    keys = states.select("nfa_id", "state_id")
    into = edges.groupBy("nfa_id", F.col("dst").alias("state_id")).agg(F.count(F.lit(1)).alias("in_degree"))
    out = edges.groupBy("nfa_id", F.col("src").alias("state_id")).agg(F.count(F.lit(1)).alias("out_degree"))
    return keys.join(into, ["nfa_id", "state_id"], "left").join(out, ["nfa_id", "state_id"], "left").fillna(0, ["in_degree", "out_degree"])


def start_states(states: DataFrame) -> DataFrame:
    """The start states of every automaton and whether they are always active."""
    return states.where("start_kind > 0").select("nfa_id", "state_id", (F.col("start_kind") == ALL_INPUT).alias("always_active"))


def start_counts(states: DataFrame) -> DataFrame:
    """nfa_id, starts, always_active."""
    return states.groupBy("nfa_id").agg(
        F.count_if(F.col("start_kind") > 0).alias("starts"), F.count_if(F.col("start_kind") == ALL_INPUT).alias("always_active")
    )


def completeness(states: DataFrame) -> DataFrame:
    """nfa_id, state_id, n_symbols, n_ranges, complete (one range) and complement (all but one range)."""
    bytes_ = symbolset.explode_bytes(states.select("nfa_id", "state_id", "symbol_set"))
    order = Window.partitionBy("nfa_id", "state_id").orderBy("byte")
    gaps = bytes_.withColumn("new", (F.col("byte") - F.lag("byte").over(order) != 1) | F.lag("byte").over(order).isNull())
    found = gaps.groupBy("nfa_id", "state_id").agg(
        F.count(F.lit(1)).alias("n_symbols"), F.count_if("new").alias("n_ranges"), F.min("byte").alias("lo"), F.max("byte").alias("hi")
    )
    # Ranges of the complement: one between each two ranges, and one at each end that is not covered.
    other = F.col("n_ranges") - 1 + (F.col("lo") > 0).cast("int") + (F.col("hi") < 255).cast("int")
    found = found.withColumn("others", other)
    rows = states.select("nfa_id", "state_id").join(found, ["nfa_id", "state_id"], "left").fillna({"n_symbols": 0, "n_ranges": 0, "others": 1})
    return rows.select(
        "nfa_id", "state_id", "n_symbols", "n_ranges", (F.col("n_ranges") == 1).alias("complete"), (F.col("others") == 1).alias("complement")
    )


def completeness_counts(states: DataFrame) -> DataFrame:
    """nfa_id, states, complete, complement, either, all_complete."""
    either = F.col("complete") | F.col("complement")
    found = completeness(states).groupBy("nfa_id").agg(
        F.count(F.lit(1)).alias("states"), F.count_if("complete").alias("complete"), F.count_if("complement").alias("complement"),
        F.count_if(either).alias("either"),
    )
    return found.withColumn("all_complete", F.col("either") == F.col("states"))


def component_sizes(labels: DataFrame) -> DataFrame:
    """nfa_id, cc_id, n of rows (nfa_id, state_id, cc_id)."""
    return labels.groupBy("nfa_id", "cc_id").agg(F.count(F.lit(1)).alias("n"))


def summary(states: DataFrame, labels: DataFrame) -> DataFrame:
    """Per automaton: states, starts, always active, reporting; components, those over 256 states, largest and mean."""
    one = states.groupBy("nfa_id").agg(
        F.count(F.lit(1)).alias("states"), F.count_if(F.col("start_kind") > 0).alias("starts"),
        F.count_if(F.col("start_kind") == ALL_INPUT).alias("always_active"), F.count_if("is_report").alias("reporting"),
    )
    two = component_sizes(labels).groupBy("nfa_id").agg(
        F.count(F.lit(1)).alias("components"), F.count_if(F.col("n") > 256).alias("components_over_256"),
        F.max("n").alias("max_component"), F.avg("n").alias("avg_component"),
    )
    return one.join(two, "nfa_id")


def extended_summary(states: DataFrame, edges: DataFrame, labels: DataFrame) -> DataFrame:
    """summary with edges, density, complete and complement counts, smallest component, those over 512, and degrees."""
    sizes = component_sizes(labels).groupBy("nfa_id").agg(F.min("n").alias("min_component"), F.count_if(F.col("n") > 512).alias("components_over_512"))
    degree = degrees(states, edges).groupBy("nfa_id").agg(
        F.sum("out_degree").alias("edges"), F.max("in_degree").alias("max_in_degree"), F.max("out_degree").alias("max_out_degree"),
        F.avg("in_degree").alias("avg_in_degree"), F.avg("out_degree").alias("avg_out_degree"),
    )
    out = summary(states, labels).join(sizes, "nfa_id").join(degree, "nfa_id")
    out = out.join(completeness_counts(states).select("nfa_id", "complete", "complement"), "nfa_id")
    return out.withColumn("density", F.col("edges") / (F.col("states") * F.col("states")))


def degree_distribution(states: DataFrame, edges: DataFrame) -> DataFrame:
    """nfa_id, kind ('in' or 'out'), degree, n."""
    both = degrees(states, edges).select("nfa_id", F.expr("stack(2, 'in', in_degree, 'out', out_degree) AS (kind, degree)"))
    return both.groupBy("nfa_id", "kind", "degree").agg(F.count(F.lit(1)).alias("n"))


def in_degree_histogram(states: DataFrame, edges: DataFrame) -> DataFrame:
    """nfa_id, bucket (0 to 4, 5 for more), n."""
    bucket = F.least(F.col("in_degree"), F.lit(5)).alias("bucket")
    return degrees(states, edges).groupBy("nfa_id", bucket).agg(F.count(F.lit(1)).alias("n"))


def log_degree_histogram(states: DataFrame, edges: DataFrame) -> DataFrame:
    """Out-degrees by powers of two: nfa_id, bucket (0 for none, k + 1 for 2^k to 2^(k+1) - 1), n."""
    d = F.col("out_degree")
    bucket = F.when(d == 0, 0).otherwise(F.length(F.bin(d)))
    return degrees(states, edges).groupBy("nfa_id", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def alphabet(states: DataFrame, kind: str = "any") -> DataFrame:
    """nfa_id, byte: all that occur; 'no_wildcard' leaves out wildcards, 'wide' takes sets of 3 or more that are none."""
    n = symbolset.cardinality_column(F.col("symbol_set"))
    if kind == "no_wildcard":
        states = states.where(n < 256)
    elif kind == "wide":
        states = states.where((n >= 3) & (n < 256))
    elif kind != "any":
        raise ValueError(f"kind is any, no_wildcard or wide, not {kind!r}")
    return symbolset.explode_bytes(states.select("nfa_id", "symbol_set")).distinct()


def counts(states: DataFrame, edges: DataFrame) -> DataFrame:
    """nfa_id, states, transitions, wide_loops (self loops of states with more than 252 symbols)."""
    loops = edges.where("src = dst").select("nfa_id", F.col("src").alias("state_id"))
    wide = states.where(symbolset.cardinality_column(F.col("symbol_set")) > 252).join(loops, ["nfa_id", "state_id"], "left_semi")
    wide = wide.groupBy("nfa_id").agg(F.count(F.lit(1)).alias("wide_loops"))
    moves = edges.groupBy("nfa_id").agg(F.count(F.lit(1)).alias("transitions"))
    one = states.groupBy("nfa_id").agg(F.count(F.lit(1)).alias("states"))
    return one.join(moves, "nfa_id", "left").join(wide, "nfa_id", "left").fillna(0, ["transitions", "wide_loops"])


def graph_labels(spark: SparkSession, automata: Iterable[Automaton]) -> DataFrame:
    """Per state: cc_id, cc_local_id, scc_id, topo_order and bfs_layer."""
    rows = []
    for a in automata:
        cc = graph.components(a)
        columns = zip(range(len(a)), cc, graph.local_ids(cc), graph.strong_components(a), graph.topological_layers(a), graph.bfs_layers(a))
        rows += [(a.nfa_id, *x) for x in columns]
    return spark.createDataFrame(rows, "nfa_id string, state_id int, cc_id int, cc_local_id int, scc_id int, topo_order int, bfs_layer int")


def states_up_to(labels: DataFrame, layer: int) -> DataFrame:
    """nfa_id, n: states whose topological layer is at most that."""
    return labels.groupBy("nfa_id").agg(F.count_if(F.col("topo_order") <= layer).alias("n"))


def memo_table(spark: SparkSession, groups, k: int) -> DataFrame:
    """g, gram, states, reports: the k-grams after which a match is pending or done."""
    return _memo_table(spark, groups, k)


def memo_lengths(table: DataFrame, k: int) -> DataFrame:
    """g, n_states, grams: the lengths of the table's entries, with the empty ones as length 0."""
    found = table.groupBy("g", F.size("states").alias("n_states")).agg(F.count(F.lit(1)).alias("grams"))
    empty = table.groupBy("g").agg((F.lit(256**k) - F.count(F.lit(1))).alias("grams")).select("g", F.lit(0).alias("n_states"), "grams")
    return found.unionByName(empty.where("grams > 0"))


def memo_cutoff(table: DataFrame) -> DataFrame:
    """g, mean_length, median_length and ids of the table's entries, and their size in bytes at 4 an id."""
    n = F.size("states")
    out = table.groupBy("g").agg(F.avg(n).alias("mean_length"), F.median(n).alias("median_length"), F.sum(n + F.size("reports")).alias("ids"))
    return out.withColumn("bytes", F.col("ids") * 4)


def hot_counts(frequencies: DataFrame, threshold: float) -> DataFrame:
    """hot, cold: ids whose freq is above the threshold, and the others."""
    return frequencies.agg(F.count_if(F.col("freq") > threshold).alias("hot"), F.count_if(F.col("freq") <= threshold).alias("cold"))


def hot_boundaries(states: DataFrame, threshold: float) -> DataFrame:
    """nfa_id, boundary: the first state, in order, that is not hot; the number of states where all are. Needs hot_degree."""
    cold = F.min(F.when(F.col("hot_degree") <= threshold, F.col("state_id")))
    return states.groupBy("nfa_id").agg(F.coalesce(cold, F.max("state_id") + 1).alias("boundary"))


def assign_hot(labels: DataFrame, hot_limit: int, block_limit: int) -> DataFrame:
    """hot_degree 1.0 for the states nearest the starts: rank by bfs_layer in each component, components in turn, up to the limit.

    labels has nfa_id, state_id, cc_id, bfs_layer. The limit counts over all components; the first ones
    come from the smallest (rank, component) pairs, so only so many rows are kept and joined back.
    """
    rank = F.row_number().over(Window.partitionBy("nfa_id", "cc_id").orderBy("bfs_layer", "state_id"))
    ranked = labels.withColumn("rank", rank).where(F.col("rank") <= block_limit)
    first = ranked.orderBy("rank", "nfa_id", "cc_id").limit(hot_limit).select("nfa_id", "state_id", F.lit(1.0).alias("hot_degree"))
    return labels.join(first, ["nfa_id", "state_id"], "left").fillna(0.0, ["hot_degree"])


def with_hot_degree(states: DataFrame, frequencies: DataFrame) -> DataFrame:
    """The states with hot_degree from a table (id, freq) of state ids; 0 where there is none."""
    freq = frequencies.select(F.col("id").alias("str_id"), F.col("freq").alias("hot_degree"))
    return states.join(freq, "str_id", "left").fillna(0.0, ["hot_degree"])


def compatible_group_table(spark: SparkSession, automata: Iterable[Automaton], alphabet: set[int] | None = None, enable: bool = False) -> DataFrame:
    """nfa_id, cc_id, state_id, cg_id: states of a component that are never active together share a group."""
    rows = []
    for a in automata:
        labels = graph.components(a)
        by: dict[int, list[int]] = {}
        for s, c in enumerate(labels):
            by.setdefault(c, []).append(s)
        for c, members in by.items():
            for s, g in zip(members, graph.compatible_groups(a.part(members), alphabet, enable)):
                rows.append((a.nfa_id, c, s, g))
    return spark.createDataFrame(rows, "nfa_id string, cc_id int, state_id int, cg_id int")


def compatible_group_summary(groups: DataFrame, states: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Per group: states, starts, reporting, temperature and type.

    temperature is hot, cold or mixed by hot_degree (0 where the states have none). type is 1 for a
    single start, 2 for a single reporting state, 3 for any other single state, 4 for several of one
    temperature, 5 for mixed ones.
    """
    rows = groups.join(states, ["nfa_id", "state_id"])
    hot = F.col("hot_degree") > threshold if "hot_degree" in states.columns else F.lit(False)
    out = rows.groupBy("nfa_id", "cc_id", "cg_id").agg(
        F.count(F.lit(1)).alias("states"), F.count_if(F.col("start_kind") > 0).alias("starts"),
        F.count_if("is_report").alias("reporting"), F.count_if(hot).alias("hot"),
    )
    warm = F.when(F.col("hot") == F.col("states"), "hot").when(F.col("hot") == 0, "cold").otherwise("mixed")
    kind = (
        F.when((F.col("states") == 1) & (F.col("starts") == 1), 1).when((F.col("states") == 1) & (F.col("reporting") == 1), 2)
        .when(F.col("states") == 1, 3).when(F.col("temperature") != "mixed", 4).otherwise(5)
    )
    return out.withColumn("temperature", warm).withColumn("type", kind).drop("hot")


def neighbours(edges: DataFrame, state_ids: DataFrame, outgoing: bool = True) -> DataFrame:
    """The successors (or predecessors) of states (nfa_id, state_id)."""
    here, there = ("src", "dst") if outgoing else ("dst", "src")
    return edges.join(state_ids.withColumnRenamed("state_id", here), ["nfa_id", here]).select("nfa_id", F.col(here).alias("state_id"), F.col(there).alias("neighbour"))


def find_states(states: DataFrame, **values) -> DataFrame:
    """States by str_id, original_id or any other column."""
    for column, value in values.items():
        states = states.where(F.col(column) == value)
    return states
