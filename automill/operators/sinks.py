"""Text forms of automata and reports, and writing them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from automill.functions import symbolset
from automill.model import ALL_INPUT, Automaton
from automill.operators import analysis
from automill.operators.numbering import ranked
from automill.operators.scratch import keep


def write_reports(reports: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    """Ordered reports as parquet, csv or json; Spark makes the folders."""
    out = reports.orderBy("stream_id", "nfa_id", "offset", "state_id")
    writer = out.write.mode(mode)
    {"parquet": writer.parquet, "json": writer.json, "csv": lambda p: writer.option("header", True).csv(p)}[fmt](path)


def dot(a: Automaton) -> str:
    """Graphviz text. Reporting states are double octagons, all-input starts orange, other starts yellow."""
    lines = ["digraph G {"]
    for i, s in enumerate(a.states):
        text = s.symbol_str or symbolset.to_class(s.symbols)
        text = text.replace("\\", "\\\\").replace('"', '\\"')
        marks = f' [label="{s.str_id} intid {i} {text} {s.symbols.bit_count()}"]'
        marks += " [shape=doubleoctagon]" if s.report else ""
        marks += " [color=orange]" if s.start == ALL_INPUT else " [color=yellow]" if s.start else ""
        lines.append(f"{i}{marks};")
    lines += [f"{x} -> {y};" for x, y in a.edges()]
    return "\n".join([*lines, "}"]) + "\n"


def dot_lines(states: DataFrame, edges: DataFrame) -> DataFrame:
    """nfa_id, place and value: the lines of ``dot`` of each automaton, from the tables."""
    escape = lambda c: F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    size = symbolset.cardinality_column(F.col("symbol_set"))
    label = F.format_string(' [label="%s intid %d %s %d"]', "str_id", "state_id", escape(F.col("symbol_set_str")), size)
    shape = F.when(F.col("is_report"), " [shape=doubleoctagon]").otherwise("")
    colour = F.when(F.col("start_kind") == ALL_INPUT, " [color=orange]").when(F.col("start_kind") > 0, " [color=yellow]").otherwise("")
    line = lambda kind, a, b, value: ["nfa_id", F.lit(kind).alias("kind"), a.alias("a"), b.alias("b"), value.alias("value")]
    none = F.lit(0)
    lines = states.select(*line(1, F.col("state_id"), none, F.concat(F.col("state_id").cast("string"), label, shape, colour, F.lit(";"))))
    lines = lines.unionByName(edges.select(*line(2, F.col("src"), F.col("dst"), F.format_string("%d -> %d;", "src", "dst"))))
    for kind, text in ((0, "digraph G {"), (3, "}")):
        lines = lines.unionByName(states.select("nfa_id").distinct().select(*line(kind, none, none, F.lit(text))))
    return ranked(lines, ["nfa_id"], [F.col("kind"), F.col("a"), F.col("b")], keep, "place").select("nfa_id", "place", "value")


_KINDS = {1: "start-of-data", 2: "all-input"}


def _xml(c: Column) -> Column:
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("\t", "&#9;"), ("\n", "&#10;"), ("\r", "&#13;")):
        c = F.replace(c, F.lit(sign), F.lit(name))
    return c


def anml_documents(states: DataFrame, edges: DataFrame) -> DataFrame:
    """nfa_id and document: each automaton as an ANML document, which ``anml.from_column`` reads back. A document is one value."""
    ids = states.select("nfa_id", F.col("state_id").alias("dst"), F.col("str_id").alias("to"))
    onward = edges.join(ids, ["nfa_id", "dst"]).groupBy("nfa_id", F.col("src").alias("state_id")).agg(F.array_sort(F.collect_list(F.struct("dst", "to"))).alias("onward"))
    rows = states.join(onward, ["nfa_id", "state_id"], "left")
    start = F.when(F.col("start_kind") > 0, F.concat(F.lit(' start="'), F.element_at(F.create_map(*[F.lit(x) for kv in _KINDS.items() for x in kv]), F.col("start_kind").cast("int")), F.lit('"'))).otherwise("")
    code = F.coalesce(F.concat(F.lit(' reportcode="'), _xml(F.col("report_code")), F.lit('"')), F.lit(""))
    report = F.when(F.col("is_report"), F.concat(F.lit("<report-on-match"), code, F.lit("/>"))).otherwise("")
    moves = F.array_join(F.transform(F.coalesce("onward", F.array().cast("array<struct<dst: int, to: string>>")), lambda x: F.concat(F.lit('<activate-on-match element="'), _xml(x["to"]), F.lit('"/>'))), "")
    element = F.concat(
        F.lit('<state-transition-element id="'), _xml(F.col("str_id")), F.lit('" symbol-set="'), _xml(F.col("symbol_set_str")), F.lit('"'), start, F.lit(">"),
        report, moves, F.lit("</state-transition-element>\n"),
    )
    body = F.transform(F.array_sort(F.collect_list(F.struct("state_id", "element"))), lambda x: x["element"])
    whole = F.concat(F.lit('<automata-network id="'), _xml(F.col("nfa_id")), F.lit('">\n'), F.array_join(body, ""), F.lit("</automata-network>\n"))
    return rows.withColumn("element", element).groupBy("nfa_id").agg(whole.alias("document"))


def gr_lines(states: DataFrame, edges: DataFrame) -> DataFrame:
    """nfa_id, place, value: a header 'p sp V E', then 'a from to 1' with states from 1."""
    one = states.groupBy("nfa_id").agg(F.count(F.lit(1)).alias("v"))
    two = edges.groupBy("nfa_id").agg(F.count(F.lit(1)).alias("e"))
    head = one.join(two, "nfa_id", "left").fillna(0, ["e"])
    head = head.select("nfa_id", F.lit(-1).alias("src"), F.lit(-1).alias("dst"), F.format_string("p sp %d %d", "v", "e").alias("value"))
    arcs = edges.select("nfa_id", "src", "dst", F.format_string("a %d %d 1", F.col("src") + 1, F.col("dst") + 1).alias("value"))
    return head.unionByName(arcs)


def write_gr(states: DataFrame, edges: DataFrame, path: str) -> None:
    """One folder per automaton; within it the lines are in order."""
    lines = gr_lines(states, edges).repartition("nfa_id").sortWithinPartitions("nfa_id", "src", "dst")
    lines.select("nfa_id", "value").write.partitionBy("nfa_id").text(path)


def bits(sets: Column) -> Column:
    """A set as 256 binary digits, byte 255 first."""
    digits = F.transform(F.sequence(F.lit(32), F.lit(1), F.lit(-1)), lambda i: F.lpad(F.conv(F.hex(F.substring(sets, i, F.lit(1))), 16, 2), 8, "0"))
    return F.array_join(digits, "")


def node_table(states: DataFrame, edges: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per state: str_id, matchset, complete, complement, bfs_layer, start, alway_enabled, report, in_degree, out_degree."""
    key = ["nfa_id", "state_id"]
    rows = states.join(analysis.completeness(states).select(*key, "complete", "complement"), key)
    rows = rows.join(labels.select(*key, "bfs_layer"), key).join(analysis.degrees(states, edges), key)
    flag = lambda c: c.cast("int")
    return rows.select(
        "nfa_id", "state_id", "str_id", bits(F.col("symbol_set")).alias("matchset"), flag(F.col("complete")).alias("complete"),
        flag(F.col("complement")).alias("complement"), "bfs_layer", flag(F.col("start_kind") > 0).alias("start"),
        flag(F.col("start_kind") == ALL_INPUT).alias("alway_enabled"), flag(F.col("is_report")).alias("report"), "in_degree", "out_degree",
    )


def edge_table(states: DataFrame, edges: DataFrame) -> DataFrame:
    """One row per edge: edge_from, edge_to, and complete, complement and matchset of the target."""
    key = ["nfa_id", "state_id"]
    ids = states.select(*key, "str_id", bits(F.col("symbol_set")).alias("matchset")).join(analysis.completeness(states).select(*key, "complete", "complement"), key)
    source = ids.select("nfa_id", F.col("state_id").alias("src"), F.col("str_id").alias("edge_from"))
    target = ids.select("nfa_id", F.col("state_id").alias("dst"), F.col("str_id").alias("edge_to"), F.col("complete").cast("int").alias("complete"), F.col("complement").cast("int").alias("complement"), "matchset")
    return edges.join(source, ["nfa_id", "src"]).join(target, ["nfa_id", "dst"]).select("nfa_id", "src", "dst", "edge_from", "edge_to", "complete", "complement", "matchset")


def write_tsv(table: DataFrame, path: str) -> None:
    """A table of states or edges as tab-separated text with a header, without the numbering columns."""
    shown = [c for c in table.columns if c not in ("nfa_id", "state_id", "src", "dst")]
    table.orderBy(*[c for c in ("nfa_id", "state_id", "src", "dst") if c in table.columns]).select(shown).write.option("sep", "\t").option("header", True).csv(path)


def write_frontier(profile: DataFrame, path: str) -> None:
    profile.orderBy("nfa_id", "group_id", "size").write.option("header", True).csv(path)


def show(a: Automaton) -> str:
    """A line for each state, for reading."""
    kinds = {0: "", 1: "start-of-data", 2: "all-input"}
    return "\n".join(
        f"{i}\t{s.str_id}\t{s.symbol_str or symbolset.to_class(s.symbols)}\t{kinds[s.start]}\t{'report ' + (s.code or '') if s.report else ''}\t{a.succ[i]}"
        for i, s in enumerate(a.states)
    )
