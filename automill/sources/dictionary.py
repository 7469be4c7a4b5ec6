"""Automata from a column of patterns: tries, built in Spark.

A state is a distinct prefix, known by its digest, so the patterns of a table are cut into prefixes, grouped,
and numbered without any of them coming to the driver. ``match`` takes the two tables as it takes those of a loader.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from automill.functions import symbolset
from automill.model import ALL_INPUT, EDGES, START_KINDS, STATES
from automill.operators.numbering import ranked

_LETTERS = set(range(65, 91)) | set(range(97, 123))


def _symbols(byte: int, gap: bytes, fold_case: bool) -> int:
    if byte in gap:
        return symbolset.ALL
    return symbolset.of({byte, byte ^ 32} if fold_case and byte in _LETTERS else {byte})


def _key(start: Column, data: Column, depth: Column) -> Column:
    return F.md5(F.concat(F.encode(F.concat(start.cast("string"), F.lit(":")), "UTF-8"), F.substring(data, F.lit(1), depth)))


def _patterns(patterns: DataFrame, fold_case: bool) -> DataFrame:
    """Distinct nfa_id, data, start (kind), repeat and code. Null and empty patterns are none."""
    names = patterns.columns
    text = F.col("pattern") if dict(patterns.dtypes)["pattern"] != "binary" else None
    data = F.encode(F.lower(text) if fold_case else text, "UTF-8") if text is not None else F.col("pattern")
    kinds = F.create_map(*[F.lit(x) for kv in START_KINDS.items() for x in kv])
    return patterns.select(
        F.col("nfa_id").cast("string").alias("nfa_id"),
        data.alias("data"),
        (F.element_at(kinds, F.col("start")) if "start" in names else F.lit(ALL_INPUT)).cast("tinyint").alias("start"),
        (F.col("repeat") if "repeat" in names else F.lit(False)).alias("repeat"),
        (F.col("code") if "code" in names else F.col("pattern")).cast("string").alias("code"),
    ).where((F.octet_length("data") > 0) & F.col("nfa_id").isNotNull() & F.col("start").isNotNull())


def _prefixes(patterns: DataFrame) -> DataFrame:
    """One row per prefix of each pattern: depth, key, the parent's and the root's key, last byte, and whether the pattern ends there."""
    rows = patterns.withColumn("depth", F.explode(F.sequence(F.lit(1), F.octet_length("data"))))
    key = lambda depth: _key(F.col("start"), F.col("data"), depth)
    return rows.select(
        "nfa_id", "start", "depth",
        key(F.col("depth")).alias("key"),
        F.when(F.col("depth") > 1, key(F.col("depth") - 1)).alias("parent"),
        key(F.lit(1)).alias("root"),
        F.conv(F.hex(F.substring(F.col("data"), F.col("depth"), F.lit(1))), 16, 10).cast("int").alias("byte"),
        (F.col("depth") == F.octet_length("data")).alias("ends"),
        "repeat", "code",
    )


def tries(patterns: DataFrame, keep: Callable[[DataFrame], DataFrame], *, gap: bytes = b"", fold_case: bool = False) -> tuple[DataFrame, DataFrame]:
    """The tables of states and edges of patterns (nfa_id, pattern, and perhaps start, repeat and code).

    A state for each distinct prefix of an automaton's patterns with the same start; it reports where a pattern ends, with the least
    code of these (the pattern itself, if there is no code). States are numbered by start, depth and digest, which is also their id.
    gap: bytes that stand for any one or more bytes: wildcards with a self loop. fold_case: ASCII letters match in either case,
    and patterns are lower-cased. repeat: an edge from the pattern's end back to its first state.
    """
    cut = _prefixes(_patterns(patterns, fold_case))
    nodes = cut.groupBy("nfa_id", "start", "depth", "key").agg(
        F.min("parent").alias("parent"), F.min("root").alias("root"), F.min("byte").alias("byte"), F.max("ends").alias("is_report"),
        F.max(F.col("repeat") & F.col("ends")).alias("repeat"), F.min(F.when(F.col("ends"), F.col("code"))).alias("report_code"),
    )
    nodes = ranked(nodes, ["nfa_id"], [F.col("start"), F.col("depth"), F.col("key")], keep, "state_id")
    nodes = keep(nodes.withColumn("state_id", F.col("state_id").cast("int")))
    sets = [(b, bytearray(symbolset.to_bytes(s)), symbolset.to_class(s)) for b in range(256) for s in [_symbols(b, gap, fold_case)]]
    table = nodes.sparkSession.createDataFrame(sets, "byte int, symbol_set binary, symbol_set_str string")  # 256 rows
    first = F.col("depth") == 1
    states = nodes.join(F.broadcast(table), "byte").select(
        "nfa_id", "state_id", F.col("key").alias("str_id"), F.col("key").alias("original_id"), "symbol_set", "symbol_set_str",
        F.when(first, F.col("start")).otherwise(F.lit(0).cast("tinyint")).alias("start_kind"), "is_report", "report_code",
    )
    known = nodes.select("nfa_id", F.col("key").alias("to_key"), F.col("state_id").alias("to"))

    def towards(rows: DataFrame, column: str) -> DataFrame:
        return rows.select("nfa_id", "state_id", F.col(column).alias("to_key")).join(known, ["nfa_id", "to_key"])

    down = towards(nodes.where(~first), "parent").select("nfa_id", F.col("to").alias("src"), F.col("state_id").alias("dst"))
    back = towards(nodes.where("repeat"), "root").select("nfa_id", F.col("state_id").alias("src"), F.col("to").alias("dst"))
    loops = nodes.where(F.col("byte").isin(*gap) if gap else F.lit(False)).select("nfa_id", F.col("state_id").alias("src"), F.col("state_id").alias("dst"))
    edges = down.unionByName(back).unionByName(loops).distinct()
    spark = nodes.sparkSession
    empty = spark.createDataFrame([], STATES), spark.createDataFrame([], EDGES)
    return empty[0].unionByName(states), empty[1].unionByName(edges)


def failure_links(patterns: DataFrame, states: DataFrame, fold_case: bool = False) -> DataFrame:
    """nfa_id, state_id, failure: the state of the longest proper suffix of a state's prefix that is a prefix itself; null for none.

    Where a match of the trie breaks off, the longest match that is still pending goes on there. Suffixes are looked up by
    their digests: a row for each prefix and start within it, so this is for keywords, not for long texts.
    """
    rows = _patterns(patterns, fold_case).withColumn("depth", F.explode(F.sequence(F.lit(1), F.octet_length("data"))))
    rows = rows.withColumn("key", _key(F.col("start"), F.col("data"), F.col("depth")))
    one = rows.groupBy("nfa_id", "start", "depth", "key").agg(F.min(F.substring(F.col("data"), F.lit(1), F.col("depth"))).alias("data"))
    size = F.col("depth") - F.col("from")
    pairs = one.where("depth > 1").withColumn("from", F.explode(F.sequence(F.lit(1), F.col("depth") - 1))).select(
        "nfa_id", "key", size.alias("size"), F.md5(F.concat(F.encode(F.concat(F.col("start").cast("string"), F.lit(":")), "UTF-8"), F.substring(F.col("data"), F.col("from") + 1, size))).alias("str_id")
    )
    ids = states.select("nfa_id", "str_id", "state_id")
    best = pairs.join(ids, ["nfa_id", "str_id"]).groupBy("nfa_id", "key").agg(F.max_by("state_id", "size").alias("failure"))
    return ids.join(best.withColumnRenamed("key", "str_id"), ["nfa_id", "str_id"], "left").select("nfa_id", "state_id", "failure")
