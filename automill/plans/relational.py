"""Matching by joins.

All positions of all segments are worked on at once. A round joins the frontier with the edges and with
the bytes at the next positions, so the number of rounds is the longest run of a match, not the length
of the input, and is known beforehand for automata without cycles. With a memo table the first k bytes are one
broadcast join. A round makes ``HOPS`` moves over bytes that one join has fetched, so the frontier is shuffled once
for so many bytes; states without successors leave it at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from automill.functions.words import gram
from automill.model import ALL_INPUT, START_OF_DATA, Compiled
from automill.sources.streams import dealt, positions

#: Rounds after which a match by joins gives up; cyclic automata need as many as the longest segment.
MAX_ROUNDS = 64
#: Moves of a round.
HOPS = 2
#: Rows of an automaton's tables that are broadcast at most.
BROADCAST_ROWS = 2_000_000

_KEY = ["stream_id", "seg_id", "base", "first"]


class TooManyRounds(RuntimeError):
    """The frontier was not empty after MAX_ROUNDS rounds."""


def tables(spark: SparkSession, groups: list[Compiled]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(g, s, byte), (g, s, t) and (g, s, start, report) of compiled groups; g counts the groups of all automata."""
    bytes_, edges, states = [], [], []
    for g, c in enumerate(groups):
        for b, mask in enumerate(c.match):
            bytes_ += [(g, s, b) for s in range(len(c.names)) if mask >> s & 1]
        for s in range(len(c.names)):
            edges += [(g, s, t) for t in range(len(c.names)) if c.succ[s] >> t & 1]
            start = ALL_INPUT if c.all_input >> s & 1 else START_OF_DATA if c.start_of_data >> s & 1 else 0
            states.append((g, s, start, bool(c.report >> s & 1)))
    return (
        spark.createDataFrame(bytes_, "g int, s int, byte int"),
        spark.createDataFrame(edges, "g int, s int, t int"),
        spark.createDataFrame(states, "g int, s int, start int, report boolean"),
    )


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _ranges(state_bytes: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
    """(g, s, lo, hi) of the sorted bytes (g, s, byte)."""
    out: list[tuple[int, int, int, int]] = []
    for g, s, b in sorted(state_bytes):
        if out and out[-1][:2] == (g, s) and out[-1][3] == b - 1:
            out[-1] = (g, s, out[-1][2], b)
        else:
            out.append((g, s, b, b))
    return out


def match(
    segments: DataFrame, groups: list[Compiled], every_segment: bool, k: int = 0, keep=None, max_rounds: int = MAX_ROUNDS, ranges: bool = False, hops: int = HOPS
) -> DataFrame:
    """Rows (stream_id, base, pos, g, s) of reports, distinct.

    Segments are dealt into parts by their bytes, so that a task's rows are bounded.
    keep writes a table and returns it, which cuts the lineage of every round. ranges: a move compares its byte with
    the bounds of the next state's ranges, instead of looking for the byte among the state's bytes.
    """
    spark = segments.sparkSession
    segments = dealt(segments, ("stream_id", "base"))
    state_bytes, edges, states = tables(spark, groups)
    size = sum(m.bit_count() for c in groups for m in c.match)
    if ranges:
        bounds = _ranges([(g, s, b) for g, c in enumerate(groups) for b, m in enumerate(c.match) for s in range(len(c.names)) if m >> s & 1])
        sets, holds = spark.createDataFrame(bounds, "g int, t int, lo int, hi int"), lambda byte: F.col(byte).between(F.col("lo"), F.col("hi"))
    else:
        sets, holds = state_bytes.select("g", F.col("s").alias("t"), F.col("byte").alias("on")), lambda byte: F.col(byte) == F.col("on")
    moves = _small(edges.join(sets, ["g", "t"]).withColumnsRenamed({"g": "g_", "s": "s_"}), size)
    move = lambda rows, byte: rows.join(moves, (F.col("g") == F.col("g_")) & (F.col("s") == F.col("s_")) & holds(byte))
    info = _small(states, size)
    leading = _small(edges.select("g", "s").distinct(), size)
    # Bytes that a match can still take after its first; more than any of them for automata with cycles.
    reach = max((c.longest or max_rounds * hops + 2 for c in groups), default=1) - max(k, 1)
    cyclic = any(c.longest == 0 for c in groups)
    late = k > 0 and any(c.start_of_data for c in groups)
    places = positions(segments, hops)
    if reach > 0 or late:
        places = keep(places)
    reporting = lambda rows: rows.join(info.where("report"), ["g", "s"], "left_semi").select("stream_id", "base", "pos", "g", "s")
    going = lambda rows: rows.join(leading, ["g", "s"], "left_semi")
    started = info.where("start > 0").join(state_bytes, ["g", "s"]).select("g", "s", "start", "byte")
    begin = (F.col("start") == ALL_INPUT) | ((F.col("pos") == 0) & (F.col("first") | F.lit(every_segment)))
    if k == 0:
        frontier = places.join(_small(started, size), "byte").where(begin).select(*_KEY, "pos", "g", "s")
        found = reporting(frontier)
    else:
        frontier, found = _from_memo(spark, segments, groups, k, every_segment, keep)
        if late:
            # These have not taken k bytes yet.
            seeds = places.join(_small(started, size), "byte").where((F.col("start") != ALL_INPUT) & begin).select(*_KEY, "pos", "g", "s")
            frontier, found, reach = frontier.unionByName(seeds), found.unionByName(reporting(seeds)), reach + k - 1
    out = [found]
    next_bytes = [F.col("byte" if j == 0 else f"byte{j}").alias(f"ahead{j}") for j in range(hops)]
    ahead = places.select(*_KEY, (F.col("pos") - 1).alias("pos"), *next_bytes)
    done = 0
    while done < reach:
        if done >= max_rounds * hops:
            raise TooManyRounds(f"the frontier isn't empty after {max_rounds} rounds; use 'arrow'")
        here = keep(going(frontier).distinct().join(ahead, [*_KEY, "pos"]))
        if (cyclic or reach - done > hops) and here.isEmpty():
            break
        rows = here
        for j in range(min(hops, reach - done)):
            rows = move(rows, f"ahead{j}").select(*_KEY, (F.col("pos") + 1).alias("pos"), "g", F.col("t").alias("s"), *[f"ahead{i}" for i in range(j + 1, hops)])
            out.append(reporting(rows))
            rows = going(rows)
        frontier, done = rows.select(*_KEY, "pos", "g", "s"), done + hops
    rows = out[0]
    for more in out[1:]:
        rows = rows.unionByName(more)
    return rows.distinct()


def memo(groups: list[Compiled], k: int) -> list[tuple[int, int, list[int], list[int]]]:
    """(g, gram, states, reports): for each k-gram that leaves something pending, the states that match at its
    last byte after starting at its first, and those of them that report."""
    out = []
    for g, c in enumerate(groups):
        front = {(): 0}
        for _ in range(k):
            following: dict[tuple, int] = {}
            for gram_, matched in front.items():
                enabled, rest = 0, matched
                while rest:
                    low = rest & -rest
                    enabled |= c.succ[low.bit_length() - 1]
                    rest ^= low
                starts = c.all_input if not gram_ else 0
                for b in range(256):
                    now = (enabled | starts) & c.match[b]
                    if now:
                        following[*gram_, b] = now
            front = following
        bits = lambda m: [s for s in range(m.bit_length()) if m >> s & 1]
        out += [(g, int.from_bytes(bytes(x), "big"), bits(m), bits(m & c.report)) for x, m in sorted(front.items())]
    return out


def memo_table(spark: SparkSession, groups: list[Compiled], k: int) -> DataFrame:
    return spark.createDataFrame(memo(groups, k), "g int, gram bigint, states array<int>, reports array<int>")


def _from_memo(spark, segments: DataFrame, groups: list[Compiled], k: int, every_segment: bool, keep) -> tuple[DataFrame, DataFrame]:
    """Frontier and reports of all-input starts at every position, after up to k bytes by lookups of j-grams."""
    n = F.octet_length("payload")
    places = segments.where(n > 0).withColumn("start", F.explode(F.sequence(F.lit(0), n - 1)))
    grams = places.select(*_KEY, "start", *[gram(F.col("payload"), F.col("start"), j).alias(f"g{j}") for j in range(1, k + 1)])
    found = frontier = None
    for j in range(1, k + 1):
        table = memo(groups, j)
        if j < k and not any(row[3] for row in table):
            continue
        rows = spark.createDataFrame(table, "g int, gram bigint, states array<int>, reports array<int>")
        hit = grams.join(_small(rows, len(table)), F.col(f"g{j}") == F.col("gram"))
        at = [*_KEY, (F.col("start") + j - 1).alias("pos"), "g"]
        reports = hit.where(F.size("reports") > 0).select(*at, F.explode("reports").alias("s")).select("stream_id", "base", "pos", "g", "s")
        found = reports if found is None else found.unionByName(reports)
        if j == k:
            frontier = hit.select(*at, F.explode("states").alias("s"))
    return frontier.distinct(), found
