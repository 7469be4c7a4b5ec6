"""Matching: automata and streams in, reports out."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from automill.model import REPORTS, Automaton, Sparse, Table, determinise, from_frames
from automill.operators.scratch import keep
from automill.plans import fold, kernels, planner, relational
from automill.plans.planner import Group
from automill.sources import streams as sources

#: States whose groups are broadcast together; more of them are further passes over the streams.
BROADCAST_STATES = 200_000
#: Segments from this size on are dealt out anew, so that one long stream is not one task.
LARGE_SEGMENT = 1 << 16
#: Segments whose functions one task composes.
COMPOSED = 256


def match(
    states: DataFrame | Automaton | Iterable[Automaton],
    edges: DataFrame | None,
    streams: DataFrame,
    *,
    strategy: str = "auto",
    segment_bytes: int | None = None,
    seam: str = "reset",
    tail: str = "drop",
    start_scope: str = "auto",
    replicas: int = 1,
    start: int | None = None,
    length: int | None = None,
    pad_to: int | None = None,
    groups: int | None = None,
    memo_k: int = 0,
    mode: str = "reports",
    cc_id: int | None = None,
    cc_with_state: str | None = None,
    max_cc_states: int | None = None,
    merge_cc: int = 1,
    app: str | None = None,
    hot: set[str] | None = None,
) -> DataFrame:
    """Every (state, offset) at which a reporting state matches the byte at that offset.

    streams has stream_id and payload, or is what ``streams.from_ranges`` gives: the ranges of a file are one stream, matched as if uncut.
    Offsets count from 0 in the replicated stream and point at the
    last matched byte.

    seam: 'reset' forgets at the end of a segment, 'exact' gives what an uncut stream would give.
    tail: whether the remainder behind the last full segment is scanned ('keep') or not ('drop').
    start_scope: start-of-data states fire in the first segment ('first'), or in each ('every_segment');
    'auto' is 'every_segment' when a replicated stream is cut into its replicas, else 'first'.
    mode: 'reports', or 'count' for one row (n) that counts them, or 'streams' for stream_id and n of streams that have any.
    Kernels count without making reports; joins, exact seams and padded streams make them and count them then.
    hot: state ids that strategy 'hybrid' runs by a table; without it, those at most two edges behind a start.
    start and length cut the stream first, if both are given. pad_to fills up with zero bytes, on which
    matches may run on but not be reported.
    """
    for name, value, allowed in (
        ("seam", seam, ("reset", "exact")), ("mode", mode, ("reports", "count", "streams")), ("start_scope", start_scope, ("auto", "first", "every_segment")),
    ):
        if value not in allowed:
            raise ValueError(f"{name} is one of {allowed}, not {value!r}")
    if isinstance(states, DataFrame):
        automata = from_frames(states, edges)
    else:
        automata = [states] if isinstance(states, Automaton) else list(states)
    if strategy == "auto" and memo_k:
        strategy = "memo"
    plan = planner.plan(
        automata, strategy=strategy, groups=groups, cc_id=cc_id, cc_with_state=cc_with_state, max_cc_states=max_cc_states, merge_cc=merge_cc, hot=hot
    )
    if {"own", "base", "first"} <= set(streams.columns):
        out = _over_ranges(streams, plan)
        if mode != "reports":
            return _counted(out.withColumn("n", F.lit(1).cast("long")), mode)
        return out.withColumn("app", F.lit(app)) if app else out
    if start is not None and length is not None:
        streams = sources.slice_streams(streams, start, length)
    limit = None
    if pad_to:
        streams = sources.pad(streams, pad_to)
        limit = streams.select(F.col("stream_id").alias("s_"), F.col("length").alias("length_"))
    every = start_scope == "every_segment"
    if start_scope == "auto" and replicas > 1:
        size = F.octet_length("payload")
        dup = F.lit(segment_bytes is None) | (size == (segment_bytes or -1))
    else:
        dup = F.lit(False)
    if start_scope == "auto" and replicas > 1 and segment_bytes is None:
        # Replicas are segments of their own: each begins anew.
        cut = sources.segments(streams, None, 1).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(replicas - 1))))
        cut = cut.select("stream_id", F.col("rep").cast("int").alias("seg_id"), (F.octet_length("payload").cast("long") * F.col("rep")).alias("base"), F.lit(True).alias("first"), "payload")
    else:
        marked = streams.withColumn("__dup", dup) if replicas > 1 else streams
        cut = sources.segments(marked, segment_bytes, replicas, "keep" if seam == "exact" and tail == "keep" else tail)
        if replicas > 1:
            flags = marked.select(F.col("stream_id").alias("s_"), "__dup")
            cut = cut.join(flags, cut["stream_id"] == flags["s_"]).withColumn("first", F.col("first") | F.col("__dup")).drop("s_", "__dup")
    if every:
        cut = cut.withColumn("first", F.lit(True))
    if segment_bytes is not None and segment_bytes >= LARGE_SEGMENT:
        cut = cut.repartition("stream_id", "seg_id")
    if seam == "exact" and segment_bytes is not None:
        if every:
            raise ValueError("an uncut stream has one beginning: seam='exact' goes with start_scope 'first'")
        out = _exact(streams, plan, segment_bytes, replicas, tail)
    elif strategy in planner.JOINS:
        out = _relational(cut, plan, memo_k or 1 if strategy == "memo" else 0, strategy == "ranges")
    elif strategy == "fold":
        out = _folded(cut, plan)
    elif mode != "reports" and limit is None:
        return _counted(_count(cut, plan), mode)
    else:
        out = scan(cut, plan)
    if limit is not None:
        out = out.join(limit, out["stream_id"] == limit["s_"]).where(F.col("offset") < F.col("length_")).drop("s_", "length_")
    if mode != "reports":
        return _counted(out.withColumn("n", F.lit(1).cast("long")), mode)
    return out.withColumn("app", F.lit(app)) if app else out


def _counted(rows: DataFrame, mode: str) -> DataFrame:
    """The sum of n over all rows, or by stream."""
    total = F.sum("n").alias("n")
    return rows.groupBy("stream_id").agg(total) if mode == "streams" else rows.agg(F.coalesce(total, F.lit(0).cast("long")).alias("n"))


def _count(cut: DataFrame, plan: list[Group]) -> DataFrame:
    """stream_id and n, the number of reports of each segment that has any; counted in the kernel, so that no report is made."""
    return reduce(DataFrame.unionByName, [_count_part(cut, part) for part in _passes(plan)])


def _count_part(cut: DataFrame, plan: list[Group]) -> DataFrame:
    shared = cut.sparkSession.sparkContext.broadcast(plan)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            firsts, payloads = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            n = np.zeros(len(payloads), np.int64)
            for group in shared.value:
                if group.table is not None and not group.cold:
                    n += kernels.count(group.table, group.compiled.longest, payloads, firsts)
                else:
                    for segs, _, _ in _hits(group, payloads, firsts):
                        n += np.bincount(segs, minlength=len(n))
            some = pa.array(np.flatnonzero(n))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(some), pa.array(n).take(some)], ["stream_id", "n"])

    return cut.select("stream_id", "first", "payload").mapInArrow(run, "stream_id string, n long")


def _columns(group: Group, segs: np.ndarray, offs: np.ndarray, local: np.ndarray, ids: list[str], bases: np.ndarray) -> pa.RecordBatch:
    c = group.compiled
    numbers, originals, codes, ccs = zip(*c.names)
    pick = pa.array(local)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([c.nfa_id] * len(segs), pa.string()),
            pa.array(ids, pa.string()).take(pa.array(segs)),
            pa.array(bases[segs] + offs, pa.int64()),
            pa.array(numbers, pa.int32()).take(pick),
            pa.array(originals, pa.string()).take(pick),
            pa.array(codes, pa.string()).take(pick),
            pa.array(ccs, pa.int32()).take(pick),
            pa.array(np.full(len(segs), c.group_id), pa.int32()),
        ],
        [x.split()[0] for x in REPORTS.split(", ")],
    )


def _hits(group: Group, payloads: list[bytes], firsts: list[bool]) -> Iterator[kernels.Hits]:
    if isinstance(group.compiled, Sparse):
        return kernels.sparse(group.compiled, payloads, firsts)
    if group.cold:
        return kernels.hybrid(group.compiled, group.cold, group.table, payloads, firsts)
    if group.table is not None:
        return kernels.lock_step(group.table, group.compiled.longest, payloads, firsts)
    return kernels.lazy(group.compiled, payloads, firsts)


def _passes(plan: list[Group]) -> list[list[Group]]:
    """The groups in parts of at most BROADCAST_STATES states; a group by itself is smaller."""
    out: list[list[Group]] = [[]]
    room = BROADCAST_STATES
    for group in plan:
        n = len(group.compiled.names)
        if out[-1] and n > room:
            out.append([])
            room = BROADCAST_STATES
        out[-1].append(group)
        room -= n
    return out


def scan(cut: DataFrame, plan: list[Group]) -> DataFrame:
    """Reports of segments: every task runs all groups over its batches, so payloads are not copied by group.

    A report is made once, because segments part the offsets and groups part the states; nothing is
    shuffled.
    """
    passes = [_scan(cut, part) for part in _passes(plan)]
    return reduce(DataFrame.unionByName, passes)


def _scan(cut: DataFrame, plan: list[Group]) -> DataFrame:
    shared = cut.sparkSession.sparkContext.broadcast(plan)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, bases = batch.column(0).to_pylist(), np.array(batch.column(1).to_pylist(), np.int64)
            firsts, payloads = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for group in shared.value:
                for segs, offs, local in _hits(group, payloads, firsts):
                    for i in range(0, len(segs), 50_000):
                        yield _columns(group, segs[i : i + 50_000], offs[i : i + 50_000], local[i : i + 50_000], ids, bases)

    return cut.select("stream_id", "base", "first", "payload").mapInArrow(run, REPORTS)


def _names(spark, plan: list[Group]) -> DataFrame:
    rows = [
        (g, s, x.compiled.nfa_id, state, original, code, cc, x.compiled.group_id)
        for g, x in enumerate(plan)
        for s, (state, original, code, cc) in enumerate(x.compiled.names)
        if x.compiled.report >> s & 1
    ]
    return spark.createDataFrame(rows, "g int, s int, nfa_id string, state_id int, original_id string, report_code string, cc_id int, group_id int")


def _relational(cut: DataFrame, plan: list[Group], k: int, ranges: bool) -> DataFrame:
    """By joins where a group has no cycle; with one, a match could stay alive to the end, and the kernel takes the group."""
    cyclic, plan = [x for x in plan if x.dag < 2], [x for x in plan if x.dag == 2]
    if not plan:
        return scan(cut, cyclic)
    found = relational.match(cut, [x.compiled for x in plan], False, k, keep=keep, ranges=ranges)
    names = _names(cut.sparkSession, plan)
    out = found.join(F.broadcast(names), ["g", "s"]).withColumn("offset", F.col("base") + F.col("pos"))
    out = out.select(*[x.split()[0] for x in REPORTS.split(", ")])
    return out.unionByName(scan(cut, cyclic)) if cyclic else out


def _folded(cut: DataFrame, plan: list[Group]) -> DataFrame:
    """By folds in the JVM where a group's table is small, else by the kernel."""
    small = lambda x: x.table is not None and x.table.next.size <= fold.FOLD_ENTRIES
    mine, rest = [x for x in plan if small(x)], [x for x in plan if not small(x)]
    if not mine:
        return scan(cut, plan)
    found = reduce(DataFrame.unionByName, [fold.match(cut, x.table, g) for g, x in enumerate(mine)])
    out = found.join(F.broadcast(_names(cut.sparkSession, mine)), ["g", "s"]).withColumn("offset", F.col("base") + F.col("pos"))
    out = out.select(*[x.split()[0] for x in REPORTS.split(", ")])
    return out.unionByName(scan(cut, rest)) if rest else out


def _exact(streams: DataFrame, plan: list[Group], segment_bytes: int, replicas: int, tail: str) -> DataFrame:
    """As if the stream were not cut.

    Groups without cycles look back a bounded number of bytes: their segments are given that much of
    what came before, and what they report there is left out. With cycles a segment begins in the row of the table that the ones
    before lead to. The strategy is not asked: kernels do both.
    """
    size = F.octet_length("payload").cast("long") * replicas
    end = size if tail == "keep" else F.floor(size / segment_bytes) * segment_bytes
    whole = streams.select("stream_id", sources.repeated(F.col("payload"), replicas).alias("payload"), end.alias("end"))
    back = max([x.compiled.longest for x in plan], default=1) - 1
    count = F.ceil(F.col("end") / segment_bytes).cast("long")
    ids = F.when(count > 0, F.sequence(F.lit(0).cast("long"), count - 1))
    rows = whole.select("*", F.explode(ids).alias("seg")).withColumn("own", F.col("seg") * segment_bytes)
    base = F.greatest(F.col("own") - max(back, 0), F.lit(0).cast("long"))
    upto = F.least(F.col("own") + segment_bytes, F.col("end"))
    data = F.substring("payload", (base + 1).cast("int"), (upto - base).cast("int"))
    rows = rows.select("stream_id", "own", base.alias("base"), (base == 0).alias("first"), data.alias("payload"))
    if segment_bytes >= LARGE_SEGMENT:
        rows = rows.repartition("stream_id", "own")
    return _over_ranges(rows, plan)


def _over_ranges(rows: DataFrame, plan: list[Group]) -> DataFrame:
    """Reports of streams that are cut into ranges (stream_id, own, base, first, payload), as if they were not.

    Three kinds of groups: those without cycles, whose ranges have to overlap by their longest match; those with a table, whose ranges are functions
    of its rows; and others, whose streams are put together, one a task.
    """
    bounded = [x for x in plan if x.compiled.longest]
    tables = [x for x in plan if not x.compiled.longest and x.table is not None and not x.cold]
    others = [x for x in plan if not x.compiled.longest and (x.table is None or x.cold)]
    parts = []
    if bounded:
        need = max(x.compiled.longest for x in bounded) - 1
        short = F.raise_error(F.lit(f"ranges overlap by less than the {need} bytes that a match can begin before its range"))
        enough = F.col("own") - F.col("base") >= F.least(F.col("own"), F.lit(need))
        checked = rows.withColumn("base", F.when(enough, F.col("base")).otherwise(short.cast("long")))
        parts += [_trimmed(checked, part) for part in _passes(bounded)]
    if tables:
        own = rows.select("stream_id", "own", F.substring(F.col("payload"), (F.col("own") - F.col("base") + 1).cast("int"), F.octet_length("payload")).alias("payload"))
        parts += [_by_functions(own, part) for part in _passes(tables)]
    if others:
        in_order = F.array_sort(F.collect_list(F.struct("own", "payload")), lambda a, b: F.when(a["own"] < b["own"], -1).otherwise(1))
        own = rows.withColumn("payload", F.substring(F.col("payload"), (F.col("own") - F.col("base") + 1).cast("int"), F.octet_length("payload")))
        joined = F.unhex(F.array_join(F.transform(in_order, lambda x: F.hex(x["payload"])), ""))
        one = own.groupBy("stream_id").agg(joined.alias("payload")).select("stream_id", F.lit(0).cast("long").alias("base"), F.lit(True).alias("first"), "payload")
        parts.append(scan(one, others))
    return reduce(DataFrame.unionByName, parts) if parts else scan(rows.limit(0).select("stream_id", "base", "first", "payload"), plan)


def _by_functions(rows: DataFrame, plan: list[Group]) -> DataFrame:
    """Reports of ranges (stream_id, own, payload) of groups with cycles, by their tables.

    A range is a function from the rows of a table to its rows. Functions are composed in blocks of ``COMPOSED``, the blocks' ones in blocks again,
    until a stream is one block, and the way back gives each range the row that it begins in. Then every range is scanned by itself.
    """
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(plan)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            payloads = batch.column(2).to_pylist()
            for g, group in enumerate(shared.value):
                made = kernels.functions(group.table, payloads)
                yield pa.RecordBatch.from_arrays([pa.array([g] * len(payloads), pa.int32()), batch.column(0), batch.column(1), pa.array(list(made), pa.list_(pa.int32()))], ["g", "stream_id", "own", "f"])

    kind = "g int, stream_id string, own long, f array<int>"
    found = rows.mapInArrow(make, kind)
    place = F.row_number().over(Window.partitionBy("g", "stream_id").orderBy("own")) - 1  # ranges of a stream, without their bytes
    tiers = [keep(found.withColumn("place", place.cast("long")).select("g", "stream_id", "own", "place", "f"))]
    while tiers[-1].where("place > 0").take(1):
        blocks = tiers[-1].withColumn("block", F.floor(F.col("place") / COMPOSED)).groupBy("g", "stream_id", "block")
        tiers.append(keep(blocks.applyInArrow(_composed, "g int, stream_id string, own long, place long, f array<int>")))
    first = [x.table.first for x in plan]
    begin = tiers[-1].select("g", "stream_id", "own", "place", F.element_at(F.array(*map(F.lit, first)), F.col("g") + 1).alias("row"))
    for tier in reversed(tiers[:-1]):
        inner = tier.withColumn("block", F.floor(F.col("place") / COMPOSED)).groupBy("g", "stream_id", "block")
        above = begin.select("g", "stream_id", F.col("place").alias("block"), "row").groupBy("g", "stream_id", "block")
        begin = keep(inner.cogroup(above).applyInArrow(_descended, "g int, stream_id string, own long, place long, row int"))
    starts = begin.groupBy("stream_id", "own").agg(F.map_from_entries(F.collect_list(F.struct("g", "row"))).alias("starts"))
    ready = rows.join(starts, ["stream_id", "own"]).select("stream_id", "own", "payload", F.transform(F.sequence(F.lit(0), F.lit(len(plan) - 1)), lambda g: F.element_at("starts", g)).alias("rows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, bases, payloads = batch.column(0).to_pylist(), np.array(batch.column(1).to_pylist(), np.int64), batch.column(2).to_pylist()
            begins = batch.column(3).to_pylist()
            for g, group in enumerate(shared.value):
                for segs, offs, local in kernels.lock_step(group.table, 0, payloads, [], [x[g] for x in begins]):
                    for i in range(0, len(segs), 50_000):
                        yield _columns(group, segs[i : i + 50_000], offs[i : i + 50_000], local[i : i + 50_000], ids, bases)

    return ready.mapInArrow(run, REPORTS)


def _functions(table: pa.Table) -> list[np.ndarray]:
    column = table.column("f").combine_chunks()
    return list(column.flatten().to_numpy().reshape(len(column), -1))


def _composed(table: pa.Table) -> pa.Table:
    """A block's function."""
    table = table.sort_by("place")
    made = _functions(table)
    now = made[0]
    for f in made[1:]:
        now = f[now]
    first = {c: table.column(c).slice(0, 1) for c in ("g", "stream_id", "own")}
    return pa.table({**first, "place": table.column("block").slice(0, 1).cast(pa.int64()), "f": pa.array([now], pa.list_(pa.int32()))})


def _descended(table: pa.Table, above: pa.Table) -> pa.Table:
    """The row that each member of a block begins in, from the row that the block begins in."""
    table = table.sort_by("place")
    now, rows = above.column("row")[0].as_py(), []
    for f in _functions(table):
        rows.append(now)
        now = int(f[now])
    return pa.table({**{c: table.column(c) for c in ("g", "stream_id", "own", "place")}, "row": pa.array(rows, pa.int32())})


def _trimmed(rows: DataFrame, plan: list[Group]) -> DataFrame:
    """Reports at own offsets only. A segment's own part starts where the one before it ends."""
    shared = rows.sparkSession.sparkContext.broadcast(plan)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, own, bases, firsts, payloads = (batch.column(i).to_pylist() for i in range(5))
            own, bases = np.array(own, np.int64), np.array(bases, np.int64)
            for group in shared.value:
                for segs, offs, local in _hits(group, payloads, firsts):
                    mine = bases[segs] + offs >= own[segs]
                    yield _columns(group, segs[mine], offs[mine], local[mine], ids, bases)

    return rows.mapInArrow(run, REPORTS)


def state_profile(states, edges, streams: DataFrame, *, compat: bool = False, segment_bytes: int | None = None) -> DataFrame:
    """How often each state is active over the streams: nfa_id, state_id, original_id, activations.

    compat counts start states as active before each byte, matched or not; otherwise a state is active
    where it matches.
    """
    automata = from_frames(states, edges) if isinstance(states, DataFrame) else [states]
    plan = planner.plan(automata)
    if compat and any(isinstance(x.compiled, Sparse) for x in plan):
        raise ValueError(f"compat counts are for components of at most {planner.MASK_STATES} states")
    compats = [kernels.compat_table(x.compiled, planner.TABLE_ROWS) if compat else None for x in plan]
    cut = sources.segments(streams, segment_bytes, tail="keep")
    shared = cut.sparkSession.sparkContext.broadcast(list(zip(plan, compats)))

    def one(group: Group, table: Table | None, payloads: list[bytes], firsts: list[bool]) -> np.ndarray:
        c = group.compiled
        if isinstance(c, Sparse):
            return kernels.sparse_profile(c, payloads, firsts)[0]
        if compat and table is not None:
            return kernels.compat_by_table(c, table, payloads, firsts)
        if not compat and group.table is not None:
            return kernels.profile_by_table(c, group.table, payloads, firsts)
        return kernels.profile(c, payloads, firsts, compat)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [np.zeros(len(x.compiled.names), np.int64) for x, _ in shared.value]
        for batch in batches:
            firsts, payloads = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for total, (group, table) in zip(totals, shared.value):
                total += one(group, table, payloads, firsts)
        rows = [
            (g.compiled.nfa_id, name[0], name[1], int(n)) for total, (g, _) in zip(totals, shared.value) for name, n in zip(g.compiled.names, total)
        ]
        nfa, number, original, n = zip(*rows) if rows else ((),) * 4
        yield pa.RecordBatch.from_arrays(
            [pa.array(nfa, pa.string()), pa.array(number, pa.int32()), pa.array(original, pa.string()), pa.array(n, pa.int64())],
            ["nfa_id", "state_id", "original_id", "n"],
        )

    counts = cut.select("first", "payload").mapInArrow(run, "nfa_id string, state_id int, original_id string, n long")
    return counts.groupBy("nfa_id", "state_id", "original_id").agg(F.sum("n").alias("activations"))


def frontier_profile(states, edges, streams: DataFrame) -> DataFrame:
    """How many states match at each position, as a histogram: nfa_id, group_id, size, positions."""
    automata = from_frames(states, edges) if isinstance(states, DataFrame) else [states]
    plan = planner.plan(automata, strategy="arrow")
    for x in plan:  # a group stays one, as its sizes are those of all its states
        x.table = None if isinstance(x.compiled, Sparse) else determinise(x.compiled, planner.TABLE_ROWS)
    cut = sources.segments(streams)
    shared = cut.sparkSession.sparkContext.broadcast(plan)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, int, int], int] = {}
        for batch in batches:
            firsts, payloads = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for g in shared.value:
                c = g.compiled
                if isinstance(c, Sparse):
                    sizes = kernels.sparse_profile(c, payloads, firsts)[1].items()
                elif g.table is not None:
                    sizes = [(mask.bit_count(), n) for mask, n in kernels.matched_states(c, g.table, kernels.visits(g.table, c.longest, payloads, firsts))]
                else:
                    sizes = [(size, 1) for first, payload in zip(firsts, payloads) for size in kernels.frontier(c, payload, first)]
                for size, n in sizes:
                    key = c.nfa_id, c.group_id, size
                    seen[key] = seen.get(key, 0) + n
        columns = list(zip(*[(*k, n) for k, n in seen.items()])) or [()] * 4
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["nfa_id", "group_id", "size", "positions"])

    rows = cut.select("first", "payload").mapInArrow(run, "nfa_id string, group_id int, size int, positions long")
    return rows.groupBy("nfa_id", "group_id", "size").agg(F.sum("positions").alias("positions"))
