"""The automaton: tables for Spark, an object for the driver, and the form that kernels run.

An automaton is homogeneous: bytes are matched on states, edges carry none. The tables are

    states: nfa_id, state_id, str_id, original_id, symbol_set, symbol_set_str, start_kind, is_report, report_code
    edges:  nfa_id, src, dst
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from automill.functions import symbolset

STATES = (
    "nfa_id string, state_id int, str_id string, original_id string, symbol_set binary, symbol_set_str string, "
    "start_kind tinyint, is_report boolean, report_code string"
)
EDGES = "nfa_id string, src int, dst int"
SEGMENTS = "stream_id string, seg_id int, base bigint, first boolean, payload binary"
REPORTS = (
    "nfa_id string, stream_id string, offset bigint, state_id int, original_id string, report_code string, cc_id int, group_id int"
)

#: Start kinds.
NONE, START_OF_DATA, ALL_INPUT = 0, 1, 2
START_KINDS = {"start-of-data": START_OF_DATA, "all-input": ALL_INPUT}


class AutomatonError(ValueError):
    """An automaton that breaks a rule of the model."""


@dataclass
class State:
    str_id: str
    symbols: int
    start: int = NONE
    report: bool = False
    code: str | None = None
    original_id: str = ""
    symbol_str: str = ""

    def __post_init__(self):
        self.original_id = self.original_id or self.str_id


@dataclass
class Automaton:
    """States in order of their ids, and for each the ordered set of its successors."""

    nfa_id: str = "nfa"
    states: list[State] = field(default_factory=list)
    succ: list[list[int]] = field(default_factory=list)

    def __len__(self) -> int:
        return len(self.states)

    @property
    def index(self) -> dict[str, int]:
        return {s.str_id: i for i, s in enumerate(self.states)}

    def edges(self) -> list[tuple[int, int]]:
        return [(a, b) for a, out in enumerate(self.succ) for b in out]

    def pred(self) -> list[list[int]]:
        out: list[list[int]] = [[] for _ in self.states]
        for a, b in self.edges():
            out[b].append(a)
        return out

    def add_state(self, state: State) -> int:
        self.states.append(state)
        self.succ.append([])
        return len(self.states) - 1

    def add_edge(self, a: int, b: int) -> None:
        """Edges are a set: adding one twice changes nothing."""
        if b not in self.succ[a]:
            self.succ[a].append(b)

    def starts(self) -> list[int]:
        return [i for i, s in enumerate(self.states) if s.start]

    def copy(self, nfa_id: str | None = None) -> Automaton:
        return Automaton(nfa_id or self.nfa_id, [replace(s) for s in self.states], [list(x) for x in self.succ])

    def part(self, keep: Iterable[int], nfa_id: str | None = None) -> Automaton:
        """The subgraph of some states, renumbered in the given order."""
        order = list(keep)
        new = {old: k for k, old in enumerate(order)}
        succ = [[new[b] for b in self.succ[old] if b in new] for old in order]
        return Automaton(nfa_id or self.nfa_id, [replace(self.states[old]) for old in order], succ)


def build(nfa_id: str, states: Iterable[dict], edges: Iterable[tuple[str, str]]) -> Automaton:
    """From dicts (id, symbols as a class, start, report, code) and edges between ids; undeclared ids are errors."""
    out = Automaton(nfa_id)
    for s in states:
        symbols = s.get("symbols", "")
        out.add_state(
            State(s["id"], symbolset.parse(symbols), START_KINDS.get(s.get("start") or "", NONE), bool(s.get("report") or s.get("code") is not None), s.get("code"), symbol_str=symbols)
        )
    index = out.index
    if len(index) != len(out):
        raise AutomatonError(f"{nfa_id}: a state id occurs twice")
    for a, b in edges:
        if a not in index or b not in index:
            raise AutomatonError(f"{nfa_id}: edge {a} -> {b} to a state that isn't declared")
        out.add_edge(index[a], index[b])
    return out


def keywords(nfa_id: str, words: Iterable[str | bytes], start: str = "all-input", codes: Iterable[str] | None = None) -> Automaton:
    """A chain of states for each keyword, which reports at its last byte."""
    states, edges = [], []
    words = list(words)
    for k, (word, code) in enumerate(zip(words, codes or map(str, range(len(words))))):
        data = word.encode() if isinstance(word, str) else word
        for j, b in enumerate(data):
            last = j == len(data) - 1
            states.append({"id": f"k{k}_{j}", "symbols": f"[\\x{b:02x}]", "start": start if j == 0 else None, "report": last, "code": code if last else None})
            if j:
                edges.append((f"k{k}_{j - 1}", f"k{k}_{j}"))
    return build(nfa_id, states, edges)


def to_frames(spark: SparkSession, *automata: Automaton) -> tuple[DataFrame, DataFrame]:
    """The tables of states and edges."""
    rows = [
        (a.nfa_id, i, s.str_id, s.original_id, bytearray(symbolset.to_bytes(s.symbols)), s.symbol_str or symbolset.to_class(s.symbols), s.start, s.report, s.code)
        for a in automata
        for i, s in enumerate(a.states)
    ]
    edges = [(a.nfa_id, x, y) for a in automata for x, y in a.edges()]
    return spark.createDataFrame(rows, STATES), spark.createDataFrame(edges, EDGES)


#: States that are brought to the driver to be compiled, at most.
MAX_STATES = 5_000_000


def from_frames(states: DataFrame, edges: DataFrame) -> list[Automaton]:
    """The automata of the tables, by nfa_id. Their number of states is checked before they are collected."""
    n = states.count()
    if n > MAX_STATES:
        raise AutomatonError(f"{n} states are more than the {MAX_STATES} that may be compiled at once; match them by parts")
    out: dict[str, Automaton] = {}
    numbers: dict[str, dict[int, int]] = defaultdict(dict)
    for r in sorted(states.collect(), key=lambda r: (r.nfa_id, r.state_id)):
        a = out.setdefault(r.nfa_id, Automaton(r.nfa_id))
        if r.state_id in numbers[r.nfa_id]:
            raise AutomatonError(f"{r.nfa_id}: state {r.state_id} occurs twice")
        numbers[r.nfa_id][r.state_id] = a.add_state(
            State(r.str_id, symbolset.from_bytes(bytes(r.symbol_set or b"")), r.start_kind, r.is_report, r.report_code, r.original_id, r.symbol_set_str or "")
        )
    for r in sorted(edges.distinct().collect()):
        known = numbers.get(r.nfa_id, {})
        if r.src not in known or r.dst not in known:
            raise AutomatonError(f"{r.nfa_id}: edge {r.src} -> {r.dst} to a state that isn't declared")
        out[r.nfa_id].add_edge(known[r.src], known[r.dst])
    return list(out.values())


@dataclass
class Compiled:
    """A group of components as integer masks: bit s stands for local state s."""

    nfa_id: str
    group_id: int
    match: list[int]
    succ: list[int]
    all_input: int
    start_of_data: int
    report: int
    #: Of each local state: state id, original id, report code, component.
    names: list[tuple[int, str, str | None, int]]
    #: Longest path in bytes, or 0 if a cycle is there.
    longest: int

    def hot_part(self, hot: int) -> tuple[Compiled, int] | None:
        """The part without cold states, and the mask of these; None where one of the two is empty.

        Cold is what is not in the mask hot, and what a cold state leads into. All-input states are always hot, as they are
        enabled whatever leads into them. What leads from a hot state to a cold one is marked as a report is.
        """
        everything = (1 << len(self.names)) - 1
        cold = everything & ~(hot | self.all_input)
        grown = 0
        while grown != cold:
            grown = cold
            for s, out in enumerate(self.succ):
                if grown >> s & 1:
                    cold |= out & ~self.all_input
        inside = everything & ~cold
        if not cold or not inside:
            return None
        crossing = sum(1 << s for s, out in enumerate(self.succ) if inside >> s & 1 and out & cold)
        part = Compiled(
            self.nfa_id, self.group_id, [m & inside for m in self.match], [x & inside for x in self.succ], self.all_input,
            self.start_of_data & inside, self.report & inside | crossing, self.names, self.longest,
        )
        return part, cold

    def step(self, enabled: int, byte: int) -> tuple[int, int]:
        """States matched on the byte, and the states enabled next."""
        matched = enabled & self.match[byte]
        after, rest = self.all_input, matched
        while rest:
            low = rest & -rest
            after |= self.succ[low.bit_length() - 1]
            rest ^= low
        return matched, after


@dataclass
class Sparse:
    """A group that is too large for masks: successors as one array with offsets, sets of bytes as rows of 32 bytes."""

    nfa_id: str
    group_id: int
    sets: np.ndarray
    offsets: np.ndarray
    targets: np.ndarray
    all_input: np.ndarray
    start_of_data: np.ndarray
    report: np.ndarray
    names: list[tuple[int, str, str | None, int]]
    longest: int

    def successors(self, s: int) -> np.ndarray:
        return self.targets[self.offsets[s] : self.offsets[s + 1]]


def compile_sparse(a: Automaton, members: list[int], components: list[int], group_id: int) -> Sparse:
    """What compile_group makes, in memory in proportion to states and edges."""
    local = {s: k for k, s in enumerate(members)}
    after = [sorted(local[b] for b in set(a.succ[s])) for s in members]
    where = lambda test: np.array([k for k, s in enumerate(members) if test(a.states[s])], np.int32)
    return Sparse(
        a.nfa_id,
        group_id,
        np.frombuffer(b"".join(symbolset.to_bytes(a.states[s].symbols) for s in members), np.uint8).reshape(-1, 32),
        np.append(0, np.cumsum([len(x) for x in after])),
        np.array([b for x in after for b in x], np.int32),
        where(lambda x: x.start == ALL_INPUT),
        where(lambda x: x.start == START_OF_DATA),
        where(lambda x: x.report),
        [(s, a.states[s].original_id, a.states[s].code, components[s]) for s in members],
        longest_path(a, members),
    )


def compile_group(a: Automaton, members: list[int], components: list[int], group_id: int) -> Compiled:
    local = {s: k for k, s in enumerate(members)}
    match = [0] * 256
    for k, s in enumerate(members):
        for b in symbolset.members(a.states[s].symbols):
            match[b] |= 1 << k
    mask = lambda test: sum(1 << k for k, s in enumerate(members) if test(a.states[s]))
    return Compiled(
        a.nfa_id,
        group_id,
        match,
        [sum(1 << local[b] for b in set(a.succ[s])) for s in members],
        mask(lambda x: x.start == ALL_INPUT),
        mask(lambda x: x.start == START_OF_DATA),
        mask(lambda x: x.report),
        [(s, a.states[s].original_id, a.states[s].code, components[s]) for s in members],
        longest_path(a, members),
    )


def longest_path(a: Automaton, members: list[int]) -> int:
    """States on the longest path within members; 0 if there is a cycle."""
    inside = set(members)
    degree = {s: 0 for s in members}
    for s in members:
        for b in a.succ[s]:
            if b in inside:
                degree[b] += 1
    depth = {s: 1 for s in members}
    ready, seen = [s for s in members if not degree[s]], 0
    while ready:
        s = ready.pop()
        seen += 1
        for b in a.succ[s]:
            if b in inside:
                depth[b] = max(depth[b], depth[s] + 1)
                degree[b] -= 1
                if not degree[b]:
                    ready.append(b)
    return max(depth.values(), default=0) if seen == len(members) else 0


@dataclass
class Table:
    """A deterministic table: rows are sets of enabled states, columns classes of bytes that no state tells apart."""

    classes: np.ndarray
    next: np.ndarray
    #: Per (row, class) the number of a report set; 0 is none.
    reports: np.ndarray
    report_sets: list[list[int]]
    #: Row of the first byte of a stream, and of a later segment.
    first: int
    later: int
    #: The set that each row stands for, and a byte of each class.
    masks: list[int] = field(default_factory=list)
    bytes_of: list[int] = field(default_factory=list)


def determinise(c: Compiled, limit: int, step: Callable[[int, int], tuple[int, int]] | None = None) -> Table | None:
    """All rows that can be reached, or None if they are more than ``limit``. step: (matched, next) of a set and a byte, if not the automaton's own."""
    step = step or c.step
    kinds: dict[int, int] = {}
    classes = np.array([kinds.setdefault(m, len(kinds)) for m in c.match], np.int64)
    bytes_of = {k: b for b, k in reversed(list(enumerate(classes.tolist())))}
    rows: dict[int, int] = {}
    order: list[int] = []

    def row(enabled: int) -> int:
        if enabled not in rows:
            rows[enabled] = len(order)
            order.append(enabled)
        return rows[enabled]

    first, later = row(c.all_input | c.start_of_data), row(c.all_input)
    sets: dict[int, int] = {0: 0}
    nexts, reports = [], []
    done = 0
    while done < len(order):
        if len(order) > limit:
            return None
        for k in range(len(kinds)):
            matched, after = step(order[done], bytes_of[k])
            nexts.append(row(after))
            reports.append(sets.setdefault(matched & c.report, len(sets)))
        done += 1
    report_sets = [[k for k in range(len(c.names)) if m >> k & 1] for m in sets]
    shape = (len(order), len(kinds))
    return Table(classes, np.array(nexts, np.int32).reshape(shape), np.array(reports, np.int32).reshape(shape), report_sets, first, later, order, [bytes_of[k] for k in range(len(kinds))])
