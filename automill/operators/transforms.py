"""Transforms of automata. On tables where a join says it, on the driver's object where order matters."""

from __future__ import annotations

import random
from collections.abc import Callable, Iterable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from automill.functions import symbolset
from automill.model import ALL_INPUT, NONE, Automaton, AutomatonError, State
from automill.operators import graph
from automill.operators.numbering import ranked
from automill.operators.scratch import keep as _keep

# On tables.


def add_states(states: DataFrame, more: DataFrame) -> DataFrame:
    return states.unionByName(more)


def add_edges(edges: DataFrame, more: DataFrame) -> DataFrame:
    """Edges are a set."""
    return edges.unionByName(more).distinct()


def remove_edges(edges: DataFrame, gone: DataFrame) -> DataFrame:
    return edges.join(gone, ["nfa_id", "src", "dst"], "left_anti")


def remove_states(states: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without the states (nfa_id, state_id) and the edges at them."""
    left = states.join(gone, ["nfa_id", "state_id"], "left_anti")
    for end in ("src", "dst"):
        edges = edges.join(gone.withColumnRenamed("state_id", end), ["nfa_id", end], "left_anti")
    return left, edges.select("nfa_id", "src", "dst")


def induced(states: DataFrame, edges: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The subgraph of the states (nfa_id, state_id), with their old numbers."""
    for end in ("src", "dst"):
        edges = edges.join(wanted.withColumnRenamed("state_id", end), ["nfa_id", end], "left_semi")
    return states.join(wanted, ["nfa_id", "state_id"], "left_semi"), edges.select("nfa_id", "src", "dst")


def component_table(states: DataFrame, edges: DataFrame, keep: Callable[[DataFrame], DataFrame], max_rounds: int = 10_000) -> DataFrame:
    """nfa_id, state_id and cc_root, the lowest state of the component, for automata of any size.

    Every round takes the lowest label around each state, then that label's own label, so long chains
    take a logarithmic number of rounds. keep cuts the lineage.
    """
    both = keep(edges.select("nfa_id", "src", "dst").union(edges.select("nfa_id", F.col("dst"), F.col("src"))).distinct())
    labels = keep(states.select("nfa_id", "state_id", F.col("state_id").alias("cc_root")))
    for _ in range(max_rounds):
        near = both.join(labels.withColumnRenamed("state_id", "dst"), ["nfa_id", "dst"]).groupBy("nfa_id", F.col("src").alias("state_id")).agg(F.min("cc_root").alias("near"))
        new = labels.join(near, ["nfa_id", "state_id"], "left").withColumn("mid", F.least("cc_root", "near"))
        up = labels.select("nfa_id", F.col("state_id").alias("mid"), F.col("cc_root").alias("up"))
        new = keep(new.join(up, ["nfa_id", "mid"]).select("nfa_id", "state_id", F.col("cc_root").alias("was"), F.least("mid", "up").alias("cc_root")))
        labels_done = new.where("was <> cc_root").isEmpty()
        labels = new.select("nfa_id", "state_id", "cc_root")
        if labels_done:
            return labels
    raise AutomatonError(f"components did not settle in {max_rounds} rounds")


def with_components(labels: DataFrame, keep: Callable[[DataFrame], DataFrame] = _keep) -> DataFrame:
    """cc_id (numbered by lowest state) and cc_local_id of component_table's rows."""
    roots = ranked(labels.where("state_id = cc_root").select("nfa_id", "cc_root"), ["nfa_id"], [F.col("cc_root")], keep, "cc_id")
    inside = ranked(labels.select("nfa_id", "cc_root", "state_id"), ["nfa_id", "cc_root"], [F.col("state_id")], keep, "cc_local_id")
    as_int = [F.col(c).cast("int").alias(c) for c in ("cc_id", "cc_local_id")]
    return inside.join(roots, ["nfa_id", "cc_root"]).select("nfa_id", "state_id", *as_int)


def small_components(labels: DataFrame, max_states: int) -> DataFrame:
    """The rows of components of at most so many states; labels has nfa_id, state_id, cc_id."""
    small = labels.groupBy("nfa_id", "cc_id").count().where(F.col("count") <= max_states)
    return labels.join(small, ["nfa_id", "cc_id"], "left_semi")


def one_component(labels: DataFrame, cc_id: int | None = None, state_id: int | None = None) -> DataFrame:
    """The rows of one component, by its id or by one of its states."""
    if cc_id is not None:
        return labels.where(F.col("cc_id") == cc_id)
    having = labels.where(F.col("state_id") == state_id).select("nfa_id", "cc_id")
    return labels.join(having, ["nfa_id", "cc_id"], "left_semi")


def split_table(states: DataFrame, edges: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every component as an automaton of its own, ``<nfa_id>#<cc_id>``; labels has nfa_id, state_id, cc_id and cc_local_id."""
    name = F.concat_ws("#", "nfa_id", "cc_id")
    key = ["nfa_id", "state_id"]
    places = labels.select(*key, name.alias("part"), F.col("cc_local_id").cast("int").alias("local"))
    out = states.join(places, key).withColumn("nfa_id", F.col("part")).withColumn("state_id", F.col("local")).drop("part", "local")
    for end in ("src", "dst"):
        ends = places.select("nfa_id", F.col("state_id").alias(end), F.col("local").alias(f"{end}_local"), *(["part"] if end == "src" else []))
        edges = edges.join(ends, ["nfa_id", end])
    return out.select(states.columns), edges.select(F.col("part").alias("nfa_id"), F.col("src_local").alias("src"), F.col("dst_local").alias("dst"))


def cut_table_by_depth(states: DataFrame, edges: DataFrame, labels: DataFrame, limit: float) -> tuple[DataFrame, DataFrame]:
    """The states whose topological layer is below that share of the depth of their component, with their old numbers."""
    depth = labels.groupBy("nfa_id", "cc_id").agg((F.max("topo_order") + 1).alias("depth"))
    near = labels.join(depth, ["nfa_id", "cc_id"]).where(F.col("topo_order") / F.col("depth") < limit)
    return induced(states, edges, near.select("nfa_id", "state_id"))


def merge(states: DataFrame, edges: DataFrame, nfa_id: str) -> tuple[DataFrame, DataFrame]:
    """All automata as one, renumbered in order of (nfa_id, state_id); ids of states stay."""
    numbers = ranked(states.select("nfa_id", "state_id"), [], [F.col("nfa_id"), F.col("state_id")], _keep, "new")
    numbers = _keep(numbers.withColumn("new", F.col("new").cast("int")))
    out = states.join(numbers, ["nfa_id", "state_id"]).withColumn("state_id", F.col("new")).withColumn("nfa_id", F.lit(nfa_id)).drop("new")
    for end in ("src", "dst"):
        edges = edges.join(numbers.withColumnRenamed("state_id", end), ["nfa_id", end]).drop(end).withColumnRenamed("new", end)
    return out.select(states.columns), edges.select(F.lit(nfa_id).alias("nfa_id"), "src", "dst")


def renumber(states: DataFrame, edges: DataFrame, *order: Column, boundary: int | None = None) -> tuple[DataFrame, DataFrame]:
    """States numbered in another order within each automaton; ties keep the old order.

    boundary: only the first so many places are given out by the order, the other states follow as they were.
    """
    numbers = ranked(states, ["nfa_id"], [*order, F.col("state_id")], _keep)
    if boundary is not None:
        numbers = numbers.withColumn("late", F.col("rank") >= boundary)
        place = F.when(F.col("late"), F.col("state_id").cast("long")).otherwise(F.col("place"))
        numbers = ranked(numbers.withColumnRenamed("rank", "place"), ["nfa_id"], [F.col("late"), place], _keep)
    numbers = _keep(numbers.select("nfa_id", "state_id", F.col("rank").cast("int").alias("rank")))
    out = states.join(numbers, ["nfa_id", "state_id"]).withColumn("state_id", F.col("rank")).drop("rank")
    for end in ("src", "dst"):
        edges = edges.join(numbers.withColumnRenamed("state_id", end), ["nfa_id", end]).drop(end).withColumnRenamed("rank", end)
    return out.select(states.columns), edges.select("nfa_id", "src", "dst")


#: Orders of renumber by name. The states need the columns that are named.
ORDERS: dict[str, Callable[[], list[Column]]] = {
    "NONE": lambda: [],
    "REPORT": lambda: [F.col("is_report").desc()],
    "TOPO_ORDER": lambda: [F.col("topo_order")],
    "OUTDEGREE": lambda: [F.col("out_degree").desc()],
    "BFS_LAYER": lambda: [F.col("bfs_layer")],
    "COMPLETE": lambda: [F.col("complete").desc()],
    "COMPLETE_AND_TOP": lambda: [F.col("complete").desc(), F.col("topo_order")],
    "COMPLETE_AND_BFS": lambda: [F.col("complete").desc(), F.col("bfs_layer")],
    "HOT_DEGREE": lambda: [F.col("hot_degree").desc()],
}


def pack_components(sizes: DataFrame, policy: int, frequencies: DataFrame | None = None, seed: int = 0) -> DataFrame:
    """An order of components (nfa_id, cc_id, n): 0 as they are, 1 random, 2 by activation ratio, 3 by ratio per state.

    frequencies has nfa_id, cc_id and ratio. Adds the column place, from 0.
    """
    if policy in (2, 3):
        sizes = sizes.join(frequencies, ["nfa_id", "cc_id"], "left").fillna(0.0, ["ratio"])
    order = {
        0: [F.col("cc_id")],
        1: [F.xxhash64(F.lit(seed), "cc_id"), F.col("cc_id")],
        2: [F.col("ratio").desc(), F.col("cc_id")] if policy == 2 else [],
        3: [(F.col("ratio") / F.col("n")).desc(), F.col("cc_id")] if policy == 3 else [],
    }[policy]
    return sizes.withColumn("place", F.row_number().over(Window.partitionBy("nfa_id").orderBy(*order)) - 1)


def round_robin(cc_id: Column, groups: int) -> Column:
    return F.pmod(cc_id, F.lit(groups))


def merge_every(cc_id: Column, k: int) -> Column:
    return F.floor(cc_id / k).cast("int")


# On the driver's object.


def split_components(a: Automaton) -> list[Automaton]:
    labels = graph.components(a)
    members: dict[int, list[int]] = {}
    for s, c in enumerate(labels):
        members.setdefault(c, []).append(s)
    return [a.part(m, f"{a.nfa_id}#{c}") for c, m in members.items()]


def merge_automata(parts: Iterable[Automaton], nfa_id: str) -> Automaton:
    out = Automaton(nfa_id)
    for a in parts:
        base = len(out)
        out.states += [replace(s) for s in a.states]
        out.succ += [[base + b for b in x] for x in a.succ]
    return out


def group_by_hot(parts: list[Automaton], hot: dict[str, float], capacity: int, threshold: float) -> list[list[int]]:
    """Components, in order, into groups of at most so many hot states; starts are hot whatever their degree."""
    sizes = [sum(bool(s.start) or hot.get(s.str_id, 0.0) > threshold for s in a.states) for a in parts]
    for k, n in enumerate(sizes):
        if not 0 < n <= capacity:
            raise AutomatonError(f"component {k} has {n} hot states; a group holds 1 to {capacity}")
    return graph.group_by_size(sizes, capacity, ascending=False)


def limit_out_degree(a: Automaton, limit: int = 4) -> Automaton:
    """States split until none has more than ``limit`` successors; copies are ``<id>_dup_<k>`` with the same origin.

    Each copy takes a share of the successors and all predecessors; a self loop stays on every copy and
    takes one of its places; since copies match alike, each keeps itself alive. The state with the fewest predecessors
    is split first. Raises when 2 * states rounds do not do it, as in dense graphs.
    """
    out = a.copy()
    budget = 2 * len(a)
    while True:
        wide = [s for s in range(len(out)) if len(out.succ[s]) > limit]
        if not wide:
            return out
        if budget == 0:
            raise AutomatonError(f"{a.nfa_id}: out-degrees can't be limited to {limit}")
        budget -= 1
        before = out.pred()
        s = min(wide, key=lambda x: (len(before[x]), -x))
        loop = s in out.succ[s]
        share = limit - 1 if loop else limit
        if share < 1:
            raise AutomatonError(f"{a.nfa_id}: a self loop leaves no room under a limit of {limit}")
        targets = [t for t in out.succ[s] if t != s]
        origin = out.states[s]
        copies = []
        for k in range(0, len(targets), share):
            twin = replace(origin, str_id=f"{origin.str_id}_dup_{len(copies)}")
            if copies:
                copies.append(out.add_state(twin))
            else:
                out.states[s] = twin
                copies.append(s)
            out.succ[copies[-1]] = targets[k : k + share]
        for c in copies:
            if loop:
                out.add_edge(c, c)
            if c != s:
                for p in before[s]:
                    if p != s:
                        out.add_edge(p, c)


def split_to_complete(a: Automaton, max_ranges: int = 256) -> Automaton:
    """States split into their ranges, or, where the complement has fewer, so that each part misses one range of it.

    A part of the second kind can have two ranges, one on each side of what it misses. Copies are ``<id>_mc_<k>`` with the same origin.
    Sets of more than max_ranges ranges either way stay. Copies have all neighbours of the state; with a
    self loop they follow one another, so that the language stays the same.
    """
    out = a.copy()
    for s in range(len(a)):
        symbols = a.states[s].symbols
        own, other = symbolset.ranges(symbols), symbolset.ranges(symbolset.ALL & ~symbols)
        if len(own) <= 1 or len(other) <= 1 or min(len(own), len(other)) > max_ranges:
            continue
        if len(own) <= len(other):
            sets = [symbolset.from_ranges([r]) for r in own]
        else:
            # Each part misses one range of the complement, and reaches to the ranges before and after it.
            edges = [0, *[r[1] for r in other[:-1]], 256]
            ends = [r[0] for r in other[1:]] + [256]
            sets = [symbolset.span(edges[k], ends[k] - 1) & ~symbolset.from_ranges([r]) for k, r in enumerate(other)]
        before, origin, loop = out.pred()[s], out.states[s], s in out.succ[s]
        targets = [t for t in out.succ[s] if t != s]
        copies = [s]
        out.states[s] = replace(origin, symbols=sets[0], symbol_str=symbolset.to_class(sets[0]))
        for k, part in enumerate(sets[1:], 1):
            copies.append(out.add_state(replace(origin, str_id=f"{origin.str_id}_mc_{k}", symbols=part, symbol_str=symbolset.to_class(part))))
        for c in copies:
            for t in targets:
                out.add_edge(c, t)
            for p in before:
                if p != s:
                    out.add_edge(p, c)
            for d in copies if loop else ():
                out.add_edge(c, d)
    return out


def move_starts(a: Automaton) -> Automaton:
    """Starts moved to wildcard clones ahead of them: matches begin a byte later."""
    out = a.copy()
    for s in a.starts():
        clone = out.add_state(replace(out.states[s], str_id=out.states[s].str_id + "clone", report=False, code=None, symbols=symbolset.ALL, symbol_str="*"))
        out.add_edge(clone, s)
        out.states[s].start = NONE
    return out


def one_start_each(a: Automaton) -> Automaton:
    """One all-input wildcard start ahead of each component's starts; all-input states lose their self loops.

    Start-of-data states become reachable at every position: a rewrite for engines that know one start
    only, which changes what they match.
    """
    out = a.copy()
    labels = graph.components(a)
    fake: dict[int, int] = {}
    for s in a.starts():
        if labels[s] not in fake:
            fake[labels[s]] = out.add_state(State(f"fake_start_{labels[s]}", symbolset.ALL, ALL_INPUT, symbol_str="*"))
        out.add_edge(fake[labels[s]], s)
        if a.states[s].start == ALL_INPUT and s in out.succ[s]:
            out.succ[s].remove(s)
        out.states[s].start = NONE
    return out


def clone_starts(a: Automaton) -> Automaton:
    """For each start a clone with the same start kind and successors that never reports; the original is no start."""
    out = a.copy()
    for s in a.starts():
        clone = out.add_state(replace(out.states[s], str_id=out.states[s].str_id + "_start", report=False, code=None))
        for t in a.succ[s]:
            out.add_edge(clone, t)
    return out


def cut_by_depth(a: Automaton, limit: float) -> Automaton:
    """The states whose topological layer is below that share of the depth of their component."""
    labels, layers = graph.components(a), graph.topological_layers(a)
    depth: dict[int, int] = {}
    for c, layer in zip(labels, layers):
        depth[c] = max(depth.get(c, 0), layer + 1)
    return a.part([s for s in range(len(a)) if layers[s] / depth[labels[s]] < limit])


def without_self_loops(a: Automaton) -> Automaton:
    out = a.copy()
    out.succ = [[t for t in x if t != s] for s, x in enumerate(out.succ)]
    return out


def reorder(a: Automaton, key: Callable[[int], object], boundary: int | None = None) -> Automaton:
    """States in the order of a key, stably; only the first ``boundary`` places if given."""
    order = sorted(range(len(a)), key=key)
    if boundary is not None:
        order = order[:boundary] + sorted(order[boundary:])
    return a.part(order)


def shuffle_components(parts: list[Automaton], seed: int) -> list[Automaton]:
    out = list(parts)
    random.Random(seed).shuffle(out)
    return out


def pack_compatible(sizes: list[list[int]], capacity: int) -> list[list[tuple[int, int]]]:
    """(component, group) pairs into blocks: groups of a component stay together while they fit a block.

    sizes has, per component, the number of slots of each of its compatible groups.
    """
    blocks: list[list[tuple[int, int]]] = []
    room = 0
    for c, groups in enumerate(sizes):
        need = len(groups)
        if need > capacity:
            raise AutomatonError(f"component {c} needs {need} slots; a block has {capacity}")
        if not blocks or need > room:
            blocks.append([])
            room = capacity
        blocks[-1] += [(c, g) for g in range(need)]
        room -= need
    return blocks
