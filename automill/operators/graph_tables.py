"""Graph algorithms over the tables, for automata that do not fit the driver.

All are rounds over a frontier: only vertices whose label has just changed, or pairs that are new, are joined with
the edges again. What a round leaves is written, so that plans do not grow. ``graph`` has the same for one automaton on the driver.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from automill.functions import symbolset
from automill.model import ALL_INPUT
from automill.operators.transforms import component_table, with_components

Keep = Callable[[DataFrame], DataFrame]
KEY = ["nfa_id", "state_id"]
#: Moves along edges that a round makes.
HOPS = 4


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _ends(edges: DataFrame, back: bool = False) -> DataFrame:
    """Edges as (nfa_id, state_id, to)."""
    here, there = ("dst", "src") if back else ("src", "dst")
    return edges.select("nfa_id", F.col(here).alias("state_id"), F.col(there).alias("to"))


def propagate(labels: DataFrame, edges: DataFrame, step: Column, keep: Keep) -> DataFrame:
    """Labels (nfa_id, state_id, label) at their least: along an edge a label may become ``step`` of it, where that is less.

    A round makes ``HOPS`` moves, each with the least label for each vertex, and rounds go on until nothing changes: as many as the longest of
    the shortest ways that a least label goes needs.
    """
    ends = _ends(edges)
    labels = frontier = keep(labels)
    while not frontier.isEmpty():
        sent, moves = frontier, []
        for _ in range(HOPS):
            sent = sent.join(ends, KEY).select("nfa_id", F.col("to").alias("state_id"), step.alias("label")).groupBy(*KEY).agg(F.min("label").alias("label"))
            moves.append(sent)
        new = _union(moves).groupBy(*KEY).agg(F.min("label").alias("new"))
        found = keep(labels.join(new, KEY, "left").select(*KEY, F.least("label", "new").alias("label"), (F.col("new") < F.col("label")).alias("changed")))
        labels, frontier = found.drop("changed"), found.where("changed").drop("changed")
    return labels


def strong_components(states: DataFrame, edges: DataFrame, keep: Keep) -> DataFrame:
    """nfa_id, state_id and scc_root, the lowest state of the strong component.

    A round leaves out edges from where none leads in and to where none leads out, as no cycle has them, before it walks along what is left.
    Every vertex gets the lowest vertex that reaches it and the lowest one that it reaches. Where they are the same, that is the root
    of its component. Edges between vertices that differ in either are in no component, and the rest begins anew without them; the lowest
    vertex of what is left is done in every round, and a forest in two.
    """
    left = keep(states.select(*KEY))
    moves = keep(edges.where("src <> dst").select("nfa_id", "src", "dst"))
    done: list[DataFrame] = []
    while not moves.isEmpty():
        entered, gone_from = (moves.select("nfa_id", F.col(a).alias(b)).distinct() for a, b in (("dst", "src"), ("src", "dst")))
        moves = keep(moves.join(entered, ["nfa_id", "src"], "left_semi").join(gone_from, ["nfa_id", "dst"], "left_semi").select("nfa_id", "src", "dst"))
        inside = keep(moves.select("nfa_id", F.col("src").alias("state_id")).union(moves.select("nfa_id", "dst")).distinct())
        done.append(left.join(inside, KEY, "left_anti").select(*KEY, F.col("state_id").alias("scc_root")))
        left = inside
        own = left.withColumn("label", F.col("state_id"))
        before = propagate(own, moves, F.col("label"), keep).withColumnRenamed("label", "before")
        behind = propagate(own, moves.select("nfa_id", F.col("dst").alias("src"), F.col("src").alias("dst")), F.col("label"), keep).withColumnRenamed("label", "behind")
        both = keep(before.join(behind, KEY))
        done.append(both.where("before = behind").select(*KEY, F.col("before").alias("scc_root")))
        rest = both.where("before <> behind")
        left = rest.select(*KEY)
        for end in ("src", "dst"):
            marks = [F.col(c).alias(f"{end}_{c}") for c in ("before", "behind")]
            moves = moves.join(rest.select("nfa_id", F.col("state_id").alias(end), *marks), ["nfa_id", end])
        moves = keep(moves.where("src_before = dst_before and src_behind = dst_behind").select("nfa_id", "src", "dst"))
    return _union([*done, left.withColumn("scc_root", F.col("state_id"))])


def topological_layers(strong: DataFrame, edges: DataFrame, keep: Keep) -> DataFrame:
    """nfa_id, state_id, scc_root and topo_order: the longest way, in edges between strong components, to the state's one.

    A move goes on from all components that a way of so many edges ends in; the last one that a component is in is its layer.
    """
    between = edges
    for end in ("src", "dst"):
        names = strong.select("nfa_id", F.col("state_id").alias(end), F.col("scc_root").alias(f"{end}_root"))
        between = between.join(names, ["nfa_id", end])
    between = keep(between.where("src_root <> dst_root").select("nfa_id", F.col("src_root").alias("src"), F.col("dst_root").alias("dst")).distinct())
    ends = _ends(between)
    roots = strong.select("nfa_id", F.col("scc_root").alias("state_id")).distinct()
    frontier = keep(roots.join(_ends(between, True).select(*KEY).distinct(), KEY, "left_anti").withColumn("topo_order", F.lit(0)))
    layers, depth = [], 0
    while not frontier.isEmpty():
        layers.append(frontier)
        moved, parts = frontier, []
        for _ in range(HOPS):
            moved = moved.join(ends, KEY).select("nfa_id", F.col("to").alias("state_id"), (F.col("topo_order") + 1).alias("topo_order")).distinct()
            parts.append(moved)
        depth += HOPS
        ahead = keep(_union(parts))
        layers.append(ahead)
        frontier = ahead.where(F.col("topo_order") == depth)
    if not layers:
        return strong.withColumn("topo_order", F.lit(0))
    last = _union(layers).groupBy(*KEY).agg(F.max("topo_order").alias("topo_order")).withColumnRenamed("state_id", "scc_root")
    return strong.join(last, ["nfa_id", "scc_root"]).select(*KEY, "scc_root", "topo_order")


def bfs_layers(states: DataFrame, edges: DataFrame, keep: Keep) -> DataFrame:
    """nfa_id, state_id, bfs_layer: the distance from the lowest state that reaches a state, over one edge at least; 0 if there is none.

    Only states that no lower one reaches begin a search; one of these may be reached by a later search.
    """
    start = states.select(*KEY, F.struct(F.col("state_id").alias("root"), F.lit(0).alias("far")).alias("label"))
    onward = F.struct(F.col("label.root").alias("root"), (F.col("label.far") + 1).alias("far"))
    labels = keep(propagate(start, edges, onward, keep).select(*KEY, "label.root", "label.far"))
    into = edges.join(labels.select("nfa_id", F.col("state_id").alias("src"), "root", "far"), ["nfa_id", "src"])
    back = into.groupBy("nfa_id", F.col("dst").alias("state_id")).agg((F.min(F.struct("root", "far"))["far"] + 1).alias("back"))
    layer = F.when(F.col("root") == F.col("state_id"), F.coalesce("back", F.lit(0))).otherwise(F.col("far"))
    return labels.join(back, KEY, "left").select(*KEY, layer.alias("bfs_layer"))


def graph_labels(states: DataFrame, edges: DataFrame, keep: Keep) -> DataFrame:
    """Per state: cc_id, cc_local_id, scc_root, topo_order and bfs_layer."""
    components = keep(with_components(component_table(states, edges, keep), keep))
    strong = keep(strong_components(states, edges, keep))
    layers = topological_layers(strong, edges, keep)
    return keep(components.join(layers, KEY).join(bfs_layers(states, edges, keep), KEY))


def dag_classes(strong: DataFrame, edges: DataFrame) -> DataFrame:
    """nfa_id, dag_class: 2 without cycles, 1 with self loops only, else 0."""
    loops = edges.where("src = dst").select("nfa_id").distinct().withColumn("loops", F.lit(True))
    per = strong.groupBy("nfa_id").agg(F.max(F.col("scc_root") != F.col("state_id")).alias("cycles"))
    kind = F.when(F.col("cycles"), 0).when(F.col("loops"), 1).otherwise(2)
    return per.join(loops, "nfa_id", "left").select("nfa_id", kind.alias("dag_class"))


def incompatible_pairs(states: DataFrame, edges: DataFrame, keep: Keep, enable: bool = False) -> DataFrame:
    """nfa_id, x, y: pairs x <= y of states that can be active together, by the rules of ``graph.incompatible_pairs``.

    Only the pairs that the last round has found are joined with the edges, at both ends.
    """
    lanes = [lane.alias(f"lane{k}") for k, lane in enumerate(symbolset.lanes(F.col("symbol_set")))]
    sets = keep(states.select(*KEY, *lanes, (F.col("start_kind") == ALL_INPUT).alias("always"), ((F.col("start_kind") > 0) | F.col("is_report")).alias("special")))
    reach = keep(_ends(edges).unionByName(sets.where("always").select(*KEY, F.col("state_id").alias("to"))).distinct())
    share = F.lit(False)
    for k in range(len(lanes)):
        share = share | (F.col(f"a{k}").bitwiseAND(F.col(f"b{k}")) != 0)

    def side(name: str, mark: str) -> DataFrame:
        return sets.select("nfa_id", F.col("state_id").alias(name), *[F.col(f"lane{k}").alias(f"{mark}{k}") for k in range(len(lanes))])

    def ordered(rows: DataFrame, a: str, b: str) -> DataFrame:
        return rows.select("nfa_id", F.least(a, b).alias("x"), F.greatest(a, b).alias("y")).distinct()

    special = sets.where("special").select("nfa_id", F.col("state_id").alias("s"))
    with_all = special.join(sets.select(*KEY), "nfa_id")
    new = keep(ordered(with_all, "s", "state_id").unionByName(sets.select("nfa_id", F.col("state_id").alias("x"), F.col("state_id").alias("y"))).distinct())
    found = [new]
    while not new.isEmpty():
        ahead = new.join(reach.select("nfa_id", F.col("state_id").alias("x"), F.col("to").alias("p")), ["nfa_id", "x"])
        ahead = ahead.join(reach.select("nfa_id", F.col("state_id").alias("y"), F.col("to").alias("q")), ["nfa_id", "y"])
        ahead = ordered(ahead, "p", "q")
        if not enable:
            ahead = ahead.join(side("x", "a"), ["nfa_id", "x"]).join(side("y", "b"), ["nfa_id", "y"]).where(share).select("nfa_id", "x", "y")
        new = keep(ahead.join(_union(found), ["nfa_id", "x", "y"], "left_anti"))
        found.append(new)
    return _union(found)


def compatible_groups(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """nfa_id, cc_id, state_id, cg_id: by ``graph.compatible_groups``' rule, from the pairs of a component, which is one task's work.

    pairs has nfa_id, x and y (incompatible_pairs), labels nfa_id, state_id and cc_id; states of different components may share no group anyway.
    """
    key = ["nfa_id", "cc_id"]
    inside = pairs.where("x < y").join(labels.select("nfa_id", "cc_id", F.col("state_id").alias("x")), ["nfa_id", "x"])
    inside = inside.join(labels.select("nfa_id", "cc_id", F.col("state_id").alias("y")), ["nfa_id", "cc_id", "y"]).select(*key, "x", "y")

    def run(states: pa.Table, found: pa.Table) -> pa.Table:
        lower: dict[int, list[int]] = {}
        for x, y in zip(found.column("x").to_pylist(), found.column("y").to_pylist()):
            lower.setdefault(y, []).append(x)
        states = states.sort_by("state_id")
        group: dict[int, int] = {}
        for s in states.column("state_id").to_pylist():
            taken = {group[x] for x in lower.get(s, ())}
            group[s] = next(g for g in range(len(taken) + 1) if g not in taken)
        return pa.table({**{c: states.column(c) for c in ("nfa_id", "cc_id", "state_id")}, "cg_id": pa.array(list(group.values()), pa.int32())})

    inside = inside.select(*[F.col(c).alias(c) for c in inside.columns])  # columns of their own, though both sides come from labels
    rows = labels.select("nfa_id", "cc_id", "state_id").groupBy(*key).cogroup(inside.groupBy(*key))
    return rows.applyInArrow(run, "nfa_id string, cc_id int, state_id int, cg_id int")
