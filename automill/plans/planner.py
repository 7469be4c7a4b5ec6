"""Which way to run a match, and the groups it runs in.

Decided on the driver from the compiled automata before a plan is built:

* ``table``: a deterministic table per group, segments side by side. Chosen while the table is small.
* ``arrow``: a table that fills as it is used. Always right; chosen when the table would grow too large.
* ``hybrid``: a table for the hot states, masks for the cold ones, where they are enabled. For components whose
  table would be too large, but whose states far from the starts are seldom reached.
* ``fold``: the table in the plan itself, a fold over the bytes in the JVM. For short streams and small tables; other groups go to the kernel.
* ``relational``: joins of frontier, edges and bytes. For acyclic components and short paths; groups with a cycle
  (``dag_class`` 0 or 1) go to the ``arrow`` kernel.
* ``ranges``: as relational, with sets of bytes as ranges: wide classes are a row or two of the broadcast table.
* A component of more than ``MASK_STATES`` states is run by sets of active states, with sparse successors, whatever is asked for.
* ``memo``: a broadcast join on the first k bytes, the rest relational.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from automill.model import Automaton, Compiled, Sparse, Table, compile_group, compile_sparse, determinise
from automill.operators.graph import components, group_by_count, group_by_size

#: Rows of a deterministic table, and states of a group when groups are made by size.
TABLE_ROWS, GROUP_STATES = 4096, 4000
#: States of a component that masks are made for, at most; a larger one is run by sets of states.
MASK_STATES = 20_000
STRATEGIES = ("auto", "table", "arrow", "relational", "ranges", "memo", "vector", "hybrid", "fold")
#: Strategies that join, and layers behind the starts that are hot unless it is said which states are.
JOINS, HOT_LAYERS = ("relational", "ranges", "memo"), 2


@dataclass
class Group:
    compiled: Compiled | Sparse
    table: Table | None
    #: The states that the table leaves to masks.
    cold: int = 0
    #: 2 without cycles, 1 with self loops only, else 0.
    dag: int = 0


def component_filter(a: Automaton, cc_id: int | None, cc_with_state: str | None, max_cc_states: int | None) -> tuple[list[int], list[int]]:
    """Component of each state, and the components that take part."""
    labels = components(a)
    wanted = sorted(set(labels))
    if max_cc_states is not None:
        sizes = [labels.count(c) for c in wanted] if len(wanted) < 50 else _sizes(labels)
        wanted = [c for c, n in zip(wanted, sizes) if n <= max_cc_states]
    if cc_id is not None:
        wanted = [c for c in wanted if c == cc_id]
    if cc_with_state is not None:
        having = {labels[i] for i, s in enumerate(a.states) if cc_with_state in (s.str_id, s.original_id)}
        wanted = [c for c in wanted if c in having]
    return labels, wanted


def _sizes(labels: list[int]) -> list[int]:
    out = [0] * (max(labels) + 1)
    for c in labels:
        out[c] += 1
    return out


def plan(
    automata: list[Automaton],
    *,
    strategy: str = "auto",
    groups: int | None = None,
    cc_id: int | None = None,
    cc_with_state: str | None = None,
    max_cc_states: int | None = None,
    merge_cc: int = 1,
    hot: set[str] | None = None,
) -> list[Group]:
    """Groups of components, compiled; group ids count from 0 within each automaton. hot: ids of the states that 'hybrid' takes for hot."""
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy is one of {STRATEGIES}, not {strategy!r}")
    out = []
    for a in automata:
        labels, wanted = component_filter(a, cc_id, cc_with_state, max_cc_states)
        by: dict[int, list[int]] = {c: [] for c in wanted}
        for s, c in enumerate(labels):
            if c in by:
                by[c].append(s)
        members = [by[c] for c in wanted]
        members = [sum(members[i : i + merge_cc], []) for i in range(0, len(members), merge_cc)]
        parts = group_by_count(len(members), groups) if groups else group_by_size([len(m) for m in members], GROUP_STATES)
        for g, part in enumerate(parts):
            out += _compiled(a, [members[k] for k in part], labels, g, strategy, hot)
    return out


def _compiled(a: Automaton, members: list[list[int]], labels: list[int], group: int, strategy: str, hot: set[str] | None) -> list[Group]:
    """A group, as one table if it stays small, else halved while halves help, else without a table."""
    states = sorted(sum(members, []))
    if len(members) == 1 and len(states) > MASK_STATES:
        return [Group(compile_sparse(a, states, labels, group), None)]  # whatever is asked for: masks of so many states are too large
    c = compile_group(a, states, labels, group)
    if strategy in JOINS:
        return [Group(c, None, dag=dag_class(a.part(states)))]
    if strategy == "arrow":
        return [Group(c, None)]
    if strategy == "hybrid":
        near = _near_starts(c) if hot is None else sum(1 << k for k, s in enumerate(states) if a.states[s].str_id in hot)
        part = c.hot_part(near)
        table = determinise(part[0] if part else c, TABLE_ROWS)
        return [Group(c, table, part[1] if part and table else 0)]
    table = determinise(c, TABLE_ROWS)
    if table is not None:
        return [Group(c, table)]
    if len(members) > 1:
        half = math.ceil(len(members) / 2)
        return _compiled(a, members[:half], labels, group, strategy, hot) + _compiled(a, members[half:], labels, group, strategy, hot)
    if strategy == "auto":
        return [Group(c, None)]
    raise ValueError(f"a table of {TABLE_ROWS} rows is too small for component {labels[states[0]]}; use 'arrow' or 'auto'")


def _near_starts(c: Compiled) -> int:
    """The states at most HOT_LAYERS edges behind a start."""
    near = c.all_input | c.start_of_data
    for _ in range(HOT_LAYERS):
        for s, out in enumerate(c.succ):
            if near >> s & 1:
                near |= out
    return near


def dag_class(a: Automaton) -> int:
    """2 without cycles, 1 with self loops only, else 0."""
    from automill.operators.graph import strong_components

    if len(set(strong_components(a))) < len(a):
        return 0
    return 1 if any(x == y for x, y in a.edges()) else 2
