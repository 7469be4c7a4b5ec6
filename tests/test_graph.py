from __future__ import annotations

import pytest

from automill.model import AutomatonError, build, keywords
from automill.operators import graph, transforms
from automill.plans.planner import dag_class
from conftest import MIXED


def chain(*edges, n=6):
    return build("g", [{"id": f"s{i}", "symbols": "a"} for i in range(n)], [(f"s{a}", f"s{b}") for a, b in edges])


def test_components():
    a = chain((3, 1), (4, 5))
    assert graph.components(a) == [0, 1, 2, 1, 3, 3]
    assert graph.local_ids(graph.components(a)) == [0, 0, 0, 1, 0, 1]


def test_strong_components_and_layers():
    a = chain((0, 1), (1, 2), (2, 1), (2, 3), (0, 4))
    scc = graph.strong_components(a)
    assert scc[1] == scc[2] and len(set(scc)) == 5
    assert graph.topological_layers(a) == [0, 1, 1, 2, 1, 0]
    assert graph.bfs_layers(a) == [0, 1, 2, 3, 1, 0]
    deep = build("deep", [{"id": str(i), "symbols": "a"} for i in range(20_000)], [(str(i), str(i + 1)) for i in range(19_999)])
    assert graph.topological_layers(deep)[-1] == 19_999  # no recursion


def test_dag_class():
    assert [dag_class(x) for x in (chain((0, 1)), chain((0, 1), (1, 1)), chain((0, 1), (1, 0)))] == [2, 1, 0]


@pytest.mark.parametrize(("n", "groups", "sizes"), [(5, 2, [2, 3]), (7, 3, [2, 2, 3]), (3, 9, [1, 1, 1]), (4, 1, [4]), (0, 3, [])])
def test_group_by_count(n, groups, sizes):
    parts = graph.group_by_count(n, groups)
    assert [len(p) for p in parts] == sizes and sum(parts, []) == list(range(n))


def test_group_by_size():
    assert graph.group_by_size([5, 1, 3, 9, 2], 6) == [[1, 4, 2], [0], [3]]
    assert graph.group_by_size([3, 3, 3], 6, ascending=False) == [[0, 1], [2]]


def test_limit_out_degree():
    a = transforms.limit_out_degree(MIXED, 4)
    assert max(map(len, a.succ)) <= 4
    assert {s.original_id for s in a.states} == {s.str_id for s in MIXED.states}
    with pytest.raises(AutomatonError):
        transforms.limit_out_degree(chain((0, 0), (0, 1)), 1)


def test_cuts_and_starts():
    a = chain((0, 1), (1, 2), (2, 3), n=4)
    assert len(transforms.cut_by_depth(a, 0.5)) == 2
    assert transforms.without_self_loops(chain((0, 0), (0, 1))).edges() == [(0, 1)]
    k = keywords("k", ["ab", "cd"])
    moved = transforms.move_starts(k)
    assert len(moved) == 6 and not any(s.start for s in moved.states[:4])
    assert len(transforms.one_start_each(k)) == 6
    clones = transforms.clone_starts(k)
    assert not any(s.report for s in clones.states[4:]) and clones.succ[4] == k.succ[0]


def test_packing():
    assert transforms.pack_compatible([[1, 1], [4], [2, 2, 2]], 3) == [[(0, 0), (0, 1), (1, 0)], [(2, 0), (2, 1), (2, 2)]]
    parts = transforms.split_components(keywords("k", ["ab", "cd", "ef"]))
    assert transforms.group_by_hot(parts, {}, 2, 0.5) == [[0, 1], [2]]
    with pytest.raises(AutomatonError):
        transforms.group_by_hot(parts, {f"k0_{i}": 1.0 for i in range(2)}, 1, 0.5)
    assert sorted(p.nfa_id for p in transforms.shuffle_components(parts, 3)) == ["k#0", "k#1", "k#2"]


def test_undeclared_and_repeated_ids():
    with pytest.raises(AutomatonError):
        build("x", [{"id": "a", "symbols": "a"}], [("a", "b")])
    with pytest.raises(AutomatonError):
        build("x", [{"id": "a"}, {"id": "a"}], [])
