"""Kernels against the rules, without Spark."""

from __future__ import annotations

import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

import oracle
from automill.model import ALL_INPUT, Automaton, State, build, compile_group, compile_sparse, determinise, keywords
from automill.operators import graph, transforms
from automill.plans import kernels, planner


def run(a, payloads, firsts, strategy="auto", **options):
    out = set()
    for g in planner.plan([a], strategy=strategy, **options):
        if g.cold:
            hits = kernels.hybrid(g.compiled, g.cold, g.table, payloads, firsts)
        else:
            hits = kernels.lock_step(g.table, g.compiled.longest, payloads, firsts) if g.table else kernels.lazy(g.compiled, payloads, firsts)
        for seg, off, local in hits:
            found = {(int(s), int(o), g.compiled.names[k][0]) for s, o, k in zip(seg, off, local)}
            assert not out & found  # a report is made once
            out |= found
    return out


def expected(a, payloads, firsts):
    return {(k, p, s) for k, (d, f) in enumerate(zip(payloads, firsts)) for p, s in oracle.reports(a, d, f)}


texts = st.lists(st.tuples(st.binary(max_size=40).map(lambda b: bytes(97 + x % 3 for x in b)), st.booleans()), min_size=1, max_size=6)


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10_000), st.booleans(), texts, st.sampled_from(["auto", "arrow"]), st.sampled_from([None, 1, 2, 5]))
def test_random(seed, cycles, data, strategy, groups):
    a = oracle.random_automaton(seed, cycles=cycles)
    payloads, firsts = zip(*data)
    assert run(a, payloads, firsts, strategy, groups=groups) == expected(a, payloads, firsts)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10_000), st.booleans(), st.binary(max_size=60))
def test_long_lanes(seed, cycles, data):
    """Streams that are cut into lanes, and a few long ones."""
    a = oracle.random_automaton(seed, cycles=cycles)
    payloads, before = [bytes(97 + x % 3 for x in data), b"abcab" * 9], (kernels.LANE, kernels.BLOCK_BYTES)
    kernels.LANE, kernels.BLOCK_BYTES = 7, 30
    try:
        assert run(a, payloads, [True, False]) == expected(a, payloads, [True, False])
    finally:
        kernels.LANE, kernels.BLOCK_BYTES = before


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10_000), st.booleans(), texts, st.none() | st.sets(st.integers(0, 6)))
def test_hybrid(seed, cycles, data, hot):
    a = oracle.random_automaton(seed, cycles=cycles)
    payloads, firsts = zip(*data)
    hot = None if hot is None else {f"s{k}" for k in hot}
    assert run(a, payloads, firsts, "hybrid", hot=hot) == expected(a, payloads, firsts)


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 10_000), st.booleans(), texts, st.booleans())
def test_counts(seed, cycles, data, lanes):
    """The kernel that counts, with lanes and without."""
    a = oracle.random_automaton(seed, cycles=cycles)
    payloads, firsts = zip(*data)
    before = (kernels.LANE, kernels.BLOCK_BYTES)
    kernels.LANE, kernels.BLOCK_BYTES = (7, 30) if lanes else before
    try:
        n = sum(kernels.count(g.table, g.compiled.longest, list(payloads), list(firsts)) for g in planner.plan([a]))
    finally:
        kernels.LANE, kernels.BLOCK_BYTES = before
    found = [k for k, _, _ in expected(a, payloads, firsts)]
    assert n.tolist() == [found.count(k) for k in range(len(payloads))]


def test_small_cases():
    one = lambda a, d, first=True: {p for _, p, _ in run(a, [d], [first])}
    assert one(keywords("w", ["ab"], start="start-of-data"), b"abab") == {1}
    assert one(keywords("w", ["ab"], start="start-of-data"), b"abab", False) == set()
    assert one(keywords("w", ["aa"]), b"aaaa") == {1, 2, 3}
    assert one(keywords("w", [b"\xff"]), b"\x00\xff") == {1}
    assert one(keywords("w", ["z"]), b"xyz") == {2}
    gap = build("g", [{"id": "a", "symbols": "a", "start": "all-input"}, {"id": "x", "symbols": "*"}, {"id": "b", "symbols": "b", "report": True}], [("a", "x"), ("x", "x"), ("x", "b")])
    assert one(gap, b"axxbxb") == {3, 5}
    empty = build("e", [{"id": "a", "start": "all-input", "report": True}], [])
    assert one(empty, b"abc") == set() and one(empty, b"") == set()
    two = build("t", [{"id": "p", "symbols": "a", "start": "all-input", "report": True}, {"id": "q", "symbols": "[a-z]", "start": "all-input", "report": True}], [])
    assert run(two, [b"a"], [True]) == {(0, 0, 0), (0, 0, 1)}


def test_table_limit_falls_back():
    """A component whose table is too large runs without one."""
    n = 16
    states = [{"id": "s0", "symbols": "a", "start": "all-input"}] + [{"id": f"s{i}", "symbols": "[ab]", "report": i == n} for i in range(1, n + 1)]
    a = build("wide", states, [(f"s{i}", f"s{i + 1}") for i in range(n)])
    assert planner.plan([a])[0].table is None
    data = bytes(np.random.default_rng(1).choice(list(b"ab"), 300))
    assert run(a, [data], [True]) == expected(a, [data], [True])


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10_000), st.binary(max_size=30))
def test_profiles(seed, data):
    a = oracle.random_automaton(seed)
    data = bytes(97 + x % 3 for x in data)
    c = planner.plan([a], strategy="arrow", groups=1)[0].compiled
    always = {i for i, s in enumerate(a.states) if s.start == ALL_INPUT}
    counts, sizes = [0] * len(a), []
    enabled = always | {i for i, s in enumerate(a.states) if s.start}
    for b in data:
        matched = {i for i in enabled if a.states[i].symbols >> b & 1}
        for i in matched:
            counts[i] += 1
        sizes.append(len(matched))
        enabled = always | {t for i in matched for t in a.succ[i]}
    assert kernels.profile(c, [data], [True], False).tolist() == counts
    assert kernels.frontier(c, data, True) == sizes


# Transforms that must not change what is reported, by origin and offset.

inputs = st.binary(min_size=1, max_size=40).map(lambda b: bytes(97 + x % 3 for x in b))


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 10_000), inputs)
def test_transforms_keep_reports(seed, data):
    a = oracle.random_automaton(seed, n=6, cycles=False)
    want = oracle.by_origin(a, oracle.reports(a, data))
    for b in (transforms.split_to_complete(a), transforms.reorder(a, lambda s: -len(a.succ[s])), transforms.merge_automata(transforms.split_components(a), "m"), transforms.limit_out_degree(a, 2)):
        assert oracle.by_origin(b, oracle.reports(b, data)) == want


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10_000), inputs)
def test_split_to_complete_with_loops(seed, data):
    a = oracle.random_automaton(seed, n=5)
    b = transforms.split_to_complete(a)
    assert oracle.by_origin(b, oracle.reports(b, data)) == oracle.by_origin(a, oracle.reports(a, data))


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10_000), inputs)
def test_compatible_states_never_meet(seed, data):
    a = oracle.random_automaton(seed, n=6)
    group = graph.compatible_groups(a)
    always = {i for i, s in enumerate(a.states) if s.start == ALL_INPUT}
    enabled = {i for i, s in enumerate(a.states) if s.start}
    for b in data:
        matched = {i for i in enabled if a.states[i].symbols >> b & 1}
        assert len({group[i] for i in matched}) == len(matched)
        enabled = always | {t for i in matched for t in a.succ[i]}


@pytest.mark.parametrize("seed", range(6))
def test_functions_and_cut_lanes(seed, monkeypatch):
    """What cuts make of every row, composed, is what the bytes do one by one; long payloads of cyclic automata are cut into lanes."""
    monkeypatch.setattr(kernels, "LANE", 7)
    monkeypatch.setattr(kernels, "FUNCTION_LANES", 30)
    r = random.Random(seed)
    a = oracle.random_automaton(seed + 20, 6)
    c = compile_group(a, list(range(len(a))), [0] * len(a), 0)
    t = determinise(c, 500)
    payloads = [bytes(r.choice(b"abcd") for _ in range(n)) for n in (0, 1, 6, 7, 8, 100, 333)]
    got = kernels.functions(t, payloads)
    for k, p in enumerate(payloads):
        for row in range(len(t.next)):
            here = row
            for b in p:
                here = t.next[here, t.classes[b]]
            assert got[k, row] == here
    for first in (True, False):
        found = {(s, p, i) for segs, offs, states in kernels.lock_step(t, 0, payloads, [first] * len(payloads)) for s, p, i in zip(segs.tolist(), offs.tolist(), states.tolist())}
        assert found == {(k, p, i) for k, data in enumerate(payloads) for p, i in oracle.reports(a, data, first)}
        assert kernels.count(t, 0, payloads, [first] * len(payloads)).sum() == len(found)


@pytest.mark.parametrize("seed", range(8))
def test_profiles_by_visits(seed, monkeypatch):
    """Counts by visits of a table's rows, and by sparse sets, are those of a pass byte by byte."""
    monkeypatch.setattr(kernels, "LANE", 16)
    r = random.Random(seed)
    a = oracle.random_automaton(seed, 7, cycles=seed % 2 == 0)
    c = compile_group(a, list(range(len(a))), [0] * len(a), 0)
    t = determinise(c, 500)
    payloads = [bytes(r.choice(b"abcd") for _ in range(n)) for n in (0, 1, 5, 17, 100, 333, 17)]
    firsts = [k % 3 != 1 for k in range(len(payloads))]
    want = kernels.profile(c, payloads, firsts, False)
    assert (kernels.profile_by_table(c, t, payloads, firsts) == want).all()
    assert (kernels.compat_by_table(c, kernels.compat_table(c, 500), payloads, firsts) == kernels.profile(c, payloads, firsts, True)).all()
    s = compile_sparse(a, list(range(len(a))), [0] * len(a), 0)
    counts, sizes = kernels.sparse_profile(s, payloads, firsts)
    assert (counts == want).all() and s.longest == c.longest
    plain = [n for p, f in zip(payloads, firsts) for n in kernels.frontier(c, p, f)]
    assert sizes == {n: plain.count(n) for n in set(plain)}
    by_visits = {}
    for mask, n in kernels.matched_states(c, t, kernels.visits(t, c.longest, payloads, firsts)):
        by_visits[mask.bit_count()] = by_visits.get(mask.bit_count(), 0) + n
    assert by_visits == sizes
    found = {(k, p, i) for segs, offs, states in kernels.sparse(s, payloads, firsts) for k, p, i in zip(segs.tolist(), offs.tolist(), states.tolist())}
    assert found == {(k, p, i) for k, data in enumerate(payloads) for p, i in oracle.reports(a, data, firsts[k])}


def test_large_component():
    """A component of 200,000 states is compiled without masks, in memory in proportion to its states, and matched."""
    import tracemalloc

    words = [f"{i:06d}" for i in range(0, 240_000, 3)]
    states, succ, index = [State("root", 1 << ord("#"), ALL_INPUT)], [[]], {"": 0}
    for w in words:
        for k in range(1, 7):
            if w[:k] not in index:
                index[w[:k]] = len(states)
                succ[index[w[: k - 1]]].append(len(states))
                succ.append([])
                states.append(State(w[:k], 1 << ord(w[k - 1]), report=k == 6))
    for k in range(110_000):  # a long tail
        succ[-1].append(len(states))
        succ.append([])
        states.append(State(f"t{k}", 1 << ord("z")))
    a = Automaton("large", states, succ)
    assert len(a) > 200_000
    tracemalloc.start()
    (group,) = planner.plan([a])
    assert tracemalloc.get_traced_memory()[1] < 500_000_000
    tracemalloc.stop()
    data = b"##000003#000004#239997z"
    found = [(p, group.compiled.names[i][1]) for _, offs, ids in kernels.sparse(group.compiled, [data], [True]) for p, i in zip(offs.tolist(), ids.tolist())]
    assert found == [(7, "000003"), (21, "239997")]
