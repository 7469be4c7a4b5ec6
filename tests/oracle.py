"""The rules of matching, byte by byte."""

from __future__ import annotations

import random

from automill.model import ALL_INPUT, START_OF_DATA, Automaton, build


def reports(a: Automaton, data: bytes, first: bool = True, base: int = 0) -> set[tuple[int, int]]:
    always = {i for i, s in enumerate(a.states) if s.start == ALL_INPUT}
    enabled = always | ({i for i, s in enumerate(a.states) if s.start == START_OF_DATA} if first else set())
    out = set()
    for p, b in enumerate(data):
        matched = {i for i in enabled if a.states[i].symbols >> b & 1}
        out |= {(base + p, i) for i in matched if a.states[i].report}
        enabled = always | {t for i in matched for t in a.succ[i]}
    return out


def random_automaton(seed: int, n: int = 7, cycles: bool = True) -> Automaton:
    r = random.Random(seed)
    classes = ["[a]", "[b]", "[ab]", "[bc]", "*", "[^a]", "[c]", "."]
    states = [
        {"id": f"s{i}", "symbols": r.choice(classes), "start": r.choice([None, None, "all-input", "start-of-data"]) if i else "all-input", "report": r.random() < 0.4}
        for i in range(n)
    ]
    edges = [(f"s{i}", f"s{j}") for i in range(n) for j in range(n) if r.random() < 0.22 and (cycles or i < j)]
    return build(f"n{seed}", states, edges)


def by_origin(a: Automaton, found: set[tuple[int, int]]) -> set[tuple[int, str]]:
    return {(p, a.states[i].original_id) for p, i in found}
