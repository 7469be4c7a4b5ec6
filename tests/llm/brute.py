"""Brute-force versions of operators that SQL cannot express."""

from __future__ import annotations

import re
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UP = {c: c + 32 for c in range(65, 91)}


def shingle_set(text: str | None) -> frozenset:
    w = WORD.findall((text or "").translate(UP))
    if len(w) < 5:
        return frozenset([tuple(w)]) if w else frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def near_components(rows: list[tuple[int, str | None]]) -> dict[int, tuple[int, int]]:
    """id -> (set size, component), comparing all pairs that share a shingle."""
    sets = {i: shingle_set(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    by = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            by[x].append(i)
    shared = defaultdict(int)
    for ids in by.values():
        for k, i in enumerate(ids):
            for j in ids[k + 1 :]:
                shared[i, j] += 1
    for (i, j), both in shared.items():
        if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return {i: (len(s), find(i)) for i, s in sets.items()}


def line_dedup(rows: list[tuple[int, str]], run_words: int) -> dict[int, str]:
    """id -> text without the words, and the white space behind them, of runs of run_words words that occur earlier."""
    first, out = {}, {}
    for i, t in sorted(rows):
        found = [(m.group(), m.start()) for m in WORD.finditer(t or "")]
        words, ends = [w for w, _ in found], [a for _, a in found[1:]] + [len(t or "")]
        gone = set()
        for p in range(len(words) - run_words + 1):
            doc, q = first.setdefault(tuple(words[p : p + run_words]), (i, p))
            if doc != i or q + run_words <= p:
                gone.update(range(p, p + run_words))
        out[i] = t and t[: found[0][1] if found else len(t)] + "".join(t[found[p][1] : ends[p]] for p in range(len(words)) if p not in gone)
    return out
