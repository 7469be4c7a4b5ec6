"""Matching kernels that run inside Arrow batches.

Each takes the payloads of segments and yields arrays (segment, offset in the segment, local state).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from automill.model import Compiled, Sparse, Table, determinise

Hits = tuple[np.ndarray, np.ndarray, np.ndarray]
Lanes = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]

#: Payload bytes that the lock-step kernel holds at a time, and the longest lane it runs.
BLOCK_BYTES, LANE = 4_000_000, 2048
#: Entries of the lazy table before it is cleared.
CACHE = 200_000
#: Lanes that run side by side to find what cuts make of every row.
FUNCTION_LANES = 500_000


def _expand(table_sets: list[list[int]], seg: np.ndarray, off: np.ndarray, sets: np.ndarray) -> Hits:
    """A row for each state of each report set."""
    sizes = np.array([len(x) for x in table_sets])[sets]
    flat = np.concatenate([np.array(x, np.int64) for x in table_sets]) if len(table_sets) > 1 else np.zeros(0, np.int64)
    starts = np.append(0, np.cumsum([len(x) for x in table_sets]))[sets]
    rows = np.repeat(np.arange(len(seg)), sizes)
    within = np.arange(len(rows)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return seg[rows], off[rows], flat[starts[rows] + within]


def lock_step(t: Table, longest: int, payloads: list[bytes], firsts: list[bool], rows: list[int] | None = None) -> Iterator[Hits]:
    """Many segments side by side: one table lookup moves all lanes by a byte.

    If no path is longer than ``longest`` states, a long segment is cut into lanes that start
    ``longest - 1`` bytes early with nothing pending, and drop what they see before their own part. With cycles a
    long segment is cut into lanes too, whose first rows come from what the lanes before make of every row (``functions``).
    rows: the table's row that each segment begins in; else the first row of a stream or of a later segment.
    """
    nexts, marks = _flat(t)
    for i, part in _parts(payloads):
        begin = rows[i : i + len(part)] if rows is not None else _first_rows(t, firsts[i : i + len(part)])
        yield from _block(t, longest, nexts, marks, part, begin, i)


def _first_rows(t: Table, firsts: list[bool]) -> list[int]:
    return [t.first if first else t.later for first in firsts]


def _cut_functions(nexts: np.ndarray, n_rows: int, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """(cuts, rows): the row that each cut of the data leads to from each row.

    All cuts and rows run side by side; lanes of a cut that meet in a row go on as one, which is looked for after 1, 2, 4, 8 ... bytes.
    """
    n = len(starts)
    cut = np.repeat(np.arange(n), n_rows)
    state = np.tile(np.arange(n_rows, dtype=np.int64), n)
    lane = np.arange(n * n_rows)  # of each (cut, row)
    check = 1
    for p in range(int(sizes.max(initial=0))):
        alive = sizes[cut] > p
        if alive.all():
            state = nexts[state * 256 + data[starts[cut] + p]] // 256
        else:
            some = np.flatnonzero(alive)
            state[some] = nexts[state[some] * 256 + data[starts[cut[some]] + p]] // 256
        if p + 1 == check:
            check *= 2
            if len(state) > n:
                kept, back = np.unique(cut * n_rows + state, return_inverse=True)
                lane = back.reshape(-1)[lane]
                cut, state = kept // n_rows, kept % n_rows
    return state[lane].reshape(n, n_rows)


def functions(t: Table, payloads: list[bytes]) -> np.ndarray:
    """(payloads, rows): the row of the table that each payload leads to from each row."""
    nexts, n_rows = _flat(t)[0].astype(np.int64), len(t.next)
    out = np.empty((len(payloads), n_rows), np.int64)
    for k, payload in enumerate(payloads):
        data, now = np.frombuffer(payload, np.uint8), np.arange(n_rows)
        for made in _functions_of(nexts, n_rows, data):
            for f in made:
                now = f[now]
        out[k] = now
    return out


def _functions_of(nexts: np.ndarray, n_rows: int, data: np.ndarray) -> Iterator[np.ndarray]:
    """The functions of a payload's cuts of LANE bytes, so many cuts at a time that memory is bounded."""
    starts = np.arange(0, len(data), LANE)
    step = max(1, FUNCTION_LANES // n_rows)
    for i in range(0, len(starts), step):
        some = starts[i : i + step]
        yield _cut_functions(nexts, n_rows, data, some, np.minimum(LANE, len(data) - some))


def count(t: Table, longest: int, payloads: list[bytes], firsts: list[bool]) -> np.ndarray:
    """The number of reports of each payload, as lock_step would make them, without making them."""
    nexts, marks = _flat(t)
    sizes = np.array([len(x) for x in t.report_sets], np.int64)[marks]
    out = np.zeros(len(payloads), np.int64)
    for i, part in _parts(payloads):
        got = _lanes(t, longest, nexts, part, _first_rows(t, firsts[i : i + len(part)]))
        if got is None:
            continue
        data = np.frombuffer(b"".join(part), np.uint8)
        start, size, seg, _, skip, row = got
        state, totals = row * 256, np.zeros(len(start), np.int64)
        alive, t_end = _steps(size)
        late = int(skip.max())
        for p in range(t_end):
            n = alive[p]
            index = state[:n] + data[start[:n] + p]
            totals[:n] += sizes[index] if p >= late else sizes[index] * (skip[:n] <= p)
            state = nexts[index].astype(np.int64)
        if t_end < len(alive):
            next_list, size_list = nexts.tolist(), sizes.tolist()
            for lane in range(int(alive[t_end])):
                here, own, n = int(state[lane]), int(start[lane] + max(skip[lane], t_end)), 0
                first = int(start[lane]) + t_end
                for q, b in enumerate(data[first : start[lane] + size[lane]].tolist(), first):
                    x = here + b
                    if q >= own:
                        n += size_list[x]
                    here = next_list[x]
                totals[lane] += n
        np.add.at(out, i + seg, totals)
    return out


def _flat(t: Table) -> tuple[np.ndarray, np.ndarray]:
    """Next row (times 256) and report set by row times 256 plus byte."""
    return np.ascontiguousarray(t.next[:, t.classes] * 256).reshape(-1), np.ascontiguousarray(t.reports[:, t.classes]).reshape(-1)


def _parts(payloads: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """The payloads in parts of at most BLOCK_BYTES, or one longer payload, and where each part begins."""
    i = 0
    while i < len(payloads):
        j, size = i, 0
        while j < len(payloads) and (j == i or size + len(payloads[j]) <= BLOCK_BYTES):
            size += len(payloads[j])
            j += 1
        yield i, payloads[i:j]
        i = j


def _lanes(t: Table, longest: int, nexts: np.ndarray, payloads: list[bytes], rows: list[int]) -> Lanes | None:
    """Start in the joined data, bytes, segment, offset of the first byte, bytes to ignore and first row of each lane, longest first."""
    lanes = []
    at = 0
    for k, (p, row) in enumerate(zip(payloads, rows)):
        if not longest and len(p) > LANE:
            begin = 0
            for made in _functions_of(nexts.astype(np.int64), len(t.next), np.frombuffer(p, np.uint8)):
                for f in made:
                    lanes.append((at + begin, min(LANE, len(p) - begin), k, begin, 0, row))
                    row, begin = int(f[row]), begin + LANE
        elif longest and len(p) > LANE:
            for own in range(0, len(p), LANE):
                start = max(0, own - longest + 1)
                lanes.append((at + start, min(len(p), own + LANE) - start, k, start, own - start, row if start == 0 else t.later))
        elif len(p):
            lanes.append((at, len(p), k, 0, 0, row))
        at += len(p)
    lanes.sort(key=lambda x: -x[1])
    return tuple(np.array(x, np.int64) for x in zip(*lanes)) if lanes else None


def _steps(size: np.ndarray) -> tuple[np.ndarray, int]:
    """How many lanes have a byte at each step, and the step from which on too few are left to run side by side."""
    steps, few = int(size[0]), 24
    alive = np.searchsorted(-size, -np.arange(steps), "left")  # lanes with more than t bytes
    return alive, int(np.searchsorted(-alive, -few, "right")) if alive[-1] < few else steps


def _block(t: Table, longest: int, nexts, marks, payloads, rows, base) -> Iterator[Hits]:
    lanes = _lanes(t, longest, nexts, payloads, rows)
    if lanes is None:
        return
    data = np.frombuffer(b"".join(payloads), np.uint8)
    start, size, seg, off, skip, row = lanes
    state = row * 256
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    alive, t_end = _steps(size)
    steps = len(alive)
    for p in range(t_end):
        n = alive[p]
        index = state[:n] + data[start[:n] + p]
        hit = marks[index]
        state = nexts[index].astype(np.int64)
        if hit.any():
            which = np.flatnonzero(hit)
            found.append((which, np.full(len(which), p), hit[which]))
    next_list, mark_list = (None, None)
    for lane in range(int(alive[t_end]) if t_end < steps else 0):  # a few long lanes are left
        if next_list is None:
            next_list, mark_list = nexts.tolist(), marks.tolist()
        here, p, which, sets = int(state[lane]), t_end, [], []
        for b in data[start[lane] + t_end : start[lane] + size[lane]].tolist():
            x = here + b
            if mark_list[x]:
                which.append(p)
                sets.append(mark_list[x])
            here = next_list[x]
            p += 1
        if which:
            found.append((np.full(len(which), lane), np.array(which), np.array(sets)))
    if not found:
        return
    lane, p, sets = (np.concatenate(x) for x in zip(*found))
    own = p >= skip[lane]
    lane, p, sets = lane[own], p[own], sets[own]
    yield _expand(t.report_sets, base + seg[lane], off[lane] + p, sets)


def lazy(c: Compiled, payloads: list[bytes], firsts: list[bool], every: bool = False) -> Iterator[Hits]:
    """One segment after the other with a table that fills as it is used, and is cleared at its bound."""
    known: dict[tuple[int, int], tuple[int, list[int]]] = {}
    segs, offs, states = [], [], []
    for k, payload in enumerate(payloads):
        enabled = c.all_input | (c.start_of_data if firsts[k] or every else 0)
        for p, b in enumerate(payload):
            got = known.get((enabled, b))
            if got is None:
                matched, after = c.step(enabled, b)
                hit = matched & c.report
                got = after, [s for s in range(hit.bit_length()) if hit >> s & 1]
                if len(known) >= CACHE:
                    known.clear()
                known[enabled, b] = got
            enabled, hits = got
            for s in hits:
                segs.append(k)
                offs.append(p)
                states.append(s)
            if len(offs) > 100_000:
                yield np.array(segs), np.array(offs), np.array(states)
                segs, offs, states = [], [], []
    if offs:
        yield np.array(segs), np.array(offs), np.array(states)


class _Sets:
    """Steps of a sparse group: sets of enabled states, without the always enabled ones, which are looked up by byte."""

    def __init__(self, c: Sparse):
        self.c, self.known = c, {}
        self.always = [c.all_input[(c.sets[c.all_input, b >> 3] >> (b & 7)) & 1 == 1].tolist() for b in range(256)]
        self.is_always = set(c.all_input.tolist())
        self.reports = set(c.report.tolist())

    def step(self, enabled: frozenset[int], byte: int) -> tuple[frozenset[int], list[int], list[int]]:
        """The states enabled next, those that match, and of these the reporting ones."""
        got = self.known.get((enabled, byte))
        if got is None:
            sets, at, bit = self.c.sets, byte >> 3, byte & 7
            matched = [s for s in enabled if sets[s, at] >> bit & 1] + self.always[byte]
            after = {t for s in matched for t in self.c.successors(s).tolist()} - self.is_always
            got = frozenset(after), matched, sorted(s for s in matched if s in self.reports)
            if len(self.known) >= CACHE:
                self.known.clear()
            self.known[enabled, byte] = got
        return got


def sparse(c: Sparse, payloads: list[bytes], firsts: list[bool]) -> Iterator[Hits]:
    """One segment after the other by sets of active states; steps are remembered up to a bound."""
    sets, out = _Sets(c), []
    begin = frozenset(c.start_of_data.tolist())
    for k, payload in enumerate(payloads):
        enabled = begin if firsts[k] else frozenset()
        for p, b in enumerate(payload):
            enabled, _, hits = sets.step(enabled, b)
            out += [(k, p, s) for s in hits]
        if len(out) > 100_000:
            yield tuple(np.array(x) for x in zip(*out))
            out = []
    if out:
        yield tuple(np.array(x) for x in zip(*out))


def sparse_profile(c: Sparse, payloads: list[bytes], firsts: list[bool]) -> tuple[np.ndarray, dict[int, int]]:
    """How often each state matches, and how many positions have so many matching states."""
    sets, counts, sizes = _Sets(c), np.zeros(len(c.names), np.int64), {}
    for payload, first in zip(payloads, firsts):
        enabled = frozenset(c.start_of_data.tolist()) if first else frozenset()
        for b in payload:
            enabled, matched, _ = sets.step(enabled, b)
            counts[matched] += 1
            sizes[len(matched)] = sizes.get(len(matched), 0) + 1
    return counts, sizes


def hybrid(c: Compiled, cold: int, table: Table, payloads: list[bytes], firsts: list[bool]) -> Iterator[Hits]:
    """Hot states by a table, side by side; cold states by masks, from where a hot one activates them until none is left.

    The table is that of c's hot part, with marks at its reports and at the states with cold successors. No cold state
    leads into a hot one that is not enabled anyway, so its pass is right by itself, and a byte is looked at again only
    where cold states are enabled.
    """
    into = [x & cold for x in c.succ]
    wake: dict[int, dict[int, int]] = {}
    if c.start_of_data & cold:
        wake = {k: {0: c.start_of_data & cold} for k, first in enumerate(firsts) if first}
    reports, crosses = (np.array([bool(x) for x in marks]) for marks in ([c.report >> s & 1 for s in range(len(c.names))], into))
    for segs, offs, states in lock_step(table, c.longest, payloads, firsts):
        reporting, crossing = reports[states], crosses[states]
        if reporting.any():
            yield segs[reporting], offs[reporting], states[reporting]
        for k, p, s in zip(segs[crossing].tolist(), offs[crossing].tolist(), states[crossing].tolist()):
            here = wake.setdefault(k, {})
            here[p + 1] = here.get(p + 1, 0) | into[s]
    known: dict[tuple[int, int], tuple[int, int]] = {}
    out: list[tuple[int, int, int]] = []
    for k, places in wake.items():
        payload, end = payloads[k], -1
        for begin in sorted(places):
            if begin < end:
                continue
            p, enabled = begin, places[begin]
            while enabled and p < len(payload):
                key = enabled, payload[p]
                if key not in known:
                    if len(known) >= CACHE:
                        known.clear()
                    matched, after = enabled & c.match[payload[p]], 0
                    for s in _bits(matched):
                        after |= into[s]
                    known[key] = matched & c.report, after
                hit, enabled = known[key]
                out += [(k, p, s) for s in _bits(hit)]
                p += 1
                enabled |= places.get(p, 0)
            end = p + 1
            if len(out) > 100_000:
                yield tuple(np.array(x) for x in zip(*out))
                out = []
    if out:
        yield tuple(np.array(x) for x in zip(*out))


def _bits(mask: int) -> list[int]:
    return [s for s in range(mask.bit_length()) if mask >> s & 1]


def visits(t: Table, longest: int, payloads: list[bytes], firsts: list[bool]) -> np.ndarray:
    """How often each (row, class) of the table is passed by a byte, side by side over all lanes; (rows, classes)."""
    nexts = _flat(t)[0]
    totals = np.zeros(len(nexts), np.int64)
    seen: list[np.ndarray] = []
    held = 0
    for i, part in _parts(payloads):
        got = _lanes(t, longest, nexts, part, _first_rows(t, firsts[i : i + len(part)]))
        if got is None:
            continue
        data = np.frombuffer(b"".join(part), np.uint8)
        start, size, _, _, skip, row = got
        state = row * 256
        late = int(skip.max())
        # Lanes are at most LANE bytes, or short segments, so their number does the work, not a loop over bytes.
        order = np.searchsorted(-size, -np.arange(int(size[0])), "left")
        for p, n in enumerate(order.tolist()):
            index = state[:n] + data[start[:n] + p]
            seen.append(index if p >= late else index[skip[:n] <= p])
            held += n
            if held > 2_000_000:
                totals += np.bincount(np.concatenate(seen), minlength=len(totals))
                seen, held = [], 0
            state = nexts[index].astype(np.int64)
    if seen:
        totals += np.bincount(np.concatenate(seen), minlength=len(totals))
    out = np.zeros(t.next.shape, np.int64)
    for k in range(t.next.shape[1]):
        out[:, k] = totals.reshape(-1, 256)[:, t.classes == k].sum(axis=1)
    return out


def matched_states(c: Compiled, t: Table, seen: np.ndarray) -> Iterator[tuple[int, int]]:
    """The set that matches, and how often, for each (row, class) that was passed."""
    for row, k in zip(*np.nonzero(seen)):
        yield t.masks[row] & c.match[t.bytes_of[k]], int(seen[row, k])


def compat_table(c: Compiled, limit: int) -> Table | None:
    """A table whose rows are active sets as profilers hold them: successors of all active states that match, and the all-input states."""

    def step(active: int, byte: int) -> tuple[int, int]:
        after = 0
        for s in _bits(active):
            after |= c.succ[s]
        return 0, after & c.match[byte] | c.all_input

    return determinise(c, limit, step)


def profile_by_table(c: Compiled, t: Table, payloads: list[bytes], firsts: list[bool]) -> np.ndarray:
    """``profile`` by rule, from the visits of the automaton's table."""
    counts = np.zeros(len(c.names), np.int64)
    for mask, n in matched_states(c, t, visits(t, c.longest, payloads, firsts)):
        counts[_bits(mask)] += n
    return counts


def compat_by_table(c: Compiled, t: Table, payloads: list[bytes], firsts: list[bool]) -> np.ndarray:
    """``profile`` with compat, from the visits of compat_table and the rows that payloads end in."""
    counts = np.zeros(len(c.names), np.int64)
    rows = visits(t, 0, payloads, firsts).sum(axis=1)
    # An active set is counted before each byte, which the visits are, and once behind the last one.
    for size in sorted({len(p) for p in payloads}):
        some = [k for k, p in enumerate(payloads) if len(p) == size]
        for k, ends in zip(some, functions(t, [payloads[k] for k in some])):
            rows[ends[t.first if firsts[k] else t.later]] += 1
    for row in np.flatnonzero(rows).tolist():
        counts[_bits(t.masks[row])] += rows[row]
    return counts


def profile(c: Compiled, payloads: list[bytes], firsts: list[bool], compat: bool) -> np.ndarray:
    """How often each local state is active.

    By rule: the number of positions at which it matches. compat: as profilers count that take start
    states for active before a byte is read, whether or not they match it.
    """
    counts = np.zeros(len(c.names), np.int64)
    for k, payload in enumerate(payloads):
        enabled = c.all_input | (c.start_of_data if firsts[k] else 0)
        active, seen = enabled, {}
        for b in payload:
            if compat:
                seen[active] = seen.get(active, 0) + 1
                after, rest = 0, active
                while rest:
                    low = rest & -rest
                    after |= c.succ[low.bit_length() - 1]
                    rest ^= low
                active = after & c.match[b] | c.all_input
            else:
                matched, enabled = c.step(enabled, b)
                seen[matched] = seen.get(matched, 0) + 1
        if compat:
            seen[active] = seen.get(active, 0) + 1
        for mask, n in seen.items():
            while mask:
                low = mask & -mask
                counts[low.bit_length() - 1] += n
                mask ^= low
    return counts


def frontier(c: Compiled, payload: bytes, first: bool) -> list[int]:
    """States matched at each position: the profile of the work list."""
    enabled, out = c.all_input | (c.start_of_data if first else 0), []
    for b in payload:
        matched, enabled = c.step(enabled, b)
        out.append(matched.bit_count())
    return out
