"""Matching over unbounded streams: an extension beyond fixed inputs.

Chunks of a stream arrive in order; what is pending and the offset are the stream's state. The reports
are those of an uncut stream.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from automill.model import REPORTS, Automaton
from automill.plans import planner

_STATE = "enabled array<string>, base long"


def advance(plan: list[planner.Group], enabled: list[int] | None, payload: bytes) -> tuple[list[int], list[list[tuple[int, int]]]]:
    """States enabled after a chunk, and (offset in the chunk, local state) of its reports, by group."""
    enabled = list(enabled) if enabled is not None else [g.compiled.all_input | g.compiled.start_of_data for g in plan]
    found: list[list[tuple[int, int]]] = []
    for k, g in enumerate(plan):
        c, mask, hits, known = g.compiled, enabled[k], [], {}
        for p, b in enumerate(payload):
            got = known.get((mask, b))
            if got is None:
                if len(known) > 100_000:
                    known.clear()
                got = known[mask, b] = c.step(mask, b)
            matched, mask = got
            hit = matched & c.report
            while hit:
                low = hit & -hit
                hits.append((p, low.bit_length() - 1))
                hit ^= low
        enabled[k] = mask
        found.append(hits)
    return enabled, found


def match_stream(chunks: DataFrame, automata: Automaton | list[Automaton]) -> DataFrame:
    """Reports of a streaming DataFrame (stream_id, seq, payload). Within a trigger chunks are taken in order of seq."""
    plan = planner.plan([automata] if isinstance(automata, Automaton) else automata, strategy="arrow")
    shared = chunks.sparkSession.sparkContext.broadcast(plan)
    names = [x.split()[0] for x in REPORTS.split(", ")]

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        groups = shared.value
        enabled, base = None, 0
        if state.exists:
            masks, base = state.get
            enabled = [int(x, 16) for x in masks]
        rows = []
        for payload in pd.concat(list(frames)).sort_values("seq")["payload"]:
            enabled, found = advance(groups, enabled, bytes(payload))
            for g, hits in zip(groups, found):
                for p, s in hits:
                    number, original, code, cc = g.compiled.names[s]
                    rows.append((g.compiled.nfa_id, key[0], base + p, number, original, code, cc, g.compiled.group_id))
            base += len(payload)
        state.update(([f"{x:x}" for x in enabled], base))
        yield pd.DataFrame(rows, columns=names)

    keyed = chunks.select("stream_id", "seq", F.col("payload")).groupBy("stream_id")
    return keyed.applyInPandasWithState(run, REPORTS, _STATE, "append", GroupStateTimeout.NoTimeout)
