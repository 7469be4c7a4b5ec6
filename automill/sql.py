"""SQL: a table function and a scalar function over automata that a session knows by name."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from automill.functions.symbolset import parse_symbol_set
from automill.model import Automaton
from automill.plans import kernels, planner


def register(spark: SparkSession, automata: dict[str, Automaton]) -> None:
    """Makes these available to SQL:

    * ``nfa_match(payload BINARY, automaton STRING)``, a table function: offset, state_id, original_id, report_code
    * ``nfa_count(payload, automaton)``: the number of reports
    * ``parse_symbol_set(class)``: the 32 bytes of a symbol class
    """
    plans = {name: planner.plan([a]) for name, a in automata.items()}
    shared = spark.sparkContext.broadcast(plans)

    @F.udtf(returnType="offset bigint, state_id int, original_id string, report_code string")
    class NfaMatch:
        def eval(self, payload, automaton: str):
            if payload is None:
                return
            found = []
            for group in shared.value[automaton]:
                for _, offs, local in _hits(group, [bytes(payload)]):
                    names = group.compiled.names
                    found += [(o, *names[s][:3]) for o, s in zip(offs.tolist(), local.tolist())]
            yield from sorted(found, key=lambda r: r[:2])

    @F.pandas_udf(LongType())
    def nfa_count(payloads: pd.Series, names: pd.Series) -> pd.Series:
        out = np.zeros(len(payloads), np.int64)
        for name in names.unique():
            at = np.flatnonzero((names == name).to_numpy() & payloads.notna().to_numpy())
            data = [bytes(payloads.iloc[i]) for i in at]
            for group in shared.value[name]:
                if group.table is not None:
                    out[at] += kernels.count(group.table, group.compiled.longest, data, [True] * len(at))
                    continue
                for segs, _, _ in _hits(group, data):
                    out[at] += np.bincount(segs, minlength=len(at))
        return pd.Series(out)

    spark.udtf.register("nfa_match", NfaMatch)
    spark.udf.register("nfa_count", nfa_count)
    spark.udf.register("parse_symbol_set", parse_symbol_set)


def _hits(group: planner.Group, payloads: list[bytes]):
    firsts = [True] * len(payloads)
    if group.table is not None:
        return kernels.lock_step(group.table, group.compiled.longest, payloads, firsts)
    return kernels.lazy(group.compiled, payloads, firsts)
