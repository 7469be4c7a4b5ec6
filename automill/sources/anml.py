"""ANML files as a Spark data source.

``spark.read.format("anml").option("table", "states" | "edges").load(path)``; each file is a task.
"""

from __future__ import annotations

import glob
import io
import os
import re
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from automill.functions import symbolset
from automill.model import EDGES, NONE, START_KINDS, STATES, Automaton, AutomatonError, State


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def parse(data: bytes, name: str = "nfa") -> Automaton:
    """The automaton of an ANML document: a network, or an ``anml`` element around one.

    Elements other than states, their edges, reports and descriptions are errors, and so are states
    that occur twice and edges to states that are not declared. Unknown attributes are ignored.
    """
    try:
        root = ElementTree.parse(io.BytesIO(data)).getroot()
    except ElementTree.ParseError as e:
        raise AutomatonError(f"{name}: {e}") from e
    network = root if _local(root.tag) == "automata-network" else next((x for x in root if _local(x.tag) == "automata-network"), None)
    if network is None or _local(root.tag) not in ("anml", "automata-network"):
        raise AutomatonError(f"{name}: no automata-network")
    out, edges = Automaton(name), []
    for element in network:
        tag = _local(element.tag)
        if tag == "description":
            continue
        if tag != "state-transition-element":
            raise AutomatonError(f"{name}: element {tag} is not supported")
        text = element.get("symbol-set") or ""
        state = State(element.get("id") or "", symbolset.parse(text), START_KINDS.get(element.get("start") or "", NONE), symbol_str=text)
        for child in element:
            kind = _local(child.tag)
            if kind == "activate-on-match":
                edges.append((state.str_id, child.get("element") or ""))
            elif kind == "report-on-match":
                state.report, state.code = True, child.get("reportcode")
            elif kind != "description":
                raise AutomatonError(f"{name}: element {kind} is not supported in a state")
        out.add_state(state)
    index = out.index
    if len(index) != len(out):
        raise AutomatonError(f"{name}: a state id occurs twice")
    for a, b in edges:
        if b not in index:
            raise AutomatonError(f"{name}: {a} activates {b}, which isn't declared")
        out.add_edge(index[a], index[b])
    return out


def rows(a: Automaton, table: str) -> Iterator[tuple]:
    if table == "edges":
        yield from ((a.nfa_id, x, y) for x, y in a.edges())
    else:
        for i, s in enumerate(a.states):
            yield a.nfa_id, i, s.str_id, s.original_id, bytearray(symbolset.to_bytes(s.symbols)), s.symbol_str, s.start, s.report, s.code


class _File(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.table = options.get("table", "states")
        path = re.sub("^file:/+", "/", options["path"])
        found = sorted(glob.glob(os.path.join(path, "*.anml"))) if os.path.isdir(path) else sorted(glob.glob(path))
        if not found:
            raise AutomatonError(f"no such file: {path}")
        if wrong := [p for p in found if not p.endswith(".anml")]:
            raise AutomatonError(f"only .anml files are supported: {wrong[0]}")
        self.paths = found

    def partitions(self) -> list[_File]:
        return [_File(p) for p in self.paths]

    def read(self, partition: _File) -> Iterator[tuple]:
        with open(partition.path, "rb") as f:
            name = os.path.basename(partition.path).removesuffix(".anml")
            yield from rows(parse(f.read(), name), self.table)


class AnmlSource(DataSource):
    """Option table: states (default) or edges. For paths that every executor can open."""

    @classmethod
    def name(cls) -> str:
        return "anml"

    def schema(self) -> str:
        return EDGES if self.options.get("table", "states") == "edges" else STATES

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(AnmlSource)


def load(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """States and edges of the ANML files of a path in any store that Spark reads."""
    if not path.rstrip("/").endswith(".anml") and "*" not in path and not path.endswith("/"):
        raise AutomatonError(f"only .anml files are supported: {path}")
    files = spark.read.format("binaryFile").load(path).where(F.col("path").endswith(".anml"))
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.anml$", "")
    return from_column(files.select(name.alias("name"), "content"), "name", "content")


def from_column(documents: DataFrame, id_col: str, data_col: str) -> tuple[DataFrame, DataFrame]:
    """States and edges of ANML documents that stand in a column, text or binary; rows without one are left out."""
    data = F.col(data_col) if dict(documents.dtypes)[data_col] == "binary" else F.encode(data_col, "UTF-8")
    files = documents.where(F.col(data_col).isNotNull()).select(F.col(id_col).cast("string").alias("name"), data.alias("content"))

    def run(table: str):
        def each(batches):
            import pandas as pd

            names = [x.split()[0] for x in (EDGES if table == "edges" else STATES).split(", ")]
            for batch in batches:
                found = [row for name, c in zip(batch["name"], batch["content"]) for row in rows(parse(bytes(c), name), table)]
                yield pd.DataFrame(found, columns=names)

        return each

    return files.mapInPandas(run("states"), STATES), files.mapInPandas(run("edges"), EDGES)
