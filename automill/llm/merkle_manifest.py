"""A Merkle manifest of a table: a tree for each group of rows, a tree over the groups' roots, and every row's proof.

A row's leaf is the digest of its fields. Within a group leaves stand in order of their ids; every ``fanout``
consecutive nodes, the last run fewer, become the digest of their concatenated hex digests, until one node is left.
The groups' roots, in the order of the groups, give the root in the same way.

Ranks come from a range partitioning and the counts of its partitions, so a group may hold all rows. Nodes are dealt
in aligned blocks of ``fanout ** LEVELS``: a block's digests are one contiguous matrix of 64-byte rows, a level is a
reshape by the fanout and a digest of each row, and siblings are found by arithmetic on indices. Blocks' roots
are the nodes of the next tier. Down again, a block meets one row, its own path to the root, so proofs are never
shuffled. No task holds more than a block.

Edge cases: a null field is ``-``, other than the empty one; a null group is a group of its own and comes first; null
ids come first in their group; rows of equal id stand in order of their leaves, and repeated rows are leaves
each; a lone leaf is its group's root, and a lone group's root is the root; an empty table has no rows and the root None;
columns that are not fields pass by, whatever they are called.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from automill.llm.scratch import keep

FANOUT = 3
#: Levels of a block: with a fanout of 3, 729 leaves.
LEVELS = 6
#: Counts of (partition, group) that are broadcast at most.
BROADCAST_COUNTS = 100_000

_PATH = "array<struct<before: string, behind: string>>"
_PATH_ARROW = pa.list_(pa.struct([("before", pa.string()), ("behind", pa.string())]))


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(values: list[Column]) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]).cast("binary"), 256)


# Digest matrices: rows of 64 hex digits.


def hash_rows(rows: np.ndarray) -> np.ndarray:
    """The hex digests of a matrix's rows, as a matrix."""
    width, data = rows.shape[1], np.ascontiguousarray(rows).tobytes()
    hexes = "".join(hashlib.sha256(data[i : i + width]).hexdigest() for i in range(0, len(data), width)) if width else ""
    return np.frombuffer(hexes.encode(), np.uint8).reshape(-1, 64)


def climb(nodes: np.ndarray, fanout: int, steps: int | None) -> list[np.ndarray]:
    """A block's levels from the nodes up: so many steps, or until one node is left."""
    out = [nodes]
    while len(out) <= steps if steps is not None else len(out[-1]) > 1:
        now = out[-1]
        full = len(now) // fanout
        up = [hash_rows(now[: full * fanout].reshape(full, fanout * 64))] if full else []
        if len(now) % fanout:
            up.append(hash_rows(now[full * fanout :].reshape(1, -1)))
        out.append(np.concatenate(up))
    return out


def runs(levels: list[np.ndarray], fanout: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each level below the top and each node of the lowest: its run's digests (n, fanout, 64), which of them exist, and its own place."""
    at = np.arange(len(levels[0]))
    for nodes in levels[:-1]:
        own = at % fanout
        members = (at - own)[:, None] + np.arange(fanout)
        there = members < len(nodes)
        yield nodes[np.minimum(members, len(nodes) - 1)], there, own
        at = at // fanout


def fold(current: np.ndarray, levels: list[np.ndarray], fanout: int) -> np.ndarray:
    """The block's root as each of the given digests, in its node's place and with that node's siblings, gives it."""
    for run, there, own in runs(levels, fanout):
        run[np.arange(len(current)), own] = current
        width = there.sum(1)
        current = np.empty_like(current)
        for w in np.unique(width):
            pick = width == w
            current[pick] = hash_rows(run[pick, :w].reshape(-1, w * 64))
    return current


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """A column of digests as a matrix."""
    return np.frombuffer("".join(column.to_pylist()).encode(), np.uint8).reshape(-1, 64)


def _texts(matrix: np.ndarray) -> list[str]:
    data = matrix.tobytes().decode()
    return [data[i : i + 64] for i in range(0, len(data), 64)]


# Tiers of blocks.


@dataclass
class Forest:
    """Trees over nodes (g, rank, n, h): the group, the node's rank and the number of nodes in it, and the digest.

    ``tiers[0]`` are the nodes; a tier's blocks are the next one's nodes.
    """

    tiers: list[DataFrame]
    fanout: int
    levels: int

    @staticmethod
    def grow(nodes: DataFrame, fanout: int, levels: int) -> Forest:
        size = fanout**levels
        most = nodes.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
        tiers = [nodes]
        while len(tiers) == 1 or most > 1:
            below = tiers[-1] if len(tiers) == 1 else tiers[-1].where("n > 1")
            tiers.append(keep(_by_block(below, size).applyInArrow(_climber(fanout, levels), "g string, rank long, n long, h string"), "merkle-tier"))
            most = -(-most // size)
        return Forest(tiers, fanout, levels)

    def tops(self) -> DataFrame:
        """g and the digest of the tree."""
        return reduce(DataFrame.unionByName, [t.where("n = 1").select("g", "h") for t in self.tiers[1:]])

    def descend(self, tops: DataFrame, out: Callable, schema: str) -> DataFrame:
        """From each tree's (g, rank 0, top, path) down; ``out`` makes the rows of the lowest nodes."""
        paths, size = tops, self.fanout**self.levels
        for t in range(len(self.tiers) - 2, 0, -1):
            joined = _by_block(self.tiers[t].select("g", "rank", "n", "h"), size).cogroup(paths.groupBy("g", "rank"))
            paths = joined.applyInArrow(_paths(self.fanout, self.levels, False), f"g string, rank long, top string, path {_PATH}")
        joined = _by_block(self.tiers[0], size).cogroup(paths.groupBy("g", "rank"))
        return joined.applyInArrow(out, schema)


def _by_block(nodes: DataFrame, size: int):
    return nodes.withColumn("block", F.floor(F.col("rank") / size).cast("long")).groupBy("g", "block")


def _levels(table: pa.Table, fanout: int, levels: int) -> list[np.ndarray]:
    n = table.column("n")[0].as_py()
    return climb(_matrix(table.column("h")), fanout, None if n <= fanout**levels else levels)


def _climber(fanout: int, levels: int) -> Callable:
    size = fanout**levels

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("rank")
        top = _levels(table, fanout, levels)[-1]
        n, block = table.column("n")[0].as_py(), table.column("block")[0].as_py()
        g = table.column("g")[0].as_py()
        return pa.table({"g": [g], "rank": pa.array([block], pa.int64()), "n": pa.array([-(-n // size)], pa.int64()), "h": _texts(top)})

    return run


def _sides(levels: list[np.ndarray], fanout: int, above: list[dict]) -> list[list[dict]]:
    """Each node's path: at every level, bottom first, the siblings before and behind it; then the block's own path."""
    out: list[list[dict]] = [[] for _ in levels[0]]
    for run, there, own in runs(levels, fanout):
        for i, (o, w) in enumerate(zip(own.tolist(), there.sum(1).tolist())):
            out[i].append({"before": run[i, :o].tobytes().decode(), "behind": run[i, o + 1 : w].tobytes().decode()})
    return [x + above for x in out]


def _paths(fanout: int, levels: int, by_name: bool) -> Callable:
    """Paths of a block's nodes. A tree of fewer tiers passes its top's path down."""

    def run(nodes: pa.Table, paths: pa.Table) -> pa.Table:
        if not nodes.num_rows:
            return paths
        nodes = nodes.sort_by("rank")
        found = _sides(_levels(nodes, fanout, levels), fanout, paths.column("path")[0].as_py())
        top = [paths.column("top")[0].as_py()] * len(found)
        if by_name:  # of groups: the next trees' tops
            return pa.table({"g": nodes.column("name"), "rank": pa.array([0] * len(found), pa.int64()), "top": nodes.column("h"), "path": pa.array(found, _PATH_ARROW), "root": pa.array(top)})
        return pa.table({"g": nodes.column("g"), "rank": nodes.column("rank"), "top": pa.array(top), "path": pa.array(found, _PATH_ARROW)})

    return run


def _prover(fanout: int, levels: int, id_type: pa.DataType, root: str, with_path: bool) -> Callable:
    def run(nodes: pa.Table, paths: pa.Table) -> pa.Table:
        nodes = nodes.sort_by("rank")
        tree, above = _levels(nodes, fanout, levels), paths.column("path")[0].as_py()
        parts = [(run, there & (np.arange(fanout) != own[:, None])) for run, there, own in runs(tree, fanout)]
        upper = "".join(s["before"] + s["behind"] for s in above).encode()
        proofs = [hashlib.sha256(b"".join([*(run[i][others[i]].tobytes() for run, others in parts), upper])).hexdigest() for i in range(len(tree[0]))]
        current = _texts(fold(_matrix(nodes.column("now")), tree, fanout))
        for s in above:
            current = [hashlib.sha256((s["before"] + h + s["behind"]).encode()).hexdigest() for h in current]
        found = {
            "id": nodes.column("id").cast(id_type), "leaf": nodes.column("h"), "subroot": pa.array([paths.column("top")[0].as_py()] * len(current)),
            "root": pa.array([root] * len(current)), "proof_sha256": pa.array(proofs), "folded_root": pa.array(current), "verified": pa.array([h == root for h in current]),
        }
        if with_path:
            found["path"] = pa.array(_sides(tree, fanout, above), _PATH_ARROW)
        return pa.table(found)

    return run


# Ranks.


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """The rows with their rank in their group ``g`` and the group's number of rows ``n``."""
    kind = rows.schema
    placed = rows.repartitionByRange("g", *order).sortWithinPartitions("g", *order)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, seen = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            ends = pc.run_end_encode(batch.column("g"))
            place = np.arange(batch.num_rows, dtype=np.int64)
            begin = 0
            for end, g in zip(ends.run_ends.to_pylist(), ends.values.to_pylist()):
                seen = seen if g == last else 0
                place[begin:end] += seen - begin
                seen, last, begin = seen + end - begin, g, end
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * batch.num_rows, pa.int32()), pa.array(place)], [*batch.schema.names, "part", "place"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kind), "part int, place long"])
    placed = keep(placed.mapInArrow(number, schema), "merkle-ranks")
    in_group = Window.partitionBy("g")
    counts = placed.groupBy("part", "g").agg(F.count(F.lit(1)).alias("rows_here"))
    counts = counts.select(
        "part", "g",
        (F.sum("rows_here").over(in_group.orderBy("part")) - F.col("rows_here")).alias("first"),
        F.sum("rows_here").over(in_group).alias("n"),
    )
    counts = keep(counts, "merkle-counts")
    few = counts.count() <= BROADCAST_COUNTS
    return placed.join(F.broadcast(counts) if few else counts, ["part", "g"]).select(
        "g", (F.col("first") + F.col("place")).alias("rank"), "n", *[c for c in rows.columns if c != "g"]
    )


# The operator.


@dataclass
class Manifest:
    """Digests of a table: ``leaves`` (g, rank, n, h, id, now), the trees of groups, the tree over them, and the root."""

    leaves: DataFrame
    groups: Forest
    top: Forest
    root: str | None

    def subroots(self, group_col: str = "source") -> DataFrame:
        """Each group with its root, in the order of ``rank``."""
        name = F.when(F.col("name") != "-", F.substr(F.col("name"), F.lit(2)))
        return self.top.tiers[0].select(name.alias(group_col), "rank", F.col("h").alias("subroot"))

    def prove(self, id_col: str = "doc_id", with_path: bool = False) -> DataFrame:
        """Each row's leaf, subroot, root, proof, and the root that its present fields give with the recorded siblings."""
        tree = self.groups
        start = self.leaves.sparkSession.createDataFrame([("", 0, self.root, [])] if self.root else [], f"g string, rank long, top string, path {_PATH}")
        tops = self.top.descend(start, _paths(tree.fanout, tree.levels, True), f"g string, rank long, top string, path {_PATH}, root string")
        tops = keep(tops.drop("root"), "merkle-tops")
        kind = self.leaves.schema["id"].dataType
        of = pa.int64() if kind.typeName() == "long" else pa.string()
        schema = "id " + kind.simpleString() + ", leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
        schema += f", path {_PATH}" if with_path else ""
        return tree.descend(tops, _prover(tree.fanout, tree.levels, of, self.root, with_path), schema).withColumnRenamed("id", id_col)


def build(
    rows: DataFrame,
    fields: list[str],
    *,
    id_col: str = "doc_id",
    group_col: str = "source",
    present: list[Column] | None = None,
    fanout: int = FANOUT,
    levels: int = LEVELS,
) -> Manifest:
    """The manifest of rows. ``present``: the fields as they are now, where that may differ from what was recorded."""
    wide = rows.schema[id_col].dataType.typeName() in ("byte", "short", "integer", "long")
    leaves = rows.select(
        F.when(F.col(group_col).isNull(), "-").otherwise(F.concat(F.lit("="), F.col(group_col).cast("string"))).alias("g"),
        F.col(id_col).cast("long" if wide else "string").alias("id"),
        leaf([F.col(c) for c in fields]).alias("h"),
        leaf(present or [F.col(c) for c in fields]).alias("now"),
        F.monotonically_increasing_id().alias("row"),  # lets equal rows be dealt to many tasks
    )
    leaves = keep(ranked(leaves, ["id", "h", "now", "row"]).drop("row"), "merkle-leaves")
    groups = Forest.grow(leaves, fanout, levels)
    subroots = groups.tops().select(F.lit("").alias("g"), F.col("g").alias("name"), "h")
    top = Forest.grow(keep(ranked(subroots, ["name"]), "merkle-subroots"), fanout, levels)
    found = top.tops().collect()  # one row: the root
    return Manifest(leaves, groups, top, found[0]["h"] if found else None)
