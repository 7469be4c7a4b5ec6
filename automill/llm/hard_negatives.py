"""Hard-negative mining with a vantage-point tree over norm-augmented vectors.

Vectors become whole numbers, floor(scale * x), and a score is an inner product, exact in doubles. Every vector
gets one more component that brings its norm to the largest one, M; anchors get 0 there. A score s then is a distance,
d^2 = |q|^2 + M^2 - 2 s, high scores are near, and a window of scores is an annulus around the anchor.

The tree is fitted on a sample of at most ``SAMPLE`` rows and has at most ``LEAVES`` leaves; every row is dealt to its
leaf, and what is stored of a leaf are the smallest and the largest distances of all its rows to the leaf's vantage points,
so bounds hold for all rows, not for the sample. A leaf's rows are dealt into chunks of about ``CHUNK_ROWS``, however many
rows or copies it has.

A search goes through the leaves that reach into its annulus, nearest first, in waves: the nearest leaf, then the next
ones, then all others; what the k best rows found so far rule out is left out of the next wave. So results are those of
comparing everything. A visit is a chunk's matrix times a matrix of anchors, and gives k rows for an anchor and window at most.
First each anchor's best rows of the same label are searched, then, at once for the windows of all of them, rows
of other labels.

Edge cases: rows with a null label or vector, or with a null or non-finite component, take no part; vectors of different
lengths are filled up with zeros; a null id is no anchor and comes last among equal scores; repeated rows count one
by one, an anchor's copy is another row; a positive with a negative score has an empty window; an empty table gives an
empty result; other columns are ignored. Vectors whose squares sum up to 2^53 or more are an error, as their scores would not be exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from automill.llm.scratch import keep

#: Rows that the tree is fitted on, and its leaves, at most.
SAMPLE, LEAVES = 4096, 256
#: Rows of a chunk and anchors of a visit, about.
CHUNK_ROWS, VISIT_ROWS = 2048, 512
#: Leaves of the first waves; the last wave has the rest.
WAVES = (1, 8)
#: Candidates for a vantage point.
_TRIES = 8


@dataclass
class Tree:
    """Vantage points with their augmented component, radii and children; a child below 0 is leaf -1 - child."""

    points: np.ndarray
    radius: np.ndarray
    children: np.ndarray
    most: float
    leaves: int

    @staticmethod
    def fit(sample: np.ndarray, most: float, leaves: int) -> Tree:
        rng = np.random.default_rng(0)
        full = augmented(sample, most)
        points, radius, children = [], [], []
        made = 0

        def split(rows: np.ndarray, want: int) -> int:
            nonlocal made
            if want > 1:
                tries = rng.choice(rows, min(_TRIES, len(rows)), replace=False)
                far = distances(full[rows], full[tries])
                best = int(np.argmax(far.std(axis=0)))
                d = far[:, best]
                r = float(np.median(d))
                inside = d <= r
                if inside.all():
                    r = float(np.max(d[d < r], initial=-1.0))
                    inside = d <= r
                if inside.any():
                    k = len(points)
                    points.append(full[tries[best]])
                    radius.append(r)
                    children.append([0, 0])
                    children[k] = [split(rows[inside], (want + 1) // 2), split(rows[~inside], want // 2)]
                    return k
            made += 1
            return -made

        split(np.arange(len(full)), leaves)
        width = full.shape[1]
        return Tree(np.array(points).reshape(-1, width), np.array(radius), np.array(children, np.int64).reshape(-1, 2), most, made)

    def leaf(self, far: np.ndarray) -> np.ndarray:
        """The leaf of each row, from the rows' distances to all vantage points."""
        at = np.zeros(len(far), np.int64) if len(self.radius) else np.full(len(far), -1)
        while (inner := at >= 0).any():
            rows, nodes = np.flatnonzero(inner), at[inner]
            at[rows] = self.children[nodes, (far[rows, nodes] > self.radius[nodes]).astype(int)]
        return -1 - at


def augmented(vectors: np.ndarray, most: float) -> np.ndarray:
    """With the component that brings the square of the norm to ``most``."""
    return np.hstack([vectors, np.sqrt(np.maximum(0.0, most - (vectors * vectors).sum(1)))[:, None]])


def distances(rows: np.ndarray, points: np.ndarray) -> np.ndarray:
    squares = (rows * rows).sum(1)[:, None] + (points * points).sum(1) - 2 * (rows @ points.T)
    return np.sqrt(np.maximum(0.0, squares))


def bounds(anchors: np.ndarray, tree: Tree, near: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lowest and the highest score that an anchor can have with a row of each leaf; (anchors, leaves).

    ``near`` and ``far`` are the smallest and largest distances (leaves, vantage points) of the leaves' rows.
    """
    squares = (anchors * anchors).sum(1)[:, None] + tree.most
    low = np.zeros((len(anchors), len(near)))
    high = np.full(low.shape, np.inf)
    if len(tree.radius):
        d = distances(np.hstack([anchors, np.zeros((len(anchors), 1))]), tree.points)
        for leaf in range(len(near)):
            low[:, leaf] = np.maximum(d - far[leaf], near[leaf] - d).max(1).clip(0)
            high[:, leaf] = (d + far[leaf]).min(1)
    slip = 1 + 1e-6 * squares
    limit = np.sqrt((squares - tree.most) * tree.most) + slip  # of any score, by the norms
    return np.maximum((squares - high**2) / 2 - slip, -limit), np.minimum((squares - low**2) / 2 + slip, limit)


def _vectors(column: pa.Array, width: int) -> np.ndarray:
    """Lists of numbers as rows of doubles, short ones filled up with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.values.to_numpy(zero_copy_only=False)[column.offsets[0].as_py() : column.offsets[-1].as_py()] if len(column) else np.zeros(0)
    if (sizes == width).all():
        return flat.astype(np.float64).reshape(len(column), width)
    out = np.zeros((len(column), width))
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def _array(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


# Rows, leaves and chunks.


def points(rows: DataFrame, id_col: str, label: Column, vec_col: str, anchor: Column, scale: int) -> DataFrame:
    """The rows that take part: row (a number of their own), id, label, v, squares, and whether they are anchors."""
    usable = F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    scaled = F.transform(vec_col, lambda x: F.lit(float(scale)) * x.cast("double"))
    exact = F.aggregate(scaled, F.lit(0.0), lambda acc, x: acc + (F.abs(x) + 1) * (F.abs(x) + 1)) < float(2**53)
    whole = F.when(exact, F.transform(scaled, lambda x: F.floor(x).cast("int")))
    out = rows.select(
        F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), whole.alias("v"), F.coalesce(anchor, F.lit(False)).alias("anchor"), usable.alias("usable")
    )
    out = out.where("label is not null and usable").drop("usable").withColumn("row", F.monotonically_increasing_id())
    squares = F.aggregate("v", F.lit(0).cast("long"), lambda acc, x: acc + x.cast("long") * x.cast("long"))
    return keep(out.withColumn("squares", squares), "hard-points")


class Index:
    """All rows in the chunks of a tree's leaves."""

    def __init__(self, rows: DataFrame, leaves: int = LEAVES, chunk_rows: int = CHUNK_ROWS, sample: int = SAMPLE):
        n, bad, most, width = rows.agg(F.count(F.lit(1)), F.count(F.when(F.col("v").isNull(), 1)), F.max("squares"), F.max(F.size("v"))).first()
        if bad:
            raise ValueError(f"{bad} vectors are too large: the sum of their squares reaches 2^53")
        self.rows, self.n, self.width, self.spark = rows, n, width or 0, rows.sparkSession
        if not n:
            return
        some = rows.select("v", F.xxhash64("row").alias("h")).orderBy("h").limit(sample).toArrow()
        self.tree = Tree.fit(_vectors(_array(some.column("v")), self.width), float(most), max(1, min(leaves, -(-n // chunk_rows))))
        dealt = keep(self._dealt(rows), "hard-leaves")
        sizes = dict(dealt.groupBy("leaf").count().collect())
        self.chunks = {leaf: -(-size // chunk_rows) for leaf, size in sizes.items()}
        many = F.element_at(F.create_map(*[F.lit(int(x)) for kv in sorted(self.chunks.items()) for x in kv]), F.col("leaf"))
        chunked = dealt.withColumn("chunk", F.pmod(F.xxhash64("row"), many).cast("int"))
        schema = "leaf int, chunk int, data binary, ids array<long>, labels array<long>, own array<long>, near array<double>, far array<double>"
        self.blocks = keep(chunked.groupBy("leaf", "chunk").applyInArrow(self._packer(), schema), "hard-blocks")
        self.near = np.full((self.tree.leaves, len(self.tree.radius)), np.inf)
        self.far = np.full(self.near.shape, -np.inf)
        reach = self.blocks.select("leaf", F.posexplode(F.arrays_zip("near", "far"))).groupBy("leaf", "pos").agg(F.min("col.near"), F.max("col.far"))
        for leaf, k, a, b in reach.collect():
            self.near[leaf, k], self.far[leaf, k] = a, b

    def _dealt(self, rows: DataFrame) -> DataFrame:
        tree, width = self.spark.sparkContext.broadcast(self.tree), self.width

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                far = distances(augmented(_vectors(batch.column("v"), width), tree.value.most), tree.value.points)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tree.value.leaf(far), pa.int32())], [*batch.schema.names, "leaf"])

        return rows.select("row", "id", "label", "v").mapInArrow(run, "row long, id long, label long, v array<int>, leaf int")

    def _packer(self) -> Callable:
        tree, width = self.spark.sparkContext.broadcast(self.tree), self.width

        def run(table: pa.Table) -> pa.Table:
            table = table.sort_by([("id", "ascending"), ("row", "ascending")])  # null ids last
            vectors = _vectors(_array(table.column("v")), width)
            far = distances(augmented(vectors, tree.value.most), tree.value.points)
            lists = {name: pa.array([table.column(c).to_pylist()], pa.list_(pa.int64())) for name, c in (("ids", "id"), ("labels", "label"), ("own", "row"))}
            reach = {name: pa.array([x.tolist()], pa.list_(pa.float64())) for name, x in (("near", far.min(0)), ("far", far.max(0)))}
            first = {c: pa.array([table.column(c)[0].as_py()], pa.int32()) for c in ("leaf", "chunk")}
            return pa.table({**first, "data": pa.array([vectors.astype("<i4").tobytes()], pa.binary()), **lists, **reach})

        return run

    def search(self, queries: DataFrame, k: int, same: bool, waves: tuple[int, ...] = WAVES, visit_rows: int = VISIT_ROWS) -> DataFrame:
        """The k best rows of each query and window: (query, w, score, id, own, rank), by score, then id.

        Queries have query (their row), label, v and ``windows`` (w, lo, hi): scores from lo to hi. Rows are of the query's label
        or of another one; a query's own row is never found.
        """
        parts = max(1, -(-queries.count() // visit_rows))
        best, begin = None, 0
        for wave in [*waves, self.tree.leaves]:
            if begin >= self.tree.leaves:
                break
            asked = queries.withColumn("limits", F.array().cast("array<struct<w: int, score: long>>"))
            if best is not None:
                limits = best.where(F.col("rank") == k).groupBy("query").agg(F.collect_list(F.struct("w", "score")).alias("limits"))
                asked = queries.join(limits, "query", "left")
            visits = keep(self._visits(asked, begin, begin + wave, parts), "hard-visits")
            needed = visits.select("leaf", "chunk", F.col("part").alias("part")).distinct()
            blocks = self.blocks.drop("near", "far").join(needed, ["leaf", "chunk"])
            key = ("leaf", "chunk", "part")
            met = blocks.groupBy(*key).cogroup(visits.groupBy(*key)).applyInArrow(_visitor(self.width, k, same), "query long, w int, score long, id long, own long")
            found = met if best is None else met.unionByName(best.drop("rank"))
            order = Window.partitionBy("query", "w").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last(), "own")
            best = keep(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), "hard-best")
            begin += wave
        return best

    def _visits(self, asked: DataFrame, begin: int, end: int, parts: int) -> DataFrame:
        """The chunks that the queries go to in a wave: of the leaves in reach of a window, the begin-th to the end-th nearest.

        The order of the leaves is that of the windows alone, so it is the same in every wave.
        """
        shared = self.spark.sparkContext.broadcast((self.tree, self.near, self.far))
        schema = "leaf int, query long, label long, v array<int>, windows array<struct<w: int, lo: long, hi: long>>"
        rows = asked.select("query", "label", "v", "windows", "limits").mapInArrow(_planner(shared, self.width, begin, end), schema)
        many = F.element_at(F.create_map(*[F.lit(int(x)) for kv in sorted(self.chunks.items()) for x in kv]), F.col("leaf"))
        rows = rows.withColumn("chunk", F.explode(F.sequence(F.lit(0), many - 1)))
        return rows.withColumn("part", F.pmod(F.xxhash64("query"), F.lit(parts)).cast("int"))


def _planner(shared: Broadcast, width: int, begin: int, end: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, near, far = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                low, high = bounds(_vectors(batch.column("v"), width), tree, near, far)
                windows, limits = batch.column("windows").to_pylist(), batch.column("limits").to_pylist()
                leaves, origin, narrowed = [], [], []
                for i, asked in enumerate(windows):
                    by_leaf: dict[int, list[dict]] = {}
                    least = {x["w"]: x["score"] for x in limits[i] or []}
                    for x in asked:
                        reach = (high[i] >= x["lo"]) & (low[i] <= x["hi"])
                        order = np.lexsort((np.arange(len(reach)), -np.minimum(high[i], x["hi"])))
                        lo = max(x["lo"], least.get(x["w"], x["lo"]))
                        for leaf in order[reach[order]][begin:end].tolist():
                            if high[i, leaf] >= lo:
                                by_leaf.setdefault(leaf, []).append({"w": x["w"], "lo": lo, "hi": x["hi"]})
                    for leaf, some in by_leaf.items():
                        leaves.append(leaf)
                        origin.append(i)
                        narrowed.append(some)
                picked = batch.take(pa.array(origin, pa.int64()))
                kind = pa.list_(pa.struct([("w", pa.int32()), ("lo", pa.int64()), ("hi", pa.int64())]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(leaves, pa.int32()), *[picked.column(c) for c in ("query", "label", "v")], pa.array(narrowed, kind)],
                    ["leaf", "query", "label", "v", "windows"],
                )

    return run


def _visitor(width: int, k: int, same: bool) -> Callable:
    """A chunk against the anchors that visit it."""
    empty = pa.table({"query": pa.array([], pa.int64()), "w": pa.array([], pa.int32()), **{c: pa.array([], pa.int64()) for c in ("score", "id", "own")}})

    def run(block: pa.Table, visits: pa.Table) -> pa.Table:
        if not block.num_rows or not visits.num_rows:
            return empty
        own, labels = (np.array(block.column(c)[0].as_py(), np.int64) for c in ("own", "labels"))
        ids = block.column("ids")[0].as_py()
        rows = np.frombuffer(block.column("data")[0].as_py(), "<i4").reshape(len(own), width).astype(np.float64)
        out = []
        for begin in range(0, visits.num_rows, VISIT_ROWS):
            some = visits.slice(begin, VISIT_ROWS)
            query = some.column("query").to_numpy()
            scores = _vectors(_array(some.column("v")), width) @ rows.T
            fits = (some.column("label").to_numpy()[:, None] == labels) == same
            fits &= query[:, None] != own
            asked = [{x["w"]: x for x in windows} for windows in some.column("windows").to_pylist()]
            for w in sorted({w for x in asked for w in x}):
                here = np.array([i for i, x in enumerate(asked) if w in x])
                lo, hi = (np.array([asked[i][w][e] for i in here.tolist()], np.float64)[:, None] for e in ("lo", "hi"))
                now = scores[here]
                now = np.where(fits[here] & (now >= lo) & (now <= hi), now, -np.inf)
                for i, row in zip(here.tolist(), now):
                    for j in _first(row, k):
                        out.append((int(query[i]), w, int(row[j]), ids[j], int(own[j])))
        if not out:
            return empty
        return pa.table([pa.array(c, t.type) for c, t in zip(zip(*out), empty.schema)], names=empty.schema.names)

    return run


def _first(scores: np.ndarray, k: int) -> list[int]:
    """Places of the k highest finite scores, of equal ones the first."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        if least == -np.inf:
            return np.flatnonzero(scores > least).tolist()
        above = np.flatnonzero(scores > least)
        return [*above.tolist(), *np.flatnonzero(scores == least)[: k - len(above)].tolist()]
    return np.flatnonzero(scores > -np.inf).tolist()


# The operator.


def mine(
    rows: DataFrame,
    anchor: Column,
    *,
    id_col: str = "vec_id",
    label: Column | None = None,
    vec_col: str = "embedding",
    scale: int = 256,
    positives: int = 5,
    negatives: int = 10,
    window: tuple[int, int] = (30, 90),
    leaves: int = LEAVES,
    chunk_rows: int = CHUNK_ROWS,
    waves: tuple[int, ...] = WAVES,
) -> DataFrame:
    """For each anchor, each of its best rows of the same label (positives) and each hard negative a row.

    Hard negatives of a positive are the best rows of other labels with a score from window[0] to window[1] per cent of the positive's.
    Columns: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.
    """
    usable = points(rows, id_col, F.col("label") if label is None else label, vec_col, anchor, scale)
    index = Index(usable, leaves, chunk_rows)
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not index.n:
        return rows.sparkSession.createDataFrame([], schema)
    asked = usable.where("anchor").select(F.col("row").alias("query"), "id", "label", "v")
    any_score = F.array(F.struct(F.lit(0).alias("w"), F.lit(-(2**53)).alias("lo"), F.lit(2**53).alias("hi")))
    good = index.search(asked.withColumn("windows", any_score), positives, True, waves)
    low = F.ceil(F.col("score") * window[0] / F.lit(100).cast("decimal(3,0)")).cast("long")
    high = F.floor(F.col("score") * window[1] / F.lit(100).cast("decimal(3,0)")).cast("long")
    windows = good.where("score >= 0").groupBy("query").agg(F.collect_list(F.struct(F.col("rank").alias("w"), low.alias("lo"), high.alias("hi"))).alias("windows"))
    bad = index.search(asked.join(windows, "query"), negatives, False, waves)
    good = good.select("query", F.col("rank").alias("w"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    bad = bad.select("query", "w", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    ids = asked.select("query", F.col("id").alias("anchor_id"))
    return good.join(bad, ["query", "w"]).join(ids, "query").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
