"""Near-duplicate detection with circulant MinHash.

Two permutations make the whole signature: the first places every shingle in a universe of ``UNIVERSE``
positions, the second, shifted circularly by k, gives coordinate k. With the second one stored as a
table and its head repeated behind its tail, the coordinates of a shingle are a contiguous slice, and a
signature is the minimum over the slices of the set. Signatures are cut into bands; texts that agree
on a band are candidates; links are confirmed on full shingle sets.

Groups of any size are handled without making all pairs:

1. Texts with equal sets form a class; its smallest id stands for it.
2. In every band each class meets the smallest id of its bucket only. A class is compared with the
   pivot it meets most often, and confirmed links form trees that pointer jumping resolves.
3. Buckets that still hold several components are compared across components, each class outside
   the bucket's largest component with every class of another one, so no link between components is
   lost; pairs whose sizes, common shingles or signatures rule a link out are skipped, first by kinds of classes that
   have the same size and number of common shingles, so texts of one template that are not linked make no pairs. Confirmed links join components.

Edge cases: null and empty text, or text without words, has an empty set and no links; ties go to the
smallest id; repeated rows share their component; null ids count as documents of their own whose
component is null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from automill.llm import kernels
from automill.llm.scratch import drop, keep

#: Words of a shingle, and the least similarity of a link in hundredths.
SHINGLE, LEAST = 5, 75
#: Bands and coordinates of a band: a pair at similarity 0.75 is missed with probability 6e-5, at 0.8 with 6e-7.
BANDS, ROWS = 36, 5
UNIVERSE = 1 << 20
#: Share of equal coordinates under which a pair isn't confirmed: five standard deviations below 0.75.
LEAST_AGREEMENT = 0.58
#: Parts of the hash range in which common shingles are bounded one by one.
PARTS = 32
#: Ids of candidates that are broadcast at most, to pick their texts; more of them are joined by a shuffle of the texts.
BROADCAST_IDS = 1_000_000
#: Followers of a pivot that are compared in one group.
GROUP = 256
SEED = 20_24


@lru_cache(maxsize=1)
def _table() -> np.ndarray:
    """Row p has the coordinates of position p: the second permutation at p, p + 1, ..., circularly."""
    second = np.random.default_rng(SEED).permutation(UNIVERSE).astype(np.int32)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([second, second[: BANDS * ROWS]]), BANDS * ROWS)


def signature(shingles: np.ndarray) -> np.ndarray:
    """Coordinates of a set; the first permutation is the shingles' own mixing, cut to the universe."""
    table, out = _table(), np.full(BANDS * ROWS, UNIVERSE, np.int32)
    at = (kernels.mix(shingles ^ np.uint64(SEED)) & np.uint64(UNIVERSE - 1)).astype(np.int64)
    for i in range(0, len(at), 1024):
        np.minimum(out, table[at[i : i + 1024]].min(axis=0), out=out)
    return out


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, digests, signs = [], [], []
        for s in kernels.shingle_sets(batch.column(1), SHINGLE):
            sizes.append(len(s))
            digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
            signs.append(signature(s).astype(np.uint16).tobytes() if len(s) else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(signs, pa.binary())],
            ["id", "n", "digest", "sign"],
        )


def _agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose signatures do not rule a link out."""
    for batch in batches:
        if batch.num_rows:
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for i in (2, 3))
            batch = batch.filter(pa.array((a == b).mean(axis=1) >= LEAST_AGREEMENT))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"])


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, salt, role, b, text) sorted so that a's own text comes before those of its partners b."""
    head, own = None, np.zeros(0, np.uint64)
    for batch in batches:
        a, salt, role, b = (batch.column(i).to_pylist() for i in range(4))
        left, right = [], []
        for i, s in enumerate(kernels.shingle_sets(batch.column(4), SHINGLE)):
            if role[i] == 0:
                head, own = (a[i], salt[i]), s
            elif head == (a[i], salt[i]):
                both = len(np.intersect1d(own, s, assume_unique=True))
                if 100 * both >= LEAST * (len(own) + len(s) - both):
                    left.append(a[i])
                    right.append(b[i])
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough. Texts are (id, text), one row per id.

    Each text goes to its partner's group once; a pivot with many partners is salted into groups of
    about ``GROUP``, and its text is sent to each.
    """
    load = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / GROUP).cast("int").alias("salts"))
    heads = load.select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("role"), F.col("a").alias("b"))
    load = load.select(F.col("a").alias("a_"), F.xxhash64("a").alias("key_"), "salts")
    salt = F.pmod(F.xxhash64("b"), F.col("salts")).cast("int")
    tails = pairs.join(load, (F.xxhash64("a") == F.col("key_")) & (F.col("a") == F.col("a_")))
    wanted = heads.unionByName(tails.select("a", salt.alias("salt"), F.lit(1).alias("role"), "b"))
    rows = wanted.join(texts.select(F.col("id").alias("b_"), "text"), F.col("b") == F.col("b_")).select("a", "salt", "role", "b", "text")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(parts, "a", "salt").sortWithinPartitions("a", "salt", "role")
    return rows.mapInArrow(_confirm, "a long, b long")


def settle(parents: DataFrame) -> DataFrame:
    """(id, root) from (id, root) rows that point at another id or at themselves: pointer jumping until nothing moves.

    Each round halves the depth of the trees.
    """
    roots = keep(parents, "roots")
    while True:
        up = roots.select(F.col("id").alias("id_"), F.col("root").alias("next"))
        jumped = roots.join(up, roots["root"] == up["id_"], "left")
        jumped = keep(jumped.select("id", F.coalesce("next", "root").alias("root"), F.col("root").alias("was")), "roots")
        moved = jumped.where("root <> was").limit(1).count()
        drop(roots)
        roots = jumped
        if not moved:
            return roots


def components(edges: DataFrame) -> DataFrame:
    """(id, root) for every id of the edges (a, b): the least id that can be reached.

    Each round takes the least label of all neighbours, then jumps to the label's own label, so a
    chain of length n takes about log n rounds.
    """
    both = keep(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = keep(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")).select(F.col("a").alias("id"), "root"), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["id"]).groupBy("a").agg(F.min("root").alias("near"))
        up = labels.select(F.col("id").alias("id_"), F.col("root").alias("next"))
        new = labels.join(near, labels["id"] == near["a"], "left")
        new = new.select("id", F.col("root").alias("was"), F.least("root", "near").alias("mid"))
        new = new.join(up, new["mid"] == up["id_"], "left").select("id", "was", F.least("mid", "next").alias("root"))
        new = keep(new, "labels")
        moved = new.where("root <> was").limit(1).count()
        drop(labels)
        labels = new
        if not moved:
            drop(both)
            return labels


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_shingles, component_id, kept and class_id (smallest id with the same set)."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    signs = keep(texts.mapInArrow(_signatures, "id long, n long, digest binary, sign binary"), "near-signs")
    full = signs.where("digest is not null and id is not null")
    classes = full.groupBy("digest").agg(F.min(F.struct("id", "n", "sign")).alias("x"))
    classes = keep(classes.select("digest", "x.*"), "near-classes")
    bands = F.transform(
        F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.substring(F.col("sign"), i * (2 * ROWS) + 1, F.lit(2 * ROWS)))
    )
    members = classes.select("id", "n", F.explode(bands).alias("band"))
    pivots = members.groupBy("band").agg(F.min("id").alias("pivot"), F.max("id").alias("last")).where("pivot < last")
    pivots = pivots.select(F.col("band").alias("band_"), F.xxhash64("band").alias("key_"), "pivot")
    members = members.join(pivots, (F.xxhash64("band") == F.col("key_")) & (F.col("band") == F.col("band_")))
    members = keep(members.select("id", "n", "band", "pivot"), "near-members")
    best = members.where("id <> pivot").groupBy("id", "pivot").agg(F.count(F.lit(1)).alias("c"))
    best = best.groupBy("id").agg(F.max(F.struct("c", (-F.col("pivot")).alias("p"))).alias("x"))
    pairs = keep(best.select((-F.col("x.p")).alias("a"), F.col("id").alias("b")), "near-pairs")
    involved = keep(members.select(F.col("id").alias("i")).distinct(), "near-ids")
    if involved.count() <= BROADCAST_IDS:
        involved = F.broadcast(involved)
    texts = keep(texts.join(involved, texts["id"] == involved["i"]).groupBy("id").agg(F.max("text").alias("text")), "near-texts")
    links = keep(confirmed(pairs, texts), "near-links")
    linked = links.select(F.col("b").alias("id"), F.col("a").alias("root"))
    roots = links.select(F.col("a").alias("id")).distinct().join(linked.select(F.col("id").alias("i")), F.col("id") == F.col("i"), "left_anti")
    trees = settle(linked.unionByName(roots.select("id", F.col("id").alias("root"))))
    across = keep(_across(members, trees, classes, texts), "near-across")
    more = confirmed(across, texts)
    roots_of = lambda c: trees.select(F.col("id").alias(f"{c}_id"), F.col("root").alias(f"{c}_root"))
    more = more.join(roots_of("a"), F.col("a") == F.col("a_id"), "left").join(roots_of("b"), F.col("b") == F.col("b_id"), "left")
    joined = components(more.select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b")))
    joined = joined.select(F.col("id").alias("j"), F.col("root").alias("joined"))
    tree_of = trees.select(F.col("id").alias("t"), F.col("root").alias("tree"))
    found = classes.join(tree_of, classes["id"] == tree_of["t"], "left").withColumn("tree", F.coalesce("tree", "id"))
    found = found.join(joined, found["tree"] == joined["j"], "left")
    found = keep(found.select("digest", F.col("id").alias("class_id"), F.coalesce("joined", "tree").alias("component_id")), "near-found")
    found = found.select(F.col("digest").alias("digest_"), F.xxhash64("digest").alias("key_"), "class_id", "component_id")
    keyed = F.when(F.col("id").isNotNull(), F.xxhash64("digest"))
    out = signs.join(found, (keyed == F.col("key_")) & (F.col("digest") == F.col("digest_")), "left")
    component = F.coalesce("component_id", "id")
    return out.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"),
        F.coalesce("class_id", "id").alias("class_id"),
    )


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = list(kernels.shingle_sets(batch.column(1), SHINGLE))
        ids = np.repeat(np.array(batch.column(0).to_pylist(), np.int64), [len(s) for s in sets])
        flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(flat.view(np.int64))], ["id", "s"])


def _shared_shingles(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """i and c0, c1, ...: how many of its shingles that another of the ids also has fall into each part of the hash range."""
    held = texts.join(ids, texts["id"] == ids["i"], "left_semi").select("id", "text").mapInArrow(_exploded, "id long, s long")
    by_part = [F.count(F.when(F.pmod("s", F.lit(PARTS)) == k, 1)) for k in range(PARTS)]
    every = held.groupBy(F.col("id").alias("i")).agg(*[c.alias(f"n{k}") for k, c in enumerate(by_part)])
    own = held.groupBy("s").agg(F.min("id").alias("o"), F.max("id").alias("last")).where("o = last")
    own = own.groupBy("o").agg(*[c.alias(f"o{k}") for k, c in enumerate(by_part)])
    left = [(F.col(f"n{k}") - F.coalesce(f"o{k}", F.lit(0))).alias(f"c{k}") for k in range(PARTS)]
    return every.join(own, every["i"] == own["o"], "left").select("i", *left)


def _across(members: DataFrame, trees: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame:
    """Candidate pairs (a, b) of different components that share a bucket."""
    tree_of = trees.select(F.col("id").alias("t"), F.col("root").alias("tree"))
    placed = members.join(tree_of, members["id"] == tree_of["t"], "left")
    placed = keep(placed.select("band", "id", "n", F.coalesce("tree", "id").alias("tree")), "near-placed")
    counts = placed.groupBy("band", "tree").agg(F.count(F.lit(1)).alias("c"))
    main = counts.groupBy("band").agg(F.max(F.struct("c", (-F.col("tree")).alias("m"))).alias("x"), F.count(F.lit(1)).alias("k"))
    main = main.where("k > 1").select(F.col("band").alias("band_"), F.xxhash64("band").alias("key_"), (-F.col("x.m")).alias("main"))
    mixed = placed.join(main, (F.xxhash64("band") == F.col("key_")) & (F.col("band") == F.col("band_")))
    mixed = keep(mixed.select("band", "id", "n", "tree", "main"), "near-mixed")
    shared = _shared_shingles(texts, mixed.select(F.col("id").alias("i")).distinct())
    total = F.aggregate(F.array(*[F.col(f"c{k}") for k in range(PARTS)]), F.lit(0).cast("long"), lambda acc, c: acc + c)
    mixed = keep(mixed.join(shared, mixed["id"] == shared["i"]).drop("i").withColumn("total", total), "near-mixed")
    # Classes of a bucket by size and common shingles: what rules out two such kinds rules out all pairs of their members, unseen.
    bound = lambda most: 100 * most >= LEAST * (F.col("n") + F.col("n_") - most)
    kinds = keep(mixed.groupBy("band", "n", "total").agg(F.max(F.col("tree") != F.col("main")).alias("apart")), "near-kinds")
    others = kinds.where("apart").select(*[F.col(c).alias(f"{c}_") for c in ("band", "n", "total")])
    could = (F.col("band") == F.col("band_")) & bound(F.least("total", "total_"))
    one = kinds.join(others, could, "left_semi").select("band", "n", "total")
    two = others.join(kinds.drop("apart"), could, "left_semi").select(F.col("band_").alias("band"), F.col("n_").alias("n"), F.col("total_").alias("total"))
    left, few = mixed.join(one, ["band", "n", "total"], "left_semi"), mixed.where("tree <> main").join(two, ["band", "n", "total"], "left_semi")
    few = few.select(*[F.col(c).alias(f"{c}_") for c in few.columns if c != "main"])
    near = (F.col("band") == F.col("band_")) & (F.col("tree") != F.col("tree_"))
    near &= bound(reduce(lambda x, k: x + F.least(f"c{k}", f"c{k}_"), range(1, PARTS), F.least("c0", "c0_")))
    near &= (F.col("tree") == F.col("main")) | (F.col("id") < F.col("id_"))
    pairs = left.join(few, near).select(F.least("id", "id_").alias("a"), F.greatest("id", "id_").alias("b")).distinct()
    sign = lambda c: classes.select(F.col("id").alias(f"{c}_id"), F.col("sign").alias(f"{c}_sign"))
    pairs = pairs.join(sign("a"), F.col("a") == F.col("a_id")).join(sign("b"), F.col("b") == F.col("b_id"))
    return pairs.select("a", "b", "a_sign", "b_sign").mapInArrow(_agree, "a long, b long")
