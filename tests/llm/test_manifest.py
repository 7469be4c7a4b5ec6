from __future__ import annotations

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from automill.llm import merkle_manifest, queries_manifest
from conftest import SF

FIELDS = queries_manifest.FIELDS


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(values):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes, fanout):
    """The root, and each node's path: (siblings before, siblings behind) from the bottom up."""
    place, paths = list(range(len(nodes))), [[] for _ in nodes]
    while len(nodes) > 1:
        groups = [nodes[i : i + fanout] for i in range(0, len(nodes), fanout)]
        for i, p in enumerate(place):
            run = groups[p // fanout]
            paths[i].append(("".join(run[: p % fanout]), "".join(run[p % fanout + 1 :])))
        place, nodes = [p // fanout for p in place], [sha(*run) for run in groups]
    return nodes[0], paths


def brute(rows, fanout):
    """Of (doc_id, source, leaf, present leaf) rows: id, leaf, subroot, root, proof, folded root, verified."""
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    inner = {}
    for s in names:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[2], r[3]))
        inner[s] = tree([r[2] for r in by[s]], fanout)
    root, outer = tree([inner[s][0] for s in names], fanout)
    out = []
    for s, above in zip(names, outer):
        for r, path in zip(by[s], inner[s][1]):
            h = r[3]
            for before, behind in path + above:
                h = sha(before, h, behind)
            out.append((r[0], r[2], inner[s][0], root, sha(*(a + b for a, b in path + above)), h, h == root))
    return out


def ordered(rows):
    return sorted(rows, key=str)


@pytest.mark.parametrize("fanout,levels", [(3, 1), (3, 2), (2, 3), (3, 6)])
def test_manifest(spark, fanout, levels):
    """Sources of one, few and many rows, a null one, repeated ids and rows, nulls in every column, long and empty texts, and clashing names."""
    r = random.Random(fanout * 10 + levels)
    rows = [(i, r.choice(["hot", "hot", "é", "b"]), r.choice(["en", None]), i, r.choice(["", "x\ny", "long " * 2000, None, "a:b"])) for i in range(120)]
    rows += [(1000 + i, f"one{i}", "en", i, "only") for i in range(5)] + [(5, None, None, None, None), (None, None, "en", 1, "no id"), (None, "b", None, None, "\n")]
    rows += [rows[7]] * 3 + [(rows[8][0], rows[8][1], "other", 0, "same id")]
    schema = "doc_id long, source string, lang string, n_chars long, text string"
    docs = spark.createDataFrame(rows, schema).select("*", *[F.lit(1).alias(c) for c in ("g", "rank", "n", "h", "id", "now", "row", "part", "place", "block", "name", "root")])
    cut = F.when(F.col("doc_id") % 4 == 1, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    made = merkle_manifest.build(docs, FIELDS, present=[*map(F.col, FIELDS[:-1]), cut], fanout=fanout, levels=levels)
    now = lambda x: (*x[:4], x[4].replace("\n", "")) if x[4] and (x[0] or 0) % 4 == 1 else x
    want = brute([(x[0], x[1], leaf(x), leaf(now(x))) for x in rows], fanout)
    got = [tuple(x) for x in made.prove().collect()]
    assert ordered(got) == ordered(want)
    assert {x[-1] for x in got} == {True, False}
    subroots = {x.source: x.subroot for x in made.subroots().collect()}
    assert subroots == {x[1]: y for x in rows for y in [next(w[2] for w in want if w[1] == leaf(x))]}
    for x in made.prove(with_path=True).collect():
        h = x.leaf
        for step in x.path:
            h = sha(step.before, h, step.behind)
        assert h == x.root == made.root


def test_manifest_small(spark):
    schema = "doc_id long, source string, lang string, n_chars long, text string"
    empty = merkle_manifest.build(spark.createDataFrame([], schema), FIELDS)
    assert empty.root is None and empty.prove().collect() == [] and empty.subroots().collect() == []
    row = (3, "s", None, 4, "text")
    (one,) = merkle_manifest.build(spark.createDataFrame([row], schema), FIELDS).prove().collect()
    assert tuple(one) == (3, leaf(row), leaf(row), leaf(row), sha(), leaf(row), True)
    named = spark.createDataFrame([("k1", 1, "a"), ("k0", 1, "b"), (None, 2, "c")], "name string, shard int, body string")
    made = merkle_manifest.build(named, ["name", "body"], id_col="name", group_col="shard")
    assert made.root == sha(sha(leaf(("k0", "b")), leaf(("k1", "a"))), leaf((None, "c")))


def test_levels_of_blocks():
    """A block's matrices equal a tree by lists, and a fold with the own digest gives the root."""
    for n in (1, 2, 3, 4, 9, 10, 26, 27):
        nodes = [sha(str(i)) for i in range(n)]
        matrix = np.frombuffer("".join(nodes).encode(), np.uint8).reshape(-1, 64)
        levels = merkle_manifest.climb(matrix, 3, None)
        assert levels[-1].tobytes().decode() == tree(nodes, 3)[0]
        assert {x.tobytes() for x in merkle_manifest.fold(matrix.copy(), levels, 3)} == {levels[-1].tobytes()}


def test_manifest_query(spark):
    """The query against SQL and against brute force; only texts that lost line ends fail."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(*FIELDS).collect()
    tampered = lambda x: x.text is not None and zlib.crc32(str(x.doc_id).encode()) % 2 == 0
    want = brute([(x.doc_id, x.source, leaf(x), leaf((*x[:4], x.text.replace("\n", "") if tampered(x) else x.text))) for x in docs], 3)
    df = queries_manifest.op11_merkle_manifest(spark, SF)
    got = ordered(tuple(x) for x in df.collect())
    assert got == ordered(want)
    bad = {x.doc_id for x in docs if tampered(x) and "\n" in x.text}
    assert bad and {x[0] for x in got if not x[-1]} == bad
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    assert ordered(con.sql(f"SELECT {', '.join(df.columns)} FROM ({queries_manifest._OP11})").fetchall()) == got
