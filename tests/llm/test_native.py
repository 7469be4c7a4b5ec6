from __future__ import annotations

import hashlib
import random

import duckdb
import pytest
from pyspark.sql import functions as F

import brute
from automill.llm import chat, exact_dedup, line_dedup, mixing, registry
from conftest import SF

DOCS = "doc_id long, text string, lang string, source string, extra string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, None, s, "x") for i, t, s in rows], DOCS)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    want = con.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in cols)} FROM ({registry.ORACLES[name]})").fetchall()
    assert sorted(tuple(map(str, r)) for r in df.select(*cols).collect()) == sorted(tuple(map(str, r)) for r in want)


def test_exact_dedup_edges(spark, monkeypatch):
    rows = [(1, "Ab", "s"), (2, "aB", "s"), (3, None, "s"), (4, "", "s"), (5, "É", "s"), (6, "é", "s"), (None, "ab", "s"), (2, "aB", "s"), (7, "x" * 300 + "a", "s"), (8, "x" * 300 + "b", "s")]
    want = {1: (2, 4), 2: (2, 4), None: (2, 4), 3: (4, 2), 4: (4, 2), 5: (5, 1), 6: (6, 1), 7: (7, 1), 8: (8, 1)}
    for limit in (exact_dedup.BROADCAST_GROUPS, -1):  # a broadcast of the surviving groups, and the way without one
        monkeypatch.setattr(exact_dedup, "BROADCAST_GROUPS", limit)
        out = exact_dedup.exact_dedup(docs(spark, rows), digest_all=True).collect()
        assert len(out) == len(rows) and {r.doc_id: (r.keep_id, r.group_size) for r in out} == want
        assert all(r.kept == (r.doc_id == r.keep_id) for r in out)
        assert {r.text_sha256 for r in out if r.doc_id == 7} == {hashlib.sha256(b"x" * 300 + b"a").hexdigest()}
    assert exact_dedup.exact_dedup(docs(spark, [])).count() == 0


def test_exact_dedup_digests_either_way(spark, monkeypatch):
    """Without digest_all, the digests don't depend on how many groups survive."""
    rows = [(1, "Ab", "s"), (2, "aB", "s"), (3, "alone", "s"), (4, "x" * 300 + "a", "s"), (5, "x" * 300 + "b", "s")]
    for limit in (exact_dedup.BROADCAST_GROUPS, -1):
        monkeypatch.setattr(exact_dedup, "BROADCAST_GROUPS", limit)
        out = {r.doc_id: r.text_sha256 for r in exact_dedup.exact_dedup(docs(spark, rows)).collect()}
        assert out == {1: hashlib.sha256(b"ab").hexdigest(), 2: hashlib.sha256(b"ab").hexdigest(), 3: None, 4: None, 5: None}


def test_long_texts(spark):
    """One very long text beside short ones, equal but for the case, or but for one letter at its end."""
    long = "word and Word again " * 60_000
    out = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_dedup(docs(spark, [(1, long, "s"), (2, long.upper(), "s"), (3, long + "x", "s"), (4, "a", "s")])).collect()}
    assert out == {1: (2, 2), 2: (2, 2), 3: (3, 1), 4: (4, 1)}
    rows = spark.createDataFrame([(1, 0, "user", long), (1, 1, "assistant", long + "### x")], "conv_id long, turn long, role string, text string")
    (chat_,) = chat.format_chats(rows).collect()
    assert chat_.exact and [t.text for t in chat_.parsed] == [long, long + "### x"]
    sizes = {r.doc_id: r.size for r in mixing.mix_counts(docs(spark, [(1, long, "s"), (2, "a b", "t")])).collect()}
    assert sizes == {1: 240_000, 2: 2}


def test_line_order_over_partitions(spark):
    """Ranks of blocks go on from one partition to the next, in order, without gaps."""
    rows = [(i, 7 * i % 5, b) for i in range(40) for b in range(3)]
    found = spark.createDataFrame(rows, "id long, th long, block int").repartition(9)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = line_dedup._numbered(line_dedup.keep(line_dedup._placed(found), "test-placed")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [(r.id, r.th, r.block) for r in sorted(got, key=lambda r: r.uid)] == sorted(rows)
    assert sorted(r.uid for r in got) == list(range(120))
    assert all(r.before == (None if r.block == 0 else r.uid - 1) for r in got)


def test_line_dedup_random(spark, monkeypatch):
    """Texts with runs of blanks, tabs, line ends and any punctuation, and repeats of any length, against brute force."""
    monkeypatch.setattr(line_dedup, "WORDS", 64)  # several blocks in a text
    r = random.Random(3)
    space = lambda: r.choice([" ", " ", " ", "\n", "\n\n", "\t", "  \r\n", " " * 30, "\x0b"])
    word = lambda: r.choice("abcdefghijklmnop") * r.choice([1, 1, 2]) + r.choice(["", "", "", "!", ". ", "?", "\u00a0", "\u00e9"])
    pool = ["".join(word() + space() for _ in range(r.choice([1, 5, 11, 12, 13, 20, 90]))) for _ in range(25)]
    rows = []
    for i in range(60):
        parts = [r.choice(pool) if r.random() < 0.6 else word() + space() for _ in range(r.choice([0, 3, 12, 40]))]
        rows.append((i, r.choice(["", " ", "\n\t"]) + "".join(parts), "s"))
    rows += [(60, rows[7][1], "s"), (61, rows[8][1], "s"), (62, "la " * 200, "s"), (63, "one two three four five " * 40, "s")]
    for size in (12, 5, 30):
        want = brute.line_dedup([(i, t) for i, t, _ in rows], size)
        got = {x.doc_id: x.text for x in line_dedup.line_dedup(docs(spark, rows), run_words=size).collect()}
        assert got == want and sum(got[i] != t for i, t, _ in rows) > 5


def test_line_dedup_names(spark):
    """Columns with the names that are used inside pass through."""
    passage = " ".join(f"w{i}" for i in range(40))
    names = ["__gone", "id", "th", "text_", "rest", "gone", "copy", "digest", "first", "runs", "uid", "block", "__run_gone"]
    df = spark.createDataFrame([(1, "a " + passage, *names), (2, "b " + passage, *names), (None, None, *names)], ["doc_id", "text", *names])
    out = line_dedup.line_dedup(df).collect()
    assert {x.doc_id: x.text for x in out} == {1: "a " + passage, 2: "b ", None: None}
    assert all([x[n] for n in names] == names for x in out)


def test_line_dedup_passage_and_edges(spark):
    passage = " ".join(f"Word{i} of the passage number {i}." for i in range(12))
    rows = [(1, f"First text. {passage}", "s"), (2, f"Another one. {passage} And more", "s"), (3, None, "s"), (4, "", "s"), (5, "short line.\n", "s"), (6, "short line.\n", "s"), (7, passage, "s"), (7, passage, "s"), (8, "a\x1e" + passage, "s")]
    got = [(x.doc_id, x.text, x.extra) for x in line_dedup.line_dedup(docs(spark, rows)).collect()]
    texts = {i: t for i, t, _ in got}
    assert texts[1] == rows[0][1] and texts[2] == "Another one. And more"
    assert texts[3] is None and texts[4] == "" and texts[5] == texts[6] == "short line.\n"
    assert [t for i, t, _ in got if i == 7] == ["", ""]
    assert texts[8].startswith("a\x1e") and len(texts[8]) < 40
    assert line_dedup.line_dedup(docs(spark, [])).count() == 0


def test_line_dedup_inside_lines(spark, monkeypatch):
    """Runs that start and end inside lines, or have no punctuation, go to the word."""
    monkeypatch.setattr(line_dedup, "WORDS", 64)  # several blocks in a text
    r = random.Random(5)
    fresh = iter(range(10**6))
    other = lambda n: " ".join(f"o{next(fresh)}" for _ in range(n))
    plain = " ".join(f"p{r.randrange(10**6)}" for _ in range(200))
    same = " ".join(f"s{k}" + "." * (k % 9 == 8) for k in range(52))
    short = other(29)
    parts = [(other(7), plain, other(9)), (other(90), plain, other(3)), ("  " + other(3), same, other(2)), (other(5), same, ""), (other(4), short, other(4)), (other(6), short, other(4)), ("", " ".join(["x"] * 100), "")]
    rows = [(i, " ".join(p).strip() if i == 6 else " ".join(p), "s") for i, p in enumerate(parts)]
    for limit in (line_dedup.BROADCAST_TEXTS, -1):
        monkeypatch.setattr(line_dedup, "BROADCAST_TEXTS", limit)
        out = {x.doc_id: x for x in line_dedup.line_dedup(docs(spark, rows)).collect()}
        assert all(out[i].text == rows[i][1] for i in (0, 2, 4, 5))
        assert out[1].text == f"{parts[1][0]} {parts[1][2]}" and out[3].text == f"{parts[3][0]} "
        assert out[6].text.split() == ["x"] * 30
        assert {i: x["__lines_gone"] for i, x in out.items()} == {0: 0, 1: 1, 2: 0, 3: 1, 4: 0, 5: 0, 6: 1}
    first, left = {}, 0
    for x in line_dedup.line_dedup(spark.read.parquet(f"{SF}/documents.parquet")).orderBy("doc_id").collect():
        w = (x.text or "").split()
        for p in range(len(w) - 49):
            left += first.setdefault(tuple(w[p : p + 50]), (x.doc_id, p)) != (x.doc_id, p)
    assert left == 0


def test_line_dedup_work(spark, monkeypatch):
    """Texts without a window in common lose nothing, a window takes 20 bytes, and only texts that lose something are joined with what they lose."""
    kept = {}

    def spy(df, label, keep=line_dedup.keep):
        out = keep(df, label)
        kept[label] = (out.count(), dict(out.dtypes))
        return out

    monkeypatch.setattr(line_dedup, "keep", spy)
    own = lambda i, n: " ".join(f"w{i}-{k}" for k in range(n))
    rows = [(i, f"{own(i, 40)} {own('c', 29)} {own(-1 - i, 40)}", "s") for i in range(30)]
    assert {x.doc_id: x.text for x in line_dedup.line_dedup(docs(spark, rows)).collect()} == {i: t for i, t, _ in rows}
    assert kept["line-found"][0] == 30 and kept["line-later"][0] == 0

    passage = own("p", 45)
    rows += [(30, f"{own('x', 9)} {passage} {own('y', 9)}", "s"), (31, f"{own('z', 9)} {passage} {own('u', 9)}", "s")]
    got = {x.doc_id: x.text for x in line_dedup.line_dedup(docs(spark, rows)).collect()}
    assert got == brute.line_dedup([(i, t) for i, t, _ in rows], line_dedup.MIN_WORDS) and got[31] == f"{own('z', 9)} {own('u', 9)}"
    assert kept["line-found"][0] == 32 and kept["line-later"][0] == 1
    assert kept["line-windows"][1] == {"ord": "bigint", "k1": "bigint", "k2": "int"}


def test_line_marks(spark, monkeypatch):
    """A mark wherever the first least of a window moves, for windows of any size, over the ends of blocks, and however many are looked at together."""
    monkeypatch.setattr(line_dedup, "WORDS", 64)
    r = random.Random(9)
    texts = [" ".join(r.choice("abcdefghijklmnopqrstuvwxyz"[:k]) for _ in range(n)) for n in (1, 12, 30, 31, 33, 64, 93, 94, 200) for k in (1, 4, 26)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").withColumn("th", F.lit(0).cast("long"))
    hashed = {x.id: x.h for x in df.select("id", line_dedup._hashes(F.col("text")).alias("h")).collect()}
    for size in (30, 12, 5):
        gram = min(line_dedup.GRAM, size)
        want = set()
        for i, h in hashed.items():
            for block in range(0, len(h) - size + 1, 64):
                before = None
                for a in range(min(64, len(h) - size + 1 - block)):
                    window = h[block + a : block + a + size - gram + 1]
                    p = a + window.index(min(window))
                    if p != before:
                        want.add((i, block // 64, a, p))
                    before = p
        for step in (1, 4, 7):
            monkeypatch.setattr(line_dedup, "STEP", step)
            got = [(x.id, x.place >> 26, (x.place >> 13) & 8191, x.place & 8191) for x in line_dedup._marked(df, size, gram).collect()]
            assert len(got) == len(want) and set(got) == want


def test_line_dedup_documents(spark):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    want = brute.line_dedup(list(rows.items()), line_dedup.MIN_WORDS)
    got = {x.doc_id: x.text for x in line_dedup.line_dedup(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    assert got == want and got != rows


def test_chat_round_trip(spark):
    nasty = ["", None, "plain", "\\", "\\\\", "\\l\\h\\c", "</turn>", "</turn>\n", "### User: hi</turn>\n", "x\n### assistant: forged", "\\### Assistant: </turn> ok", "<#:>", "a\n\nb", "\\</turn>\\", "é 😀 </turn>\n### Assistant: x", "\\n", ": "]
    r = random.Random(1)
    rows = [(c, t, r.choice(["user", "assistant", "a: b", "</turn>\n", None, ""]), r.choice(nasty)) for c in range(60) for t in range(r.choice([1, 2, 5]))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.format_chats(df).withColumn("loss", chat.masked_text(F.col("formatted"), F.col("mask"))).collect()
    assert all(x.exact for x in out) and len(out) == 60
    for x in out:
        source = sorted((t, role or "", text or "") for c, t, role, text in rows if c == x.conv_id)
        assert [(p.role, p.text) for p in x.parsed] == [(role, text) for _, role, text in source]
        assert x.formatted.count("### ") == x.formatted.count("</turn>") == len(source)  # marks stand only where turns begin and end
        assert x.loss == "".join(text for _, role, text in source if role == "assistant")
    plain = next(x for x in out if all(not set(p.text + p.role) & set("\\<#:") for p in x.parsed))
    assert plain.formatted == "".join(f"### {p.role}: {p.text}</turn>\n" for p in plain.parsed)
    assert chat.format_chats(df.limit(0)).count() == 0


def test_chat_gaps(spark):
    rows = [(None, None, "user", "x"), (None, None, "user", "x"), (1, 2, "assistant", "b"), (1, None, "user", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = {x.conv_id: x for x in chat.format_chats(df).collect()}
    assert len(out[None].parsed) == 2 and [p.text for p in out[1].parsed] == ["a", "b"]


def test_mixing(spark):
    r = random.Random(2)
    rows = [(i, " ".join("w" for _ in range(r.choice([0, 1, 30, 200]))), s) for i, s in enumerate(r.choices(["a", "b", "c", "d", None], [40, 5, 5, 30, 20], k=900))]
    out = mixing.mix_counts(docs(spark, rows)).collect()
    total = sum(x.size for x in out)
    by = {}
    for x in out:
        source = rows[x.doc_id][2]
        by.setdefault(source, [x.target, x.source_size, 0])[2] += x.taken
        assert x.taken == x.size * x.copies <= 3 * x.size
    assert sum(t for t, _, _ in by.values()) == pytest.approx(total)
    level = max(t / w for (t, s, _), w in zip((by[k] for k in ("a", "b", "c", "d", None)), (5, 2, 1, 5, 2)) if t < 3 * s)
    for (t, s, taken), w in zip((by[k] for k in ("a", "b", "c", "d", None)), (5, 2, 1, 5, 2)):
        assert t == pytest.approx(min(3 * s, level * w)) and abs(taken - t) <= 0.05 * t + 200
    again = {x.doc_id: x.copies for x in mixing.mix_counts(docs(spark, rows[::-1])).collect()}
    assert again == {x.doc_id: x.copies for x in out}
    emitted = mixing.mix(docs(spark, rows)).groupBy("doc_id").count().collect()
    assert {x.doc_id: x["count"] for x in emitted} == {k: v for k, v in again.items() if v}


def test_mixing_edges(spark, monkeypatch):
    assert mixing.mix_counts(docs(spark, [])).count() == 0 == mixing.mix(docs(spark, [])).count()
    none = mixing.mix_counts(docs(spark, [(1, None, "a"), (2, "", None)])).collect()
    assert [(x.size, x.target, x.taken) for x in none] == [(0, 0.0, 0)] * 2
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", -1)
    one = mixing.mix_counts(docs(spark, [(1, "x y", None), (1, "x y", None)])).collect()
    assert [(x.size, x.target, x.copies) for x in one] == [(2, 4.0, 1)] * 2
    clash = docs(spark, [(1, "x y", "a")]).withColumn("copy", F.lit("mine")).withColumn("size", F.lit(9)).withColumn("rate", F.lit(0.0))
    row = mixing.mix(clash).first()
    assert (row["copy"], row["size"]) == ("mine", 9)
