from __future__ import annotations

import html
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import brute
from automill.llm import decontaminate, html_extract, kernels, langid, near_dedup, quality, queries_models, queries_near, queries_web, warc_audit
from conftest import SF


def test_words_and_shingles():
    texts = ["", None, "one", "Two words", "a b c d e", "A B C D E f", " \t x\n", "é ß 漢字 x y z", "a b c d e f a b c d e f", "x" * 5000]
    sets = [set(s.tolist()) for s in kernels.shingle_sets(pa.array(texts))]
    assert [len(s) for s in sets] == [len(brute.shingle_set(t)) for t in texts]
    assert sets[4] < sets[5] and not sets[2] & sets[3]
    for limit in (1, 7, 10_000):  # the cuts between slices do not matter
        got = []
        for _, data, offsets in kernels.slices(pa.array(texts), limit):
            h, _, _, bounds = kernels.words(data, offsets)
            got += [set(s.tolist()) for s in kernels.shingles(h, bounds)]
        assert got == sets
    sliced = pa.array(["skip", *texts])[1:]
    assert [set(s.tolist()) for s in kernels.shingle_sets(sliced)] == sets


def test_circulant_signature():
    """Coordinate k is the second permutation shifted by k; equal shares of coordinates estimate similarity."""
    second = np.random.default_rng(near_dedup.SEED).permutation(near_dedup.UNIVERSE)
    r = np.random.default_rng(1)
    s = r.integers(0, 2**63, 300).astype(np.uint64)
    at = (kernels.mix(s ^ np.uint64(near_dedup.SEED)) & np.uint64(near_dedup.UNIVERSE - 1)).astype(np.int64)
    for k in (0, 1, 77):
        assert near_dedup.signature(s)[k] == second[(at + k) % near_dedup.UNIVERSE].min()
    agreement = np.mean([(near_dedup.signature(x[:400]) == near_dedup.signature(x[100:])).mean() for x in r.integers(0, 2**63, (30, 500)).astype(np.uint64)])
    assert agreement == pytest.approx(0.6, abs=0.03)


def near(spark, rows):
    return {r.doc_id: r for r in near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string, id long")).collect()}


def test_near_dedup_groups(spark):
    """Copies, chains, and groups whose members are not all similar to one another."""
    r = random.Random(4)
    vocabulary = [f"w{i}" for i in range(4000)]
    rows, base = [], [r.choice(vocabulary) for _ in range(90)]
    for i in range(60):  # near copies of one text, some too far from it
        w = list(base)
        for k in r.sample(range(90), r.choice([1, 2, 3, 4])):
            w[k] = r.choice(vocabulary)
        rows.append((1000 + i, " ".join(w), i))
    chain = [r.choice(vocabulary) for _ in range(100)]
    for i in range(12):  # each similar to the next only
        rows.append((500 + i, " ".join(chain), i))
        chain = chain[7:] + [r.choice(vocabulary) for _ in range(7)]
    rows += [(i, " ".join(r.choice(vocabulary) for _ in range(r.choice([1, 4, 5, 60]))), i) for i in range(40)]
    rows += [(2000 + i, rows[0][1].upper(), i) for i in range(5)] + [(3001, None, 1), (3002, "", 1), (3003, " \n", 1), (3004, "two words", 1), (3005, "Two Words", 1), (3006, "two words", 9)]
    want = brute.near_components([(i, t) for i, t, _ in rows])
    got = near(spark, rows)
    assert {i: (x.n_shingles, x.component_id) for i, x in got.items()} == want
    assert all(x.kept == (i == x.component_id) for i, x in got.items())
    assert len({c for _, c in want.values()}) < len(rows) - 40


@pytest.mark.parametrize("limit", [near_dedup.BROADCAST_IDS, -1])
def test_near_dedup_tables(spark, monkeypatch, limit):
    """The given documents against brute force, with the ids of candidates broadcast and joined."""
    monkeypatch.setattr(near_dedup, "BROADCAST_IDS", limit)
    folder = SF if limit < 0 else SF.replace("sf0.001", "sf0.01")
    df = spark.read.parquet(f"{folder}/documents.parquet")
    want = brute.near_components([(r.doc_id, r.text) for r in df.collect()])
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_dedup(df).collect()} == want


def test_near_dedup_template(spark):
    """Texts of one template, just not similar enough, make no pairs: kinds of classes are ruled out, not members one by one."""
    r = random.Random(8)
    base = [f"w{i}" for i in range(100)]
    rows = [(i, " ".join(base + [f"x{r.randrange(10**9)}" for _ in range(20)])) for i in range(600)]
    rows += [(1000 + i, rows[i][1] + " end") for i in range(0, 600, 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: x.component_id for x in near_dedup.near_dedup(df).collect()}
    assert got == {i: i - 1000 if i >= 1000 else i for i, _ in rows}


def test_near_dedup_edges(spark):
    assert near(spark, []) == {}
    got = near_dedup.near_dedup(spark.createDataFrame([(1, "a b", 1), (1, "a b", 1), (None, "a b", 1)], "doc_id long, text string, id long")).collect()
    assert sorted((str(x.doc_id), str(x.component_id)) for x in got) == [("1", "1"), ("1", "1"), ("None", "None")]


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 7), (200, 201)]
    got = {x.id: x.root for x in near_dedup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 0, 200: 200, 201: 200}


def test_decontamination_scan():
    items = [("1", "The quick brown fox, jumps over the lazy dog. Again and again!"), ("2", "short one"), ("3", None), ("4", "..."), ("5", "short one")]
    found = decontaminate.Matcher(items)
    text = "é x THE QUICK--brown fox jumps over the lazy dog AGAIN and; shortone a short   one"
    n, runs, hit = found.scan(text)
    assert (n, runs, hit) == (17, [(2, 13), (15, 17)], {"1", "2", "5"}) or n == len(decontaminate.normalised(text))
    assert [text[a:b] for a, b in decontaminate.spans(text, runs)][-1] == "short   one"
    assert decontaminate.Matcher([]).scan("a text") == (2, [], set()) and found.scan(None) == (0, [], set())


def test_decontamination_random():
    """Against a plain search for every window, over few words so that windows overlap and nest."""
    r = random.Random(8)
    line = lambda n: [r.choice("abcd") for _ in range(n)]
    items = [(str(k), " ".join(line(r.choice([1, 2, 5, 10, 14])))) for k in range(12)]
    found = decontaminate.Matcher(items)
    for _ in range(200):
        words = line(r.choice([0, 3, 20, 60]))
        hit, ids = set(), set()
        for item, text in items:
            w = text.split()
            for p in range(max(1, len(w) - 9)):
                x = w[p : p + 10]
                for q in range(len(words) - len(x) + 1):
                    if words[q : q + len(x)] == x:
                        hit |= set(range(q, q + len(x)))
                        ids.add(item)
        n, runs, got = found.scan(" ".join(words))
        assert (n, {k for a, b in runs for k in range(a, b)}, got) == (len(words), hit, ids)


@pytest.mark.parametrize("block", [decontaminate.BLOCK_WORDS, 12])
def test_decontamination_blocks(spark, block):
    items = spark.createDataFrame([(i, f"alpha{i} beta gamma{i} delta") for i in range(9)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x alpha3 beta gamma3 delta y alpha5 Beta gamma5, delta", "z"), (2, None, "z"), (3, "alpha3 beta", "z")], "doc_id long, text string, __words string")
    out = {r.doc_id: r for r in decontaminate.find_benchmark(docs, items, block_words=block).collect()}
    assert out[1]["__items"] == ["3", "5"] and [tuple(x) for x in out[1]["__runs"]] == [(1, 5), (6, 10)]
    assert (out[2]["__words"], out[3]["__runs"]) == (0, [])
    assert decontaminate.find_benchmark(docs.limit(0), items, block_words=block).count() == 0
    assert decontaminate.find_benchmark(docs, items.limit(0)).where("size(__runs) > 0").count() == 0
    names = ["__words", "__runs", "__items", "__spans"]
    clash = docs.select("doc_id", "text", *[F.lit("mine").alias(n) for n in names])
    assert [tuple(r)[2:] for r in decontaminate.without_benchmark(clash, items).orderBy("doc_id").collect()] == [("mine",) * 4] * 2


def test_decontamination_worker_keeps_its_automaton():
    class Shared:
        def __init__(self, value):
            self.value = value

    for k in range(50):  # a value that was freed must not be taken for another one at its address
        assert decontaminate._here(Shared([("i", f"w{k}")])).scan(f"w{k}")[2] == {"i"}


def test_language(spark):
    out = queries_models.op7_language_id(spark, SF).toPandas()
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").toPandas()
    both = out.merge(docs, on="doc_id")
    held = both[both.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.95 and both.score.between(0, 1).all()
    assert (both.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in both.doc_id]).all()


def test_language_brute(spark):
    """Posteriors against plain counts of the same n-grams."""
    r = random.Random(2)
    word = lambda letters: "".join(r.choice(letters) for _ in range(r.choice([1, 3, 6])))
    rows = [(k, " ".join(word(ls) for _ in range(8)), lang) for k, (lang, ls) in enumerate([("aa", "abcd"), ("bb", "cdef"), ("cc", "efgh\u00e9")] * 10)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    tests = [(k, " ".join(word("abcdefgh\u00e9") for _ in range(4))) for k in range(40)]
    got = {x.doc_id: (x.lang_pred, x.score) for x in langid.predict(spark.createDataFrame(tests, "doc_id long, text string"), model).collect()}

    def grams(text):
        t = f" {text.lower()} ".encode()
        b = langid.ngrams(np.frombuffer(t[1:-1], np.uint8), np.array([0, len(t) - 2]))[0]
        return [int(x) for part in b for x in part]

    counts = {c: Counter(g for _, t, lang in rows if lang == c for g in grams(t)) for c in ("aa", "bb", "cc")}
    for k, text in tests:
        assert len(grams(text)) == 2 * len(text) + 1
        logs = {c: math.log(1 / 3) + sum(math.log((n[g] + langid.ALPHA) / (sum(n.values()) + langid.ALPHA * langid.BUCKETS)) for g in grams(text)) for c, n in counts.items()}
        top = max(logs.values())
        best = min(c for c in logs if logs[c] == top)
        assert got[k][0] == best and got[k][1] == pytest.approx(1 / sum(math.exp(x - top) for x in logs.values()), rel=1e-3)


def test_language_edges(spark):
    rows = [(1, "der die das und", "de"), (2, "the and of with", "en"), (3, "x", None), (4, None, "de")]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model[0] == ["de", "en"]
    test = spark.createDataFrame([(1, "die und"), (2, "THE WITH"), (3, None), (4, ""), (5, "12 %%"), (6, "é" * 100_000)], "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(test, model).collect()}
    assert got[1][0] == "de" and got[2][0] == "en" and got[3] == got[4] == got[5] == ("und", 0.0) and got[6][0] != "und"
    untrained = langid.predict(test, langid.train(spark.createDataFrame([], "doc_id long, text string, lang string")))
    assert {r.lang_pred for r in untrained.collect()} == {"und"}


def test_many_languages(spark, monkeypatch):
    """Languages beyond one block are trained and scored like the others."""
    rows = [(k, " ".join([chr(0x4E00 + 3 * k) * 2, chr(0x4E01 + 3 * k)] * 5), f"l{k:03}") for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(df)
    assert model[0] == [x[2] for x in rows]
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(df, model).collect()}
    assert all(got[k][0] == lang for k, _, lang in rows)
    monkeypatch.setattr(langid, "CLASSES", 1000)  # one block
    whole = langid.train(df)
    assert np.array_equal(whole[2], model[2]) and {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(df, whole).collect()} == got


def test_ngrams_stay_in_their_text():
    data, offsets = np.frombuffer("abcdé".encode(), np.uint8), np.array([0, 2, 2, 4, 6])
    (b2, b3), (o2, o3), letters = langid.ngrams(data, offsets)
    assert np.bincount(o2, minlength=4).tolist() == [3, 1, 3, 2] and np.bincount(o3, minlength=4).tolist() == [2, 0, 2, 1]
    alone = langid.ngrams(data[:2], np.array([0, 2]))[0]
    assert b2[:3].tolist() == alone[0].tolist() and b3[:2].tolist() == alone[1].tolist()


def test_quality(spark):
    out = queries_models.op3_quality(spark, "/root/testdata/sf0.01").toPandas()
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas()
    held = out.merge(labels, on="doc_id")
    held = held[held.held_out]
    assert (held.quality == held.predicted).mean() > 0.95 and out.score.between(0, 1).all()


def test_quality_brute():
    """Votes against plain loops over all labelled vectors, with ties among them."""
    r = random.Random(4)
    texts = [" ".join(r.choice(["plain", "Words", "###", "%%", "x1", "and."]) for _ in range(r.choice([2, 3, 9]))) for _ in range(120)] + ["same text"] * 60
    model = quality.fit(pa.array(texts), np.array([k % 2 for k in range(len(texts))]))
    tests = ["same text", "Words and. plain", "### %% x1 ###", *texts[:20]]
    got = quality._scores(model, pa.array(tests)).to_pylist()
    for t, score in zip(tests, got):
        data = np.frombuffer(t.encode(), np.uint8)
        x = (quality.features(data, np.array([0, len(data)]))[0] - model["mean"]) @ model["project"]
        x = x / np.linalg.norm(x)
        near = sorted(((-float(np.float32(x @ v)), k) for k, v in enumerate(model["vectors"])))
        edge = near[quality.NEIGHBOURS - 1][0]
        sure = [(c, k) for c, k in near if c < edge - 1e-5]
        tied = sorted(k for c, k in near if abs(c - edge) <= 1e-5)[: quality.NEIGHBOURS - len(sure)]
        votes = [(max(-c, 0.0) ** quality.SHARP, model["labels"][k]) for c, k in sure] + [(max(-edge, 0.0) ** quality.SHARP, model["labels"][k]) for k in tied]
        assert score == pytest.approx(sum(w * y for w, y in votes) / sum(w for w, _ in votes), abs=0.15 if len(set(c for c, _ in near)) < len(near) else 1e-3)
    x = np.zeros((1, 3000), np.float32)
    assert quality._nearest(x, 15).tolist() == [list(range(15))]


def test_quality_repeated_ids(spark):
    """Rows that repeat a labelled id train once."""
    docs = spark.createDataFrame([(1, "Plain words here.")] * 50 + [(2, "%%% ###")], "doc_id long, text string")
    model = quality.train(docs, spark.createDataFrame([(1, 1), (2, 0), (2, 0)], "doc_id long, quality int"))
    assert model["labels"].tolist() == [1.0, 0.0]


def test_quality_edges(spark):
    labels = np.array([1, 1, 0, 0])
    model = quality.fit(pa.array(["Plain words here.", "More plain words.", "### %%% &&&", "%%% ### $$$"]), labels)
    texts = pa.array(["Other plain words.", "&&& %%%", None, "", "x" * 200_000])
    scores = quality._scores(model, texts).to_pylist()
    assert scores[0] > 0.6 and scores[1] < 0.4 and scores[2] == scores[3] == 0.5 and 0 <= scores[4] <= 1
    empty = quality.fit(pa.array([], pa.string()), np.zeros(0))
    assert quality._scores(empty, texts).to_pylist() == [0.5] * 5
    docs = spark.createDataFrame([(1, "%%% ###", 5), (2, "Plain words.", 6), (3, None, 7)], "doc_id long, text string, score int")
    assert [r.doc_id for r in quality.keep_good(docs, model, 0.4).collect()] == [2, 3]
    assert quality.classify(docs.limit(0), model).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar">
<header>Site</header><nav><ul><li><a href="/x">Menu</a></ul></nav><div id="cookie-notice">Cookies</div><!-- note --><div class="ad">Buy</div>
<article><h1>Head &amp; line</h1><p>One<b>two</b> three&nbsp;four<br>five<p>six &lt;seven&gt;
 <form><input value="a>b"><button>Go</button></form><aside>Side</aside><ul><li>x<li>y</ul>
<section class="comments"><article class="comment">Reader</article></section></article><footer>&copy; F</footer></body></html>"""


def test_html_page():
    assert html_extract.Page(PAGE).main_text(frozenset()) == "Head & line Onetwo three four five six <seven> x y"
    assert html_extract.Page(None).main_text(frozenset()) == html_extract.Page("").main_text(frozenset()) == ""
    assert html_extract.Page("plain <b>text").main_text(frozenset()) == "plain text"
    assert html_extract.Page("<form><main>in a form</main></form>").main_text(frozenset()) == "in a form"
    assert html_extract.Page("<p>a<script>never closed").main_text(frozenset()) == "a"
    assert html_extract.Page("a < b <c 'x").main_text(frozenset()).startswith("a < b")
    assert html_extract.host_of("https://A.b/x") == "a.b" and html_extract.host_of(None) == html_extract.host_of("http://[") == ""


def test_html_words_inside_articles():
    """Inside an article only adverts, notices and comments go: elements of exactly these classes, and boxes with these words."""
    text = lambda source: html_extract.Page(source).main_text(frozenset())
    for kept in ("<section id='discussion'>a</section>", "<h2 id='search'>a</h2>", "<div class='related-work'>a</div>", "<p class='alert'>a</p>", "<p data-id='menu'>a</p>", "<p id='ad'>a</p>"):
        assert text(f"<article>{kept}<p>b</p></article>") == "a b"
    assert text("<main class='no-comments'>a</main>") == text("<article class='post has-comments'>a</article>") == "a"
    for gone in ("<p class='ad'>a</p>", "<div class='x comments'>a</div>", "<article class='comment'>a</article>", "<nav>a</nav>"):
        assert text(f"<article>{gone}<p>b</p></article>") == "b"
    boxes = ("section class='user-comments'", "div class='comment-body'", "div id='comments'", "div id='disqus_thread'", "div class='ad-slot'", "div class='advert-box'", "div class='cookie-banner'", "div class='newsletter'", "ul class='share-buttons'", "div class='breadcrumb'")
    for box in boxes:
        assert text(f"<article><{box}>a</{box.split()[0]}><p>b</p></article>") == "b"
    assert text("<div data-id='menu'>a</div><div id='menu'>b</div>") == "a"


def test_html_templates(spark, monkeypatch):
    """Pages without an article: what all pages of a host share, twice over, is template."""
    page = lambda k: f"<html><body><div>Welcome to us</div><div><p>Story {k} here</p></div><p>All rights reserved</p></body></html>"
    rows = [(k, "http://h.example/1", page(k), "z") for k in range(12)] + [(50, None, page(50), "z"), (51, "http://o.example", None, "z"), (51, "http://o.example", None, "z")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    for limit in (html_extract.BROADCAST_TOKENS, -1):
        monkeypatch.setattr(html_extract, "BROADCAST_TOKENS", limit)
        got = {r.page_id: r.text for r in html_extract.extract(df).collect()}
        assert got[3] == "Story 3 here" and got[50] == "Welcome to us Story 50 here All rights reserved" and got[51] == ""
    classes = html_extract.deduce_templates(html_extract.parse(df, "page_id", "url", "html"))[0].where("host = 'h.example'")
    assert classes.where("kind = 1").count() == 2 and classes.where("kind = 0").count() >= 3
    assert html_extract.extract(df.limit(0)).count() == 0


def test_html_brute(spark):
    """Templates of pages without articles against occurrence vectors in plain Python; without templates the texts differ."""
    r = random.Random(6)
    rows = []
    for host in range(4):
        fixed = [f"<p>fixed {host} {k}</p>" for k in range(3)]
        for k in range(8):
            parts = [f"<p>{r.choice(['story', 'tale'])} {r.randrange(50)}</p>" for _ in range(r.choice([1, 2, 3]))]
            some = [f"<p>now and then {host}</p>"] * (k % 3 > 0)
            rows.append((8 * host + k, f"http://h{host}/x", "<body>" + "".join([fixed[0], *parts, *some, fixed[1], fixed[2]]) + "</body>"))
    df = spark.createDataFrame(rows + rows[:5], "page_id long, url string, html string")
    got = {x.page_id: x.text for x in html_extract.extract(df).collect()}
    pieces = {i: re.findall(r"<p>(.*?)</p>", h) for i, _, h in rows}
    for host in range(4):
        own = {i: p for i, p in pieces.items() if i // 8 == host}
        vectors = defaultdict(set)
        for text in {t for p in own.values() for t in p}:
            vectors[tuple(p.count(text) for _, p in sorted(own.items()))].add(text)
        template = set()
        for vector, texts in vectors.items():
            once = {tuple(t for t in p if t in texts) for p in own.values()} - {()}
            if len(texts) > 1 and sum(c > 0 for c in vector) >= 0.9 * len(own) and len(once) == 1:
                template |= texts
        assert template == {f"fixed {host} {k}" for k in range(3)}
        assert all(got[i] == " ".join(t for t in p if t not in template) != " ".join(p) for i, p in own.items())


def test_html_deep_page():
    """A page of 250 KB of nested elements takes memory in proportion to its length."""
    tracemalloc.start()
    page = html_extract.Page("<div>" * 50_000 + "deep text")
    assert page.main_text(frozenset()) == "deep text" and len(page.tags) == 50_000
    assert tracemalloc.get_traced_memory()[1] < 60_000_000
    tracemalloc.stop()


def test_html_copies(spark):
    """Copies of a page, and repeated rows, don't make its text template."""
    page = lambda k, a="": f"<html><body {a}><div>Welcome to us</div><p>Story {k} here</p></body></html>"
    rows = [(1, "http://one.example", page(1))] * 3 + [(k, "http://two.example", page(2, f"data-n='{k}'")) for k in range(2, 7)]
    rows += [(k, "http://h.example", page(k)) for k in range(10, 14)] + [(k, "http://h.example", page(30)) for k in range(30, 80)]
    got = [(r.page_id, r.text) for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()]
    whole = lambda k: f"Welcome to us Story {k} here"
    want = [(1, whole(1))] * 3 + [(k, whole(2)) for k in range(2, 7)] + [(k, f"Story {k} here") for k in range(10, 14)] + [(k, "Story 30 here") for k in range(30, 80)]
    assert sorted(got) == sorted(want)


def test_html_article_keeps_what_repeats(spark, monkeypatch):
    """Nothing of an article goes because a host's articles share it; the slot is found without the element's name too."""
    page = lambda k, tag: f"<html><body><div>Site</div><{tag}><h1>Head {k}</h1><h2>Summary</h2><p>Story {k}</p><h2>Details</h2><p>More {k}</p></{tag}><div>End {k % 2}</div></body></html>"
    rows = [(k, "http://h.example", page(k, "article")) for k in range(12)] + [(k, "http://d.example", page(k, "section")) for k in range(20, 32)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for limit in (html_extract.BROADCAST_TOKENS, -1):
        monkeypatch.setattr(html_extract, "BROADCAST_TOKENS", limit)
        got = {r.page_id: r.text for r in html_extract.extract(df).collect()}
        assert all(got[k] == f"Head {k} Summary Story {k} Details More {k}" for k in range(12))
        assert all(got[k] == f"Head {k} Story {k} More {k}" for k in range(20, 32))


def _slots_of(pages):
    """Every host's chosen element, by brute force: paths as tuples, and all pages of a host at once."""
    out = {}
    for host, own in pages.items():
        distinct = {p.content(): p for p in own}.values()
        trees = []
        for p in distinct:
            paths, names = [], []
            for spot, parent, kind in p.elements:
                paths.append((*(paths[parent] if parent >= 0 else ()), spot))
                names.append(kind)
            said = defaultdict(list)
            for _, _, region, text, at in p.texts:
                if region and text.strip():
                    for k in range(len(paths[at]) + 1 if at >= 0 else 1):
                        said[paths[at][:k] if at >= 0 else ()].append(" ".join(text.split()))
            trees.append((dict(zip(paths, names)), said, sum(len(t) for _, _, r, t, _ in p.texts if r and t.strip())))
        n = len(trees)
        if n < 3:
            continue
        on = defaultdict(frozenset)
        for k, (names, _, _) in enumerate(trees):
            for path in names:
                on[path] |= {k}
        groups = defaultdict(list)
        for path, where in on.items():
            groups[where].append(path)
        template = {p for where, some in groups.items() if len(some) > 1 and len(where) >= 0.9 * n for p in some if len({tuple(x for x in t[0] if x in set(some)) for k, t in enumerate(trees) if k in where}) == 1}
        own_texts = {p: {tuple(sorted(t[1][p])) for t in trees if p in t[0] or not p} for p in {*template, ()}}
        varied = {p for p, x in own_texts.items() if len(x) >= 2 and 2 * len(x) >= sum(p in t[0] or not p for t in trees)}
        size = {p: np.mean([sum(map(len, t[1][p])) for t in trees if p in t[0] or not p]) for p in varied}
        kinds = {p: next(t[0][p] for t in trees if p in t[0]) for p in template}
        within = lambda p, kind: [x for x in varied if x[: len(p)] == p and x != p and kinds[x] >= kind]  # noqa: E731,B023
        now = ()
        while now in varied and kinds.get(now) != 2:
            inner = [x for x in within(now, 1) if not any(x[: len(y)] == y and len(now) < len(y) < len(x) for y in template)]
            best = max(inner, key=size.get, default=None)
            if best is None or size[best] < 0.6 * size[now]:
                break
            now = best
        if kinds.get(now) != 2:
            now = max(within(now, 2), key=size.get, default=now)
        out[host] = now[-1] if now else None
    return out


@pytest.mark.parametrize("folder", [SF, SF.replace("sf0.001", "sf0.01")])
def test_html_slots_brute(spark, folder):
    """The slots that the given pages' hosts get, by brute force; without them the texts of pages without article elements are other ones."""
    df = spark.read.parquet(f"{folder}/pages.parquet")
    bare = df.withColumn("html", F.regexp_replace("html", "(</?)article", "$1div"))
    for rows in (df, bare):
        by = defaultdict(list)
        for r in rows.collect():
            by[html_extract.host_of(r.url)].append(html_extract.Page(r.html))
        want = {h: s for h, s in _slots_of(by).items() if s}
        _, slots = html_extract.deduce_templates(html_extract.parse(rows, "page_id", "url", "html"))
        got = dict(html_extract.main_slots(slots).collect())
        assert got == want and (want or folder == SF)
    texts = {r.page_id: r.text for r in html_extract.extract(df).collect()}
    plain = {r.page_id: html_extract.Page(r.html).main_text() for r in bare.collect()}
    slotted = {r.page_id: r.text for r in html_extract.extract(bare).collect()}
    host = {r.page_id: html_extract.host_of(r.url) for r in df.collect()}
    hits = [i for i in texts if host[i] in want]
    assert all(slotted[i] == texts[i] for i in hits)


def test_html_query(spark):
    """Against a plain reading of the one layout that the test pages have."""
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in queries_web.op10_html_extraction(spark, SF).collect():
        body = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.DOTALL)[1]
        body = re.sub(r"</?(p|h1|br)\b[^>]*>", " ", body).replace("<b>", "").replace("</b>", "")
        assert r.text == " ".join(html.unescape(body).split()) and r.n_chars == len(r.text)


def test_warc_audit(spark, monkeypatch):
    monkeypatch.setattr(warc_audit, "RANGE", 100)
    monkeypatch.setattr(warc_audit, "FANOUT", 2)
    r = random.Random(1)
    rows, at = [], {}
    for i in range(300):
        a = r.choice(["x", "x", "y", None])
        n = r.choice([10, 60, 250])
        rows.append((a, at.get(a, 0), n, f"{i:064x}"))
        at[a] = at.get(a, 0) + n
    other = [list(x) for x in rows]
    other[7][3], other[120][2] = "f" * 64, 11
    lost = other.pop(200)
    other.append(["z", 0, 5, "a" * 64])
    schema = "archive string, offset long, length long, sha256 string"
    a, b = spark.createDataFrame(rows, schema), spark.createDataFrame([tuple(x) for x in other], schema)
    want = {(rows[7][0], rows[7][1], "changed"), (rows[120][0], rows[120][1], "changed"), (lost[0], lost[1], "missing"), ("z", 0, "extra")}
    assert {tuple(x) for x in warc_audit.audit(a, b).collect()} == want
    assert warc_audit.audit(a, a).count() == 0 == warc_audit.audit(a.limit(0), a.limit(0)).count()
    assert warc_audit.audit(a, a.limit(0)).count() == 300


def test_warc_replica(spark):
    """A replica with changed lengths and lost records, of its own layout: only these records are reported."""
    rows = [(i, f"http://a/{i}", f"<p>{i}</p>" if i % 5 else None) for i in range(700)] + [(20, "http://a/20", "<p>20 again</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    records = warc_audit.archive_pages(pages)
    replica = warc_audit.archive_pages(queries_web.damaged_pages(pages))
    old, new = ({(r.id, r.sha256): r for r in x.collect()} for x in (records, replica))
    assert {new[k].length - old[k].length for k in old.keys() & new.keys()} == {0} and any(new[k].offset != old[k].offset for k in old.keys() & new.keys())
    lengths = {r.id: r.length for r in new.values()}
    assert len({(lengths[r.id] > r.length) - (lengths[r.id] < r.length) for r in old.values() if r.id % 97 == 13}) == 3
    at = {(r.archive, r.offset): r.id for r in old.values()}
    got = [(at[r.archive, r.offset], r.status) for r in warc_audit.audit(records, warc_audit.aligned(replica, records)).collect()]
    want = [(i, "missing") for i in range(700) if i % 211 == 7] + [(i, "changed") for i in range(700) if i % 97 == 13 and i % 211 != 7]
    assert sorted(got) == sorted(want)
    extra = warc_audit.audit(records.where("id != 3"), warc_audit.aligned(records, records.where("id != 3"))).collect()
    assert [r.status for r in extra] == ["extra"]


def test_warc_files(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a", "<p>é</p>"), (2, None, None)], "page_id long, url string, html string")
    text = "".join(r[0] for r in pages.select(warc_audit.warc_record(*map(pages.__getitem__, ("url", "html", "page_id")))).collect())
    (tmp_path / "a.warc").write_bytes(text.encode())
    found = list(warc_audit.parse_warc(text.encode()))
    assert [p for _, _, _, p in found] == ["<p>é</p>".encode(), b""] and found[0][2]["warc-target-uri"] == "http://a"
    read = warc_audit.read_archives(spark.read.format("binaryFile").load(str(tmp_path))).orderBy("offset").collect()
    laid = warc_audit.archive_pages(pages).orderBy("offset").collect()
    assert [(x.offset, x.length, x.sha256) for x in read] == [(x.offset, x.length, x.sha256) for x in laid]


def test_near_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries_near.op6_near_dedup(spark, SF).collect()}
    assert got == brute.near_components(rows)


def test_warc_gz(spark, tmp_path):
    """A member for each record; a damaged member is one record, and the others are still found."""
    import gzip

    records = [b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(p), p) for p in (b"one", b"", b"x" * 200_000, b"four")]
    members = [gzip.compress(r) for r in records]
    found = list(warc_audit.parse_warc_gz(b"".join(members)))
    assert [p for *_, p in found] == [b"one", b"", b"x" * 200_000, b"four"]
    assert [(o, n) for o, n, _, _ in found] == [(sum(map(len, members[:k])), len(m)) for k, m in enumerate(members)]
    assert len(list(warc_audit.parse_warc_gz(members[0] + b"junk"))) == 2 and not list(warc_audit.parse_warc_gz(b""))
    for name, last in (("a", members[3]), ("b", gzip.compress(records[3].replace(b"four", b"five")))):
        (tmp_path / name).mkdir()
        (tmp_path / name / "x.warc.gz").write_bytes(b"".join([*members[:3], last]))
    read = lambda name: warc_audit.read_archives(spark.read.format("binaryFile").load(str(tmp_path / name))).withColumn("archive", F.lit("x"))
    bad = warc_audit.audit(read("a"), read("b")).collect()
    assert [(r.archive, r.offset, r.status) for r in bad] == [("x", sum(map(len, members[:3])), "changed")]


def test_warc_levels_of_the_query(spark):
    """The query's archives have several levels, and its result does not depend on how many."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    assert len(warc_audit.merkle_levels(warc_audit.archive_pages(pages))) >= 3
