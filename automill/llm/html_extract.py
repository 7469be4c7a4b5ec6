"""Main text of web pages by equivalence classes of template tokens.

A page is parsed once, into elements and texts, which are written as a table. Tokens are elements, known by their path with their places
among siblings of their name, and text nodes with their path. Paths are hashes, so memory grows with a page's length, not with its depth.
Over the pages of a host, of which those with equal tags and texts count once, every token has an occurrence vector; its fingerprint is
the XOR of hashes of (page, count), so it is summed up without bringing a host's pages together. Tokens with equal
vectors form a class. A class is valid if enough pages have it and it nests: on every page, its tokens, in the order
of the page, are one and the same sequence of all of them, once or several times over; only a hash for each page and class is exchanged.
The elements of valid classes, one within the other, are a host's template, and what a page has in each of them is a slot.

A slot varies if at least half of the host's pages have something of their own there. The extraction goes from the page to the slot within it
that varies and has the most text, as long as that is ``MOST`` of the text, and stops at an article or main element; if it
ends elsewhere and there is a varying article or main slot within, it takes that. The slot's text is the result: all of it in an article
or main element, however often it repeats; elsewhere without text tokens of valid classes, and without slots that are the same on all pages. Regions that are no content by name (menus,
headers, footers, sidebars, forms, scripts, styles) or, for boxes, by words of class and id (adverts, notices, comments)
do not count. Pages without the slot, and hosts without a template, give their article or main element, else all but those regions.

Hosts' templates and slots are broadcast behind a check of their size; beyond it they are joined by url.

Edge cases: null html is empty and gives empty text; a null or bad url is the host ''; hosts with fewer
than ``LEAST_PAGES`` different pages, or without a text that varies, have no template; broken markup is read as far as it goes; repeated rows give
repeated results; slots of equal length go by their token; an empty table gives an empty result; columns other than id, url and html pass by,
whatever they are called.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from automill.llm.scratch import drop, keep

#: Pages of a host, and share of them, that a template needs.
LEAST_PAGES, LEAST_SHARE = 3, 0.9
#: Share of a slot's text that a slot within it must have to be taken instead.
MOST = 0.6
#: Text tokens of all templates that are broadcast at most; 8 bytes each and the host's name.
BROADCAST_TOKENS = 500_000

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"""
    r"""|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>"""
    r"""|<(?P<name2>/?[a-zA-Z][^\s/>]*+)[^>]*+(?:>|\Z)|(?P<text>[^<]++|<)""",
    re.DOTALL,
)
_ATTR = re.compile(r"""(?<![\w:.-])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_RAW = {name: re.compile(rf"</{name}\b[^>]*>?", re.IGNORECASE) for name in ("script", "style", "textarea", "title", "xmp", "iframe", "noembed")}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike "
    "strong sub sup time tt u var wbr".split()
)
#: Elements that never hold main text, and words of class, id or role that say so.
_NOISE = frozenset(
    "head nav header footer aside form script style noscript template iframe object svg button select textarea menu dialog canvas "
    "audio video map datalist title".split()
)
_NOISE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising sponsor sponsored sponsors promo promos promotion banner banners "
    "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup sidebar sidebars "
    "menu menus nav navbar navigation breadcrumb breadcrumbs footer header masthead comment comments commentlist disqus reply replies "
    "respond discussion share sharing social related recommended recommendations widget widgets toolbar pagination pager skip "
    "complementary contentinfo search login adsbygoogle advertise".split()
)
#: Classes of adverts, notices and comments, which are dropped inside articles.
_NOISE_CLASSES = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsbygoogle sponsor sponsored cookie-notice notice notices "
    "comment comments commentlist comment-list comments-area disqus".split()
)
#: Elements that are boxes, and words of class or id by which a box inside an article is an advert, a notice or comments.
_BOXES = frozenset("section div aside ul ol dl table form figure".split())
_BOX_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsbygoogle sponsor sponsored promo cookie cookies consent gdpr notice notices newsletter "
    "subscribe subscription comment comments commentlist disqus reply replies share sharing social breadcrumb breadcrumbs".split()
)
#: Elements that a slot may be.
_SECTIONS = frozenset("html body article main section div center table tbody tr td".split())
_LAYOUT = frozenset("has with no layout".split())
_WHOLE = frozenset("html body article main".split())
_SPLIT = re.compile(r"[^A-Za-z0-9]+|(?<=[a-z])(?=[A-Z])")


def _words(attrs: str) -> set[str]:
    return {w.lower() for m in _ATTR.finditer(attrs) for w in _SPLIT.split(m[2] or m[3] or m[4] or "") if w}


def _classes(attrs: str) -> set[str]:
    return {w.lower() for m in _ATTR.finditer(attrs) if m[1].lower() == "class" for w in (m[2] or m[3] or m[4] or "").split()}


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


class Page:
    """One page: ``tags`` counts tags by path, ``elements`` are (spot, parent, kind), and ``texts`` (block, path, region, text, element).

    spot: the hash of an element's path with the places of its containers and itself among siblings of their names. parent: a place in elements, or -1.
    kind: 2 for article and main, 1 for other elements that a slot may be, else 0.
    region: 2 inside an article or main element, 1 outside, 0 inside something that never is main text.
    """

    def __init__(self, source: str | None):
        self.tags: Counter[str] = Counter()
        self.texts: list[tuple[int, str, int, str, int]] = []
        self.elements: list[tuple[int, int, int]] = []
        self._places: Counter[tuple[int, str]] = Counter()
        self._read(source or "")

    def _text(self, block: int, path: str, noise: bool, inside: int, text: str, at: int) -> None:
        self.texts.append((block, path, 0 if noise else 2 if inside else 1, text, at))

    def _element(self, name: str, parent: int) -> int:
        place = self._places[parent, name] = self._places[parent, name] + 1
        above = self.elements[parent][0] if parent >= 0 else 0
        self.elements.append((token(str(above), f"{name} {place}"), parent, 2 if name in ("article", "main") else int(name in _SECTIONS)))
        return len(self.elements) - 1

    def _read(self, source: str) -> None:
        stack: list[tuple[str, str, bool, int, int]] = []  # name, path, noise, articles, element
        path, noise, inside, here_in, block, at = "", False, 0, -1, 0, 0
        while at < len(source):
            m = _TOKEN.match(source, at)
            at = m.end()
            if m["text"] is not None:
                self._text(block, path, noise, inside, m["text"], here_in)
                continue
            name = m["name"]
            if name is None:
                if m["name2"] is not None:
                    block += 1
                elif m[0].startswith("<![CDATA["):
                    self._text(block, path, noise, inside, m[0][9:].removesuffix("]]>"), here_in)
                continue
            name = name.lower()
            if name == "br":
                self._text(block, path, noise, inside, " ", here_in)
                continue
            if name not in _INLINE:
                block += 1
            if m["end"]:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == name:
                        del stack[k:]
                        break
                    if name in _INLINE and stack[k][0] not in _INLINE and stack[k][0] != "p":
                        break
                path, noise, inside, here_in = stack[-1][1:] if stack else ("", False, 0, -1)
                continue
            attrs = m["attrs"]
            if name in _RAW and not attrs.endswith("/"):
                end = _RAW[name].search(source, at)
                at = end.end() if end else len(source)
                continue
            if name == "p" and stack and stack[-1][0] == "p":
                stack.pop()
                path, noise, inside, here_in = stack[-1][1:] if stack else ("", False, 0, -1)
            words = _words(attrs) if attrs else set()
            tag = below(path, name)
            self.tags[tag] += 1
            if name in _VOID:
                continue
            bad = name in _NOISE
            if not bad and words and inside:
                bad = bool(_classes(attrs) & _NOISE_CLASSES) or name in _BOXES and bool(words & _BOX_WORDS) and not words & _LAYOUT
            elif not bad and name not in _WHOLE:
                bad = bool(words & _NOISE_WORDS) and not words & _LAYOUT
            bad = bad or name in ("article", "main") and bool(words & {"comment", "comments", "reply"}) and not words & _LAYOUT
            here = name in ("article", "main") or "main" in words
            if here and noise and not bad and self._form_only(stack):
                noise = False  # some sites wrap the whole page in a form
            noise = noise or bad
            inside = inside + (1 if here and not noise else 0)
            if name not in _INLINE:
                path = tag if name != "p" else path
                here_in = self._element(name, here_in)
            stack.append((name, path, noise, inside, here_in))

    @staticmethod
    def _form_only(stack: list[tuple[str, str, bool, int, int]]) -> bool:
        """Whether forms are the only noise that is open: the first noise is one, and nothing in it is noise by itself."""
        first = next(k for k, x in enumerate(stack) if x[2])
        return stack[first][0] == "form" and not any(x[0] in _NOISE and x[0] != "form" for x in stack[first:])

    def constants(self) -> Counter[int]:
        """Text nodes outside noise, as token hashes."""
        return Counter(token(p, t) for _, p, region, t, _ in self.texts if region and t.strip())

    def content(self) -> int:
        """A hash of the tags and texts."""
        return token(repr(sorted(self.tags.items())), repr([(p, r, " ".join(t.split())) for _, p, r, t, _ in self.texts if t.strip()]))

    def main_text(self, template: frozenset[int] = frozenset()) -> str:
        """The article or main element's text, or all but noise and the template's texts."""
        best = max((r for _, _, r, t, _ in self.texts if t.strip()), default=0)
        fixed = template if best == 1 else frozenset()
        return joined((block, text) for block, path, region, text, _ in self.texts if region == best and best and not (fixed and text.strip() and token(path, text) in fixed))


def joined(texts: Iterable[tuple[int, str]]) -> str:
    """Texts by block, references decoded and white space made one space."""
    blocks: dict[int, list[str]] = {}
    for block, text in texts:
        blocks.setdefault(block, []).append(text)
    found = (" ".join(html.unescape("".join(parts)).split()) for parts in blocks.values())
    return " ".join(x for x in found if x)


@lru_cache(maxsize=1 << 14)
def below(path: str, name: str) -> str:
    """The path of an element in another one's: a hash, as text."""
    return hashlib.blake2b(f"{path}/{name}".encode("utf-8", "replace"), digest_size=8).hexdigest()


def token(path: str, text: str) -> int:
    return int.from_bytes(hashlib.blake2b(f"{path}\0{' '.join(text.split())}".encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)


_LISTS = (
    ("spots", pa.int64()), ("parents", pa.int32()), ("kinds", pa.int32()), ("blocks", pa.int32()), ("tokens", pa.int64()), ("regions", pa.int32()), ("texts", pa.string()), ("places", pa.int32()),
)
_SQL = {pa.int64(): "long", pa.int32(): "int", pa.string(): "string"}


def parse(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """The parsed pages: url, host, content, row (a number of its own), id, of elements spots, parents and kinds, of texts blocks, tokens (0 for noise and blanks), regions, texts and places."""
    rows = pages.select(F.col(url_col).alias("url"), F.col(html_col).alias("html"), F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                lists: dict[str, list] = {name: [] for name, _ in _LISTS}
                hosts, contents = [], []
                for i in range(part.num_rows):
                    page = Page(part.column(1)[i].as_py())
                    hosts.append(host_of(part.column(0)[i].as_py()))
                    contents.append(page.content())
                    spots, parents, kinds = zip(*page.elements) if page.elements else ((), (), ())
                    blocks, paths, regions, texts, places = zip(*page.texts) if page.texts else ((),) * 5
                    tokens = [token(p, t) if r and t.strip() else 0 for p, r, t in zip(paths, regions, texts)]
                    for (name, _), found in zip(_LISTS, (spots, parents, kinds, blocks, tokens, regions, texts, places)):
                        lists[name].append(found)
                columns = [pa.array(lists[name], pa.list_(kind)) for name, kind in _LISTS]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(hosts, pa.string()), pa.array(contents, pa.int64()), part.column(3), part.column(2), *columns], ["url", "host", "content", "row", "id", *[n for n, _ in _LISTS]])

    schema = f"url string, host string, content long, row long, id {rows.schema['id'].dataType.simpleString()}, " + ", ".join(f"{name} array<{_SQL[kind]}>" for name, kind in _LISTS)
    return keep(rows.mapInArrow(run, schema), "html-parsed")


def _nested(tokens: list[int], classes: dict[int, int]) -> list[tuple[int, int]]:
    """Of each class (of a token) on a page, the order of its tokens as a hash, or 0 if they don't nest."""
    found: dict[int, list[int]] = {}
    for t in tokens:
        if t in classes:
            found.setdefault(classes[t], []).append(t)
    out = []
    for c, seq in found.items():
        once = seq[: len(set(seq))]
        out.append((c, token("", repr(once)) | 1 if seq == once * (len(seq) // len(once)) else 0))
    return out


def _slots(spots: list[int], parents: list[int], kinds: list[int], tokens: list[int], sizes: list[int], places: list[int], classes: dict[int, int]) -> list[tuple[int, int, int, int, int]]:
    """Of each template element on a page (0 for the page itself): spot, the template element around it, kind, and hash and length of its text."""
    near, hashes, lengths = [], [0] * (len(spots) + 1), [0] * (len(spots) + 1)
    for spot, parent in zip(spots, parents):
        near.append(len(near) if spot in classes else near[parent] if parent >= 0 else -1)
    for t, size, place in zip(tokens, sizes, places):
        if t:
            at = near[place] if place >= 0 else -1
            hashes[at] = (hashes[at] + t * 0x9E3779B97F4A7C15) % (1 << 63)
            lengths[at] += size
    above = [near[parents[k]] if parents[k] >= 0 else -1 for k in range(len(spots))]
    for k in range(len(spots) - 1, -1, -1):  # what is within comes behind
        if near[k] == k:
            hashes[above[k]] = (hashes[above[k]] + hashes[k]) % (1 << 63)
            lengths[above[k]] += lengths[k]
    out = [(spots[k], spots[above[k]] if above[k] >= 0 else 0, kinds[k], hashes[k], lengths[k]) for k in range(len(spots)) if near[k] == k]
    return [*out, (0, 0, 0, hashes[-1], lengths[-1])]


def _once_each(parsed: DataFrame) -> DataFrame:
    """The parsed pages without those that have the content of another page of the host."""
    twice = parsed.groupBy("host", "content").agg(F.count(F.lit(1)).alias("rows"), F.min("row").alias("first")).where("rows > 1")
    twice = keep(twice.select(F.col("host").alias("host_"), F.col("content").alias("content_"), F.xxhash64("host", "content").alias("key_"), "first"), "html-copies")
    same = (F.xxhash64("host", "content") == F.col("key_")) & (F.col("host") == F.col("host_")) & (F.col("content") == F.col("content_"))
    out = parsed.join(F.broadcast(twice) if twice.count() <= BROADCAST_TOKENS else twice, same, "left")
    return out.where(F.col("first").isNull() | (F.col("first") == F.col("row"))).select(parsed.columns)


def _counted(tokens: Column) -> Column:
    """array<struct<token, n>> of an array of tokens, by runs of the sorted array, which is made once."""

    def runs(line: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(line) - 1), lambda i: (i == 0) | (F.get(line, i) != F.get(line, i - 1)))
        count = lambda s: F.transform(s, lambda i, k: F.struct(F.get(line, i).alias("token"), (F.coalesce(F.get(s, k + 1), F.size(line)) - i).cast("long").alias("n")))
        return F.get(F.transform(F.array(starts), count), F.lit(0))

    none = F.array().cast("array<struct<token: bigint, n: bigint>>")
    return F.get(F.transform(F.array(F.array_sort(tokens)), lambda line: F.when(F.size(line) > 0, runs(line)).otherwise(none)), F.lit(0))


def deduce_templates(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The template tokens of every host (host, kind, token, vector; kind 0 elements, 1 texts), and its slots.

    A token is template if its class (equal occurrence vector within the host) has two tokens or more, nests
    and stands on at least ``LEAST_SHARE`` of the host's pages. Pages of equal content count once, and a host
    on which no text varies has no template. Slots: host, spot, parent, kind, pages, own (different texts) and length (mean).
    """
    pages = _once_each(parsed)
    said = F.filter("tokens", lambda t: t != 0)
    found = [pages.select("host", "content", F.lit(k).alias("kind"), F.inline(_counted(c))) for k, c in ((0, F.col("spots")), (1, said))]
    seen = F.bit_xor(F.xxhash64("kind", "content", "n"))
    tokens = found[0].unionByName(found[1]).groupBy("host", "kind", "token").agg(F.count(F.lit(1)).alias("pages"), seen.alias("vector"))
    tokens = keep(tokens, "html-tokens")
    least = F.min(F.when(F.col("kind") == 1, F.col("pages"))).alias("least")
    hosts = tokens.groupBy("host").agg(F.max("pages").alias("of"), least)
    hosts = hosts.where((F.col("of") >= LEAST_PAGES) & (F.col("least") < F.col("of"))).drop("least")
    classes = tokens.groupBy("host", "vector", "pages").agg(F.count(F.lit(1)).alias("class_size"))
    classes = classes.join(hosts, "host").where((F.col("class_size") >= 2) & (F.col("pages") >= LEAST_SHARE * F.col("of")))
    found = keep(tokens.join(classes.drop("of"), ["host", "vector", "pages"]), "html-classes")
    drop(tokens)
    sizes = F.transform("texts", lambda t: F.length(t))
    rows, known = _with_classes(pages.select("url", "host", "content", "spots", "parents", "kinds", "tokens", sizes.alias("sizes"), "places"), found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: set[tuple] = set()
            for i in range(batch.num_rows):
                classes = known(batch, i)
                if classes:
                    host, content = batch.column(1)[i].as_py(), batch.column(2)[i].as_py()
                    spots, parents, kinds, tokens, sizes, places = (batch.column(j)[i].as_py() for j in range(3, 9))
                    # Elements by themselves, and texts by themselves: classes are of either.
                    out |= {(host, 0, c, 0, 0, order, 0) for c, order in [*_nested(spots, classes), *_nested(tokens, classes)]}
                    out |= {(host, content, *slot) for slot in _slots(spots, parents, kinds, tokens, sizes, places, classes)}
            columns = list(zip(*out)) or [()] * 7
            types = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
            names = ("host", "content", "spot", "parent", "kind", "hash", "length")
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, types)], list(names))

    marked = [F.when(F.col("content") == 0, 1).otherwise(F.col("content")).alias("content") if c == "content" else F.col(c) for c in rows.columns]
    read = keep(rows.select(*marked).mapInArrow(run, "host string, content long, spot long, parent long, kind int, hash long, length long"), "html-slots")
    orders = read.where("content = 0").groupBy("host", "spot").agg(F.min("hash").alias("a"), F.max("hash").alias("b")).where("a = b and a != 0")
    templates = keep(found.join(orders.select("host", F.col("spot").alias("vector")), ["host", "vector"]).select("host", "kind", "token", "vector"), "html-templates")
    by_text = read.where("content <> 0").groupBy("host", "spot", "parent", "kind", "hash").agg(F.count(F.lit(1)).alias("pages"), F.sum("length").alias("length"))
    slots = by_text.groupBy("host", "spot", "parent", "kind").agg(F.sum("pages").alias("pages"), F.count(F.lit(1)).alias("own"), (F.sum("length") / F.sum("pages")).alias("length"))
    valid = templates.where("kind = 0").select("host", F.col("token").alias("spot"))
    slots = keep(slots.where("spot = 0").unionByName(slots.where("spot <> 0").join(valid, ["host", "spot"]).select(slots.columns)), "html-slots")
    drop(read, found)
    return templates, slots


def choose(slots: list[tuple[int, int, int, int, int, float]]) -> int:
    """The spot of the slot with the main text, of a host's (spot, parent, kind, pages, own, length); 0 if it is the page."""
    varied = {x[0]: x for x in slots if x[4] >= 2 and 2 * x[4] >= x[3]}
    within: dict[int, list[int]] = {}
    spots = {x[0] for x in slots}
    for spot, parent, *_ in slots:
        if spot:
            within.setdefault(parent if parent in spots else 0, []).append(spot)
    now, kind = 0, 0
    while now in varied and kind != 2:
        best = min((x for x in within.get(now, ()) if x in varied and varied[x][2]), key=lambda x: (-varied[x][5], x), default=None)
        if best is None or varied[best][5] < MOST * varied[now][5]:
            break
        now, kind = best, varied[best][2]
    if kind != 2:
        inside, todo = [], [now]
        while todo:
            todo += (more := within.get(todo.pop(), []))
            inside += [x for x in more if x in varied and varied[x][2] == 2]
        now = min(inside, key=lambda x: (-varied[x][5], x), default=now)
    return now


def main_slots(slots: DataFrame) -> DataFrame:
    """host and spot: each host's chosen slot; a task has the slots of a host, which are as many as its template's elements."""

    def run(table: pa.Table) -> pa.Table:
        names = ("spot", "parent", "kind", "pages", "own", "length")
        spot = choose(list(zip(*(table.column(c).to_pylist() for c in names))))
        return pa.table({"host": table.column("host").slice(0, 1), "spot": pa.array([spot], pa.int64())})

    return slots.groupBy("host").applyInArrow(run, "host string, spot long").where("spot <> 0")


def _with_classes(rows: DataFrame, tokens: DataFrame) -> tuple[DataFrame, Callable[[pa.RecordBatch, int], dict[int, int]]]:
    """Rows that begin with url and host, and what tells the classes by token for a row of a batch of them."""
    if tokens.count() <= BROADCAST_TOKENS:
        templates: dict[str, dict[int, int]] = {}
        for r in tokens.select("host", "token", "vector").collect():
            templates.setdefault(r[0], {})[r[1]] = r[2]
        shared = rows.sparkSession.sparkContext.broadcast(templates)
        return rows, lambda batch, i: shared.value.get(batch.column(1)[i].as_py(), {})
    sets = tokens.groupBy(F.col("host").alias("h")).agg(F.map_from_entries(F.collect_list(F.struct("token", "vector"))).alias("classes"))
    rows = rows.join(sets, rows["host"] == sets["h"], "left").select(*rows.columns, "classes")
    return rows, lambda batch, i: dict(batch.column(batch.num_columns - 1)[i].as_py() or ())


def slot_text(spot: int | None, page: dict[str, list], template: frozenset[int]) -> str:
    """The text of a page's slot, or, if it has no text there, of its article or main element, or of all.

    Outside articles without the texts, and what stands in the elements, of ``template``.
    """
    inside: list[int] = []  # 2 in an article slot, 1 in another one
    fixed: list[bool] = []
    for s, parent, kind in zip(page["spots"], page["parents"], page["kinds"]):
        inside.append(kind if s == spot else inside[parent] if parent >= 0 else 0)
        fixed.append(s in template or parent >= 0 and fixed[parent])
    own, rest = [], []
    best = max((r for r, t in zip(page["regions"], page["texts"]) if t.strip()), default=0)
    for block, t, region, text, place in zip(*(page[c] for c in ("blocks", "tokens", "regions", "texts", "places"))):
        gone = t in template or place >= 0 and fixed[place]
        within = inside[place] if place >= 0 else 0
        if region and within and (within == 2 or not gone):
            own.append((block, text))
        if region == best and best and (best == 2 or not gone):
            rest.append((block, text))
    return joined(own) or joined(rest)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url and text of every page."""
    parsed = parse(pages, id_col, url_col, html_col)
    templates, slots = deduce_templates(parsed)
    always = slots.where("spot <> 0 and own = 1").select("host", F.col("spot").alias("token"), F.lit(1).cast("long").alias("vector"))
    fixed = templates.where("kind = 1").select("host", "token", "vector").unionByName(always)
    chosen = main_slots(slots).select("host", F.lit(0).cast("long").alias("token"), F.col("spot").alias("vector"))  # token 0 stands for the slot
    rows, known = _with_classes(parsed.drop("content", "row"), fixed.unionByName(chosen))
    kind = parsed.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                template = known(batch, i)
                page = {name: batch.column(3 + k)[i].as_py() for k, (name, _) in enumerate(_LISTS)}
                out.append(slot_text(template.get(0), page, frozenset(t for t in template if t)))
            yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(0), pa.array(out, pa.string())], [id_col, url_col, "text"])

    return rows.mapInArrow(run, f"`{id_col}` {kind}, `{url_col}` string, text string")
