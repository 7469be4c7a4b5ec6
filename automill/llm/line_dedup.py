"""Line deduplication by winnowing over the hashes of rolling lines.

Passages start and end anywhere in a text, so its lines are rolling ones: every ``GRAM`` consecutive words
are a line, whatever the text's own line breaks. A *window* is ``run_words`` consecutive words, that is
``run_words - GRAM + 1`` lines. Its minimum is the line whose first word has the least hash; which one that is
depends on the window's words alone, so equal windows have equal minima: these are guaranteed fingerprints.
Over a text the minimum moves only now and then, and a mark is made where it does.

1. Texts that are equal as a whole are found by their digests first. The first of them, by id, stands for all,
   and the later ones are later repeats as a whole.
2. Marks are counted by fingerprint. Those that occur at one place only rule their windows out.
3. The places of the others are joined with their texts. The windows that have a mark's line as their minimum,
   on both sides of it, are compared by content (96 bits) over all texts; every one with an
   earlier occurrence, by id and position, is a later repeat. This is what extending matches both ways gives:
   a maximal repeated run of n >= run_words words is the union of its n - run_words + 1 windows, each of which
   has a mark in both places (the minimum of equal windows is equal), so all of them are compared, from the
   run's first word to its last; and a window outside of all repeated runs has no earlier occurrence.
4. The words of later repeats go, with the white space behind them. Words are what ASCII white space separates.

So a word goes exactly if it stands in a run of ``run_words`` words which occurs earlier, in an earlier text or
further up in its own, where the first occurrence must not overlap it.

Texts are cut into blocks of ``WORDS`` words with margins, so the work on one row is bounded. No pairs of
documents are made: occurrences are compared with the first one only. Digests and marks are summed up on the
map side before they are exchanged, and the joins' keys are turned over, so that they are dealt out anew and
Spark can split a passage that a third of all texts have.

Edge cases: null text stays null, empty text and texts of fewer than ``run_words`` words stay as they are unless
they repeat themselves; of repeated rows (same id and text) none is later than the other, so they fare alike;
with equal ids the text's hash decides which is earlier; null ids come first; an empty table gives an empty
result; other columns pass through, whatever their names, but for one called like the count, which is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from automill.llm.scratch import drop, keep

#: Words from which on a repeated run goes.
MIN_WORDS = 30
#: Words of a rolling line.
GRAM = 8
#: Windows in a row that are looked at together first, as the minimum often stays for all of them.
STEP = 4
#: Windows that start in one row of the table of words.
WORDS = 4096
#: Bits of a window's place in its block.
_BITS = 13
_INDEX_BITS = 33  # of monotonically_increasing_id, below the partition's number
#: Texts with repeated fingerprints, or groups of equal texts, whose keys are broadcast at most; 16 and 32 bytes each.
BROADCAST_TEXTS = 200_000

_SPACE, _WORD = r"\t-\r ", r"^\t-\r "


def _once(value: Column, f) -> Column:
    """f of a value that is evaluated once, however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def bare_words(text: Column) -> Column:
    """The words of a text, without the white space between them."""

    def blank(space: Column):
        return lambda t: F.when(F.contains(t, space), F.replace(t, space, F.lit(" "))).otherwise(t)

    for space in "\t\n\x0b\x0c\r":
        text = _once(text, blank(F.lit(space)))
    return F.array_remove(F.split(text, " ", -1), "")


def _hashes(text: Column) -> Column:
    return F.transform(bare_words(text), lambda w: F.xxhash64(w))


def _part(h: Column, at: Column | int, n: int) -> Column:
    """n words from place at (from 0)."""
    return F.slice(h, at + 1, n)


def first_of_equal(rows: DataFrame) -> DataFrame:
    """Two hashes and the first id (``null_first`` if that is null) of texts that stand under more than one id; rows have id, text, th and tk."""
    groups = rows.where("text is not null").groupBy(F.col("th").alias("th_"), F.col("tk").alias("tk_"))
    groups = groups.agg(F.min("id").alias("first"), F.max("id").alias("last"), F.bool_or(F.col("id").isNull()).alias("null_first"))
    return groups.where("first < last or (null_first and first is not null)").drop("last")


def _marked(rows: DataFrame, run_words: int, gram: int) -> DataFrame:
    """id, th, f and place: block, a and p, one behind the other in ``_BITS`` each. The fingerprint f is the minimum, at p, of the windows from a on."""
    ahead = run_words - gram + 1

    def blocks(h: Column) -> Column:
        last = F.floor((F.size(h) - run_words) / WORDS).cast("int")
        cut = lambda b: F.struct(b.alias("block"), F.slice(h, b * WORDS + 1, WORDS + run_words - 1).alias("h"))
        return F.when(F.size(h) >= run_words, F.transform(F.sequence(F.lit(0), last), cut))

    rows = rows.select("id", "th", F.inline(_once(_hashes(F.col("text")), blocks)))
    last = F.size("h") - run_words
    rows = rows.select("id", "th", "block", "h", F.explode(F.sequence(F.lit(0), last, F.lit(STEP))).alias("c"))
    h, c, i = F.col("h"), F.col("c"), F.col("i")
    # The minimum of these windows and the one before stays if it lies in what they all have.
    seen = F.slice(h, F.greatest(c, F.lit(1)), ahead + STEP)
    rows = rows.where((c == 0) | ~F.array_position(seen, F.array_min(seen)).between(STEP + 1, ahead))
    rows = rows.select("id", "th", "block", "h", F.explode(F.sequence(c, F.least(c + (STEP - 1), last))).alias("i"))
    # It has moved if the word that left is the least of all, or the one that came is less than all.
    seen = F.slice(h, F.greatest(i, F.lit(1)), ahead + 1)
    left, came, least = F.get(h, i - 1), F.get(h, i + (ahead - 1)), F.array_min(seen)
    rows = rows.where((i == 0) | ((least == F.least(left, came)) & ((left <= came) | (F.array_position(seen, came) == ahead + 1))))
    front = _part(h, i, ahead)
    place = (i + F.array_position(front, F.array_min(front)) - 1).cast("int")
    packed = F.shiftleft(F.shiftleft(F.col("block").cast("long"), _BITS).bitwiseOR(i.cast("long")), _BITS).bitwiseOR(place.cast("long"))
    return rows.select("id", "th", F.xxhash64(_part(h, place, gram)).alias("f"), packed.alias("place"))


def _low(x: Column) -> Column:
    return x.bitwiseAND((1 << _BITS) - 1).cast("int")


def _repeated(marks: DataFrame) -> DataFrame:
    """Marks by block (id, th, block, ranges of a and p) whose fingerprint is there at another place too."""
    place = F.xxhash64("id", "th", "place")
    again = marks.groupBy("f").agg(F.min(place).alias("x"), F.max(place).alias("y")).where("x <> y")
    again = again.select(F.bitwise_not("f").alias("key_"))
    found = marks.join(again, F.bitwise_not("f") == F.col("key_"), "left_semi")
    found = found.groupBy("id", "th", F.shiftright("place", 2 * _BITS).cast("int").alias("block")).agg(F.collect_set(F.col("place").bitwiseAND((1 << 2 * _BITS) - 1).cast("int")).alias("ranges"))
    ranges = F.transform("ranges", lambda x: F.struct(F.shiftright(x, _BITS).alias("a"), _low(x).alias("p")))
    return found.select("id", "th", "block", ranges.alias("ranges"))


def _placed(found: DataFrame) -> DataFrame:
    """The blocks in the order of id, th and block, with their partition and place in it."""
    key = [F.col("id").asc_nulls_first(), F.col("th"), F.col("block")]
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << _INDEX_BITS) - 1))
    dealt = found.repartitionByRange(*key).sortWithinPartitions(*key)
    return dealt.withColumn("part", F.spark_partition_id()).withColumn("place", place)


def _numbered(placed: DataFrame) -> DataFrame:
    """The blocks with uid, their rank by id, th and block, and with the uid of the block before it in its text.

    Ranks are places shifted by the rows of the partitions before, so they fit beside a window's place for any number of partitions.
    """
    counts = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("least"))
    shift = F.sum("n").over(Window.orderBy("part")) - F.col("n") - F.col("least")  # a row for each partition
    counts = counts.select(F.col("part").alias("part_"), shift.alias("shift"))
    out = placed.join(F.broadcast(counts), F.col("part") == F.col("part_")).withColumn("uid", F.col("place") + F.col("shift"))
    text = Window.partitionBy("id", "th").orderBy("block")
    out = out.withColumn("before", F.when(F.lag("block").over(text) == F.col("block") - 1, F.lag("uid").over(text)))
    return out.drop("part", "part_", "place", "shift")


def _windows(texts: DataFrame, found: DataFrame, run_words: int, ahead: int) -> DataFrame:
    """ord (uid and place) and the content hashes k1 (64 bits) and k2 (32 bits) of the windows of these marks; texts have id, th and text."""
    by_text = found.groupBy("id", "th").agg(F.collect_list(F.struct("block", "uid", "ranges")).alias("blocks"))
    by_text = by_text.select(F.col("id").alias("id_"), F.col("th").alias("th_"), "blocks")
    rows = texts.join(by_text, texts["id"].eqNullSafe(by_text["id_"]) & (texts["th"] == by_text["th_"])).select("text", "blocks")
    cut = lambda h: F.transform(
        "blocks", lambda b: F.struct(b["uid"].alias("uid"), b["ranges"].alias("ranges"), _part(h, b["block"] * WORDS, WORDS + run_words - 1).alias("h"))
    )
    rows = rows.select(F.inline(_once(_hashes(F.col("text")), cut))).select("uid", "h", F.explode("ranges").alias("r"))
    rows = rows.select("uid", "h", "r", F.explode(F.sequence("r.a", F.least(F.col("r.p"), F.size("h") - run_words))).alias("i"))
    h, i, start, least = F.col("h"), F.col("i"), F.col("r.a"), F.get("h", F.col("r.p"))
    # The minimum of the mark's first window is that of a later one if no word that came since is less.
    rows = rows.where((i == start) | ((F.get(h, i + (ahead - 1)) >= least) & (F.array_min(_part(h, start + ahead, i - start)) >= least)))
    window = _part(h, i, run_words)
    return rows.select(F.shiftleft("uid", _BITS).bitwiseOR(i.cast("long")).alias("ord"), F.xxhash64(window).alias("k1"), F.hash(window).alias("k2"))


def _later(windows: DataFrame, found: DataFrame, run_words: int) -> DataFrame:
    """id, th and gone: the places, in order, of the words in windows that occur earlier."""
    first = windows.groupBy("k1", "k2").agg(F.min("ord").alias("first"), F.max("ord").alias("last")).where("first < last")
    first = first.select(F.bitwise_not("k1").alias("key_"), F.col("k2").alias("k2_"), "first")
    same = (F.bitwise_not("k1") == F.col("key_")) & (F.col("k2") == F.col("k2_"))
    later = windows.join(first, same & (F.col("ord") > F.col("first")))
    # A first occurrence that overlaps lies in the same block, or in the block before, which may be another text's.
    there, u, gap = F.shiftrightunsigned("first", _BITS), F.shiftrightunsigned("ord", _BITS), _low(F.col("ord")) - _low(F.col("first"))
    over = (there == u - 1) & (gap + WORDS < run_words)
    later = later.where((there != u) | (gap >= run_words))
    later = later.groupBy(u.alias("u")).agg(F.collect_set(F.shiftleft(_low(F.col("ord")), 1).bitwiseOR(over.cast("int"))).alias("at"))
    later = later.join(found.select("uid", "before", "id", "th", "block"), F.col("u") == F.col("uid"))
    apart = F.filter("at", lambda x: F.col("before").isNull() | (x.bitwiseAND(1) == 0))
    later = later.select("id", "th", F.transform(apart, lambda x: F.col("block") * WORDS + F.shiftright(x, 1)).alias("at")).where("size(at) > 0")
    later = later.groupBy("id", "th").agg(F.sort_array(F.flatten(F.collect_list("at"))).alias("at"))
    until = lambda a, i: F.least(F.coalesce(F.get("at", i + 1) - 1, a + run_words - 1), a + run_words - 1)
    return later.select("id", "th", F.flatten(F.transform("at", lambda a, i: F.sequence(a, until(a, i)))).alias("gone"))


def _rest(text: Column, gone: Column) -> Column:
    """The text without the words at these places and the white space behind them."""

    def stay(pieces: Column) -> Column:
        left = F.array_except(F.sequence(F.lit(0), F.size(pieces) - 1), gone)
        return F.array_join(F.transform(left, lambda i: F.get(pieces, i)), "")

    head = F.regexp_extract(text, f"^[{_SPACE}]*", 0)
    return F.concat(head, _once(F.regexp_extract_all(text, F.lit(f"[{_WORD}]++[{_SPACE}]*+"), F.lit(0)), stay))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, run_words: int = MIN_WORDS, count_col: str = "__lines_gone") -> DataFrame:
    """The documents without later repeated runs, with one more column: ``count_col``, the number of runs that went."""
    gram = min(GRAM, run_words)
    columns = [c for c in docs.columns if c != count_col]
    both = F.xxhash64(text_col).alias("th"), F.when(F.col(text_col).isNotNull(), F.xxhash64(F.lit(1), text_col)).alias("tk")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.struct(*[F.col(c) for c in columns if c != text_col]).alias("rest"), *both)
    equal = keep(first_of_equal(rows.select("id", "text", "th", "tk")), "line-equal")
    keys = F.broadcast(equal) if equal.count() <= BROADCAST_TEXTS else equal
    first = F.when(~F.col("null_first"), F.col("first"))
    rows = rows.join(keys, (rows["th"] == keys["th_"]) & (rows["tk"] == keys["tk_"]), "left")
    rows = rows.select("id", "th", "text", "rest", (F.col("tk_").isNotNull() & ~F.col("id").eqNullSafe(first)).alias("copy"))
    fresh = rows.where(~F.col("copy"))

    marks = keep(_marked(fresh, run_words, gram), "line-marks")
    found = keep(_repeated(marks), "line-found")
    drop(marks)
    placed = keep(_placed(found), "line-placed")
    drop(found)
    blocks = keep(_numbered(placed), "line-blocks")
    drop(placed)
    texts = keep(blocks.select(F.col("id").alias("id_"), F.col("th").alias("th_")).distinct(), "line-texts")
    keys = F.broadcast(texts) if texts.count() <= BROADCAST_TEXTS else texts
    on = lambda a, b: a["id"].eqNullSafe(b["id_"]) & (a["th"] == b["th_"])
    touched = fresh.join(keys, on(fresh, keys), "left_semi").select("id", "th", "text")
    windows = keep(_windows(touched, blocks, run_words, run_words - gram + 1), "line-windows")
    later = keep(_later(windows, blocks, run_words), "line-later")
    drop(windows, blocks, texts)

    # Only texts that lose something are joined with what they lose; the others pass by.
    later = later.select(F.col("id").alias("id_"), F.col("th").alias("th_"), "gone")
    keys = later.select("id_", "th_")
    keys = F.broadcast(keys) if keys.count() <= BROADCAST_TEXTS else keys
    touched, others = fresh.join(keys, on(fresh, keys), "left_semi"), rows.join(keys, on(rows, keys) & ~rows["copy"], "left_anti")
    touched = touched.join(later, on(touched, later)).select("text", "rest", "gone")
    runs = F.size(F.filter("gone", lambda g, i: (i == 0) | (F.get("gone", i - 1) != g - 1)))
    touched = touched.select("rest", _rest(F.col("text"), F.col("gone")).alias("text"), runs.alias("runs"))
    whole = F.when(F.col("copy"), F.size(bare_words(F.col("text"))) >= run_words).otherwise(False)
    bare = F.regexp_extract("text", f"^[{_SPACE}]*", 0)
    others = others.select("rest", F.when(whole, bare).otherwise(F.col("text")).alias("text"), F.when(whole, 1).otherwise(0).alias("runs"))
    out = others.unionByName(touched)
    return out.select(*[F.col("text").alias(c) if c == text_col else F.col("rest")[c].alias(c) for c in columns], F.col("runs").alias(count_col))
