"""Chat formatting with a grammar round trip.

A conversation is rendered as ``### Role: text</turn>`` and a newline for each turn. A deterministic
parser of the same grammar reads the rendering back; turns that do not come back as they were, or whose role or
text holds one of the control strings ``### `` and ``</turn>`` wherever it stands, are escaped and rendered again,
until the turns read equal the source and marks stand only where turns begin and end. Escaping replaces ``\\``, ``<``, ``#`` and ``:`` by two-character codes and touches nothing else, so
it is undone exactly, and a turn in which none of them is left cannot conflict: the second round
always succeeds, which the query's ``exact`` column confirms.

The rendering of a conversation is one value, as is its digest, so its turns come together in one
row; rows meet only within their conversation.

Edge cases: null text or role counts as empty; null turns come first; equal turns are ordered by role
and text, repeated rows stay; a null conversation id is one conversation; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from automill.llm.text import filled

OPEN, COLON, CLOSE = "### ", ": ", "</turn>\n"
#: What a text must not hold unescaped, besides OPEN.
MARK = "</turn>"
#: The role whose texts are under the loss mask.
TARGET = "assistant"
#: Rounds of rendering, parsing and escaping.
ROUNDS = 2


def escape(text: Column) -> Column:
    """Reversibly remove every character that starts a control string."""
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    text = F.replace(text, F.lit("<"), F.lit("\\l"))
    text = F.replace(text, F.lit("#"), F.lit("\\h"))
    return F.replace(text, F.lit(":"), F.lit("\\c"))


def unescape(text: Column) -> Column:
    """Undo ``escape``. Between doubled backslashes every backslash starts a code."""

    def codes(part: Column) -> Column:
        for code, char in (("\\l", "<"), ("\\h", "#"), ("\\c", ":")):
            part = F.replace(part, F.lit(code), F.lit(char))
        return part

    return F.array_join(F.transform(F.split(text, r"\\\\", -1), codes), "\\")


def render(turns: Column) -> Column:
    """The text of an array of (role, text) as they are to stand there."""
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), t["role"], F.lit(COLON), t["text"], F.lit(CLOSE))), "")


def parse(formatted: Column) -> Column:
    """The turns of a rendering: role, text as it stands, and start of the text (code points, from 1).

    A turn ends at the first end mark; its role ends at the first colon and space.
    """
    parts = F.split(formatted, CLOSE, -1)
    parts = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))

    def turn(part: Column) -> Column:
        role = F.substring_index(F.substr(part, F.lit(len(OPEN) + 1)), COLON, 1)
        skip = F.length(role) + len(OPEN) + len(COLON)
        return F.struct(role.alias("role"), F.substr(part, skip + 1).alias("text"), skip.alias("skip"), F.length(part).alias("n"))

    return F.transform(parts, turn)


def _read(raw: Column) -> Column:
    return F.transform(raw, lambda t: F.struct(unescape(t["role"]).alias("role"), unescape(t["text"]).alias("text")))


def format_chats(
    rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """One row per conversation: id, source (array of role and text), formatted, parsed, exact and mask.

    ``mask`` has, for each target text, the index of its turn and the text's start (from 0) and length in
    code points of that rendered turn.
    """
    turn = F.struct(F.col(turn_col).alias("turn"), filled(role_col).alias("role"), filled(text_col).alias("text"))
    chats = rows.select(F.col(conv_col).alias("conv"), turn.alias("t")).groupBy("conv").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    chats = chats.select("conv", F.transform("ts", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("source"))
    chats = chats.withColumn("written", F.col("source"))
    for _ in range(ROUNDS):
        # A turn that alone, rendered and read, is not itself, or that holds a mark, conflicts with the grammar.
        def settled(t: Column, i: Column) -> Column:
            alone = _read(parse(render(F.array(t))))
            source = F.get("source", i)
            said = F.concat(t["role"], F.lit("\n"), t["text"])
            marked = F.contains(said, F.lit(OPEN)) | F.contains(said, F.lit(MARK))
            fine = (F.size(alone) == 1) & F.get(alone, F.lit(0)).eqNullSafe(source) & ~marked
            escaped = F.struct(escape(source["role"]).alias("role"), escape(source["text"]).alias("text"))
            return F.when(F.coalesce(fine, F.lit(False)), t).otherwise(escaped)

        chats = chats.withColumn("written", F.transform("written", settled))
    chats = chats.withColumn("formatted", render(F.col("written"))).withColumn("raw", parse(F.col("formatted")))
    chats = chats.withColumn("parsed", _read(F.col("raw")))
    chats = chats.withColumn("exact", F.col("parsed").eqNullSafe(F.col("source")))
    return chats.withColumn("mask", _mask(F.col("raw"))).select(F.col("conv").alias(conv_col), "source", "formatted", "parsed", "exact", "mask")


def _mask(raw: Column) -> Column:
    """Spans of the target role's texts."""
    spans = F.transform(
        raw,
        lambda t, i: F.when(
            unescape(t["role"]) == TARGET, F.struct(i.cast("int").alias("turn"), t["skip"].alias("start"), (t["n"] - t["skip"]).alias("length"))
        ),
    )
    return F.filter(spans, lambda x: x.isNotNull())


def masked_text(formatted: Column, mask: Column) -> Column:
    """What the mask covers, unescaped, nothing between."""
    turns = F.split(formatted, CLOSE, -1)
    return F.array_join(F.transform(mask, lambda m: unescape(F.substr(F.get(turns, m["turn"]), m["start"] + 1, m["length"]))), "")
