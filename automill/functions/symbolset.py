"""Symbol classes: parsing, and functions on sets of bytes.

A set of bytes is an ``int`` with bit b set for byte b on the driver, and 32 bytes, least significant
first, in columns of type BINARY.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

ALL = (1 << 256) - 1


class SymbolClassError(ValueError):
    """A symbol class that the grammar does not allow."""


def span(first: int, last: int) -> int:
    """The set of the bytes first..last; empty if first is greater."""
    return ((1 << (last + 1)) - 1) & ~((1 << first) - 1) if first <= last else 0


def of(values: Iterable[int]) -> int:
    out = 0
    for v in values:
        out |= 1 << v
    return out


# Fixed values of the grammar.
_CONTROL = {"n": 10, "r": 13, "t": 9, "a": 7, "b": 8, "f": 12, "v": 11, "'": 39, '"': 34}
_CLASSES = {
    "s": of([9, 10, 11, 12, 13, 32]),
    "d": span(48, 57),
    "w": span(48, 57) | span(65, 90) | span(97, 122) | 1 << 95,
}


def _tokens(data: bytes) -> Iterator[tuple[str, int]]:
    """('byte', b), ('class', set), ('dash', 0), ('open', 0), ('close', 0) or ('invert', 0)."""
    escaped, i = False, 0
    bare = {ord("["): "open", ord("]"): "close", ord("-"): "dash", ord("^"): "invert"}
    while i < len(data):
        b, i = data[i], i + 1
        if b in b"{}":  # always literal; a pending escape stays pending
            yield "byte", b
        elif not escaped:
            if b == ord("\\"):
                escaped = True
            else:
                yield bare.get(b, "byte"), b
        else:
            escaped, c = False, chr(b)
            if c == "x":
                digits = re.match(rb"[0-9a-fA-F]{0,2}", data[i : i + 2])[0]
                i += 2
                yield "byte", int(digits or b"0", 16)
            elif c in _CLASSES:
                yield "class", _CLASSES[c]
            else:
                yield "byte", _CONTROL.get(c, b)


def parse(text: str | None) -> int:
    """The set of a symbol class.

    ``*`` is everything, ``.`` everything but a newline. Brackets only have to balance; bytes outside
    them count as well. A bare ``^`` anywhere inverts the result. A bare ``-`` is literal right after
    ``[`` and otherwise opens a range from the last byte, which the next byte closes; classes such as
    ``\\d`` neither close a range nor are a last byte. A range that runs backwards adds its ends only.
    """
    if not text:
        return 0
    if text in ("*", "."):
        return ALL if text == "*" else ALL & ~(1 << 10)
    if text[0] == "{" and text[-1] == "}":
        raise SymbolClassError(f"a class in braces: {text!r}")
    found, depth, invert = 0, 0, False
    last, opened, start = 0, False, None  # last byte; whether '[' came after it; start of an open range
    for kind, value in _tokens(text.encode("utf-8", "surrogateescape")):
        if kind == "class":
            found |= value
        elif kind == "invert":
            invert = True
        elif kind == "close":
            depth -= 1
        elif kind == "open":
            depth, opened = depth + 1, True
        elif kind == "dash" and not opened:
            start = last
        else:
            value = ord("-") if kind == "dash" else value
            found |= 1 << value
            if start is not None:
                found |= span(start, value)
                start = None
            last, opened = value, False
    if depth:
        raise SymbolClassError(f"unbalanced brackets: {text!r}")
    return ALL & ~found if invert else found


def to_bytes(found: int) -> bytes:
    return found.to_bytes(32, "little")


def from_bytes(data: bytes) -> int:
    return int.from_bytes(data, "little")


def members(found: int) -> list[int]:
    return [b for b in range(256) if found >> b & 1]


def ranges(found: int) -> list[tuple[int, int]]:
    """Maximal half-open ranges."""
    out: list[tuple[int, int]] = []
    for b in members(found):
        if out and out[-1][1] == b:
            out[-1] = (out[-1][0], b + 1)
        else:
            out.append((b, b + 1))
    return out


def from_ranges(pairs: Iterable[tuple[int, int]]) -> int:
    out = 0
    for a, b in pairs:
        out |= span(a, b - 1)
    return out


def is_complete(found: int) -> bool:
    """One contiguous range."""
    return len(ranges(found)) == 1


def is_complement(found: int) -> bool:
    """All but one contiguous range."""
    return len(ranges(ALL & ~found)) == 1


def is_wildcard(found: int) -> bool:
    return found == ALL


def is_single(found: int) -> bool:
    return found.bit_count() == 1


def is_wildcard_column(sets: Column) -> Column:
    """Whether a set column has all bytes; null for null."""
    return cardinality_column(sets) == 256


def is_single_column(sets: Column) -> Column:
    """Whether a set column has one byte; null for null."""
    return cardinality_column(sets) == 1


def cardinality(found: int) -> int:
    return found.bit_count()


def remap(found: int, mapping: dict[int, int]) -> int:
    """Every byte replaced by its image; bytes without one stay."""
    return of(mapping.get(b, b) for b in members(found))


def to_class(found: int) -> str:
    """A class that ``parse`` reads as this set."""
    if found == ALL:
        return "*"
    body = "".join(f"\\x{a:02x}" if b == a + 1 else f"\\x{a:02x}-\\x{b - 1:02x}" for a, b in ranges(found))
    return f"[{body}]"


def replace_all(text: str, find: str, by: str) -> str:
    return text.replace(find, by) if find else text


@F.pandas_udf(BinaryType())
def parse_symbol_set(texts: pd.Series) -> pd.Series:
    """Column function of ``parse``; each distinct class is parsed once a batch."""
    known = {t: to_bytes(parse(t)) for t in texts.unique()}
    return texts.map(known)


# Columns of type BINARY(32), by built-in functions.


def lanes(sets: Column) -> list[Column]:
    """Four BIGINTs that have the bits of the set's four quarters, in some order: for counting them."""
    return [F.conv(F.hex(F.substring(sets, 8 * k + 1, 8)), 16, -10).cast("long") for k in range(4)]


def cardinality_column(sets: Column) -> Column:
    """Number of bytes in the set."""
    total = F.lit(0)
    for lane in lanes(sets):
        total = total + F.bit_count(lane)
    return total


def has_byte(sets: Column, byte: Column) -> Column:
    """Whether the set has the byte: one byte of the set is looked at."""
    at = F.conv(F.hex(F.substring(sets, F.floor(byte / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return at.bitwiseAND(F.pow(F.lit(2), F.pmod(byte, F.lit(8))).cast("int")) != 0


def explode_bytes(states: DataFrame, set_col: str = "symbol_set") -> DataFrame:
    """The states with one row per byte of their set, in column ``byte``: the relational form of match sets."""
    of_set = F.filter(F.sequence(F.lit(0), F.lit(255)), lambda b: has_byte(F.col(set_col), b))
    return states.withColumn("byte", F.explode(of_set)).drop(set_col)


def ranges_of(state_bytes: DataFrame, *keys: str) -> DataFrame:
    """Keys, lo and hi of the maximal half-open ranges of (keys, byte) rows: gaps and islands."""
    order = Window.partitionBy(*keys).orderBy("byte")
    island = state_bytes.select(*keys, "byte").distinct().withColumn("island", F.col("byte") - F.row_number().over(order))
    found = island.groupBy(*keys, "island").agg(F.min("byte").alias("lo"), (F.max("byte") + 1).alias("hi"))
    return found.drop("island")


def remap_bytes(state_bytes: DataFrame, mapping: DataFrame) -> DataFrame:
    """(…, byte) rows through a (byte, to_byte) table; bytes without a row stay."""
    to = mapping.select(F.col("byte").alias("from_byte"), "to_byte")
    out = state_bytes.join(F.broadcast(to.limit(256)), state_bytes["byte"] == to["from_byte"], "left")
    return out.withColumn("byte", F.coalesce("to_byte", "byte")).drop("from_byte", "to_byte").distinct()
