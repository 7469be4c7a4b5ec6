"""Packed result words and k-grams."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bits of a packed word that hold the offset, and of its upper half that hold the state.
OFFSET_BITS, STATE_BITS = 32, 22


def pack(group: Column, state: Column, offset: Column) -> Column:
    """((group << 22 | state) << 32) | offset."""
    upper = F.shiftleft(group.cast("long"), STATE_BITS).bitwiseOR(state.cast("long"))
    return F.shiftleft(upper, OFFSET_BITS).bitwiseOR(offset.cast("long"))


def unpack(word: Column) -> dict[str, Column]:
    """Columns group_id, state_id and offset of a packed word."""
    upper = F.shiftrightunsigned(word, OFFSET_BITS)
    return {
        "group_id": F.shiftright(upper, STATE_BITS).cast("int"),
        "state_id": upper.bitwiseAND((1 << STATE_BITS) - 1).cast("int"),
        "offset": word.bitwiseAND((1 << OFFSET_BITS) - 1),
    }


def byte_at(payload: Column, position: Column) -> Column:
    """The byte at a position from 0; null outside."""
    return F.conv(F.hex(F.substring(payload, position.cast("int") + 1, F.lit(1))), 16, 10).cast("int")


def gram(payload: Column, position: Column, k: int) -> Column:
    """The k bytes from a position on as a big-endian number; null where fewer are left."""
    bytes_ = [byte_at(payload, position + j) for j in range(k)]
    return reduce(lambda high, low: high * 256 + low, bytes_)


def gram_value(data: bytes) -> int:
    return int.from_bytes(data, "big")
