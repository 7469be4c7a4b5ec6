from __future__ import annotations

import pytest
from hypothesis import given, strategies as st
from pyspark.sql import functions as F

from automill.functions import symbolset as S
from automill.functions.words import gram, gram_value, pack, unpack

span = S.span

CASES = {
    "*": S.ALL,
    ".": S.ALL & ~(1 << 10),
    "": 0,
    "a": 1 << 97,
    "[a-c]": span(97, 99),
    "[^a-c]": S.ALL & ~span(97, 99),
    "a^": S.ALL & ~(1 << 97),  # inversion anywhere
    "[a-]": 1 << 97,  # an open range adds nothing
    "[-a]": 1 << 45 | 1 << 97,  # literal right after the bracket
    "[^-a]": S.ALL & ~(1 << 45 | 1 << 97),
    "[a\\-c]": 1 << 97 | 1 << 45 | 1 << 99,
    "-c": span(0, 99),  # no byte before: from 0
    "[z-a]": 1 << 122 | 1 << 97,  # backwards: the ends only
    "[a\\d-z]": span(97, 122) | span(48, 57),  # a class is no last byte
    "[a-\\dz]": span(97, 122) | span(48, 57),  # nor does it close a range
    "\\d": span(48, 57),
    "\\s": S.of([9, 10, 11, 12, 13, 32]),
    "\\w": span(48, 57) | span(65, 90) | span(97, 122) | 1 << 95,
    "\\S\\D\\W": S.of(b"SDW"),
    "\\n\\r\\t\\a\\b\\f\\v\\'\\\"": S.of([10, 13, 9, 7, 8, 12, 11, 39, 34]),
    "\\x41\\xfF": 1 << 0x41 | 1 << 0xFF,
    "[\\x41-\\x43]": span(0x41, 0x43),
    "\\\\": 1 << 92,
    "\\[\\]\\^": S.of(b"[]^"),
    "a{": S.of(b"a{"),
    "\\{n": 1 << ord("{") | 1 << 10,  # braces leave an escape pending
    "é": S.of("é".encode()),
    "[a]b[c]": S.of(b"abc"),
    "[a-[c]]": span(97, 99),
}


@pytest.mark.parametrize("text", CASES)
def test_parse(text):
    assert S.parse(text) == CASES[text]


@pytest.mark.parametrize("text", ["[a", "a]", "{1}", "[[a]"])
def test_malformed(text):
    with pytest.raises(S.SymbolClassError):
        S.parse(text)


@given(st.sets(st.integers(0, 255)))
def test_round_trips(values):
    x = S.of(values)
    assert S.from_ranges(S.ranges(x)) == x
    assert S.from_bytes(S.to_bytes(x)) == x
    assert S.cardinality(x) == len(values)
    if x:
        assert S.parse(S.to_class(x)) == x


def test_predicates():
    assert S.is_complete(span(3, 9)) and not S.is_complete(1 | 1 << 9)
    assert S.is_complement(S.ALL & ~span(3, 9)) and not S.is_complement(S.ALL)
    assert S.is_wildcard(S.ALL) and S.is_single(1 << 7)
    assert S.remap(S.of([1, 2, 3]), {1: 9, 2: 9}) == S.of([9, 3])
    assert S.replace_all("aXbXX", "X", "--") == "a--b----" and S.replace_all("ab", "", "x") == "ab"


def test_columns(spark):
    sets = [S.parse(c) for c in CASES] + [1 << b for b in (0, 7, 8, 255)]
    df = spark.createDataFrame([(i, bytearray(S.to_bytes(x))) for i, x in enumerate(sets)], "i int, symbol_set binary")
    assert {r.i: r.n for r in df.select("i", S.cardinality_column(F.col("symbol_set")).alias("n")).collect()} == {i: x.bit_count() for i, x in enumerate(sets)}
    bytes_ = S.explode_bytes(df)
    found: dict[int, int] = {}
    for r in bytes_.collect():
        found[r.i] = found.get(r.i, 0) | 1 << r.byte
    assert found == {i: x for i, x in enumerate(sets) if x}
    pairs = sorted((r.i, r.lo, r.hi) for r in S.ranges_of(bytes_, "i").collect())
    assert pairs == sorted((i, a, b) for i, x in enumerate(sets) for a, b in S.ranges(x))
    parsed = spark.createDataFrame([(c,) for c in CASES], "c string").select("c", S.parse_symbol_set("c").alias("s")).collect()
    assert all(S.from_bytes(bytes(r.s)) == CASES[r.c] for r in parsed)


def test_words(spark):
    row = spark.range(1).select(pack(F.lit(3), F.lit(5), F.lit(77)).alias("w"))
    assert row.first().w == ((3 << 22 | 5) << 32) | 77
    assert row.select(*[c.alias(n) for n, c in unpack(F.col("w")).items()]).first().asDict() == {"group_id": 3, "state_id": 5, "offset": 77}
    data = spark.createDataFrame([(bytearray(b"\x01\xff\x03"),)], "p binary")
    got = data.select(gram(F.col("p"), F.lit(0), 3).alias("a"), gram(F.col("p"), F.lit(1), 3).alias("b")).first()
    assert got.a == gram_value(b"\x01\xff\x03") and got.b is None
