"""Every query of the engine against its SQL, on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

from automill import oracles, oracles_surface, oracles_tables, queries, queries_surface, queries_tables
from conftest import SF

QUERIES = queries.QUERIES | queries_surface.QUERIES | queries_tables.QUERIES
ORACLES = oracles.ORACLES | oracles_surface.ORACLES | oracles_tables.ORACLES
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(cols, data):
    return sorted(tuple(str(v) for v in r) for r in data)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    want = duck.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in cols)} FROM ({ORACLES[name]})").fetchall()
    assert rows(cols, df.select(*cols).collect()) == rows(cols, want) != []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
