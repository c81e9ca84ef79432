"""The driver contract: every query has a unique name, a runnable plan and, where there is one, a fitting oracle."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from fathomline.plans import registry

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for p in Path(FOLDER).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def test_contract(spark):
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and registry.FLAGSHIP in queries
    assert entry.entry(spark).count() > 0
    assert {"p3_found", "p5_found", "p6_found"} <= set(queries)


def normal(rows):
    return sorted(repr([round(x, 6) if isinstance(x, float) else x for x in r]) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_oracle(spark, tables, name):
    df = registry.QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    result = tables.execute(registry.ORACLE_SQL[name])
    got_columns = [d[0] for d in result.description]
    assert sorted(got_columns) == columns
    order = sorted(range(len(got_columns)), key=lambda i: got_columns[i])
    assert normal([row[c] for c in columns] for row in df.collect()) == normal([row[i] for i in order] for row in result.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_query_without_oracle_runs(spark, name):
    df = registry.QUERIES[name](spark, FOLDER)
    assert df.count() >= 0 and len(set(df.columns)) == len(df.columns)
