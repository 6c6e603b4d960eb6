"""Every query with an SQL oracle gives the oracle's rows."""

import duckdb
import pytest

import __spark_entry__ as entry_module

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _same(a, b):
    if isinstance(a, float) or isinstance(b, float):
        return a is not None and b is not None and abs(a - b) <= 1e-6 * max(1.0, abs(a), abs(b))
    return a == b


@pytest.mark.parametrize("name", sorted(entry_module.oracle_sql()))
def test_matches_sql(spark, duck, sf_dir, name):
    df = entry_module.queries()[name](spark, sf_dir)
    cursor = duck.execute(entry_module.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    columns = sorted(names)
    want = [tuple(row[names.index(c)] for c in columns) for row in cursor.fetchall()]
    got = [tuple(row) for row in df.select(*[f"`{c}`" for c in columns]).collect()]
    key = lambda row: tuple(("" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)) for v in row)
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert all(_same(x, y) for x, y in zip(a, b)), (a, b)


def test_entry(spark):
    df = entry_module.entry(spark)
    assert df.count() == 10 and "impact_score" in df.columns


def test_oracles_have_queries():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
