"""Every registered query of the engine against its independent DuckDB twin."""

import duckdb
import pytest

from palimpsest.plans import catalog

DIR = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations events".split()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


def norm(v):
    if v is None or v != v:
        return "null"
    return str(int(v)) if isinstance(v, float) and v == int(v) else str(v)


@pytest.mark.parametrize("name", list(catalog.ORACLES))
def test_matches_twin(spark, con, name):
    df = catalog.QUERIES[name](spark, DIR)
    found = con.execute(catalog.ORACLES[name])
    columns = sorted(c[0] for c in found.description)
    assert columns == sorted(df.columns)
    at = {c[0]: i for i, c in enumerate(found.description)}
    want = sorted(tuple(norm(r[at[c]]) for c in columns) for r in found.fetchall())
    assert sorted(tuple(norm(r[c]) for c in columns) for r in df.collect()) == want


def test_flagship_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 5
    assert set(catalog.ORACLES) <= set(__spark_entry__.queries())
