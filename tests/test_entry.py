"""Driver contract: entry, query keys, oracle agreement at sf0.001."""

import duckdb
import pytest

import __spark_entry__ as entry
from costmart.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]


def test_entry_runs(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns[0] == "jenis_jaminan"


def test_oracle_keys_subset_of_queries():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q)
    assert set(catalog.QUERIES) <= set(q)
    assert set(catalog.QUERIES) - set(o) <= {"forest_predict"}
    assert len(catalog.QUERIES) >= 54


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def _norm(rows):
    return sorted((tuple(repr(v) for v in r) for r in rows))


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_matches_oracle(spark, con, name):
    sdf = entry.queries()[name](spark, SF)
    res = con.execute(entry.oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    assert sorted(sdf.columns) == sorted(dcols)
    order = [dcols.index(c) for c in sdf.columns]
    srows = [tuple(r) for r in sdf.collect()]
    assert _norm(srows) == _norm([tuple(r[i] for i in order) for r in drows])
