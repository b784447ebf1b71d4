import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

D = "/root/testdata/sf0.001"
CORE = __import__("keylog.queries", fromlist=["QUERIES"])


def plain(x):
    if isinstance(x, float):
        return round(x, 9)
    return float(x) if isinstance(x, int) and not isinstance(x, bool) else float(x) if type(x).__name__ == "Decimal" else x


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{D}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", list(CORE.QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = CORE.QUERIES[name](spark, D)
    cols = sorted(df.columns)
    rel = duck.sql(CORE.ORACLE_SQL[name])
    assert sorted(rel.columns) == cols
    got = sorted((tuple(map(plain, r)) for r in df.select(*cols).collect()), key=repr)
    want = sorted((tuple(map(plain, r)) for r in rel.select(", ".join(f'"{c}"' for c in cols)).fetchall()), key=repr)
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).count() == 10
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_counts_of_the_fixture(spark):
    for sf, keys, live in (("0.001", 15, 10), ("0.01", 150, 120)):
        assert CORE.QUERIES["kv_put_latest"](spark, f"/root/testdata/sf{sf}").count() == keys
        assert CORE.QUERIES["kv_live"](spark, f"/root/testdata/sf{sf}").count() == live
