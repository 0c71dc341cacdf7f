"""Every query runs on the smallest tables, and equals its SQL where it has one."""

import glob
import math
import os

import pytest

import __spark_entry__ as entry
from symloom.plans import registry

duckdb = pytest.importorskip("duckdb")
ORACLE, QUERIES = registry.oracle_sql(), registry.queries()


@pytest.fixture(scope="module")
def sql(data):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in glob.glob(f"{data}/*.parquet"):
        con.execute(f"CREATE VIEW \"{os.path.basename(p)[:-8]}\" AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if hasattr(v, "isoformat"):
        return v.isoformat()[:26].replace("+00:00", "")
    return v if v is None or isinstance(v, (int, bool, str)) else str(v)


def test_names_agree():
    assert set(ORACLE) <= set(QUERIES)
    assert set(QUERIES) <= set(entry.queries())


def test_entry(spark, data):
    df = entry.entry(spark)
    assert df.columns == ["service", "caller", "foreign_service", "symbol"] and df.count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, sql, name):
    df = QUERIES[name](spark, data)
    columns = sorted(df.columns)
    got = sorted(([plain(r[c]) for c in columns] for r in df.collect()), key=str)
    if name not in ORACLE:
        return
    cursor = sql.execute(ORACLE[name])
    have = [d[0] for d in cursor.description]
    assert sorted(have) == columns
    at = [have.index(c) for c in columns]
    want = sorted(([plain(r[i]) for i in at] for r in cursor.fetchall()), key=str)
    assert got == want
