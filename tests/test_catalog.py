"""Every query against its SQL, and twice with other partitions."""

import glob
import os

import duckdb
import pytest

from sparrowgram.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def plain(v):
    if v is None or isinstance(v, str | bool):
        return v
    if hasattr(v, "__iter__"):
        return [plain(x) for x in v]
    return round(float(v), 5)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, tables, name):
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in cols]) for r in df.collect())
    if name in catalog.ORACLE_SQL:
        x = tables.execute(catalog.ORACLE_SQL[name])
        names = [d[0] for d in x.description]
        assert sorted(names) == cols
        assert got == sorted(repr([plain(r[names.index(c)]) for c in cols]) for r in x.fetchall())
    else:
        raise AssertionError(f"{name} has no SQL")
