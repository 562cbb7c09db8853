"""Every query that has SQL gives the same rows as DuckDB on the same tables."""

import math

import duckdb
import pytest

from tidemark.plans import registered

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 5)
    return str(x) if not isinstance(x, (int, bool, type(None), str)) else x


@pytest.mark.parametrize("name", sorted(registered.ORACLE_SQL))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    found = registered.QUERIES[name](spark, FOLDER)
    want = con.execute(registered.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(found.columns) == sorted(columns)
    order = sorted(columns)
    key = lambda r: tuple((x is None, str(x)) for x in r)
    got = sorted((tuple(plain(r[c]) for c in order) for r in found.collect()), key=key)
    ref = sorted((tuple(plain(r[columns.index(c)]) for c in order) for r in want.fetchall()), key=key)
    assert got == ref
