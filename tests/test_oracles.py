"""Every query with SQL gives the rows that DuckDB gives on the same tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
ORACLES = {k: v for k, v in entry.oracle_sql().items() if not k.startswith("op") and k != "pipeline"}


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def plain(rows, names):
    at = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(([r[i] for i in at] for r in rows), key=lambda r: [(x is None, round(x, 3) if isinstance(x, float) else str(x)) for x in r])


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, db, name):
    got = entry.queries()[name](spark, SF)
    want = db.execute(ORACLES[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    a, b = plain(map(tuple, got.collect()), got.columns), plain(want.fetchall(), names)
    assert len(a) == len(b) > 0
    for x, y in zip(a, b, strict=True):
        for u, v in zip(x, y, strict=True):
            assert u == v or isinstance(u, (int, float)) and isinstance(v, (int, float)) and (math.isclose(u, v, rel_tol=1e-9, abs_tol=1e-9)), (x, y)
