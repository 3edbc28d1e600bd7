import os

import duckdb
import pytest

from tidewater.llm import entry

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    got = entry.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    told = lambda rows: sorted(map(tuple, rows), key=lambda r: [(x is not None, x) for x in r])
    assert told(got.select(columns).collect()) == told(want.fetchall())
