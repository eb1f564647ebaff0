"""The queries that SQL can express against their SQL."""

import duckdb
import pytest

from tidemark.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, name, sf):
    folder = f"/root/testdata/sf{sf}"
    con = duckdb.connect()
    for table in ("documents", "conversations"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    got, want = QUERIES[name](spark, folder), con.sql(ORACLE_SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    plain = lambda x: round(x, 9) if isinstance(x, float) else x
    theirs = sorted(repr(tuple(plain(r[want.columns.index(c)]) for c in columns)) for r in want.fetchall())
    assert sorted(repr(tuple(plain(r[c]) for c in columns)) for r in got.collect()) == theirs
