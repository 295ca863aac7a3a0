"""The training-data queries that SQL can express, against their SQL on the smallest tables."""

import duckdb
import pytest

pytest.importorskip("public_tokenizers")

from provenant.llm.queries import ORACLE_SQL, QUERIES  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want, got = con.sql(ORACLE_SQL[name]), QUERIES[name](spark, SF)
    assert sorted(want.columns) == sorted(got.columns)
    assert sorted(map(str, want.select(*sorted(want.columns)).fetchall())) == sorted(str(tuple(r)) for r in got.select(*sorted(got.columns)).collect())
