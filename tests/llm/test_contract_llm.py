"""The queries that SQL can express against their SQL."""

import os

import duckdb
import pytest

from segspan.llm import queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    rows = lambda df: sorted(tuple(repr(round(float(v), 6)) if hasattr(v, "dtype") or isinstance(v, (int, float)) else str(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))
    assert rows(queries.queries()[name](spark, SF).toPandas()) == rows(con.sql(queries.oracle_sql()[name]).df())
