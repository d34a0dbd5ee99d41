"""The registered queries against their SQL."""

import duckdb
import pytest

from loomdoc.llm import registry

SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, sf, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    a, b = registry.queries()[name](spark, sf).toPandas(), con.sql(SQL[name]).df()
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    a, b = (x[cols].astype({c: str for c in cols}).sort_values(cols).reset_index(drop=True) for x in (a, b))
    assert a.equals(b)
