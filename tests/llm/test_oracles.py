from __future__ import annotations

import os

import duckdb
import pytest

from stratalog.llm import queries

SF = "/root/testdata/sf0.01"


def plain(v):
    return f"{v:.9g}" if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.execute(f"create view {t.removesuffix('.parquet')} as select * from '{SF}/{t}'")
    df = queries.queries()[name](spark, SF)
    order = sorted(df.columns)
    got = [tuple(map(plain, r)) for r in df.select(*order).collect()]
    result = con.execute(queries.oracle_sql()[name])
    at = [[c[0] for c in result.description].index(c) for c in order]
    assert sorted(map(repr, got)) == sorted(repr(tuple(plain(r[i]) for i in at)) for r in result.fetchall())
