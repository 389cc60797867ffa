"""Queries whose SQL covers a part, against the same SQL without its filters."""

import duckdb
import pytest

import parasol.queries as core
from tests.test_oracles import TABLES, plain

FILTERS = {
    "passage_steps": [(" WHERE i % 10 = 0 AND i < 1000", "")],
    "all_costs": [("range(0, 144, 4)", "range(0, 144)")],
    "attach_fixes": [(" WHERE s.i < 1000", "")],
    "followed_streets": [(" WHERE i < 1000", "")],
    "facing_sides": [(" AND i < 1000", "")],
    "shade_bands": [(" AND i < 1000", "")],
}


@pytest.mark.parametrize("name", sorted(FILTERS))
def test_whole(spark, sf, name):
    sql = core.ORACLES[name]
    for part, whole in FILTERS[name]:
        sql = sql.replace(part, whole)
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    got = core.QUERIES[name](spark, sf).toPandas()
    assert plain(got) == plain(con.sql(sql).df())
