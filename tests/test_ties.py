"""Queries at rows where the last bits or the order of equal times decide."""

import duckdb
import pytest

import parasol.queries as core
from tests.test_oracles import plain

CORNERS = [18578, 123057]  # events whose nearest corner ends several sidewalks, at distances that differ by less than a nanometre


@pytest.mark.parametrize("name", ["attach_fixes", "followed_streets"])
def test_nearest_at_corners(spark, tmp_path, name):
    con = duckdb.connect()
    con.sql(f"copy (select unnest({CORNERS}::bigint[]) as event_id, 1::bigint as user_id, timestamp '2024-01-01' as ts, 'view' as event_type, 1.0::double as value) to '{tmp_path}/events.parquet' (format parquet)")
    con.sql(f"create view events as select * from '{tmp_path}/events.parquet'")
    assert plain(core.QUERIES[name](spark, str(tmp_path)).toPandas()) == plain(con.sql(core.ORACLES[name]).df())


def test_headings_of_one_time_go_by_event(spark, tmp_path):
    con = duckdb.connect()
    for name, order in (("up", ""), ("down", "desc")):
        (tmp_path / name).mkdir()
        con.sql(f"copy (select range as event_id, 1::bigint as user_id, timestamp '2024-01-01' as ts, 'view' as event_type, 1.0::double as value from range(60) order by range {order}) to '{tmp_path}/{name}/events.parquet' (format parquet)")
    up, down = (plain(core.compass_headings(spark, f"{tmp_path}/{name}").toPandas()) for name in ("up", "down"))
    assert up == down
