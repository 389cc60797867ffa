"""Every query that has SQL gives the same rows as DuckDB does."""

import duckdb
import pandas as pd
import pytest

import parasol.queries as core

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(d: pd.DataFrame) -> list[tuple]:
    def cell(v):
        if v is None or v is pd.NA or v != v:
            return ""
        return f"{float(v) + 0.0:.6g}" if isinstance(v, (int, float)) or hasattr(v, "dtype") and v.dtype.kind in "iuf" else str(v)

    return sorted(tuple(cell(v) for v in r) for r in d[sorted(d.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(core.ORACLES))
def test_same_rows(spark, sf, name):
    got = core.QUERIES[name](spark, sf).toPandas()
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    want = con.sql(core.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)
