"""Every query with SQL gives DuckDB's result on the smallest tables; the others run."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from sparkwright.plans import catalogue

QUERIES, ORACLES = catalogue()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def normal(frame: pd.DataFrame) -> pd.DataFrame:
    def value(v):
        if v is None or v is pd.NaT or isinstance(v, float) and v != v:
            return "null"
        if isinstance(v, bool) or type(v).__name__ == "bool":
            return str(bool(v))
        try:
            return f"{float(v):.9g}"
        except (TypeError, ValueError):
            return str(v)

    out = frame[sorted(frame.columns)].copy()
    for c in out:
        out[c] = out[c].map(value)
    return out.sort_values(list(out.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    ours = QUERIES[name](spark, sf).toPandas()
    if name in ORACLES:
        pd.testing.assert_frame_equal(normal(ours), normal(duck.sql(ORACLES[name]).df()))


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
