"""Every registered terrain query against its SQL in DuckDB, or for rows where SQL can't express it."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from cragline.plans.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, (list, np.ndarray)):
        return tuple(map(plain, v))
    if v is None or pd.isna(v):
        return "null"
    return round(float(v), 9) if isinstance(v, (int, float, np.number)) and not isinstance(v, (bool, np.bool_)) else str(v)


def rows(frame):
    frame = frame[sorted(frame)]
    return sorted((tuple(map(plain, x)) for x in frame.itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name in ORACLES:
        want = duck.sql(ORACLES[name]).df()
        assert sorted(got) == sorted(want)
        assert rows(got) == rows(want)
    else:
        assert len(got) > 0
