"""Every registered query runs, and agrees with its SQL where it has some."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from waymeet.plans.queries import QUERIES, SQL


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations").split():
        c.sql(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return c


#: Queries without SQL that these tables may leave without rows, and the test that holds each against a scene.
SCENES = {"maneuver_classify": "test_whole.py::test_manoeuvres_come_from_all_tracks"}


def plain(v):
    if v is None or v is pd.NA or v is pd.NaT or (not isinstance(v, (list, np.ndarray)) and v != v):
        return ""
    if isinstance(v, (bool, np.bool_)):
        return str(bool(v))
    return f"{float(v) + 0.0:.6g}" if isinstance(v, (int, float, np.number)) else str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, con, name):
    got = QUERIES[name](spark, sf).toPandas()
    if name not in SQL:
        assert len(got.columns) and (len(got) or name in SCENES)
        return
    want = con.sql(SQL[name]).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    rows = lambda df: sorted(tuple(map(plain, r)) for r in df[cols].itertuples(index=False))
    assert rows(got) == rows(want)
