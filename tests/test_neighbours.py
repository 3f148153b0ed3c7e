"""Nearest neighbours by cells of pivots against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymeet.operators import anomaly


def rows_of(groups, seed=1):
    rng, rows = np.random.default_rng(seed), []
    for grp, n, centres in groups:
        mean = rng.normal(size=(centres, 8)) * 3
        rows += [(grp, i, (mean[i % centres] + rng.normal(0, 0.15, 8)).tolist()) for i in range(n)]
    return rows


def all_pairs(rows, k):
    out = set()
    for grp in {r[0] for r in rows}:
        mine = [(i, np.array(v) / np.linalg.norm(v)) for g, i, v in rows if g == grp]
        u = np.array([v for _, v in mine])
        d = np.round(1 - u @ u.T, 12)
        for a, (i, _) in enumerate(mine):
            near = sorted((d[a, b], j) for b, (j, _) in enumerate(mine) if b != a)[:k]
            out |= {(grp, i, j, rank + 1) for rank, (_, j) in enumerate(near)}
    return out


@pytest.mark.parametrize("block", [1024, 40])
def test_neighbours_equal_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(anomaly, "BLOCK_ROWS", block)
    monkeypatch.setattr(anomaly, "ONE_CELL", 64)
    rows = rows_of([("a", 500, 10), ("b", 40, 3), ("c", 90, 90), ("d", 1, 1)]) + [("same", i, [1.0] * 8) for i in range(100)]
    df = spark.createDataFrame(rows, "grp string, id int, embedding array<double>").repartition(3)
    got = {(r["grp"], r["id"], r["other"], r["rank"]) for r in anomaly.knn(df, 7).collect()}
    assert got == all_pairs(rows, 7)


def test_few_pairs_are_compared_where_vectors_cluster(spark, monkeypatch):
    monkeypatch.setattr(anomaly, "BLOCK_ROWS", 64)
    monkeypatch.setattr(anomaly, "ONE_CELL", 64)
    rows = rows_of([("a", 3000, 50)])
    df = spark.createDataFrame(rows, "grp string, id int, embedding array<double>")
    pairs = anomaly._compared(df, 10).agg(F.sum("n_pairs")).first()[0]
    assert 3000 * 10 < pairs < 3000 * 3000 / 8


def test_vectors_that_are_none_take_no_part(spark):
    rows = [("a", 1, [0.0, 0.0]), ("a", 2, [1.0, None]), ("a", 3, [float("nan"), 1.0]), ("a", 4, None), ("a", 5, []), ("a", 6, [1.0, 0.0]), ("a", 7, [0.0, 2.0])]
    got = anomaly.knn(spark.createDataFrame(rows, "grp string, id int, embedding array<double>"), 3).collect()
    assert {(r["id"], r["other"], r["d"]) for r in got} == {(6, 7, 1.0), (7, 6, 1.0)}
    assert anomaly.knn(spark.createDataFrame([], "grp string, id int, embedding array<double>"), 3).collect() == []


def test_chunks_equal_all_pairs_and_leave_few_rows(spark, monkeypatch):
    monkeypatch.setattr(anomaly, "ONE_CELL", 64)
    monkeypatch.setattr(anomaly, "CHUNK_ROWS", 150)
    rows = rows_of([("a", 500, 500), ("b", 400, 2)])
    df = spark.createDataFrame(rows, "grp string, id int, embedding array<double>")
    got = {(r["grp"], r["id"], r["other"], r["rank"]) for r in anomaly.knn(df, 7).collect()}
    assert got == all_pairs(rows, 7)
    met = anomaly._compared(df, 7).groupBy("grp", "id").count().groupBy("grp").agg(F.max("count")).collect()
    assert all(n <= 7 * (1 + 4) for _, n in met)  # its own cell, then at most four chunks
