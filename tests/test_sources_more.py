"""Sources without a query: database tables, file lists, rays on the ground, pixels and angles."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymeet.functions import kinematics
from waymeet.sources import calibration, tables


def test_records_of_a_database(spark):
    url = "jdbc:derby:memory:waymeet;create=true"
    rows = [(1, 1, i, f"/r{i}", "2025-01-01") for i in range(6)]
    ddl = "idMeasurementSeries int, idSensor int, idRecord long, path string, start_ts string"
    try:
        spark.createDataFrame(rows, ddl).write.format("jdbc").options(url=url, dbtable="records", driver="org.apache.derby.iapi.jdbc.AutoloadedDriver").mode("overwrite").save()
    except Exception as e:  # noqa: BLE001
        if "ClassNotFound" in str(e):
            pytest.skip("no database driver is on the class path")
        raise
    key = spark.createDataFrame([(1, 1, 2), (1, 1, 4), (2, 1, 2)], "idMeasurementSeries int, idSensor int, idRecord long")
    got = tables.database_records(spark, url, "records", key, driver="org.apache.derby.iapi.jdbc.AutoloadedDriver")
    assert sorted((r["idRecord"], r["path"]) for r in got.collect()) == [(2, "/r2"), (4, "/r4")]


@pytest.mark.parametrize(("n", "share", "most"), [(54, 5, 10), (3, 5, 1), (1, 5, 1), (0, 5, 0), (20, 2, 10)])
def test_files_are_split_by_rank(spark, n, share, most):
    files = spark.createDataFrame([(f"/f/{i}",) for i in range(n)] + [(None,)], "path string").repartition(3)
    got = [{r["path"] for r in tables.split_files(files.repartition(k), share).filter("validation").collect()} for k in (1, 4)]
    assert got[0] == got[1] and len(got[0]) == most and None not in got[0]
    assert tables.split_files(files, share).count() == n + 1


def test_repeated_paths_are_on_one_side(spark):
    files = spark.createDataFrame([(f"/f/{i % 10}",) for i in range(100)], "path string")
    sides = tables.split_files(files, 5).groupBy("path").agg(F.count_distinct("validation").alias("sides"), F.first("validation").alias("v")).collect()
    assert all(r["sides"] == 1 for r in sides) and sum(r["v"] for r in sides) == 2


def test_rays_meet_the_ground(spark):
    rng = np.random.default_rng(3)
    normal, through = np.array([0.1, -0.2, 1.0]), np.array([1.0, 2.0, 3.0])
    rays = [tuple(map(float, rng.normal(size=6))) for _ in range(50)] + [(0.0, 0.0, 5.0, 2.0, 1.0, 0.0)]
    got = calibration.to_ground(spark.createDataFrame(rays, "ox double, oy double, oz double, rx double, ry double, rz double"), tuple(normal), tuple(through)).collect()
    for row in got:
        o, r = np.array([row["ox"], row["oy"], row["oz"]]), np.array([row["rx"], row["ry"], row["rz"]])
        if abs(r @ normal) < 1e-12:
            assert row["gx"] is None
            continue
        hit = o + (through - o) @ normal / (r @ normal) * r
        assert [row["gx"], row["gy"], row["gz"]] == pytest.approx(hit.tolist(), abs=1e-6)


def test_pixels_are_located_and_normals_turned(spark):
    pixels = spark.createDataFrame([(1, 2, 0, 5.0, 6.0, 0.0), (1, 3, 1, 7.0, 8.0, 0.0)], "px long, py long, tri int, wx double, wy double, wz double")
    found = calibration.locate(spark.createDataFrame([(9, 1, 3), (8, 4, 4)], "det_id long, px long, py long"), pixels).collect()
    assert [(r["det_id"], r["wx"], r["wy"]) for r in found] == [(9, 7.0, 8.0)]
    n = np.array([[0.0, 0.6, -0.8], [0.0, 0.6, 0.8], [1.0, 0.0, 0.0]])
    assert calibration.upward(n).tolist() == [[0.0, -0.6, 0.8], [0.0, 0.6, 0.8], [1.0, 0.0, 0.0]]


def test_differences_of_angles_take_the_short_way(spark):
    angles = [0.0, 1.0, 3.5, -3.5, 6.3, 12.6, -9.5]
    got = spark.createDataFrame([(a,) for a in angles], "a double").select("a", kinematics.short_way(F.col("a")).alias("s")).collect()
    for r in got:
        assert abs(r["s"]) <= math.pi + 1e-9 and math.cos(r["s"] - r["a"]) == pytest.approx(1)
