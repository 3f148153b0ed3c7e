"""Paths with bad points, long gaps and steps of all lengths: pet2d finds what it finds without them, and all crossings."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymeet.operators import interactions
from waymeet.plans import views

HOUR = 3_600_000_000
BAD = {
    "far": ("x", 1, 1e12),
    "farther": ("x", 1, 1e300),
    "early": ("us", 0, 0),
    "late": ("us", 10**9, 9_000_000_000_000_000),
    "nan": ("y", 1, float("nan")),
    "infinite": ("x", 1, float("-inf")),
}


@pytest.fixture(scope="module")
def paths(spark, sf):
    return views.points(spark, sf, "yyyyMMdd")


@pytest.fixture(scope="module")
def found(paths):
    return {str(r) for r in interactions.pet2d(paths, threshold_s=3600, slot_us=HOUR, cell=10.0).collect()}


@pytest.mark.parametrize("name", BAD)
def test_one_bad_point_changes_only_its_vehicle(paths, found, name):
    column, at, value = BAD[name]
    hit = (F.col("id_vehicle") == 3) & (F.col("ord") == at if at < 10**9 else F.lead("ord").over(interactions.along()).isNull())
    bad = paths.withColumn(column, F.when(hit, F.lit(value)).otherwise(F.col(column)))
    got = {str(r) for r in interactions.pet2d(bad, threshold_s=3600, slot_us=HOUR, cell=10.0).collect()}
    others = {r for r in found if "Vehicle1=3," not in r and "Vehicle2=3," not in r}
    assert others and others == {r for r in got if "Vehicle1=3," not in r and "Vehicle2=3," not in r}


def test_steps_of_all_lengths_cross_as_by_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = []
    for v in range(24):
        at, us = rng.uniform(-20, 20, 2), int(rng.integers(0, 2_000_000))
        for k in range(12):
            rows.append((1, v, k, us, float(at[0]), float(at[1]), 0.0, 0.1, "car", 4.0, 2.0, 1.5, 1))
            at = at + rng.normal(0, 1, 2) * 10.0 ** rng.uniform(-1, 5)
            us += int(10 ** rng.uniform(4, 8))
    pts = spark.createDataFrame(rows, "id_record long, id_vehicle long, ord long, us long, x double, y double, z double, yaw double, class_name string, length double, width double, height double, cluster int")
    within = 40_000_000
    got = {(r["a_id_vehicle"], r["b_id_vehicle"], r["a_ord"], r["b_ord"]) for r in interactions.crossings(pts, cell=1.0, within_us=within).collect()}
    want, steps = set(), [(a, b) for a, b in zip(rows, rows[1:]) if a[1] == b[1]]
    for p, p2 in steps:
        for q, q2 in steps:
            if p[1] < q[1]:
                ux, uy, vx, vy = p2[4] - p[4], p2[5] - p[5], q2[4] - q[4], q2[5] - q[5]
                cross = ux * vy - uy * vx
                f, g = ((q[4] - p[4]) * vy - (q[5] - p[5]) * vx) / cross, ((q[4] - p[4]) * uy - (q[5] - p[5]) * ux) / cross
                if 0 <= f <= 1 and 0 <= g <= 1 and abs(p[3] + round(f * (p2[3] - p[3])) - q[3] - round(g * (q2[3] - q[3]))) <= within:
                    want.add((p[1], q[1], p[2], q[2]))
    assert got == want and len(want) > 30


def test_vectors_are_compared_once_for_all_factors(spark):
    from waymeet.operators import anomaly

    rows = [(g, i, [float(i % 7) + 0.1, float(i % 5), float(i)]) for g in (0, 1) for i in range(40)]
    df = spark.createDataFrame(rows, "grp int, id long, embedding array<double>")
    plan = anomaly.local_outlier_factor(df, 5)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan and not any(line.count("Window [count") for line in plan.splitlines())
