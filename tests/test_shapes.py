"""Segments, smoothing, label files and anchors on small hand-made inputs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymeet.operators import anomaly, detections, shapes

DDL = "id_record long, id_vehicle long, ord long, x double, y double"


def track(spark, xy, vehicle=1):
    return spark.createDataFrame([(1, vehicle, i, float(x), float(y)) for i, (x, y) in enumerate(xy)], DDL)


def segments(df):
    out = {}
    for r in df.orderBy("ord").collect():
        out.setdefault(r["segment"], []).append(r["ord"])
    return [out[k] for k in sorted(out)]


def test_distance_segments_wait_for_enough_rows(spark):
    assert segments(shapes.distance_segments(track(spark, [(i, 0) for i in range(14)]))) == [list(range(6)), list(range(6, 12))]
    assert segments(shapes.distance_segments(track(spark, [(0, 0)] * 5))) == []


def test_angle_segments_share_the_corner(spark):
    xy = [(i, 0) for i in range(6)] + [(5, i) for i in range(1, 5)]
    cut = shapes.angle_segments(track(spark, xy))
    assert segments(cut) == [list(range(6)), list(range(6, 10))]
    assert {r["lead_ord"] for r in cut.filter("segment = 1").collect()} == {5}


def test_gaussian_keeps_a_constant_and_follows_numpy(spark):
    rng = random.Random(4)
    xy = [(i + rng.random(), 7.0) for i in range(30)]
    got = shapes.gaussian_smooth(track(spark, xy)).orderBy("ord").toPandas()
    steps = np.hypot(*np.diff(np.array(xy), axis=0).T)
    sigma = max(0.5, min(5.0, 15 * (np.percentile(steps, 75) - np.percentile(steps, 25))))
    r = int(4 * sigma + 0.5)
    w = np.exp(-(np.arange(-r, r + 1) ** 2) / (2 * sigma * sigma))
    want = np.convolve(np.pad(np.array(xy)[:, 0], r, mode="symmetric"), w / w.sum(), mode="valid")
    assert got["x_smooth"].to_numpy() == pytest.approx(want)
    assert got["y_smooth"].to_numpy() == pytest.approx(np.full(30, 7.0))
    assert shapes.gaussian_smooth(track(spark, [(1, 2)])).first()["x_smooth"] == 1.0


def test_curvature_of_a_circle(spark):
    xy = [(10 * math.cos(t / 20), 10 * math.sin(t / 20)) for t in range(40)]
    inner = shapes.curvature(track(spark, xy)).filter("ord between 2 and 37").toPandas()["curvature"]
    assert inner.to_numpy() == pytest.approx(np.full(36, 0.1), rel=1e-2)
    assert shapes.curvature(track(spark, [(1, 1)] * 4)).filter("curvature is not null").count() == 0


def test_hand_made_cuts_get_new_numbers(spark):
    cuts = spark.createDataFrame([(1, 1, [0, 1, 4, 9])], "id_record long, id_vehicle long, at array<long>")
    out = shapes.split_tracks(track(spark, [(i, 0) for i in range(12)]), cuts).orderBy("new_vehicle", "ord").collect()
    assert [(r["new_vehicle"], r["ord"]) for r in out] == [(2, k) for k in range(1, 5)] + [(3, k) for k in range(4, 10)]


def test_label_files(spark):
    good = " ".join(["0"] + ["0.5"] * 6 + ["3"] * 8)
    rows = [("a", good + "\n" + good.replace("3", "4")), ("b", None), ("c", " \n"), ("d", good + "\n" + good), ("e", good[:-2]), ("f", good.replace("0.5", "1.5")), ("g", good.replace("3", "-3")), ("h", good.replace("3", "x"))]
    got = {r["path"]: (r["n"], r["state"]) for r in detections.check_labels(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert got["a"] == (2, "found") and got["b"] == (0, "missing") and got["c"] == (0, "empty")
    assert {got[k][1] for k in "defgh"} == {"corrupt"}


def test_anchors_find_the_sizes(spark):
    sizes = [(10 + i % 3, 20 + i % 2) for i in range(60)] + [(100 + i % 3, 40 + i % 2) for i in range(60)]
    df = spark.createDataFrame([(float(w), float(h)) for w, h in sizes], "w double, h double")
    small, large = detections.fit_anchors(df, 2)
    assert small == pytest.approx((11, 20.5)) and large == pytest.approx((101, 40.5))
    assert detections.anchor_recall(df, [small, large]).first()["recall"] == 1.0


def test_score_groups_prefer_rule_breakers(spark):
    ddl = "Vehicle_Cluster_1 int, Vehicle_Cluster_2 int, Vehicle_Class_1 string, Vehicle_Class_2 string, idVehicle1 long, idVehicle2 long, idRecord long, Auto_Rule_Flag boolean"
    rows = [(2, 1, "car", "bus", i, 100 + i, 7, i >= 3) for i in range(6)] + [(1, 1, "car", "car", 1, 2, 7, False)] + [(3, 4, "car", "car", i, i + 9, 7, True) for i in range(2)]
    got = anomaly.score_groups(spark.createDataFrame(rows, ddl), least=2).collect()
    assert {tuple(r) for r in got} == {(1, 2, 2, "car", 7, i) for i in range(3)} | {(1, 2, 1, "bus", 7, 100 + i) for i in range(3)}


def test_embedding_is_the_mean_motion_of_each_stretch(spark):
    pts = track(spark, [(0, 2 * i) for i in range(40)]).withColumns({"yaw": F.lit(math.pi / 2), "us": F.col("ord") * 33_333})
    row = anomaly.motion_features(pts, 20).first()["embedding"]
    assert row[:2] == pytest.approx([1.0, 0.0]) and row[2::2] == pytest.approx([2.0] * 19)


def test_bernstein_paths_go_through_all_rows_smoothly(spark):
    rng = np.random.default_rng(8)
    rows = [(1, v, k, *map(float, rng.normal(size=3))) for v, n in ((1, 12), (2, 2), (3, 1)) for k in range(n)]
    pts = spark.createDataFrame(rows, "id_record long, id_vehicle long, ord long, x double, y double, z double")
    got = {(r["id_vehicle"], r["ord"], r["share"]): r for r in shapes.bernstein_paths(pts, (0.0, 1e-6, 0.5, 1 - 1e-6)).collect()}
    assert {v for v, _, _ in got} == {1, 2}
    x = np.array([r[3] for r in rows if r[1] == 1])
    v = np.gradient(x, 1 / 11)
    a = np.gradient(v, 1 / 11)
    for k in range(12):
        r = got[1, k, 0.0]
        assert (r["x"], r["vx"], r["ax"]) == (pytest.approx(x[k]), pytest.approx(v[k]), pytest.approx(a[k]))
        if k < 11:
            for share, m in ((1e-6, k), (1 - 1e-6, k + 1)):
                r = got[1, k, share]
                assert (r["x"], r["vx"], r["ax"]) == (pytest.approx(x[m], abs=1e-4), pytest.approx(v[m], abs=1e-2), pytest.approx(a[m], abs=1e-1))
    yaw = [got[1, k, 0.0]["yaw"] for k in range(12)]
    alone = {r["ord"]: r["yaw_rate"] for r in shapes.bernstein_paths(pts.filter("id_vehicle = 1")).collect()}
    assert [alone[k] for k in range(12)] == pytest.approx(np.gradient(yaw).tolist())


def test_bernstein_paths_that_stand_still_across_turn_by_half_a_circle_not_by_minus_half(spark):
    from waymeet.plans import views

    track = views.points(spark, "/root/testdata/sf0.1").filter("id_vehicle = 1332")
    row = shapes.bernstein_paths(track, (0.0, 0.25, 0.5)).filter("ord = 44 and share = 0.25").first()
    assert abs(row["vy"]) < 1e-9 and row["yaw"] > 3.14
