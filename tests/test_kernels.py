"""Column kernels and small scenes against numpy and hand-worked values."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymeet.functions import boxes, camera, geometry
from waymeet.operators import anomaly, clustering, conflicts, detections, interactions, matching, tracks
from waymeet.schemas import OBJECT_CLASSES
from waymeet.sources import calibration

SIZE = {c[0]: c[2:] for c in OBJECT_CLASSES}


def scene(spark, *vehicles):
    """Vehicles as (id, class, frames, start, function of seconds to (x, y, yaw)); 30 frames a second in record 1."""
    rows = []
    for vid, cls, n, start, f in vehicles:
        for k in range(n):
            x, y, yaw = f(k / 30)
            rows.append((1, vid, k, int((start + k / 30) * 1e6), x, y, 0.0, yaw, True, cls, *SIZE[cls], vid - 1))
    ddl = "id_record long, id_vehicle long, ord long, us long, x double, y double, z double, yaw double, detected boolean, class_name string, length double, width double, height double, cluster int"
    return spark.createDataFrame(rows, ddl)


def east(speed=10.0, x0=-15.0, y=0.0):
    return lambda t: (x0 + speed * t, y, 0.0)


def north(speed=10.0, y0=-15.0, x=0.0):
    return lambda t: (x, y0 + speed * t, math.pi / 2)


def test_crossing_cars_have_opposite_roles_in_both_indicators(spark):
    pts = scene(spark, (1, "car", 90, 0, east()), (2, "car", 90, 1, north()))
    three, two = interactions.pet3d(pts).collect(), interactions.pet2d(pts).collect()
    assert len(three) == len(two) == 1
    assert two[0]["Value"] == pytest.approx(1.0, abs=1e-5) and (two[0]["idVehicle1"], two[0]["idVehicle2"]) == (1, 2)
    assert two[0]["posX"] == pytest.approx(0) and two[0]["posY"] == pytest.approx(0) and two[0]["Auto_Type"] == "Crossing"
    assert 0 < three[0]["Value"] < 1 and three[0]["idVehicle1"] == 2 and three[0]["first_arrival"] == 1 and three[0]["Auto_Type"] == "Crossing"


def test_no_conflict_when_too_late_or_both_vulnerable_or_apart(spark):
    late = scene(spark, (1, "car", 150, 0, east()), (2, "car", 150, 4.2, north()))
    assert interactions.pet3d(late).count() == 0 and interactions.pet2d(late).count() == 0
    vulnerable = scene(spark, (1, "person", 90, 0, east()), (2, "bicycle", 90, 1, north()))
    assert interactions.pet3d(vulnerable).count() == 0 and interactions.pet2d(vulnerable).count() == 0
    seconds_apart = scene(spark, (1, "car", 60, 0, east(15)), (2, "car", 60, 2.5, north(15)))
    assert interactions.pet3d(seconds_apart).count() == 0
    parallel = scene(spark, (1, "car", 90, 0, east()), (2, "car", 90, 0, east(y=1.9)))
    pairs = interactions.tube_hits(interactions.frame_pairs(parallel, band_us=3_000_000))
    assert pairs.count() > 0 and interactions.box_hits(pairs).count() == 0


def test_following_pair_is_named_and_keeps_the_rule(spark):
    pts = scene(spark, (1, "car", 90, 0, east()), (2, "car", 90, 1, east()))
    found = interactions.pet3d(pts)
    row = found.first()
    assert row["Auto_Type"] == "Following"
    named = interactions.pet3d(pts, spark.createDataFrame([(1, 0, "Check individual"), (0, 1, "Head-on")], "ClusterVehicle1 int, ClusterVehicle2 int, ManeuverClass string")).first()
    assert named["Auto_Type"] in ("Following", "Head-on")


def test_sat_agrees_with_sampled_area(spark):
    rng = np.random.default_rng(1)
    rows = [tuple(float(v) for v in (0, 0, rng.uniform(1, 6), rng.uniform(1, 3), rng.uniform(0, 6.3), rng.uniform(-5, 5), rng.uniform(-5, 5), rng.uniform(1, 6), rng.uniform(1, 3), rng.uniform(0, 6.3))) for _ in range(200)]
    df = spark.createDataFrame(rows, "ax double, ay double, al double, aw double, ayaw double, bx double, by double, bl double, bw double, byaw double")
    got = [r["hit"] for r in df.select(geometry.boxes_overlap(*(F.col(c) for c in df.columns)).alias("hit")).collect()]
    g = (np.arange(121) + 0.5) / 121 - 0.5
    missed = 0
    for r, hit in zip(rows, got, strict=True):
        u, v = np.meshgrid(g * r[2], g * r[3])
        x, y = r[0] + math.cos(r[4]) * u - math.sin(r[4]) * v, r[1] + math.sin(r[4]) * u + math.cos(r[4]) * v
        p, q = x - r[5], y - r[6]
        inside = (abs(math.cos(r[9]) * p + math.sin(r[9]) * q) < r[7] / 2) & (abs(math.cos(r[9]) * q - math.sin(r[9]) * p) < r[8] / 2)
        assert hit or not inside.any()
        missed += hit and not inside.any()
    assert missed < 6  # overlaps smaller than the grid


def test_curve_distance_agrees_with_dense_search(spark):
    rng = np.random.default_rng(2)
    rows = [(rng.normal(0, 2, 3).tolist(), rng.normal(0, 2, 3).tolist(), *rng.normal(0, 20, 2).tolist()) for _ in range(60)]
    rows += [([0.0, 1.0, 0.0], [0.0, 0.0, 0.0], 3.0, 4.0), ([0.0, 0.0, 1.0], [0.0, 0.0, 1.0], 4.0, 5.0), ([1.0, 0.0, 0.0], [0.0, 0.0, 0.0], -1.0, 0.0), ([0.0, 2.0, 1.0], [0.0, 1.0, 0.0], 50.0, 0.0)]
    df = spark.createDataFrame(rows, "cx array<double>, cy array<double>, px double, py double")
    got = [r["d"] for r in df.select(geometry.curve_distance(F.col("cx"), F.col("cy"), F.col("px"), F.col("py"), -2, 6).alias("d")).collect()]
    t = np.linspace(-2, 6, 200_001)
    for (cx, cy, px, py), d in zip(rows, got, strict=True):
        assert d == pytest.approx(np.sqrt((np.polyval(cx, t) - px) ** 2 + (np.polyval(cy, t) - py) ** 2).min(), abs=2e-3)


def test_quadratic_fit_is_least_squares(spark):
    v = [3.0, 1.0, 4.0, 1.5, 9.0]
    row = spark.createDataFrame([tuple(v)], "a double, b double, c double, d double, e double")
    got = row.select(geometry.quadratic_fit([F.col(c) for c in "abcde"]).alias("c")).first()["c"]
    assert got == pytest.approx(np.polyfit(np.arange(5), v, 2).tolist())


def test_segments_and_polygons(spark):
    seg = lambda *v: tuple(map(float, v))
    cases = [(seg(0, 0, 2, 2, 0, 2, 2, 0), True), (seg(0, 0, 1, 1, 2, 2, 3, 3), False), (seg(0, 0, 2, 2, 1, 1, 3, 3), True), (seg(0, 0, 1, 0, 1, 0, 2, 5), True), (seg(0, 0, 1, 0, 0, 1, 1, 1), False)]
    df = spark.createDataFrame([c for c, _ in cases], "ax double, ay double, bx double, by double, cx double, cy double, dx double, dy double")
    cols = [F.col(c) for c in df.columns]
    f, g = geometry.meeting_shares(*cols)
    rows = df.select(geometry.segments_meet(*cols).alias("m"), f.alias("f"), g.alias("g")).collect()
    assert [r["m"] for r in rows] == [w for _, w in cases]
    assert (rows[0]["f"], rows[0]["g"]) == (0.5, 0.5) and rows[2]["f"] == pytest.approx(0.75) and rows[2]["g"] == pytest.approx(0.25)
    square = [{"x": float(x), "y": float(y)} for x, y in ((0, 0), (4, 0), (4, 4), (0, 4))]
    pts = spark.createDataFrame([(2.0, 2.0, square), (0.0, 2.0, square), (5.0, 2.0, square), (4.0, 4.0, square), (1.0, 3.5, square)], "x double, y double, v array<struct<x: double, y: double>>")
    got = pts.select(geometry.in_polygon(F.col("x"), F.col("y"), F.col("v")).alias("i"), geometry.border_distance(F.col("x"), F.col("y"), F.col("v")).alias("d")).collect()
    assert [r["i"] for r in got] == [True, False, False, False, True]
    assert [r["d"] for r in got] == [2.0, 0.0, 1.0, 0.0, 0.5]


def test_camera_round_trip(spark):
    a = 0.6
    r = np.array([[1, 0, 0], [0, -math.cos(a), -math.sin(a)], [0, math.sin(a), -math.cos(a)]])
    ext = np.eye(4)
    ext[:3, :3], ext[:3, 3] = r, -r @ np.array([2.0, -5.0, 8.0])
    cal = calibration.Calibration(np.array([[80.0, 0, 64], [0, 80, 48], [0, 0, 1]]), (0.02, 0.001, 0.0005, -0.0003, 0.0), ext)
    assert cal.position == pytest.approx([2, -5, 8])
    mesh = np.array([[-200, -200, 0], [200, -200, 0], [200, 200, 0], [-200, 200, 0]], float)
    pixels = calibration.pixel_map(spark, cal, mesh, np.array([[0, 1, 2], [0, 2, 3]]), 128, 96)
    u, v = camera.world_to_pixel(F.col("wx"), F.col("wy"), F.col("wz"), ext.tolist(), cal.camera.tolist(), cal.lens)
    rows = pixels.select("px", "py", u.alias("u"), v.alias("v")).collect()
    assert len(rows) > 2000
    assert max(abs(r["px"] - r["u"]) + abs(r["py"] - r["v"]) for r in rows) < 0.01
    base = calibration.orthonormal(np.array([1.0, 2.0, 3.0]))
    assert base @ base.T == pytest.approx(np.eye(3)) and np.linalg.det(base) == pytest.approx(1)


def test_dbscan_on_paths_with_outliers(spark):
    rng = random.Random(1)
    keyed = []
    for i in range(15):
        off = (rng.uniform(-0.1, 0.1) if i < 12 else 50.0 * i)
        keyed.append((i, [{"x": 5.0 * k, "y": off, "z": 0.0} for k in range(5)]))
    df = spark.createDataFrame(keyed, "id long, points array<struct<x: double, y: double, z: double>>")
    labels = {r["id"]: r["label"] for r in clustering.dbscan(df.select("id"), clustering.neighbours(df, 0.5), 5).collect()}
    assert [labels[i] for i in range(15)] == [0] * 12 + [-1] * 3
    means = clustering.merge_means(clustering.cluster_means(df, spark.createDataFrame(list(labels.items()), "id long, label int")))
    assert means.count() == 1
    got = {r["id"]: r["cluster"] for r in clustering.assign(df, means).collect()}
    assert got[0] == 0 and got[14] == -1
    back = df.filter("id = 0").select("id", F.reverse("points").alias("points"))
    assert clustering.assign(back, means).first()["cluster"] == 1


def test_maneuvers_of_simple_curves(spark):
    straight = ([0.0, 10.0, 0.0], [0.0, 0.0, 20.0])
    across = ([0.0, 0.0, 20.0], [0.0, 10.0, 0.0])
    shifted = ([0.0, 10.0, 0.0], [0.0, 0.0, 20.5])
    rows = [(i, *c, [0.0, 0.0, 0.0]) for i, c in enumerate((straight, across, shifted))]
    got = {(r[0], r[1]): r[2] for r in clustering.classify_maneuvers(spark.createDataFrame(rows, clustering.MEANS_DDL)).collect()}
    assert len(got) == 36
    assert got[0, 1] == got[3, 1] == got[0, 4] == got[3, 4] == "Crossing"
    assert got[0, 2] == got[3, 5] == "Following" and got[3, 2] == got[0, 5] == "Head-on"
    assert got[0, 0] == got[3, 3] == "Following" and got[0, 3] == got[3, 0] == "Head-on"


def test_outlier_is_the_only_anomaly(spark):
    rng = np.random.default_rng(3)
    rows = [("g", i, (np.array([1.0, 0.2, 0.1]) + rng.normal(0, 0.02, 3)).tolist()) for i in range(24)] + [("g", 24, [-1.0, 1.0, 0.0])]
    rows += [("small", i, [1.0, 0.0, float(i)]) for i in range(5)] + [("same", i, [1.0, 1.0, 1.0]) for i in range(25)]
    got = anomaly.local_outlier_factor(spark.createDataFrame(rows, "grp string, id int, embedding array<double>")).collect()
    lof = {r["id"]: r["lof"] for r in got if r["grp"] == "g"}
    assert lof[24] > 20 and max(v for i, v in lof.items() if i < 24) < 2.5
    assert all(r["lof"] == 0 and not r["is_anomaly"] for r in got if r["grp"] == "small")
    assert all(r["lof"] == pytest.approx(1) for r in got if r["grp"] == "same")


def test_greedy_match_takes_cheapest_first(spark):
    rng = random.Random(2)
    rows = [(g, i, j, float(rng.randrange(30))) for g in range(3) for i in range(8) for j in range(9) if rng.random() < 0.7]
    got = {(r["g"], r["i"], r["j"]) for r in matching.greedy_match(spark.createDataFrame(rows, "g int, i int, j int, cost double"), ["g"]).collect()}
    want, used = set(), set()
    for g, i, j, _ in sorted(rows, key=lambda r: (r[0], r[3], r[1], r[2])):
        if (g, "i", i) not in used and (g, "j", j) not in used:
            want.add((g, i, j))
            used |= {(g, "i", i), (g, "j", j)}
    assert got == want


def test_gap_is_filled_on_the_cubic(spark):
    f = lambda t: (t**3, 2 * t, 0.0)
    pts = scene(spark, (1, "car", 40, 0, f)).filter("ord < 15 or ord >= 25")
    filled = tracks.fill_gaps(pts).collect()
    assert len(filled) == 10
    for r in filled:
        t = (14 + r["k"]) / 30
        assert r["x"] == pytest.approx(t**3, abs=1e-9) and abs(r["us"] - t * 1e6) < 40


def test_split_lands_one_row_before_the_jump(spark):
    pts = scene(spark, (1, "car", 80, 0, lambda t: (t, 0.0, 0.0 if t < 40 / 30 - 1e-9 else math.pi / 2 + 0.1)))
    rows = sorted((r["piece"], r["first_ord"], r["new_vehicle"]) for r in tracks.pieces(pts).collect())
    assert rows == [(0, 0, 1), (1, 39, 3)]


def test_stationary_vehicle_has_no_key_points(spark):
    assert tracks.key_points(scene(spark, (1, "car", 120, 0, lambda t: (1.0, 2.0, 0.0)))).count() == 0


def test_rule_ties_and_shares(spark):
    rules = spark.createDataFrame([(1, 2, 5, 5, 10), (3, 4, 34, 66, 100), (5, 6, 33, 67, 100)], "cluster_A int, cluster_B int, A_as_vehicle1 long, B_as_vehicle1 long, total_pairs long")
    rows = [(1, 2, "Crossing"), (3, 4, "Crossing"), (4, 3, "Crossing"), (5, 6, "Crossing"), (7, 8, "Crossing"), (7, 8, "Following"), (9, 9, "Merging")]
    got = conflicts.assign_rules(spark.createDataFrame(rows, "Vehicle_Cluster_1 int, Vehicle_Cluster_2 int, Auto_Type string"), rules)
    flags = {tuple(r[:3]): r[3] for r in got.select("Vehicle_Cluster_1", "Vehicle_Cluster_2", "Auto_Type", "Auto_Rule_Flag").collect()}
    assert [flags[r] for r in rows] == [None, False, True, False, None, True, True]


def test_kalman_follows_a_straight_line_through_missed_frames(spark):
    pts = scene(spark, (1, "car", 120, 0, east(9.0))).withColumn("detected", ~F.col("ord").between(80, 85))
    last = matching.kalman(pts).orderBy(F.desc("ord")).first()
    x = -15 + 9 * 119 / 30
    assert last["kx"] == pytest.approx(x, abs=1.0) and last["kvx"] == pytest.approx(9.0, abs=4.0)


def test_masking_is_seeded_and_reaches_its_share(spark):
    pts = scene(spark, (1, "car", 100, 0, east()), (2, "car", 50, 0, north()))
    one, two = (sorted(map(tuple, matching.mask_and_corrupt(pts, seed=4).select("id_vehicle", "ord", "masked").collect())) for _ in range(2))
    assert one == two
    for v, n in ((1, 100), (2, 50)):
        assert sum(m for i, _, m in one if i == v) >= math.ceil(0.15 * n)


def test_suppression_matches_plain_greedy(spark):
    rng = random.Random(5)
    rows = []
    for i in range(300):
        x, y = rng.uniform(0, 60), rng.uniform(0, 60)
        rows.append((i % 4, i, i % 2, rng.random(), x, y, x + rng.uniform(10, 30), y + rng.uniform(10, 30)))
    got = {r["det_id"] for r in detections.suppress(spark.createDataFrame(rows, "frame_id long, det_id long, cls int, conf double, x1 double, y1 double, x2 double, y2 double"), iou=0.4).collect()}

    def iou(a, b):
        w, h = min(a[6], b[6]) - max(a[4], b[4]), min(a[7], b[7]) - max(a[5], b[5])
        i = max(w, 0) * max(h, 0)
        return i / ((a[6] - a[4]) * (a[7] - a[5]) + (b[6] - b[4]) * (b[7] - b[5]) - i)

    want = []
    for r in sorted((r for r in rows if r[3] > 0.25), key=lambda r: -r[3]):
        if all(k[0] != r[0] or k[2] != r[2] or iou(k, r) <= 0.4 for k in want):
            want.append(r)
    assert got == {r[1] for r in want}


def test_box_round_trips(spark):
    row = spark.createDataFrame([(1.0, 2.0, 5.0, 10.0)], "a double, b double, c double, d double")
    b = tuple(F.col(c) for c in "abcd")
    back = boxes.from_center(*boxes.to_center(b))
    assert tuple(row.select(*(c.alias(str(i)) for i, c in enumerate(back))).first()) == (1.0, 2.0, 5.0, 10.0)
    assert row.select(boxes.iou(b, b).alias("i")).first()["i"] == 1.0
