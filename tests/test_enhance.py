"""Tracks made whole, vehicles of any size, and walks along tracks, on small scenes and against plain versions."""

import math

import numpy as np
import pytest

from waymeet.operators import enhance, interactions, shapes, walks

POINT = "id_record long, id_vehicle long, ord long, us long, x double, y double, z double, yaw double, length double, width double, height double, class_name string, detected boolean"
FRAME = 33_333


def track(vehicle, frames, x0=0.0, speed=10.0, y=0.0, yaw=0.0):
    return [(1, vehicle, k, f * FRAME, x0 + speed * f / 30, y, 0.0, yaw, 3.64, 1.82, 1.39, "car", True) for k, f in enumerate(frames)]


def test_enhanced_tracks_are_linked_filled_and_filtered(spark):
    rows = track(1, range(40)) + track(2, range(50, 100)) + track(3, range(100), speed=0.0, y=50.0) + track(4, range(8), y=90.0)
    out = enhance.enhance(spark.createDataFrame(rows, POINT), {"car": 25.0}).orderBy("ord").collect()
    assert {r["id_vehicle"] for r in out} == {1} and [r["ord"] for r in out] == list(range(100))
    assert [r["detected"] for r in out] == [not 40 <= f < 50 for f in range(100)]
    assert all(abs(r["x"] - 10 * r["us"] / 1e6) < 0.6 for r in out[10:90])  # means shrink towards the ends of pieces


def test_boxes_of_long_vehicles_meet(spark):
    both = [(1, v, 0, 0, x, 0.0, 0.0, 0.0, 30.0, 2.5, 3.0, "truck", 0) for v, x in ((1, 0.0), (2, 28.0))] + [(1, 3, 0, 0, 300.0, 0.0, 0.0, 0.0, 600.0, 2.5, 3.0, "truck", 0)]
    ddl = "id_record long, id_vehicle long, ord long, us long, x double, y double, z double, yaw double, length double, width double, height double, class_name string, cluster int"
    found = interactions.pet3d(spark.createDataFrame(both, ddl), threshold_s=3.0).collect()
    assert sorted((r["idVehicle1"], r["idVehicle2"]) for r in found) == [(2, 1), (3, 1), (3, 2)]


def test_frame_pairs_find_all_near_frames(spark):
    rng = np.random.default_rng(5)
    rows = [(1, int(v), 0, int(rng.integers(0, 6)) * 1_000_000, *(float(c) for c in rng.uniform(-60, 60, 2)), 0.0, 0.0, float(rng.choice([0.7, 4.0, 13.45, 40.0, 300.0], p=[0.3, 0.4, 0.2, 0.08, 0.02])), 1.0, 1.0, "car", 0) for v in range(150)]
    ddl = "id_record long, id_vehicle long, ord long, us long, x double, y double, z double, yaw double, length double, width double, height double, class_name string, cluster int"
    got = [(r["a_id_vehicle"], r["b_id_vehicle"]) for r in interactions.frame_pairs(spark.createDataFrame(rows, ddl), band_us=2_000_000).collect()]
    want = [(a[1], b[1]) for a in rows for b in rows if a[1] < b[1] and abs(a[3] - b[3]) <= 2_000_000 and math.hypot(a[4] - b[4], a[5] - b[5]) <= (max(1, a[8]) + max(1, b[8])) / 2]
    assert sorted(got) == sorted(want) and len(got) > 50


def naive_jump_smooth(yaw):
    out, start = list(yaw), 0
    jumps = [i for i in range(len(yaw) - 1) if abs(yaw[i + 1] - yaw[i]) > 3]

    def mean(lo, hi, n):
        if n < 2:
            return
        half = (n + 1 if n % 2 == 0 else n) // 2
        part = out[lo:hi]
        for i in range(len(part)):
            near = [part[min(len(part) - 1, max(0, j))] for j in range(i - half, i + half + 1)]
            out[lo + i] = sum(near) / len(near)

    for j in jumps:
        mean(start, j + 1, min(j - start, 60))
        start = j
    mean(start, len(yaw), min(len(yaw) - start, 60))
    return out


def naive_adaptive(x, y, bent):
    out, start, k = [], 0, 0
    for i in range(len(x)):
        part = slice(start, i + 1)
        if i + 1 - start >= 4 and (walks.bend(np.array(x[part]), np.array(y[part])) > bent).any():
            start, k = i, k + 1
        out.append(k)
    return [k if k < out[-1] or len(x) - start >= 4 else None for k in out]


def test_walks_match_plain_versions(spark):
    rng = np.random.default_rng(7)
    rows, want = [], {}
    for v in range(30):
        n = int(rng.integers(1, 90))
        x, y, yaw = np.cumsum(rng.normal(1, 0.4, n)), np.cumsum(rng.normal(0, 0.4, n)), rng.uniform(-2.2, 2.2, n)
        rows += [(1, v, k, float(a), float(b), float(c)) for k, (a, b, c) in enumerate(zip(x, y, yaw))]
        want[v] = (naive_jump_smooth(yaw), naive_adaptive(x, y, 1.5))
    pts = spark.createDataFrame(rows, "id_record long, id_vehicle long, ord long, x double, y double, yaw double").repartition(5)
    smooth = {(r["id_vehicle"], r["ord"]): r["yaw_even"] for r in shapes.smooth_between_jumps(pts).collect()}
    cut = {(r["id_vehicle"], r["ord"]): r["segment"] for r in walks.adaptive_segments(pts, bent=1.5).collect()}
    assert len(smooth) == len(rows)
    for v, (even, segments) in want.items():
        assert [smooth[v, k] for k in range(len(even))] == pytest.approx(even)
        assert [cut[v, k] for k in range(len(even))] == segments
