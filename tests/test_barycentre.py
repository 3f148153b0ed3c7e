"""Barycentres by time warping against plain loops, on tracks of unlike length."""

import numpy as np
import pytest

from waymeet.operators import barycentre
from waymeet.plans import queries, views


def plain_warp(a, b):
    n, m = len(a), len(b)
    cost = np.full((n + 1, m + 1), np.inf)
    cost[0, 0] = 0
    for i in range(n):
        for j in range(m):
            cost[i + 1, j + 1] = ((a[i] - b[j]) ** 2).sum() + min(cost[i, j], cost[i, j + 1], cost[i + 1, j])
    i, j, path = n - 1, m - 1, [(n - 1, m - 1)]
    while i or j:
        ways = [cost[i, j], cost[i, j + 1], cost[i + 1, j]]
        k = ways.index(min(ways))
        i, j = i - (k != 2), j - (k != 1)
        path.append((i, j))
    return cost[n, m], path[::-1]


def plain_mean(tracks, rounds=50, gain=1e-5):
    m = max(map(len, tracks))
    mean = np.array([np.mean([t[k] for t in tracks if len(t) > k], axis=0) for k in range(m)])
    before = np.inf
    for _ in range(rounds):
        laid, cost = [[] for _ in range(m)], 0.0
        for t in tracks:
            c, path = plain_warp(t, mean)
            cost += c / len(tracks)
            for i, j in path:
                laid[j].append(t[i])
        if cost >= before - gain:
            return mean, before if cost > before else cost
        mean, before = np.array([np.mean(part, axis=0) for part in laid]), cost
    return mean, before


def test_warping_matches_plain_loops():
    rng = np.random.default_rng(1)
    for _ in range(60):
        a, b = (rng.integers(0, 4, (int(rng.integers(1, 9)), 3)).astype(float) for _ in range(2))
        cost, i, j = barycentre.warp(a, b)
        want, path = plain_warp(a, b)
        assert cost == pytest.approx(want) and list(zip(i.tolist(), j.tolist())) == path


def test_barycentres_match_plain_loops(spark):
    rng = np.random.default_rng(2)
    rows, labels, tracks = [], [], {}
    for v in range(40):
        n, label = int(rng.integers(1, 30)), v % 4 if v < 36 else -1
        t = np.cumsum(rng.normal(1, 0.5, (n, 3)), axis=0) + 20 * label
        rows += [(1, v, k, *map(float, p)) for k, p in enumerate(t)]
        labels.append((v, label))
        if label >= 0:
            tracks.setdefault(label, []).append(t)
    rows += [(1, 3, 500, float("nan"), 0.0, 0.0), (1, 3, 501, None, 0.0, 0.0), (1, 99, 0, 0.0, 0.0, 0.0)]
    labels += [(50, 7), (99, 8)]
    tracks[8] = [np.zeros((1, 3))]
    got = barycentre.barycentres(spark.createDataFrame(rows, "id_record long, id_vehicle long, ord long, x double, y double, z double"), spark.createDataFrame(labels, "id_vehicle long, label int")).collect()
    assert {r["label"] for r in got} == set(tracks)
    for label, mine in tracks.items():
        mean, cost = plain_mean(mine)
        at = sorted((r["place"], r["x"], r["y"], r["z"], r["cost"]) for r in got if r["label"] == label)
        assert np.allclose([r[1:4] for r in at], mean, atol=1e-6) and at[0][4] == pytest.approx(cost, abs=1e-6)


def test_barycentres_of_a_whole_table(spark, sf):
    _, labels = queries._lanes(spark, sf)
    of = {r["id"]: r["label"] for r in labels.collect() if r["label"] >= 0}
    tracks = {}
    for r in views.lane_points(spark, sf).orderBy("id_vehicle", "ord").collect():
        if r["id_vehicle"] in of:
            tracks.setdefault(of[r["id_vehicle"]], {}).setdefault(r["id_vehicle"], []).append((r["x"], r["y"], r["z"]))
    got = queries.QUERIES["lane_barycentres"](spark, sf).collect()
    assert len(tracks) >= 5 and {r["label"] for r in got} == set(tracks)
    for label, mine in tracks.items():
        mean, _ = plain_mean([np.array(t) for t in mine.values()])
        assert np.allclose([(r["x"], r["y"]) for r in sorted(got, key=lambda r: r["place"]) if r["label"] == label], mean[:, :2], atol=1e-4)
