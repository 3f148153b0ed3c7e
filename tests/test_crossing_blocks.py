"""Least crossings by blocks: the same as from the join by cells, and no pair of steps or of vehicles is shuffled."""

import numpy as np
from pyspark.sql import functions as F

from waymeet.operators import crossing_paths, interactions
from waymeet.plans import queries

DDL = "id_record long, id_vehicle long, ord long, us long, x double, y double, yaw double, class_name string, cluster int"
WITHIN, SLOT = 700, 900


def _scene(spark):
    """Tracks of one to forty points, some far off, some that stand, turn back, run along one line or are copies."""
    rng = np.random.default_rng(11)
    rows = []
    for v in range(140):
        n = int(rng.choice([1, 2, 3, 8, 40]))
        us = np.sort(rng.integers(0, 6000, n))
        xy = np.cumsum(rng.uniform(-9, 9, (n, 2)), axis=0) + rng.uniform(-15, 15, 2)
        if v % 9 == 0:
            xy = np.stack([np.arange(n) * 2.0, np.zeros(n)], axis=1)
        if v % 13 == 0:
            xy[n // 2] = [float(rng.choice([1e7, 1e9, np.inf, np.nan])), 3.0]
        if v % 7 == 0:
            xy[1:] = xy[:1]
        rows += [(v % 2, v, i, int(t) + (v % 5) * 10**12 * (v % 17 == 0), float(x), float(y), 0.1 * i, "person" if v % 3 == 0 else "car", v % 4) for i, (t, (x, y)) in enumerate(zip(us, xy))]
    rows += [(r, 200 + v, o, us, x, y, *rest) for r, v, o, us, x, y, *rest in rows if v in (5, 8)]
    return spark.createDataFrame([*rows, (0, 500, 0, None, 1.0, 1.0, 0.0, "car", 0), (0, 501, 0, 5, None, 1.0, 0.0, "car", 0), (0, 501, 1, 9, 4.0, 1.0, 0.0, "car", 0)], DDL).cache()


def test_blocks_find_the_least_of_all_crossings(spark):
    points = _scene(spark)
    met = interactions.crossings(points, cell=5.0, within_us=WITHIN)
    least = F.struct("gap_us", "a_ord", "b_ord", "t_a", "t_b", "px", "py", "a_cluster", "b_cluster")
    best = met.groupBy("id_record", "a_id_vehicle", "b_id_vehicle").agg(F.min_by(least, F.struct("gap_us", "a_ord", "b_ord")).alias("p"))
    shared = interactions.sharing_a_slot(best, points, SLOT)
    rounded = lambda rows: sorted((*r[:-2], round(r[-2], 6), round(r[-1], 6)) for r in rows)
    cols = ["gap_us", "a_ord", "b_ord", "t_a", "t_b", "a_cluster", "b_cluster", "px", "py"]
    key = ["id_record", "a_id_vehicle", "b_id_vehicle"]
    want = rounded(map(tuple, shared.select(*key, *(f"p.{c}" for c in cols)).collect()))
    assert 60 < len(want) < best.count()
    for block in (10_000, 300, 90):
        got = crossing_paths.least_crossings(points, within_us=WITHIN, slot_us=SLOT, carry=("ord", "cluster"), block_points=block)
        assert rounded(map(tuple, got.select(*key, *cols).collect())) == want


def test_far_tiles_are_left_out_and_none_is_missed():
    rng = np.random.default_rng(2)
    n = 3000
    x, y, us = 1e6 + rng.uniform(0, 500, n), rng.uniform(0, 500, n), rng.integers(0, 10**9, n)
    g = {"x": x, "y": y, "us": us, "x2": x + rng.uniform(-30, 30, n), "y2": y + rng.uniform(-30, 30, n), "us2": us + 10**6}
    a, b = (crossing_paths._Tiles(g | {"vehicle": np.arange(n)}, rows, 50, (1e6, 0.0, 0.0)) for rows in np.split(np.arange(n), 2))
    i, j = (v.ravel() for v in np.meshgrid(a.rows, b.rows, indexing="ij"))
    exact = crossing_paths.lines_cross(*(g[c][i] for c in ("x", "y", "x2", "y2")), *(g[c][j] for c in ("x", "y", "x2", "y2")))
    m = crossing_paths.meetings(*(g[c][r] for r in (i, j) for c in crossing_paths._STEP))
    exact = (exact & (np.abs(m["t_a"] - m["t_b"]) <= 10**8)).reshape(len(a.rows), -1)
    tiles = np.arange(len(b.at))
    may = np.concatenate([crossing_paths._crossed(a, k, b, tiles, b.some(tiles), 10**8) for k in range(len(a.at))])
    assert exact.sum() > 50 and not (exact & ~may).any() and may.sum() < 3 * exact.sum()


def test_pairs_are_not_shuffled(spark, sf):
    plan = queries.QUERIES["pet2d"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    met = plan[: plan.index("MapInArrow")]
    assert "Aggregate" not in met.split("LogicalRDD")[0].split("Join")[0] and "Repartition" not in met
    assert "Join Inner" not in plan.split("Repartition")[0] and "broadcast" in met.lower()
