"""Near frames by blocks: the same as from the join by cells, and nothing of a pair of frames is shuffled."""

import numpy as np
from pyspark.sql import functions as F

from waymeet.operators import interactions
from waymeet.operators.near_frames import near_frames
from waymeet.plans import queries

DDL = "id_record long, id_vehicle long, ord long, us long, x double, y double, z double, yaw double, class_name string, length double, width double, height double, cluster int"
BAND = 900


def _scene(spark, n=900):
    rng = np.random.default_rng(5)
    kinds = [("car", 4.5, 1.8), ("person", 0.5, 0.5), ("bus", 12.0, 2.5), ("bicycle", 1.8, 0.6), ("truck", 40.0, 3.0), ("truck", 300.0, 3.0)]
    rows = []
    for i in range(n):
        v = int(rng.integers(0, 60))
        c = kinds[v % 6 if v % 6 < 4 or v < 12 else 0]
        rows.append((int(v % 2), v, i, int(rng.integers(0, 4000)), float(rng.uniform(-30, 60)), float(rng.uniform(-20, 20)), 0.0, float(rng.choice([0.0, 1.0, np.pi / 2])), c[0], c[1], c[2], 1.5, 0))
    odd = [(0, 900 + k, k, 100, x, 0.0, 0.0, 0.0, "car", size, 1.8, 1.5, None) for k, (x, size) in enumerate([(float("nan"), 4.5), (None, 4.5), (float("inf"), 4.5), (1e9, 4.5), (1e9, None), (1.0, None)])]
    return spark.createDataFrame(rows + odd, DDL).cache()


def test_blocks_find_what_the_join_finds(spark):
    points = _scene(spark)
    key = ["id_record", "a_id_vehicle", "a_ord", "b_id_vehicle", "b_ord"]
    plain = interactions.tube_hits(interactions.frame_pairs(points.filter("x is null or x <> double('inf')"), band_us=BAND))  # the join has no cell for an infinite place
    plain = plain.cache()
    hits = interactions.box_hits(plain)
    of = lambda df, *cols: sorted(map(tuple, df.select(*cols).collect()))
    first = hits.groupBy("id_record", "a_id_vehicle", "b_id_vehicle").agg(F.min("gap_us").alias("gap_us"), F.min(F.struct("a_ord", "b_ord")).alias("p"))
    want = of(first, "id_record", "a_id_vehicle", "b_id_vehicle", "gap_us", "p.a_ord", "p.b_ord")
    shared = interactions.sharing_a_slot(first, points, 50)
    assert 0 < shared.count() < first.count()
    for block in (10_000, 200, 40):
        find = lambda **more: near_frames(points, band_us=BAND, carry=("ord",), block_frames=block, **more)  # noqa: B023, E731
        assert of(find(), *key) == of(plain, *key)
        assert of(find(boxes=True), *key) == of(hits, *key)
        pairs = ["id_record", "a_id_vehicle", "b_id_vehicle", "gap_us", "a_ord", "b_ord"]
        assert of(find(boxes=True, pairs=True), *pairs) == want
        assert of(find(boxes=True, pairs=True, slot_us=50), *pairs[:3]) == of(shared, *pairs[:3])


def test_pairs_of_frames_are_not_shuffled(spark, sf):
    for name in ("pet3d", "sat_overlap", "pet_pairs_min"):
        plan = queries.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        assert not any("Join Inner" in line and "p_x" in line for line in plan.splitlines())
        met = plan[: plan.index("MapInArrow")]
        assert "Aggregate" not in met and "Repartition" not in met
