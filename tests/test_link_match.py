"""Links matched in groups and strips: what the table of all candidates gives, also for copies and odd rows."""

import random

from pyspark.sql import functions as F

from waymeet.operators import matching
from waymeet.operators.link_match import match_links
from waymeet.plans import queries

DDL = "id_record long, id long, class_name string, s_us long, e_us long, s_x double, s_y double, s_z double, s_yaw double, e_x double, e_y double, e_z double, e_yaw double, length double, width double, height double"
LIMITS = {"car": 12.0, "bus": 16.0}


def _tracks(spark, n=500, copies=3):
    rng = random.Random(4)
    place = lambda: (float(rng.randrange(160)), float(rng.randrange(3)), 0.0, rng.choice([0.0, 0.5, 3.0]))
    rows = []
    for k in range(n):
        s = rng.randrange(3000)
        state = (1 + k % 2, rng.choice(["car", "car", "car", "bus", "tram", None]), s, s + rng.randrange(400), *place(), *place(), rng.choice([4.0, 4.5]), 1.8, 1.5)
        rows += [(state[0], 1000 * c + (k * 7) % n, *state[1:]) for c in range(copies if k % 3 else 1)]
    rows += [(1, 9000, "car", 100, 200, float("nan"), 0.0, 0.0, 0.0, 1.0, 1.0, 0.0, 0.0, 4.0, 1.8, 1.5), (1, 9001, "car", 100, 200, 1.0, None, 0.0, 0.0, float("inf"), 1.0, 0.0, 0.0, 4.0, 1.8, 1.5)]
    rows += [(None, 9002, "car", 100, 200, *[1.0] * 8, 4.0, 1.8, 1.5), (1, 9003, "car", None, 200, *[1.0] * 8, 4.0, 1.8, 1.5)]
    return spark.createDataFrame(rows, DDL).cache()


def test_strips_match_what_all_candidates_match(spark):
    tracks = _tracks(spark)
    costs = matching.link_candidates(tracks, LIMITS, 500).withColumn("cost", F.round("cost", 9))
    want = {tuple(r) for r in matching.greedy_match(costs, ["id_record"]).select("id_record", "i", "j").collect()}
    assert len(want) > 200
    for strip_rows in (100_000, 300, 60):
        got = [tuple(r) for r in match_links(tracks, LIMITS, 500, digits=9, strip_rows=strip_rows).collect()]
        assert len(got) == len(want) and set(got) == want


def test_candidates_are_not_shuffled(spark, sf):
    plan = queries.QUERIES["greedy_match"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Join Inner" not in plan
