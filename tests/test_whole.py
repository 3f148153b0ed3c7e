"""Queries answer for the whole table: results against SQL and scenes that leave nothing out."""

import datetime

import duckdb
import pytest

from waymeet.plans import queries, views


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    c.sql(f"create view events as select * from read_parquet('{sf}/events.parquet')")
    return c


def test_zones_judge_points_with_y_20(spark, sf, con):
    lower_edge = "(y = 20 and x between 100 and 200)"
    want = con.sql(f"with {views.points_sql()} select event_id from points where ({queries._INSIDE}) and not {lower_edge}").fetchall()
    got = [tuple(r) for r in queries.QUERIES["point_in_zone"](spark, sf).collect()]
    assert sorted(got) == sorted(want)
    assert con.sql(f"with {views.points_sql()} select event_id from points where y = 20 and ({queries._INSIDE}) and not {lower_edge}").fetchall()


def test_every_instant_is_answered(spark, sf, con):
    want = con.sql(f"with {views.points_sql()} select id_record, us, id_vehicle, ord + 1 from points").fetchall()
    got = [tuple(r) for r in queries.QUERIES["active_tracks"](spark, sf).select("id_record", "ask_us", "id_vehicle", "history").collect()]
    assert sorted(got) == sorted(want)


@pytest.fixture(scope="module")
def crossing(spark, tmp_path_factory):
    """Six vehicles east and six north over one place, one far from all: their numbers start at 101."""
    paths = [[(100.0 * k, 200) for k in range(5)]] * 6 + [[(200.0, 100 * k) for k in range(5)]] * 6 + [[(5000.0 + 100 * k, 9000) for k in range(5)]]
    start = datetime.datetime(2024, 1, 1)
    rows = [(100 * v + k, start + datetime.timedelta(seconds=k), 101 + v, "view", x, f"y{y}") for v, path in enumerate(paths) for k, (x, y) in enumerate(path)]
    folder = str(tmp_path_factory.mktemp("crossing"))
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{folder}/events.parquet")
    return folder


def test_manoeuvres_come_from_all_tracks(spark, crossing):
    got = {(r[0], r[1]): r[2] for r in queries.QUERIES["maneuver_classify"](spark, crossing).collect()}
    assert len(got) == 16 and got[0, 1] == got[1, 0] == "Crossing" and got[0, 0] == got[1, 1] == "Following"


def test_tracks_are_assigned_to_curves_of_all_tracks(spark, crossing, sf):
    got = {r["id"]: r["cluster"] for r in queries.QUERIES["curve_distance_assign"](spark, crossing).collect()}
    assert [got[i] for i in range(101, 114)] == [0] * 6 + [1] * 6 + [-1]
    none = queries.QUERIES["curve_distance_assign"](spark, sf)  # fewer than five tracks are near one another
    assert {tuple(r) for r in none.select("cluster", "total").collect()} == {(-1, None)} and none.count() == 15
