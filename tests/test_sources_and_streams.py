"""Files in and out, and the streaming forms."""

import math
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from waymeet.sources import calibration, tables
from waymeet.streaming import encounters, tracking

START = datetime(2024, 1, 1)


def test_record_list(spark, tmp_path):
    (tmp_path / "r.csv").write_text("RecordID,RecordFrameStartTime\n3,2024-05-01 10:20:30\n1,not a time\n2,2024-05-01 10:10:30\n9,2024-05-01 11:10:30\n")
    rows = tables.records(spark, str(tmp_path / "r.csv"), 1, 3).collect()
    assert [r["RecordID"] for r in rows] == [1, 2, 3]
    assert [r["pattern"] for r in rows] == [None, "20240501T101030", "20240501T102030"]
    (tmp_path / "v").mkdir()
    for n in ("b_20240501T101030.txt", "a_20240501T101030.txt"):
        (tmp_path / "v" / n).write_text("x")
    found = {r["RecordID"]: r["path"] for r in tables.matching_files(spark, str(tmp_path / "v"), tables.records(spark, str(tmp_path / "r.csv"), 1, 3)).collect()}
    assert found[2].endswith("a_20240501T101030.txt") and found[3] is None


def test_trajectory_csv(spark, tmp_path):
    head = "idMeasurementSeries,idSensor,idRecord,FrameTimeStamp,FrameTimeStamp_MicroSec,idVehicle,ObjectClass,Length,Width,Height,posXFit,posYFit,posZFit,YawFit,VxFit,VyFit,VzFit,AxFit,AyFit,AzFit,YawRateFit,Cluster"
    lines = [f"1,1,7,2024-05-01 10:00:{k // 30:02d},{k % 30 * 33333},5,210,{3.5 + k},1.8,1.4,{k},0,0,0,0,0,0,0,0,0,0,{2 if k == 0 else -1}" for k in range(40)]
    (tmp_path / "t.csv").write_text("\n".join([head, *lines]))
    rows = tables.trajectories(spark, str(tmp_path / "t.csv")).orderBy("ord").collect()
    assert len(rows) == 20 and rows[0]["ord"] == 10 and rows[0]["class_name"] == "car"
    assert {r["length"] for r in rows} == {3.5} and {r["cluster"] for r in rows} == {2}


def test_conflict_csv_of_two_ages(spark, tmp_path):
    (tmp_path / "a.csv").write_text("idRecord,Indicator,idVehicle1,idVehicle2,Vehicle_Cluster_1,Vehicle_Cluster_2,Value,Auto_Rule_Flag\n1,PET3D,1,2,0,3,1.5,True\n1,PET3D,1,2,-1,3,1.5,\n")
    (tmp_path / "b.csv").write_text("idRecord,Indicator,idVehicle1,idVehicle2,Value\n2,PET2D,1,2,0.5\n")
    rows = tables.conflicts(spark, str(tmp_path / "a.csv"), str(tmp_path / "b.csv")).orderBy("idRecord").collect()
    assert [(r["idRecord"], r["Vehicle_Cluster_1"], r["Auto_Rule_Flag"]) for r in rows] == [(1, 0, True), (2, None, None)]


def test_writing_a_record_again_replaces_only_it(spark, tmp_path):
    out = str(tmp_path / "p")
    df = spark.createDataFrame([(1, 1.0), (2, 2.0)], "id_record long, x double")
    tables.write_points(df, out)
    tables.write_points(spark.createDataFrame([(2, 5.0)], "id_record long, x double"), out)
    assert sorted((r["id_record"], r["x"]) for r in spark.read.parquet(out).collect()) == [(1, 1.0), (2, 5.0)]
    assert [r["id_record"] for r in tables.not_written(spark.range(1, 4).select(F.col("id").alias("id_record")), out).collect()] == [3]


def test_frames_of_a_snippet(spark):
    df = spark.sql("select timestamp_ntz'2024-01-01 00:00:00' as start_ts, timestamp_ntz'2024-01-01 00:00:01' as end_ts")
    rows = tables.snippet_frames(df).orderBy("frame_id").collect()
    assert str(rows[-2]["frame_ts"]) < "2024-01-01 00:00:01" <= str(rows[-1]["frame_ts"])


def test_folder_positions_and_totals(spark):
    names = spark.createDataFrame([("c",), ("a",), ("b",)], "folder string")
    assert sorted(map(tuple, tables.folder_records(spark, names, "b", 10).collect())) == [("b", 10), ("c", 11)]
    times = spark.createDataFrame([(1, 5, 2.0), (2, 6, 3.0)], "id_record long, items long, seconds double")
    assert (None, 11, 5.0) in map(tuple, tables.timing_report(times).collect())


def test_calibration_numbers_and_zones(spark):
    assert calibration.numbers("<a><pos unit='m'> 1 -2.5 3e1 </pos></a>", "pos") == [1.0, -2.5, 30.0]
    assert calibration.zones(spark, [{"id": 1, "name": "z", "vertices": [[0, 0], [1, 0], [1, 1]]}]).first()["vertices"][2]["y"] == 1.0


def test_encounters_on_a_stream(spark, tmp_path):
    rows = []
    for k in range(120):
        t = k / 30
        rows.append((1, 1, -15 + 10 * t, 0.0, 0.0, 3.64, 1.82, START + timedelta(seconds=t)))
        rows.append((1, 2, 0.0, -15 + 10 * t, math.pi / 2, 3.64, 1.82, START + timedelta(seconds=t + 1)))
        rows.append((1, 3, 500.0, 500.0, 0.0, 3.64, 1.82, START + timedelta(seconds=t)))
    # 60 m apart, yet longer than that
    rows.append((1, 4, 2000.0, 0.0, 0.0, 70.0, 2.0, START))
    rows.append((1, 5, 2060.0, 0.0, 0.0, 70.0, 2.0, START + timedelta(seconds=1)))
    ddl = "id_record long, id_vehicle long, x double, y double, yaw double, length double, width double, event_time timestamp"
    spark.createDataFrame(rows, ddl).repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(ddl).parquet(str(tmp_path / "in"))
    q = encounters.stream_encounters(stream).writeStream.format("memory").queryName("met").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(120)
    found = spark.table("met").collect()
    assert {(r["later"], r["earlier"]) for r in found} == {(2, 1), (5, 4)}
    assert all(sum((r["event_time"], r["later"], r["earlier"]) == (o["event_time"], o["later"], o["earlier"]) and r["pet"] == o["pet"] for o in found) == 1 for r in found[:50])
    assert 0 < min(r["pet"] for r in found) < 1


def test_files_of_conflicts_curves_and_labels(spark, tmp_path):
    for name in ("a_Conflicts.csv", "b_conflicts.csv", "c_other.csv"):
        (tmp_path / name).write_text("x\n1\n")
    assert [p.rsplit("/", 1)[1] for p in tables.conflict_files(spark, str(tmp_path))] == ["a_Conflicts.csv", "b_conflicts.csv"]
    assert tables.cluster_means(spark, str(tmp_path / "none")) is None
    spark.createDataFrame([(0, [1.0, 2.0, 3.0], [0.0] * 3, [0.0] * 3)], "cluster_id int, cx array<double>, cy array<double>, cz array<double>").write.parquet(str(tmp_path / "means"))
    assert tables.cluster_means(spark, str(tmp_path / "means")).count() == 1
    row = tables.label_paths(spark.createDataFrame([("/d/images/a.b/x.jpg",)], "path string"), {"labels": ".txt", "maps": ".npy"}).first()
    assert (row["labels"], row["maps"]) == ("/d/labels/a.b/x.txt", "/d/maps/a.b/x.npy")


def test_raw_csv_round_trip_index_and_group_scores(spark, tmp_path):
    rows = spark.createDataFrame([(1, 2, 7, 11, 1.5, -2.0), (1, 2, 8, 12, 2.5, 3.0)], "idMeasurementSeries int, idSensor int, idRecord long, idVehicle long, posX double, posXFit double")
    tables.write_raw_csv(rows, str(tmp_path / "raw"))
    tables.write_raw_csv(rows.filter("idRecord = 8"), str(tmp_path / "raw"))
    back = tables.raw_csv(spark, str(tmp_path / "raw"))
    assert len(back.columns) == 34 and sorted((r["idRecord"], r["posX"], r["posXFit"], r["posY"]) for r in back.collect()) == [(7, 1.5, -2.0, None), (8, 2.5, 3.0, None)]
    spark.createDataFrame([(5,), (5,), (6,)], "idVehicle long").selectExpr("1 as idMeasurementSeries", "2 as idSensor", "3 as idRecord", "cast(null as string) as FrameTimeStamp", "0 as FrameTimeStamp_MicroSec", "idVehicle").coalesce(1).write.option("header", True).csv(str(tmp_path / "t"))
    assert sorted(r["id_vehicle"] for r in tables.trajectory_index(spark, str(tmp_path / "t")).collect()) == [5, 6]
    scores = spark.createDataFrame([(1, 2, 9, 1.7), (3, 4, 8, 0.9)], "c_a int, c_b int, id_vehicle long, lof double")
    tables.write_group_scores(scores, str(tmp_path / "g"))
    assert sorted(p.name for p in (tmp_path / "g").iterdir() if p.is_dir()) == ["c_a=1", "c_a=3"]


def test_zones_are_added_to_a_configuration(tmp_path):
    import numpy as np

    path = str(tmp_path / "c.yaml")
    calibration.write_zones(path, [{"name": "a", "vertices": [(0, 0), (1, 0), (1, 1)]}])
    assert [z["id"] for z in calibration.write_zones(path, [{"name": "b", "vertices": [(2, 2), (3, 2), (3, 3)]}])] == [1, 2]
    assert [z["name"] for z in calibration.write_zones(path, [{"name": "c", "vertices": [(2, 2), (3, 2), (3, 3)]}], replace=True)] == ["c"]
    assert calibration.read_config(path)["zones"][0]["vertices"] == [[2.0, 2.0], [3.0, 2.0], [3.0, 3.0]]
    assert np.allclose(calibration.axis_rotation(np.array([0, 0, 2.0]), np.pi / 2) @ [1, 0, 0], [0, 1, 0])
    camera = calibration.Calibration(np.array([[100.0, 0, 50], [0, 100, 50], [0, 0, 1]]), (0.0,) * 5, np.eye(4))
    low, high = calibration.frustum_box(camera, (100, 100), 10.0)
    assert np.allclose(low, [-5, -5, 0]) and np.allclose(high, [5, 5, 10])
