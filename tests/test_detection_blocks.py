"""Suppression of many frames at once, and metrics in as many ranges as the rows need."""

import numpy as np

from waymeet.operators import detections


def _plain(rows, iou, most_in, most_out):
    kept = []
    for f in {r[0] for r in rows}:
        best = sorted((r for r in rows if r[0] == f), key=lambda r: (-r[3], r[1], *r[4:]))[:most_in]
        stay = []
        for r in best:
            hit = False
            for k in stay:
                both = max(0, min(k[6], r[6]) - max(k[4], r[4])) * max(0, min(k[7], r[7]) - max(k[5], r[5]))
                hit |= k[2] == r[2] and both > iou * ((k[6] - k[4]) * (k[7] - k[5]) + (r[6] - r[4]) * (r[7] - r[5]) - both)
            if not hit:
                stay.append(r)
        kept += stay[:most_out]
    return sorted(kept)


def test_frames_together_are_as_one_by_one(spark):
    rng = np.random.default_rng(8)
    rows = []
    for k in range(2500):
        x, y = float(rng.integers(0, 60)), float(rng.integers(0, 60))
        frame = int(rng.integers(0, 25)) if k % 5 else 99
        rows.append((frame, k, int(rng.integers(0, 3)), 0.3 + float(rng.integers(0, 7)) / 10, x, y, x + float(rng.integers(5, 40)), y + float(rng.integers(5, 40))))
    ddl = "frame_id long, det_id long, cls int, conf double, x1 double, y1 double, x2 double, y2 double"
    found = spark.createDataFrame(rows, ddl)
    for most_in, most_out in ((30_000, 300), (60, 12)):
        for size in ("10000", "7"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            got = sorted(map(tuple, detections.suppress(found, iou=0.45, most_in=most_in, most_out=most_out).collect()))
            assert got == _plain(rows, 0.45, most_in, most_out)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_a_box_of_no_place_leaves_its_frame_alone(spark):
    # before: no box of its frame was suppressed
    rows = [(None, 4, 0, 0.9, 0.0, 0.0, 10.0, 10.0), (None, 5, 0, 0.8, 0.0, 0.0, 10.0, 10.0), (1, 1, 0, 0.9, 0.0, 0.0, 10.0, 10.0), (1, 2, 0, 0.8, 1.0, 0.0, 10.0, 10.0), (1, 3, 0, 0.7, None, 0.0, 10.0, 10.0)]
    found = spark.createDataFrame(rows, "frame_id long, det_id long, cls int, conf double, x1 double, y1 double, x2 double, y2 double")
    assert sorted(r["det_id"] for r in detections.suppress(found).collect()) == [1, 3, 4]


def test_ranges_hold_no_more_of_a_larger_table(spark, monkeypatch):
    from pyspark.sql import functions as F

    from waymeet import storage

    monkeypatch.setattr(storage.tasks_for, "__defaults__", (100,))
    rng = np.random.default_rng(3)
    rows = [(int(k % 2), float(rng.integers(0, 5)) / 5, k, bool(rng.integers(0, 2))) for k in range(2000)]
    judged = spark.createDataFrame([*rows, *rows[:3]], "cls int, conf double, det_id long, tp boolean")
    truth = judged.filter("tp").groupBy("cls").agg((F.count(F.lit(1)) + 50).alias("n_truth"))
    pr = detections.precision_recall(judged, truth)
    assert pr.groupBy("part").count().agg(F.max("count")).first()[0] < 400
    got = {r["cls"]: r["ap"] for r in detections.average_precision(judged, truth).collect()}
    for cls in (0, 1):
        mine = sorted((r for r in [*rows, *rows[:3]] if r[0] == cls), key=lambda r: (-r[1], r[2]))
        tp = np.cumsum([r[3] for r in mine])
        recall, precision = tp / (tp[-1] + 50), tp / np.arange(1, len(mine) + 1)
        env = np.maximum.accumulate(precision[::-1])[::-1]
        at, first = np.unique(recall, return_index=True)
        xs, ys = np.r_[0.0, at] if at[0] > 0 else at, np.r_[1.0, env[first]] if at[0] > 0 else env[first]
        y = np.where(np.arange(101) / 100 > xs[-1], 0.0, np.interp(np.arange(101) / 100, xs, ys))
        assert abs(got[cls] - (y.sum() - (y[0] + y[-1]) / 2) / 100) < 1e-9
