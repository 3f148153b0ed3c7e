"""The tracker against a plain version with full matrices and whole histories, its life-cycle rules, and on a stream."""

import datetime
import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymeet.operators import matching, tracker, walks
from waymeet.operators.tracker import ACTIVE, CANDIDATE, DROPPED, FINISHED, Rules, Tracker
from waymeet.plans import views
from waymeet.streaming import tracking

DDL = "id_record long, frame_id long, frame_ts timestamp, x double, y double, z double, length double, width double, height double, yaw double, class_name string, score double"
KMH = {"motorcycle": 30, "car": 50, "truck": 25, "bus": 25, "bicycle": 15, "person": 7, "e-scooter": 20}
LIMIT = {"motorcycle": 7.5, "car": 9, "truck": 9, "bus": 9, "person": 2.5, "bicycle": 5, "e-scooter": 5}


def corners(x, y, length, width, yaw):
    c, s = math.cos(yaw), math.sin(yaw)
    return [(x + c * a - s * b, y + s * a + c * b) for a, b in ((-length / 2, -width / 2), (length / 2, -width / 2), (length / 2, width / 2), (-length / 2, width / 2))]


def common_area(a, b):
    """Of two convex polygons, by cutting one with each side of the other."""
    for (px, py), (qx, qy) in zip(b, b[1:] + b[:1]):
        side = lambda v: (qx - px) * (v[1] - py) - (qy - py) * (v[0] - px)  # noqa: E731, B023
        out = []
        for v, w in zip(a, a[1:] + a[:1]):
            if side(v) >= 0:
                out.append(v)
            if side(v) * side(w) < 0:
                t = side(v) / (side(v) - side(w))
                out.append((v[0] + t * (w[0] - v[0]), v[1] + t * (w[1] - v[1])))
        a = out
        if not a:
            return 0.0
    return abs(sum(v[0] * w[1] - w[0] * v[1] for v, w in zip(a, a[1:] + a[:1]))) / 2


class Plain:
    """One track: the nine-state filter in full, and everything it has been through."""

    F_ = np.eye(9)
    F_[0, 6] = F_[1, 7] = F_[2, 8] = 1 / 30
    H, Q, R = np.eye(6, 9), np.diag([1.0] * 6 + [0.01] * 3), np.diag([1.0] * 3 + [10.0] * 3)

    def __init__(self, number, d):
        v = KMH[d[7]] / 3.6
        self.number, self.s, self.p = number, np.array([*d[:6], v * math.cos(d[6]), v * math.sin(d[6]), 0.0]), np.eye(9) * 10
        self.places, self.sizes, self.kinds, self.detected, self.valid, self.banned, self.path = [self.s[:3].copy()], [self.s[3:6].copy()], [d[7]], [True], [True], [False], 0.0
        self.yaw = math.atan2(self.s[7], self.s[6]) % (2 * math.pi)

    def predict(self):
        self.s, self.p = self.F_ @ self.s, self.F_ @ self.p @ self.F_.T + self.Q
        self.ahead = self.s[:3].copy()

    def kind(self):
        seen = [k for k, d in zip(self.kinds, self.detected) if d]
        return min(set(seen), key=lambda k: (-seen.count(k), k))

    def size(self):
        return np.mean([s for s, d in zip(self.sizes, self.detected) if d], axis=0)

    def update(self, d, inside):
        if d is not None:
            gain = self.p @ self.H.T @ np.linalg.inv(self.H @ self.p @ self.H.T + self.R)
            self.s, self.p = self.s + gain @ (np.array(d[:6]) - self.H @ self.s), (np.eye(9) - gain @ self.H) @ self.p
        elif self.banned[-1]:
            self.s[6:] = 0
        self.detected.append(d is not None)
        self.kinds.append(d[7] if d else self.kinds[-1])
        self.path += float(np.linalg.norm(self.s[:3] - self.places[-1]))
        self.places.append(self.s[:3].copy())
        self.sizes.append(self.s[3:6].copy())
        self.yaw = math.atan2(self.s[7], self.s[6]) % (2 * math.pi)
        self.valid.append(inside(self.s[0], self.s[1]))
        n = len(self.places)
        new = self.banned[-1]
        if not new and 10 < n < 30:
            new = not (self.valid[-1] and self.valid[-10]) or self.path < 0.5
        elif not new and n == 100:
            new = np.linalg.norm(self.places[-1] - self.places[0]) < 0.5
        if new and not self.banned[-1]:
            self.s[6:] = 0
        self.banned.append(bool(new))

    def run(self, flags, value):
        n = 0
        for f in reversed(flags):
            if f != value:
                break
            n += 1
        return n

    def state(self):
        n = len(self.places)
        if n < 10:
            return CANDIDATE
        if n == 10 and sum(self.detected) / n < 0.5:
            return DROPPED
        if self.run(self.detected, False) >= 10 or self.run(self.valid, False) >= 10:
            return FINISHED
        return DROPPED if 110 < n < 300 and self.run(self.banned, True) >= 100 else ACTIVE


def plain_tracks(rows, inside=lambda x, y: True):
    """rows: (record, frame, detection); (record, frame, id, class, x, y, vx, vy, length, yaw, detected, valid, banned, state)."""
    out = []
    for record in sorted({r[0] for r in rows}):
        frames = {}
        for _, frame, d in (r for r in rows if r[0] == record):
            frames.setdefault(frame, []).append(d)
        live, number = [], 1
        for frame in range(min(frames), max(frames) + 1):
            dets = sorted(frames.get(frame, []))
            for t in live:
                t.predict()
            pairs = []
            for j, t in enumerate(live):
                for i, d in enumerate(dets):
                    off = np.array([*(2 * (np.array(d[:3]) - t.ahead)), *(np.array(d[3:6]) - t.size())])
                    cost = np.linalg.norm(off) * (2 - math.cos(d[6] - t.yaw)) * (1 + 0.5 * (1 - d[8] if d[7] == t.kind() else d[8]))
                    if cost <= LIMIT[t.kind()]:
                        pairs.append((cost, i, j))
            of, used = {}, set()
            for _, i, j in sorted(pairs):
                if i not in used and j not in of:
                    of[j] = i
                    used.add(i)
            for j, t in enumerate(live):
                t.update(dets[of[j]] if j in of and not t.banned[-1] else None, inside)
            old = [corners(*t.ahead[:2], *t.size()[:2], t.yaw) for t in live]
            for i, d in enumerate(dets):
                if i not in used and all(common_area(corners(d[0], d[1], d[3], d[4], d[6]), o) < 1e-12 for o in old):
                    live.append(Plain(number, d))
                    number += 1
            say = lambda t, s: out.append((record, frame, t.number, t.kind(), *t.s[:2], *t.s[6:8], t.s[3], t.yaw, t.detected[-1], t.valid[-1], t.banned[-1], s))  # noqa: E731, B023
            for t in live:
                say(t, t.state())
            live = [t for t in live if t.state() in (CANDIDATE, ACTIVE)]
        for t in live:
            say(t, FINISHED if len(t.places) >= 3 else DROPPED)
    return out


def same(got, want):
    pick = lambda r: (r["id_record"], r["frame_id"], r["id_vehicle"], r["class_name"], r["x"], r["y"], r["vx"], r["vy"], r["length"], r["yaw"], r["detected"], r["valid"], r["banned"], r["state"])
    key = lambda r: (*r[:3], r[-1])
    got, want = sorted(map(pick, got), key=key), sorted(want, key=key)
    assert [key(r) for r in got] == [key(r) for r in want]
    for a, b in zip(got, want):
        assert a[3] == b[3] and a[10:] == b[10:] and list(a[4:9]) == pytest.approx([float(v) for v in b[4:9]], abs=1e-6)
        assert math.cos(a[9] - b[9]) == pytest.approx(1, abs=1e-9)


def scene(seed=1, n=170):
    rng, rows = random.Random(seed), []
    for r in (1, 2):
        for k in range(n):
            for v in range(6):
                if rng.random() < 0.8 and v * 15 <= k < v * 15 + (120 if v != 2 else 170):
                    pace = 0.0 if v == 2 else 0.4
                    rows.append((r, k, pace * (k - v * 15) + rng.gauss(0, 0.1) * (v != 2), 10.0 * v + rng.gauss(0, 0.05), 0.0, 3.6, 1.8, 1.4, rng.gauss(0, 0.1), rng.choice(["car", "car", "truck"]), 0.8))
        rows += [(r, k, 200.0, 200.0, 0.0, 1.0, 1.0, 1.0, 0.0, "person", 0.6) for k in (5, 90, 91)]
    t0 = datetime.datetime(2025, 1, 1)
    return [(r, k, t0 + datetime.timedelta(microseconds=33_333 * k), *rest) for r, k, *rest in rows]


def test_tracks_of_a_scene_equal_the_plain_version(spark):
    zone = ((-5.0, -50.0), (30.0, -50.0), (30.0, 250.0), (-5.0, 250.0))
    got = tracker.track(spark.createDataFrame(scene(), DDL).repartition(3), Rules(zones=(zone,))).collect()
    same(got, plain_tracks([(r[0], r[1], r[3:]) for r in scene()], lambda x, y: -5 <= x < 30 and -50 <= y < 250))
    states = {r["state"] for r in got}
    assert states == {CANDIDATE, ACTIVE, FINISHED, DROPPED} and any(r["banned"] for r in got)


def test_tracks_of_a_whole_table_equal_the_plain_version(spark):
    table = views.detections(spark, "/root/testdata/sf0.01")
    given = [(r["id_record"], r["frame_id"], tuple(r[c] for c in tracker.DETECTION)) for r in table.collect()]
    same(tracker.track(table).collect(), plain_tracks(given))


def car(k, y=0.0, x=None, score=0.9):
    return (0.46 * k if x is None else x, y, 0.0, 3.6, 1.8, 1.4, 0.0, "car", score)


def states_of(frames, rules=Rules()):
    """(frame, id) -> state."""
    machine, out = Tracker(1, rules), []
    for number, dets in frames:
        out += machine.frame(number, dets)
    out += machine.stop()
    return {(r[1], r[2]): r[-1] for r in out}


def test_a_gap_over_the_judging_frame_is_judged():
    got = states_of([(k, [car(k)]) for k in (0, 1, 2, 11, 12)])
    assert got[9, 1] == DROPPED and (10, 1) not in got


def test_lost_and_invalid_tracks_finish():
    got = states_of([(k, [car(k)] if k < 15 else []) for k in range(40)])
    assert got[23, 1] == ACTIVE and got[24, 1] == FINISHED and (25, 1) not in got
    zone = ((-1.0, -5.0), (8.0, -5.0), (8.0, 5.0), (-1.0, 5.0))
    got = states_of([(k, [car(k)]) for k in range(60)], Rules(zones=(zone,), ban_early=(0, 0)))
    gone = max(k for k, i in got if i == 1)
    assert got[gone, 1] == FINISHED and 25 < gone < 30


def test_standing_tracks_are_banned_and_dropped():
    rules = Rules(ban_metres=50.0, lost_after=1000)
    machine, rows = Tracker(1, rules), []
    for k in range(130):
        rows += machine.frame(k, [car(0, x=5.0)])
    first = [r for r in rows if r[2] == 1]
    ban = next(r[1] for r in first if r[-2])
    assert ban == 10 and all(r[-2] for r in first if r[1] >= ban)
    assert not any(r[-4] for r in first if r[1] > ban), "a banned track ignores its matches"
    assert first[-1][-1] == DROPPED and first[-1][1] == 110, "100 banned frames, and longer than 110"


def test_far_classes_have_their_own_limits_and_overlaps_start_nothing():
    jump = lambda kind, size: states_of([(0, [(0.0, 0.0, 0.0, *size, 0.0, kind, 1.0)]), (1, [(3.0, 0.0, 0.0, *size, 0.0, kind, 1.0)])])
    assert {i for _, i in jump("car", (3.6, 1.8, 1.4))} == {1}
    assert {i for _, i in jump("person", (0.7, 0.7, 1.6))} == {1, 2}
    twice = states_of([(0, [car(0)]), (1, [car(1), car(1, y=0.5, score=0.4)]), (2, [car(2), car(2, y=9.0)])])
    assert {i for _, i in twice} == {1, 2}


def test_bad_detections_start_nothing():
    bad = [(None, *car(0)[1:]), (math.nan, *car(0)[1:]), (*car(0)[:7], "tram", 0.5), (*car(0)[:6], None, "car", 0.5)]
    assert states_of([(0, bad), (1, [])]) == {}
    assert {s for (f, _), s in states_of([(0, [(*car(0)[:8], None)]), (5_000_000, [])]).items() if f >= 9} == {DROPPED}


def test_lost_car_goes_on_at_its_speed(spark):
    rows = [(1, 1, k, 10 / 30 * k, 0.0, 0.0, 3.6, 1.8, 1.4, 0.0, "car", k < 3) for k in range(13)]
    pts = spark.createDataFrame(rows, "id_record long, id_vehicle long, ord long, x double, y double, z double, length double, width double, height double, yaw double, class_name string, detected boolean")
    got = matching.kalman(pts).orderBy("ord").collect()
    t = Plain(1, (*rows[0][3:10], "car"))
    for k in range(1, 13):
        t.predict()
        t.update((*rows[k][3:10], "car") if k < 3 else None, lambda x, y: True)
        assert [got[k][c] for c in walks.FILTERED] == pytest.approx([*t.s[:3], *t.s[6:], *t.s[3:6]])
    assert got[12]["kx"] > 3.5


def test_stream_equals_batch_also_after_a_restart(spark, tmp_path):
    rng, rows = random.Random(3), scene(4, 140)
    want = sorted(map(tuple, tracker.track(spark.createDataFrame(rows, DDL)).collect()))
    rows.sort(key=lambda r: r[1] + rng.randrange(6))
    late = datetime.datetime(2025, 1, 1, 1)
    ends = [(9, k, late + datetime.timedelta(seconds=30 * k), *car(0)) for k in range(3)]
    parts = [rows[k * len(rows) // 4 : (k + 1) * len(rows) // 4] for k in range(4)]

    def put(number, part):
        target = tmp_path / f"part{number:02d}"
        spark.createDataFrame(part, DDL).coalesce(1).write.parquet(str(target))
        (file,) = target.glob("*.parquet")
        (tmp_path / "in").mkdir(exist_ok=True)
        file.rename(tmp_path / "in" / f"{number:02d}.parquet")

    def go():
        stream = spark.readStream.schema(DDL).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "in"))
        writer = tracking.stream_tracks(stream, late="1 second", idle_ms=20_000).writeStream.format("parquet").option("path", str(tmp_path / "out"))
        query = writer.option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
        assert query.awaitTermination(240)

    for k, part in enumerate(parts[:2]):
        put(k, part)
        time.sleep(1.1)
    go()
    for k, part in enumerate([*parts[2:], *([e] for e in ends)], 2):
        put(k, part)
        time.sleep(1.1)
    go()
    got = spark.read.schema(tracker.OUT_DDL).parquet(str(tmp_path / "out")).filter(F.col("id_record") < 9)
    assert sorted(map(tuple, got.collect())) == want
