"""Tracks from a stream of detections: state and event-time timers for each record, frames strictly in order.

Detections wait in the record's state until the watermark has passed their frame, so rows of one frame may come in
several micro-batches and frames in any order within the allowed lateness; what is worked off does not depend on how the
stream was cut into batches. A timer at the newest frame works off the waiting ones, and one more, `idle` after it, ends
the record's tracks.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.tracker import DETECTION, OUT_DDL, TRACK_DDL, Rules, Tracker, packed, unpacked

CLOCK_DDL = "next_id long, last long, seen_ms long"
WAITING_DDL = "ms long, rows array<struct<x: double, y: double, z: double, length: double, width: double, height: double, yaw: double, class_name: string, score: double>>"
COLUMNS = [c.split()[0] for c in OUT_DDL.split(", ")]


class RecordTracks(StatefulProcessor):
    """State of a record: its clock, its tracks by number, and the detections that wait, by frame."""

    def __init__(self, rules: Rules, idle_ms: int) -> None:
        self.rules, self.idle_ms = rules, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.clock = handle.getValueState("clock", CLOCK_DDL)
        self.tracks = handle.getMapState("tracks", "id long", TRACK_DDL)
        self.waiting = handle.getMapState("waiting", "frame_id long", WAITING_DDL)

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        next_id, last, newest = self.clock.get() if self.clock.exists() else (1, None, 0)
        got = pd.concat(list(rows), ignore_index=True)
        got["ms"] = got["frame_ts"].astype("datetime64[us]").astype("int64") // 1000
        before = newest
        for frame, part in got.groupby("frame_id", sort=True):
            if last is not None and frame <= last:
                continue  # its moment is past
            _, held = self.waiting.getValue((int(frame),)) if self.waiting.containsKey((int(frame),)) else (0, [])
            more = [tuple(None if pd.isna(v) else v for v in r) for r in part[list(DETECTION)].itertuples(index=False, name=None)]
            ms = int(part["ms"].max())
            self.waiting.updateValue((int(frame),), (ms, [*map(tuple, held), *more]))
            newest = max(newest, ms)
        if newest > before:
            self.handle.deleteTimer(before + self.idle_ms)
            self.handle.registerTimer(newest)
            self.handle.registerTimer(newest + self.idle_ms)
        self.clock.update((next_id, last, newest))
        yield pd.DataFrame(columns=COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.clock.exists():
            return
        next_id, last, newest = self.clock.get()
        now = expiredTimerInfo.getExpiryTimeInMs()
        alive = sorted((unpacked(v) for _, v in self.tracks.iterator()), key=lambda t: t.id)
        machine = Tracker(int(key[0]), self.rules, int(next_id), None if last is None else int(last), alive)
        was, out = {t.id for t in alive}, []
        for (frame,), (ms, rows) in sorted(((tuple(k), tuple(v)) for k, v in self.waiting.iterator()), key=lambda w: w[0]):
            if ms > now:
                break  # frames after one that still waits wait too
            out += machine.frame(int(frame), [tuple(r) for r in rows])
            self.waiting.removeKey((frame,))
        if now >= newest + self.idle_ms:
            out += machine.stop()
        for gone in was - {t.id for t in machine.tracks}:
            self.tracks.removeKey((gone,))
        for t in machine.tracks:
            self.tracks.updateValue((t.id,), packed(t))
        self.clock.update((machine.next_id, machine.last, newest))
        yield pd.DataFrame(out, columns=COLUMNS)


def stream_tracks(detections: DataFrame, rules: Rules = Rules(), *, late: str = "10 seconds", idle_ms: int = 600_000) -> DataFrame:
    """Rows of tracks for each frame, as `track` gives them for whole records.

    detections: a stream of id_record, frame_id, frame_ts (timestamp) and what `track` asks for. Rows that come more than
    `late` behind the newest are left out; idle_ms after a record's newest frame its tracks end. Needs Spark's RocksDB
    state store.
    """
    spark = detections.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    kept = detections.select(
        F.col("id_record").cast("long").alias("id_record"), F.col("frame_id").cast("long").alias("frame_id"), F.col("frame_ts").cast("timestamp").alias("frame_ts"),
        *(F.col(c).cast("string" if c == "class_name" else "double").alias(c) for c in DETECTION),
    )
    timed = kept.filter("id_record is not null and frame_id is not null and frame_ts is not null").withWatermark("frame_ts", late)
    return timed.groupBy("id_record").transformWithStateInPandas(RecordTracks(rules, idle_ms), OUT_DDL, "Append", "EventTime")
