"""Tracking objects through the frames of a record: predict, match, correct, start and end tracks.

A record is one camera's minutes, so its frames follow one another and a task goes through them with the few tracks that
are alive; records are dealt out over the cluster. The same state machine serves whole tables (`track`) and streams
(`waymeet.streaming.tracking`).

Defined results: frames without detections count, as they lie between frames that have some; a detection without a
place, size, yaw or known class can neither match nor start a track; of a repeated detection only one matches, and the
other one overlaps it, so it starts no track; detections of a frame are taken in the order of place, class and score, so
that their order in the table does not matter; null scores count as 0; a null frame or record is left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import astuple, dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import COST_LIMITS, OBJECT_CLASSES, START_KMH

NAMES = [c[0] for c in OBJECT_CLASSES]
#: Variances (fixed values): of a new track, added a frame to place and size and to speed, of a measured place and size.
START, MOVES, DRIFTS, SEES_PLACE, SEES_SIZE = 10.0, 1.0, 0.01, 1.0, 10.0
DETECTION = ("x", "y", "z", "length", "width", "height", "yaw", "class_name", "score")
OUT_DDL = (
    "id_record long, frame_id long, id_vehicle long, class_name string, x double, y double, z double, vx double, vy double, vz double, "
    "length double, width double, height double, yaw double, detected boolean, valid boolean, banned boolean, state string"
)
CANDIDATE, ACTIVE, FINISHED, DROPPED = "candidate", "active", "finished", "dropped"


@dataclass(frozen=True)
class Rules:
    """When tracks are judged, banned and ended, and where detections count.

    zones: polygons of (x, y) in which places are valid, in pixels if there is a camera (a 3 x 4 matrix, row by row),
    else on the ground; none means everywhere.
    """

    limits: tuple[tuple[str, float], ...] = tuple(COST_LIMITS.items())
    weight: float = 0.5
    dt: float = 1 / 30
    early: int = 10
    early_share: float = 0.5
    lost_after: int = 10
    least_frames: int = 3
    ban_early: tuple[int, int] = (10, 30)
    ban_at: int = 100
    ban_metres: float = 0.5
    ban_pixels: float = 5.0
    ban_judged: tuple[int, int] = (110, 300)
    ban_most: int = 100
    zones: tuple[tuple[tuple[float, float], ...], ...] = ()
    camera: tuple[float, ...] = ()

    def pixel(self, x: float, y: float, z: float) -> tuple[float, float]:
        """Where the camera sees a place, in whole pixels; the place itself without a camera."""
        if not self.camera:
            return x, y
        u, v, w = (self.camera[4 * r] * x + self.camera[4 * r + 1] * y + self.camera[4 * r + 2] * z + self.camera[4 * r + 3] for r in range(3))
        return (float(round(u / w)), float(round(v / w))) if w else (math.inf, math.inf)

    def valid(self, px: float, py: float) -> bool:
        return not self.zones or any(_inside(px, py, z) for z in self.zones)


def _inside(x: float, y: float, zone: tuple[tuple[float, float], ...]) -> bool:
    odd = False
    for (ax, ay), (bx, by) in zip(zone, zone[1:] + zone[:1], strict=True):
        if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
            odd = not odd
    return odd


@dataclass
class Track:
    """A track's filter and counters. Place and speed of an axis have the covariances a, b, c; a size has the variance d.

    None of the filter's matrices ties axes or sizes together, so this is the nine-state filter taken apart.
    """

    id: int
    votes: list[int]
    x: float
    y: float
    z: float
    length: float
    width: float
    height: float
    vx: float
    vy: float
    vz: float
    yaw: float
    first_px: float
    first_py: float
    first_x: float
    first_y: float
    first_z: float
    sum_length: float
    sum_width: float
    sum_height: float
    a: float = START
    b: float = 0.0
    c: float = START
    d: float = START
    frames: int = 1
    seen: int = 1
    missed: int = 0
    outside: int = 0
    banned: int = 0
    #: Whether the last frames were in a zone, the newest in the lowest bit.
    valid_bits: int = 1
    path: float = 0.0
    at_x: float = 0.0
    at_y: float = 0.0
    at_z: float = 0.0

    @classmethod
    def start(cls, number: int, det: tuple, rules: Rules) -> Track:
        """Its first speed is its class's, along its yaw."""
        x, y, z, length, width, height, yaw, kind, _ = det
        speed = START_KMH[kind] / 3.6
        vx, vy = speed * math.cos(yaw), speed * math.sin(yaw)
        votes = [int(n == kind) for n in NAMES]
        return cls(number, votes, x, y, z, length, width, height, vx, vy, 0.0, math.atan2(vy, vx) % (2 * math.pi), *rules.pixel(x, y, z), x, y, z, length, width, height, at_x=x, at_y=y, at_z=z)

    @property
    def kind(self) -> str:
        """The class it was seen as most often; the smallest name of equals."""
        top = max(self.votes)
        return min(n for n, v in zip(NAMES, self.votes, strict=True) if v == top)

    def sizes(self) -> tuple[float, float, float]:
        """Mean size, as filtered, over the frames it was seen in."""
        return self.sum_length / self.seen, self.sum_width / self.seen, self.sum_height / self.seen

    def predict(self, dt: float) -> None:
        self.x, self.y, self.z = self.x + dt * self.vx, self.y + dt * self.vy, self.z + dt * self.vz
        self.a, self.b, self.c = self.a + 2 * dt * self.b + dt * dt * self.c + MOVES, self.b + dt * self.c, self.c + DRIFTS
        self.d += MOVES

    def correct(self, det: tuple) -> None:
        g, h, k = self.a / (self.a + SEES_PLACE), self.b / (self.a + SEES_PLACE), self.d / (self.d + SEES_SIZE)
        dx, dy, dz = det[0] - self.x, det[1] - self.y, det[2] - self.z
        self.x, self.y, self.z = self.x + g * dx, self.y + g * dy, self.z + g * dz
        self.vx, self.vy, self.vz = self.vx + h * dx, self.vy + h * dy, self.vz + h * dz
        self.length, self.width, self.height = self.length + k * (det[3] - self.length), self.width + k * (det[4] - self.width), self.height + k * (det[5] - self.height)
        self.a, self.b, self.c, self.d = (1 - g) * self.a, (1 - g) * self.b, self.c - h * self.b, (1 - k) * self.d

    def stand(self) -> None:
        self.vx = self.vy = self.vz = 0.0

    def go_on(self, det: tuple | None, rules: Rules) -> None:
        """A frame with the detection that matched it, if one did."""
        self.frames += 1
        if det is not None:
            self.correct(det)
            self.votes[NAMES.index(det[7])] += 1
            self.seen, self.missed = self.seen + 1, 0
            self.sum_length, self.sum_width, self.sum_height = self.sum_length + self.length, self.sum_width + self.width, self.sum_height + self.height
        else:
            self.missed += 1
            if self.banned:
                self.stand()
        self.yaw = math.atan2(self.vy, self.vx) % (2 * math.pi)
        px, py = rules.pixel(self.x, self.y, self.z)
        inside = rules.valid(px, py)
        self.outside = 0 if inside else self.outside + 1
        self.valid_bits = (self.valid_bits << 1 | inside) & 1023
        self.path += math.dist((self.x, self.y, self.z), (self.at_x, self.at_y, self.at_z))
        self.at_x, self.at_y, self.at_z = self.x, self.y, self.z
        if self.banned:
            self.banned += 1
        elif rules.ban_early[0] < self.frames < rules.ban_early[1]:
            if not (inside and self.valid_bits >> 9 & 1) or self.path < rules.ban_metres:
                self.banned = 1
        elif self.frames == rules.ban_at:
            still = math.dist((self.x, self.y, self.z), (self.first_x, self.first_y, self.first_z)) < rules.ban_metres
            if still or (rules.camera and math.dist((px, py), (self.first_px, self.first_py)) < rules.ban_pixels):
                self.banned = 1
        if self.banned == 1:
            self.stand()

    def state(self, rules: Rules) -> str:
        if self.frames < rules.early:
            return CANDIDATE
        if self.frames == rules.early and self.seen / self.frames < rules.early_share:
            return DROPPED
        if self.missed >= rules.lost_after or self.outside >= rules.lost_after:
            return FINISHED
        if rules.ban_judged[0] < self.frames < rules.ban_judged[1] and self.banned >= rules.ban_most:
            return DROPPED
        return ACTIVE

    def row(self, record: int, frame: int, state: str) -> tuple:
        return (
            record, frame, self.id, self.kind, self.x, self.y, self.z, self.vx, self.vy, self.vz, self.length, self.width, self.height, self.yaw,
            self.missed == 0, self.outside == 0, self.banned > 0, state,
        )


TRACK_DDL = ", ".join(f"{f.name} {'array<int>' if f.name == 'votes' else 'long' if f.type == 'int' else 'double'}" for f in fields(Track))


def overlap(ax: float, ay: float, al: float, aw: float, ayaw: float, bx: float, by: float, bl: float, bw: float, byaw: float) -> bool:
    """Whether two turned boxes share an area: no side of either keeps them apart."""
    dx, dy = bx - ax, by - ay
    c, s = abs(math.cos(byaw - ayaw)), abs(math.sin(byaw - ayaw))
    for yaw, l1, w1, l2, w2 in ((ayaw, al, aw, bl, bw), (byaw, bl, bw, al, aw)):
        u, v = abs(dx * math.cos(yaw) + dy * math.sin(yaw)), abs(dy * math.cos(yaw) - dx * math.sin(yaw))
        if u >= (l1 + l2 * c + w2 * s) / 2 or v >= (w1 + l2 * s + w2 * c) / 2:
            return False
    return True


@dataclass
class Tracker:
    """The tracks of one record that are alive, up to its frame `last`."""

    record: int
    rules: Rules
    next_id: int = 1
    last: int | None = None
    tracks: list[Track] | None = None

    def __post_init__(self) -> None:
        self.tracks = self.tracks or []

    def _matches(self, dets: list[tuple]) -> dict[int, int]:
        """track -> detection, cheapest pairs first; of equals the earlier detection, then track."""
        if not dets or not self.tracks:
            return {}
        kinds = [t.kind for t in self.tracks]
        place = np.array([(t.x, t.y, t.z, *t.sizes()) for t in self.tracks])
        seen = np.array([d[:6] for d in dets])
        away = (seen[:, None, :] - place[None, :, :]) * np.array([2.0, 2, 2, 1, 1, 1])
        turn = np.array([d[6] for d in dets])[:, None] - np.array([t.yaw for t in self.tracks])[None, :]
        sure = np.array([d[8] for d in dets])[:, None]
        same = np.array([d[7] for d in dets])[:, None] == np.array(kinds)[None, :]
        cost = np.sqrt((away * away).sum(axis=2)) * (2 - np.cos(turn)) * (1 + self.rules.weight * np.where(same, 1 - sure, sure))
        limits = dict(self.rules.limits)
        i, j = np.nonzero(cost <= np.array([limits[k] for k in kinds])[None, :])
        got: dict[int, int] = {}
        used: set[int] = set()
        for k in np.lexsort((j, i, cost[i, j])):
            if i[k] not in used and j[k] not in got:
                got[int(j[k])] = int(i[k])
                used.add(i[k])
        return got

    def _frame(self, number: int, dets: list[tuple]) -> list[tuple]:
        self.last = number
        for t in self.tracks:
            t.predict(self.rules.dt)
        foreseen = [(t.x, t.y) for t in self.tracks]
        match = self._matches(dets)
        for j, t in enumerate(self.tracks):
            taken = j in match and not t.banned
            t.go_on(dets[match[j]] if taken else None, self.rules)
        old = [(x, y, *t.sizes()[:2], t.yaw) for (x, y), t in zip(foreseen, self.tracks, strict=True)]
        used = set(match.values())
        for i, d in enumerate(dets):
            if i not in used and not any(overlap(d[0], d[1], d[3], d[4], d[6], *box) for box in old):
                self.tracks.append(Track.start(self.next_id, d, self.rules))
                self.next_id += 1
        told = [(t, t.state(self.rules)) for t in self.tracks]
        self.tracks = [t for t, s in told if s in (CANDIDATE, ACTIVE)]
        return [t.row(self.record, number, s) for t, s in told]

    def frame(self, number: int, dets: Iterable[tuple]) -> list[tuple]:
        """Rows of this frame and of the empty ones before it, as long as a track is alive."""
        out: list[tuple] = []
        while self.last is not None and self.tracks and self.last + 1 < number:
            out += self._frame(self.last + 1, [])
        known = (d for d in dets if d[7] in NAMES and all(v is not None and math.isfinite(v) for v in d[:7]))
        return out + self._frame(number, sorted((*d[:8], d[8] if d[8] is not None and math.isfinite(d[8]) else 0.0) for d in known))

    def stop(self) -> list[tuple]:
        """The end of the record: tracks of a few frames are dropped, the others finished."""
        out = [t.row(self.record, self.last, FINISHED if t.frames >= self.rules.least_frames else DROPPED) for t in self.tracks]
        self.tracks = []
        return out


def packed(t: Track) -> tuple:
    return astuple(t)


def unpacked(values: Iterable) -> Track:
    got = [list(v) if isinstance(v, (list, np.ndarray)) else v for v in values]
    return Track(*(int(v) if f.type == "int" else v for f, v in zip(fields(Track), got, strict=True)))


def as_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}
    schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in OUT_DDL.split(", ")])
    columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def track(detections: DataFrame, rules: Rules = Rules(), *, batch_rows: int = 10_000) -> DataFrame:
    """A row for every track and frame, with the state the track is in; its last row says finished or dropped.

    detections: id_record, frame_id, x, y, z, length, width, height, yaw, class_name, score.
    """
    kept = detections.select(F.col("id_record").cast("long"), F.col("frame_id").cast("long"), *(F.col(c).cast("string" if c == "class_name" else "double").alias(c) for c in DETECTION))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, frame, dets, out = None, None, [], []
        for batch in batches:
            for record, number, *det in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or record != now.record or number != frame:
                    if now is not None:
                        out += now.frame(frame, dets)
                    if now is None or record != now.record:
                        out += now.stop() if now is not None else []
                        now = Tracker(record, rules)
                    frame, dets = number, []
                dets.append(tuple(det))
            if len(out) >= batch_rows:
                yield as_batch(out)
                out = []
        if now is not None:
            out += now.frame(frame, dets) + now.stop()
        yield as_batch(out)

    ready = kept.filter("id_record is not null and frame_id is not null")
    return ready.repartition("id_record").sortWithinPartitions("id_record", "frame_id").mapInArrow(run, OUT_DDL)
