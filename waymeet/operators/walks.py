"""Operators that go through a track row by row, because what comes next depends on where the last cut fell."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import START_KMH
from .tracker import DRIFTS, MOVES, SEES_PLACE, SEES_SIZE, START
from .tracks import KEY


def each_track(points: DataFrame, columns: list[str], walk: Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]], new: str, *, key: tuple[str, ...] = KEY, order: tuple = ("ord",)) -> DataFrame:
    """points (key, columns, and ord for tracks) with the columns `new` (DDL) that walk returns for the rows of one track, in order.

    Tracks are dealt out and sorted by Spark; a task goes through many of them and holds the rows of one batch and one
    track.
    """
    kept = points.select(*key, *(["ord"] if any(isinstance(o, str) and o == "ord" for o in order) else []), *columns)
    fields = [f.strip().split() for f in new.split(",")]
    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done(whole: pa.Table, ends: np.ndarray) -> pa.RecordBatch:
            at = {c: whole.column(c).to_numpy() for c in columns}
            made: dict[str, list] = {name: [] for name, _ in fields}
            for lo, hi in zip(ends[:-1], ends[1:], strict=True):
                out = walk({c: v[lo:hi] for c, v in at.items()})
                for name, _ in fields:
                    made[name].append(out[name])
            flat = whole.slice(ends[0], ends[-1] - ends[0]).combine_chunks().to_batches()
            arrays = flat[0].columns if flat else [pa.array([], f.type) for f in whole.schema]
            more = [pa.array(np.concatenate(made[name]), kinds[kind], from_pandas=True) for name, kind in fields]
            return pa.RecordBatch.from_arrays([*arrays, *more], names=[*whole.schema.names, *(name for name, _ in fields)])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            whole = pa.Table.from_batches(held)
            ids = [whole.column(k).to_numpy() for k in key]
            starts = np.flatnonzero(np.concatenate([[True], np.any([v[1:] != v[:-1] for v in ids], axis=0)]))
            if len(starts) > 1:
                yield done(whole, starts)
                held = whole.slice(starts[-1]).combine_chunks().to_batches()
        if held:
            whole = pa.Table.from_batches(held)
            yield done(whole, np.array([0, whole.num_rows]))

    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.schema)
    return kept.repartition(*key).sortWithinPartitions(*key, *order).mapInArrow(run, f"{ddl}, {new}")


def metre_yaw(points: DataFrame, distance: float = 1.0) -> DataFrame:
    """Adds yaw_way: rows from one stop to the next take the direction between both, where a stop is the first row more than `distance` from the last.

    Rows after the last stop keep their yaw.
    """

    def walk(at: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        x, y, out, start = at["x"], at["y"], at["yaw"].copy(), 0
        for i in range(2, len(x)):
            dx, dy = x[i] - x[start], y[i] - y[start]
            if np.hypot(dx, dy) > distance:
                out[start:i], start = np.arctan2(dy, dx), i
        return {"yaw_way": out}

    return each_track(points, ["x", "y", "yaw"], walk, "yaw_way double")


def bend(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Curvature by gradients of gradients; not a number where a path stands still."""
    gx, gy = np.gradient(x), np.gradient(y)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.abs(gx * np.gradient(gy) - gy * np.gradient(gx)) / (gx * gx + gy * gy) ** 1.5


def adaptive_segments(points: DataFrame, *, bent: float = 10.0, rows: int = 4) -> DataFrame:
    """Adds segment: one ends before the row with which its curvature, of `rows` rows or more, exceeds `bent` anywhere.

    The last segment is left out if it has fewer rows (its segment is null).
    """

    def walk(at: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        x, y, out, start, k = at["x"], at["y"], np.zeros(len(at["x"])), 0, 0
        for i in range(len(x)):
            # only the last rows' gradients change with a row more, and curvature elsewhere has been looked at
            if i + 1 - start >= rows and (bend(x[max(start, i - 5) : i + 1], y[max(start, i - 5) : i + 1])[-3 if i - start > 5 else 0 :] > bent).any():
                start, k = i, k + 1
            out[i] = k
        if len(x) - start < rows:
            out[start:] = np.nan
        return {"segment": out}

    return each_track(points, ["x", "y"], walk, "segment double")


#: What the filter adds: place and speed of the axes, and the sizes.
FILTERED = ("kx", "ky", "kz", "kvx", "kvy", "kvz", "klength", "kwidth", "kheight")


def kalman(points: DataFrame, dt: float = 1 / 30) -> DataFrame:
    """Constant-velocity Kalman filter over place and size of every track; rows not detected are predicted only.

    The first speed is that of the row's class along its yaw. The nine-state filter falls apart into one filter of place
    and speed an axis and one of each size, as none of its matrices ties them together; all axes and all sizes share the
    course of their gains.
    """
    columns = ["x", "y", "z", "length", "width", "height", "yaw", "detected"]

    def walk(at: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        z, seen = np.stack([at[c] for c in columns[:6]], axis=1), at["detected"]
        pace, yaw = at["start_speed"][0], at["yaw"][0]
        place, speed, size = z[0, :3].copy(), np.array([pace * np.cos(yaw), pace * np.sin(yaw), 0.0]), z[0, 3:].copy()
        a, b, c, d = START, 0.0, START, START
        out = np.empty((len(z), 9))
        out[0] = *place, *speed, *size
        for k in range(1, len(z)):
            place = place + dt * speed
            a, b, c, d = a + 2 * dt * b + dt * dt * c + MOVES, b + dt * c, c + DRIFTS, d + MOVES
            if seen[k]:
                g, h, j, off = a / (a + SEES_PLACE), b / (a + SEES_PLACE), d / (d + SEES_SIZE), z[k, :3] - place
                place, speed, size = place + g * off, speed + h * off, size + j * (z[k, 3:] - size)
                a, b, c, d = (1 - g) * a, (1 - g) * b, c - h * b, (1 - j) * d
            out[k] = *place, *speed, *size
        return {n: out[:, i] for i, n in enumerate(FILTERED)}

    pace = F.coalesce(*(F.when(F.col("class_name") == k, F.lit(v / 3.6)) for k, v in START_KMH.items()), F.lit(0.0))
    paced = points.withColumn("start_speed", pace)
    return each_track(paced, [*columns, "start_speed"], walk, ", ".join(f"{n} double" for n in FILTERED)).drop(*columns, "start_speed")
