"""Mean tracks of clusters under time warping.

A cluster's barycentre starts as the mean of its tracks row by row and is as long as the longest of them. In each round
every track is laid against it along the path of least squared distance, and each place of the barycentre moves to the
mean of what was laid on it, until the distance no longer falls. Tracks travel once; a round sends the barycentres to
the tasks and a row for each place of one back, summed before it leaves a task.

Defined results: rows with a null or non-finite place, and tracks without a cluster (null or -1), take no part; a
cluster of one track is that track; ties of paths go to the diagonal, then to the track's step.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import bounded, store
from .tracks import KEY

SUM_DDL = "label int, place int, n double, x double, y double, z double, cost double, tracks long"
_SUMS = pa.schema([("label", pa.int32()), ("place", pa.int32()), *((c, pa.float64()) for c in ("n", "x", "y", "z", "cost")), ("tracks", pa.int64())])


def warp(track: np.ndarray, mean: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """The least sum of squared distances over monotone paths from both starts to both ends, and the path's rows of each.

    Cells are worked out diagonal by diagonal; a byte a cell is kept for the way back.
    """
    n, m = len(track), len(mean)
    way = np.zeros((n, m), np.uint8)
    before, last = np.full(n + 1, np.inf), np.full(n + 1, np.inf)  # by row + 1: the diagonal before the last, and the last
    before[0] = 0.0  # leads into the first cell
    for d in range(n + m - 1):
        i = np.arange(max(0, d - m + 1), min(n, d + 1))
        off = track[i] - mean[d - i]
        moves = np.stack([before[i], last[i], last[i + 1]])  # both step, the track steps, the mean steps
        best = moves.argmin(axis=0)
        way[i, d - i] = best
        now = np.full(n + 1, np.inf)
        now[i + 1] = moves[best, np.arange(len(i))] + (off * off).sum(axis=1)
        before, last = last, now
    i, j, path = n - 1, m - 1, [(n - 1, m - 1)]
    while i or j:
        step = way[i, j]
        i, j = i - (step != 2), j - (step != 1)
        path.append((i, j))
    rows = np.array(path[::-1])
    return float(last[n]), rows[:, 0], rows[:, 1]


def warp_all(tracks: np.ndarray, mean: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """`warp` for tracks of one length at once: their costs, and the paths backwards as steps (which tracks, their row, the mean's)."""
    b, n = tracks.shape[:2]
    m = len(mean)
    way = np.zeros((n, m, b), np.uint8)
    before, last = np.full((n + 1, b), np.inf), np.full((n + 1, b), np.inf)
    before[0] = 0.0
    rows = tracks.transpose(1, 0, 2)
    for d in range(n + m - 1):
        i = np.arange(max(0, d - m + 1), min(n, d + 1))
        off = rows[i] - mean[d - i][:, None, :]
        moves = np.stack([before[i], last[i], last[i + 1]])
        best = moves.argmin(axis=0)
        way[i, d - i] = best
        now = np.full((n + 1, b), np.inf)
        now[i + 1] = np.take_along_axis(moves, best[None], axis=0)[0] + (off * off).sum(axis=2)
        before, last = last, now
    who, i, j = np.arange(b), np.full(b, n - 1), np.full(b, m - 1)
    steps = [(who, i, j)]
    while True:
        go = (i > 0) | (j > 0)
        who, i, j = who[go], i[go], j[go]
        if not len(who):
            return last[n], steps
        step = way[i, j, who]
        i, j = i - (step != 2), j - (step != 1)
        steps.append((who, i, j))


#: Cells of paths that are worked out at once, a byte each.
WARP_CELLS = 1 << 24


def _round(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of what a batch's tracks lay on each place of their barycentres; a row without place has the distances.

    Tracks of one cluster and length are laid together.
    """
    for batch in batches:
        flat = lambda c: np.column_stack([batch.column(c).flatten().field(k).to_numpy(zero_copy_only=False) for k in "xyz"])  # noqa: B023, E731
        sizes = lambda c: batch.column(c).value_lengths().to_numpy(zero_copy_only=False)  # noqa: B023, E731
        label, (points, long), (means, wide) = batch.column("label").to_numpy(zero_copy_only=False), *((flat(c), sizes(c)) for c in ("points", "mean"))
        start, mean_start = np.cumsum(long) - long, np.cumsum(wide) - wide
        rows: list[tuple] = []
        for k in np.unique(label).tolist():
            of = np.flatnonzero(label == k)
            centre = means[mean_start[of[0]] : mean_start[of[0]] + wide[of[0]]]
            at, costs = np.zeros((len(centre), 4)), 0.0
            for n in np.unique(long[of]).tolist():
                same = of[long[of] == n]
                for part in np.array_split(same, -(-len(same) * n * len(centre) // WARP_CELLS)):
                    tracks = points[start[part][:, None] + np.arange(n)]
                    cost, steps = warp_all(tracks, centre)
                    costs += float(cost.sum())
                    who, i, j = (np.concatenate(x) for x in zip(*steps, strict=True))
                    laid = tracks[who, i]
                    for c, v in enumerate((None, *laid.T)):
                        at[:, c] += np.bincount(j, v, len(centre))
            rows += [(k, p, *at[p].tolist(), 0.0, 0) for p in np.flatnonzero(at[:, 0]).tolist()]
            rows.append((k, None, 0.0, 0.0, 0.0, 0.0, costs, len(of)))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SUMS, strict=True)] if rows else [pa.array([], f.type) for f in _SUMS], schema=_SUMS)


def barycentres(points: DataFrame, labels: DataFrame, *, rounds: int = 50, least_gain: float = 1e-5) -> DataFrame:
    """(label, place, x, y, z, cost): each cluster's barycentre, and its tracks' mean squared distance when it was last measured.

    points: (key, ord, x, y, z); labels: (id_vehicle, label), or with id_record too.
    """
    fine = points.filter((F.abs("x") < float("inf")) & (F.abs("y") < float("inf")) & (F.abs("z") < float("inf")))
    on = [c for c in KEY if c in labels.columns]
    place = F.struct("ord", "x", "y", "z")
    whole = fine.groupBy(*KEY).agg(F.array_sort(F.collect_list(place)).alias("rows")).select(*KEY, F.transform("rows", lambda r: F.struct(r.x.alias("x"), r.y.alias("y"), r.z.alias("z"))).alias("points"))
    tracks = store(whole.join(labels.filter("label >= 0").select(*on, F.col("label").cast("int").alias("label")), on).select("label", "points"), "tracks")
    mean = lambda c: F.round(F.avg(c), 9).alias(c)
    start = tracks.select("label", F.posexplode("points").alias("place", "p")).select("label", "place", "p.*").groupBy("label", "place").agg(*map(mean, "xyz"))
    at = store(start.withColumns({"cost": F.lit(float("inf")), "done": F.lit(False)}), "barycentres")
    for _ in range(rounds):
        moving = at.filter(~F.col("done"))
        packed = moving.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("place", "x", "y", "z"))).alias("mean"))
        laid = tracks.join(bounded(store(packed.withColumnRenamed("label", "of"), "means"), F.size("mean") * 40), F.col("label") == F.col("of")).select("label", "points", "mean")
        sums = store(laid.mapInArrow(_round, SUM_DDL).groupBy("label", "place").agg(*(F.sum(c).alias(c) for c in ("n", "x", "y", "z", "cost")), F.sum("tracks").alias("tracks")), "sums")
        costs = sums.filter("place is null").select(F.col("label").alias("c_label"), F.round(F.col("cost") / F.col("tracks"), 9).alias("new_cost"))
        moved = sums.filter("place is not null").select(F.col("label").alias("m_label"), F.col("place").alias("m_place"), *(F.round(F.col(c) / F.col("n"), 9).alias(f"new_{c}") for c in "xyz"))
        both = at.join(moved, (at.label == F.col("m_label")) & (at.place == F.col("m_place")), "left").join(bounded(costs, 16), at.label == F.col("c_label"), "left")
        # the last step stands only while the distance still falls; the barycentre that was measured is kept then
        stop = F.col("done") | (F.col("new_cost") >= F.col("cost") - least_gain)
        keep = lambda c: F.when(stop | F.col(f"new_{c}").isNull(), F.col(c)).otherwise(F.col(f"new_{c}")).alias(c)  # noqa: B023, E731
        cost = F.when(F.col("done"), F.col("cost")).otherwise(F.least("cost", "new_cost")).alias("cost")
        at = store(both.select("label", "place", *map(keep, "xyz"), cost, F.coalesce(stop, F.lit(False)).alias("done")), "barycentres")
        if at.filter(~F.col("done")).isEmpty():
            break
    return at.select("label", "place", "x", "y", "z", "cost")
