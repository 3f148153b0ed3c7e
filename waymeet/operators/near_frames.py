"""Frames of two vehicles that are near one another, found block by block.

A record's vehicles are dealt to blocks, with all their frames, and every two blocks meet in one task. There frames are
looked up by cells of space and an exact range of time. As all frames of two vehicles meet in one task, what is asked of
a pair of vehicles is answered there, and only the answer leaves it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import VULNERABLE
from ..storage import bounded

#: Frames of a block, about; and pairs of frames that are held at once.
BLOCK_FRAMES, HELD = 125_000, 1 << 20

_KEY = ("id_record", "block_a", "block_b")
_NUMBERS = ("x", "y", "z", "length", "width", "yaw", "size")


def groups(batches: Iterator[pa.RecordBatch], key: tuple[str, ...]) -> Iterator[pa.Table]:
    """The rows of each key, which follow one another."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = [batch.column(k).to_numpy(zero_copy_only=False) for k in key]
        cuts = np.flatnonzero(np.any([v[1:] != v[:-1] for v in ids], axis=0)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            this = tuple(v[lo] for v in ids)
            if held and this != last:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            held.append(batch.slice(lo, hi - lo))
            last = this
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def runs(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """lo, lo + 1, .. of n numbers each, one after another."""
    return np.arange(n.sum()) + np.repeat(lo - np.cumsum(n) + n, n)


def pieces(n: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Stretches of n whose sum is about `most`, at least one number each."""
    total, at = np.cumsum(n), 0
    while at < len(n):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, "right")))
        yield at, end
        at = end


class Lookup:
    """Frames b in cells of a side, sorted by cell and time."""

    def __init__(self, g: dict[str, np.ndarray], b: np.ndarray, side: float):
        self.side = side if np.isfinite(side) and side > 0 else None
        cells = [self._cell(g[c][b]) for c in "xy"]
        self.xs, ix = np.unique(cells[0], return_inverse=True)
        self.ys, iy = np.unique(cells[1], return_inverse=True)
        self.codes, cell = np.unique(ix * len(self.ys) + iy, return_inverse=True)
        by_time = np.argsort(g["us"][b], kind="stable")
        self.us, rank = g["us"][b][by_time], np.empty(len(b), np.int64)
        rank[by_time] = np.arange(len(b))
        self.wide = len(b) + 1
        keys = cell * self.wide + rank
        order = np.argsort(keys)
        self.keys, self.rows = keys[order], b[order]

    def _cell(self, v: np.ndarray) -> np.ndarray:
        return np.floor(v / self.side) if self.side else np.zeros(len(v))

    def ranges(self, x: np.ndarray, y: np.ndarray, since: np.ndarray, until: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(frame, cell around it): where in rows those from since to until begin, and how many they are."""
        since, until = np.searchsorted(self.us, since, "left"), np.searchsorted(self.us, until, "right")
        find = lambda of, v: (np.minimum(np.searchsorted(of, v), len(of) - 1), v)
        steps = (-1, 0, 1) if self.side else (0,)
        cx, cy = self._cell(x), self._cell(y)
        lo, n = [], []
        for dx in steps:
            i, v = find(self.xs, cx + dx)
            there_x = self.xs[i] == v
            for dy in steps:
                j, w = find(self.ys, cy + dy)
                k, code = find(self.codes, i * len(self.ys) + j)
                there = there_x & (self.ys[j] == w) & (self.codes[k] == code)
                at, end = (np.searchsorted(self.keys, k * self.wide + t) for t in (since, until))
                lo.append(at)
                n.append(np.where(there, end - at, 0))
        return np.stack(lo, axis=1), np.stack(n, axis=1)


def _overlap(g: dict[str, np.ndarray], p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """`geometry.boxes_overlap` of frames p and q."""
    dx, dy = g["x"][q] - g["x"][p], g["y"][q] - g["y"][p]
    turn = g["yaw"][q] - g["yaw"][p]
    c, s = np.abs(np.cos(turn)), np.abs(np.sin(turn))

    def meets(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        cos, sin = np.cos(g["yaw"][i]), np.sin(g["yaw"][i])
        return (np.abs(dx * cos + dy * sin) < (g["length"][i] + g["length"][j] * c + g["width"][j] * s) / 2) & (np.abs(dy * cos - dx * sin) < (g["width"][i] + g["length"][j] * s + g["width"][j] * c) / 2)

    return meets(p, q) & meets(q, p)


def _near(g: dict[str, np.ndarray], band: int, boxes: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(p, q) of near frames in stretches that hold all of some vehicles' frames p; p's vehicle is in the first block."""
    one = g["own"][0] == 2  # of two blocks that are the same
    first = np.flatnonzero(g["fit"] & (g["own"] != 1))
    first = first[np.argsort(g["vehicle"][first], kind="stable")]
    second = np.flatnonzero(g["fit"] & (g["own"] != 0))
    kind = np.where(np.isfinite(g["size"]), np.clip(np.frexp(np.where(np.isfinite(g["size"]), g["size"], 1))[1], 0, 60), 61) * 2 + g["vru"]
    met, count = [], np.zeros(len(first), np.int64)
    for a in np.unique(kind[first]):
        at = np.flatnonzero(kind[first] == a)
        rows = first[at]
        for b in np.unique(kind[second]):
            if a % 2 and b % 2:
                continue
            others = second[kind[second] == b]
            look = Lookup(g, others, (g["size"][rows].max() + g["size"][others].max()) / 2)
            lo, n = look.ranges(g["x"][rows], g["y"][rows], g["us"][rows] - band, g["us"][rows] + band)
            count[at] += n.sum(axis=1)
            met.append((at, rows, look.rows, lo, n))
    ends = np.flatnonzero(np.r_[g["vehicle"][first][1:] != g["vehicle"][first][:-1], np.ones(min(1, len(first)), bool)]) + 1
    for i, j in pieces(np.diff(np.cumsum(np.r_[0, count])[np.r_[0, ends]]), 4 * HELD):
        here = ends[i - 1] if i else 0, ends[j - 1]
        ps, qs = [], []
        for at, rows, order, lo, n in met:
            u, v = np.searchsorted(at, here)
            flat_lo, flat_n = lo[u:v].ravel(), n[u:v].ravel()
            each = np.repeat(rows[u:v], lo.shape[1])
            some = np.flatnonzero(flat_n)
            flat_lo, flat_n, each = flat_lo[some], flat_n[some], each[some]
            for s, e in pieces(flat_n, HELD):
                p, q = np.repeat(each[s:e], flat_n[s:e]), order[runs(flat_lo[s:e], flat_n[s:e])]
                d = [g[c][p] - g[c][q] for c in "xyz"]
                reach = (g["size"][p] + g["size"][q]) / 2
                fine = ~(d[0] * d[0] + d[1] * d[1] + d[2] * d[2] > reach * reach) & ~(reach < 0)
                fine &= g["vehicle"][p] < g["vehicle"][q] if one else g["vehicle"][p] != g["vehicle"][q]
                p, q = p[fine], q[fine]
                if boxes:
                    fine = _overlap(g, p, q)
                    p, q = p[fine], q[fine]
                ps.append(p)
                qs.append(q)
        if sum(map(len, ps)):
            p, q = np.concatenate(ps), np.concatenate(qs)
            swap = g["vehicle"][p] > g["vehicle"][q]
            yield np.where(swap, q, p), np.where(swap, p, q)


class Slots:
    """The time slots of each vehicle."""

    def __init__(self, vehicle: np.ndarray, slot: np.ndarray, vehicles: int | None = None):
        self.slots, at = np.unique(slot, return_inverse=True)
        self.keys = np.unique(vehicle * len(self.slots) + at)
        self.start = np.searchsorted(self.keys, np.arange((vehicle.max() + 1 if vehicles is None else vehicles) + 1) * len(self.slots))

    def shared(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        size = np.diff(self.start)
        a, b = np.where(size[a] <= size[b], a, b), np.where(size[a] <= size[b], b, a)
        out = np.zeros(len(a), bool)
        for s, e in pieces(size[a], HELD):
            n = size[a[s:e]]
            asked = self.keys[runs(self.start[a[s:e]], n)] % len(self.slots) + np.repeat(b[s:e], n) * len(self.slots)
            hit = self.keys[np.minimum(np.searchsorted(self.keys, asked), len(self.keys) - 1)] == asked
            out[s + np.repeat(np.arange(e - s), n)[hit]] = True
        return out


def _least(g: dict[str, np.ndarray], p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every pair of vehicles the first frames, by p's order, then q's, and the least time between two."""
    pair = g["vehicle"][p] * (g["vehicle"].max() + 1) + g["vehicle"][q]
    order = np.lexsort((g["ord"][q], g["ord"][p], pair))
    p, q, pair = p[order], q[order], pair[order]
    start = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])
    return p[start], q[start], np.minimum.reduceat(np.abs(g["us"][p] - g["us"][q]), start)


def near_frames(points: DataFrame, *, band_us: int, carry: tuple[str, ...] = (), boxes: bool = False, pairs: bool = False, slot_us: int | None = None, block_frames: int = BLOCK_FRAMES) -> DataFrame:
    """Frames as `frame_pairs` has them, with the columns carry of both: id_record, gap_us, a_id_vehicle, b_id_vehicle, a_*, b_*.

    boxes: only frames whose boxes overlap as seen from above. pairs: one row for two vehicles, with the first of their
    frames (lowest ord of a, then of b) and the least time between any; with slot_us only of vehicles that are on record
    in a common time slot.
    """
    carry = tuple(c for c in carry if c != "id_vehicle")
    number = lambda c: F.col(c).cast("double").alias(f"n_{c}")
    size = F.greatest("length", "width", "height")
    placed = [F.abs(c) < float("inf") for c in "xyz"]  # nor is NaN below it
    fit = F.coalesce(placed[0] & placed[1] & placed[2] & size.isNotNull(), F.lit(False)).alias("fit")
    vru = F.coalesce(F.col("class_name").isin(*VULNERABLE), F.lit(False)).alias("vru")
    rows = points.withColumn("size", size).filter("id_record is not null and id_vehicle is not null and us is not null")
    rows = rows.select("id_record", "id_vehicle", *carry, *map(number, _NUMBERS), F.col("us").alias("n_us"), F.coalesce("ord", F.lit(-1)).alias("n_ord"), fit, vru)
    if slot_us is None:
        rows = rows.filter("fit")
    sizes = bounded(points.groupBy("id_record").agg(F.ceil(F.count(F.lit(1)) / block_frames).alias("blocks")).filter("blocks > 1"), 16)
    rows = rows.join(sizes, "id_record", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id_vehicle"), "blocks")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    block, other = F.col("block"), F.col("other")
    # which of its group's blocks a frame is of: the first, the second, or (2) the only one
    own = F.when(block == other, 2).when(block < other, 0).otherwise(1).cast("int").alias("own")
    rows = rows.withColumns({"block_a": F.least(block, other), "block_b": F.greatest(block, other)}).select(*_KEY, "id_vehicle", *carry, *(f"n_{c}" for c in (*_NUMBERS, "us", "ord")), "fit", "vru", own)
    kind = {f.name: f.dataType.simpleString() for f in rows.schema}
    names = ["id_vehicle", *carry]
    out = ", ".join([f"id_record {kind['id_record']}", "gap_us long", *(f"{s}_{c} {kind[c]}" for s in "ab" for c in names)])

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, _KEY):
            g = {c: table.column(f"n_{c}").to_numpy() for c in (*_NUMBERS, "us", "ord")}
            g |= {c: table.column(c).to_numpy() for c in ("fit", "vru", "own")}
            g["vehicle"] = np.unique(table.column("id_vehicle").to_numpy(), return_inverse=True)[1]
            slots = Slots(g["vehicle"], g["us"] // slot_us) if slot_us else None
            shown = table.select(names)
            for p, q in _near(g, band_us, boxes):
                gap = np.abs(g["us"][p] - g["us"][q])
                if pairs:
                    p, q, gap = _least(g, p, q)
                    if slots:
                        fine = slots.shared(g["vehicle"][p], g["vehicle"][q])
                        p, q, gap = p[fine], q[fine], gap[fine]
                for s in range(0, len(p), HELD // 8):
                    part = slice(s, s + HELD // 8)
                    sides = [shown.take(pa.array(v[part])).combine_chunks() for v in (p, q)]
                    record = table.column("id_record").take(pa.array(p[part])).combine_chunks()
                    arrays = [record, pa.array(gap[part]), *(t.column(c).combine_chunks() for t in sides for c in names)]
                    yield pa.RecordBatch.from_arrays(arrays, names=["id_record", "gap_us", *(f"{s}_{c}" for s in "ab" for c in names)])

    return rows.repartition(*_KEY).sortWithinPartitions(*_KEY).mapInArrow(met, out)
