"""Ends of tracks matched with the starts that continue them, cheapest first, without a table of all candidates.

All tracks of a class and record meet in one task, or strips of places of them if they are many. There pairs are looked
up by cells of space and an exact range of time in bands of rising cost, so what is matched cheaply never meets what is
far away. Tracks in the same state (copies) are one entry with a list of numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import bounded, store
from .near_frames import HELD, Lookup, groups, pieces, runs

#: Starts and ends of a strip, about; a task holds three strips.
STRIP_ROWS = 250_000
#: Places along x at which a group is cut, at most.
CUTS = 256

_STATE = ("x", "y", "z", "length", "width", "height", "yaw")
_GROUP = ("id_record", "class_name", "strip")


class _Side:
    """Distinct states of starts or ends; numbers of the tracks in each, rising, and how many are left."""

    def __init__(self, g: dict[str, np.ndarray], at: np.ndarray):
        cols = [g[c][at] for c in (*_STATE, "s_us", "e_us")]
        order = np.lexsort([g["id"][at], *cols])
        new = np.ones(len(at), bool)
        new[1:] = np.any([v[order][1:] != v[order][:-1] for v in cols], axis=0)
        first = np.flatnonzero(new)
        self.g = {c: v[order][first] for c, v in zip((*_STATE, "s_us", "e_us", "known", "core"), [*cols, g["known"][at], g["core"][at]], strict=True)}
        self.ids = g["id"][at][order]
        self.next, self.end = first.tolist(), np.r_[first[1:], len(at)].tolist()
        #: costs below this are decided by what the task holds
        self.known = self.g["known"].tolist()

    def alive(self) -> np.ndarray:
        return np.flatnonzero(np.array(self.next, np.int64) < np.array(self.end, np.int64))


def _found(look: Lookup, i: _Side, at: np.ndarray, within: int) -> tuple[np.ndarray, np.ndarray]:
    s, e = i.g["s_us"][at], i.g["e_us"][at]
    return look.ranges(i.g["x"][at], i.g["y"][at], s - within, np.minimum(s + within, e))


def _band(i: _Side, j: _Side, at: np.ndarray, look: Lookup, lo: np.ndarray, n: np.ndarray, low: float, high: float, limit: float, digits: int | None) -> list[np.ndarray]:
    """States (p, q) of starts and ends with a cost above low, up to high; and the cost."""
    kept: list[list[np.ndarray]] = [[], [], []]
    each, lo, n = np.repeat(at, lo.shape[1]), lo.ravel(), n.ravel()
    some = np.flatnonzero(n > 0)
    each, lo, n = each[some], lo[some], n[some]
    for s, e in pieces(n, HELD):
        p, q = np.repeat(each[s:e], n[s:e]), look.rows[runs(lo[s:e], n[s:e])]
        d = {c: i.g[c][p] - j.g[c][q] for c in _STATE}
        with np.errstate(over="ignore"):
            square = 4 * (d["x"] * d["x"] + d["y"] * d["y"] + d["z"] * d["z"]) + d["length"] * d["length"] + d["width"] * d["width"] + d["height"] * d["height"]
            cost = np.sqrt(square) * (2 - np.cos(d["yaw"]))
        fine = (cost <= limit) & ((i.g["e_us"][p] > j.g["e_us"][q]) | (i.g["s_us"][p] > j.g["s_us"][q]))
        if digits is not None:
            cost = np.floor(cost * 10.0**digits + 0.5) / 10.0**digits
        fine &= (cost > low) & (cost <= high)
        for out, v in zip(kept, (p, q, cost), strict=True):
            out.append(v[fine])
    return [np.concatenate(v) if v else np.array([]) for v in kept]


def _equals(i: _Side, j: _Side, pairs: list[tuple[int, int]], cost: float) -> Iterator[tuple[int, int]]:
    """(i, j) of pairs of states that cost the same: what is undecided spreads, the others go by i, then j."""
    pairs = [(p, q) for p, q in pairs if i.next[p] < i.end[p] and j.next[q] < j.end[q]]
    spread = True
    while spread:
        spread = False
        for p, q in pairs:
            if (i.known[p] <= cost or j.known[q] <= cost) and (i.known[p] >= 0 or j.known[q] >= 0):
                i.known[p] = j.known[q] = -1.0
                spread = True
    ends: dict[int, list[int]] = {}
    for p, q in pairs:
        if i.known[p] > cost and j.known[q] > cost:
            ends.setdefault(p, []).append(q)
    starts = sorted((i.ids[k], p) for p in ends for k in range(i.next[p], i.end[p]))
    for number, p in starts:
        left = [q for q in ends[p] if j.next[q] < j.end[q]]
        if left:
            q = min(left, key=lambda q: j.ids[j.next[q]])
            yield number, j.ids[j.next[q]]
            i.next[p] += 1
            j.next[q] += 1


def _solve(i: _Side, j: _Side, within: int, limit: float, digits: int | None) -> list[list[np.ndarray]]:
    """Matched numbers of i and of j."""
    done: list[list[np.ndarray]] = [[], []]

    def take(a: np.ndarray, b: np.ndarray) -> None:
        done[0].append(a)
        done[1].append(b)

    low, high = -1.0, limit
    at, ends = i.alive(), j.alive()
    while len(at) and len(ends):
        while True:
            # a cost is at least twice the distance
            look = Lookup({"x": j.g["x"], "y": j.g["y"], "us": j.g["e_us"]}, ends, high * 0.5 * (1 + 1e-9) + 1e-8)
            lo, n = _found(look, i, at, within)
            floor = max(low, 0.0)
            if n.clip(0).sum() <= 16 * len(at) + HELD or high - floor <= max(0.1 * floor, 1e-6):
                break
            high = (floor + high) / 2
        p, q, cost = _band(i, j, at, look, lo, n, low, high, limit, digits)
        order = np.lexsort((q, p, cost))
        p, q, cost = p[order].tolist(), q[order].tolist(), cost[order].tolist()
        k, size = 0, len(p)
        while k < size:
            c, e = cost[k], k + 1
            while e < size and cost[e] == c:
                e += 1
            if e - k > 1:
                some = list(_equals(i, j, list(zip(p[k:e], q[k:e], strict=True)), c))
                if some:
                    take(*map(np.array, zip(*some, strict=True)))
            else:
                a, b = p[k], q[k]
                m = min(i.end[a] - i.next[a], j.end[b] - j.next[b])
                if m and (i.known[a] <= c or j.known[b] <= c):
                    i.known[a] = j.known[b] = -1.0
                elif m:
                    take(i.ids[i.next[a] : i.next[a] + m], j.ids[j.next[b] : j.next[b] + m])
                    i.next[a] += m
                    j.next[b] += m
            k = e
        if high >= limit:
            break
        low, high = high, min(limit, 2 * high)
        at, ends = i.alive(), j.alive()
    return done


def _open(side: _Side, limit: float) -> np.ndarray:
    """Numbers of this strip that what lies beyond the task's strips may still decide."""
    some = [side.ids[side.next[k] : side.end[k]] for k in side.alive() if side.known[k] <= limit and side.g["core"][k]]
    return np.concatenate(some) if some else np.array([], np.int64)


def match_links(tracks: DataFrame, limits: dict[str, float], within_us: int = 1_500_000, *, most: float = 1000.0, digits: int | None = None, strip_rows: int = STRIP_ROWS) -> DataFrame:
    """(id_record, i, j): what `greedy_match` takes of the `link_candidates` of tracks; digits rounds the costs that are compared.

    A group of more than strip_rows starts and ends is cut into strips along x. A task holds a strip and its neighbours
    and takes a pair if nothing outside can cost as little; what stays undecided goes round again, in fewer strips.
    """
    limit = F.element_at(F.create_map(*(F.lit(v) for kv in limits.items() for v in kv)), F.col("class_name"))
    number = [F.abs(c) < float("inf") for c in _STATE]
    both, tracks = [], store(tracks, "tracks")
    for role, side in ((True, "s"), (False, "e")):
        place = [F.col(f"{side}_{c}" if c in ("x", "y", "z", "yaw") else c).cast("double").alias(c) for c in _STATE]
        # a start at no time is known not to be later than another
        since = F.col("s_us") if role else F.coalesce("s_us", F.lit((1 << 63) - 1))
        both.append(tracks.select("id_record", "class_name", F.lit(role).alias("starts"), "id", *place, since.cast("long").alias("s_us"), F.col("e_us").cast("long").alias("e_us"), F.when(limit.isNotNull(), F.least(limit, F.lit(most))).alias("limit")))
    todo = both[0].unionByName(both[1]).filter("id_record is not null and id is not null and s_us is not null and e_us is not null and limit is not null")
    for n in number:
        todo = todo.filter(n)
    kind = {f.name: f.dataType.simpleString() for f in todo.schema}
    out = f"id_record {kind['id_record']}, i {kind['id']}, j {kind['id']}"
    numbers = pa.int64() if kind["id"] == "bigint" else pa.int32()

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, _GROUP):
            g = {c: table.column(c).to_numpy() for c in (*_STATE, "s_us", "e_us", "id", "starts", "known", "core")}
            i, j = _Side(g, np.flatnonzero(g["starts"])), _Side(g, np.flatnonzero(~g["starts"]))
            limit = table.column("limit")[0].as_py()
            done = [np.concatenate(v) if v else np.array([], np.int64) for v in _solve(i, j, within_us, limit, digits)]
            open_i, open_j = _open(i, limit), _open(j, limit)
            none = lambda v: pa.nulls(len(v), numbers)
            a = pa.concat_arrays([pa.array(done[0], numbers), pa.array(open_i, numbers), none(open_j)])
            b = pa.concat_arrays([pa.array(done[1], numbers), none(open_i), pa.array(open_j, numbers)])
            record = pa.array([table.column("id_record")[0].as_py()] * len(a), table.schema.field("id_record").type)
            yield pa.RecordBatch.from_arrays([record, a, b], names=["id_record", "i", "j"])

    taken, before = None, None
    while True:
        large = todo.groupBy("id_record", "class_name").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > strip_rows)
        large = store(large, "large")
        left = large.agg(F.sum("n")).first()[0] or 0
        if before is not None and left > before / 2:
            strip_rows *= 2
        before = left
        rows = todo.withColumn("cuts", F.lit(None).cast("array<double>"))
        if left:
            known = bounded(large.select("id_record", "class_name", "n"), 64)
            cuts = todo.join(known, ["id_record", "class_name"]).groupBy("id_record", "class_name", "n").agg(F.percentile_approx("x", [k / CUTS for k in range(1, CUTS)], 4 * CUTS).alias("cuts"))
            step = F.greatest(F.lit(1), F.floor(F.lit(CUTS) * strip_rows / F.col("n"))).cast("int")
            cuts = cuts.select("id_record", "class_name", F.array_distinct(F.filter("cuts", lambda _, k: (k + 1) % step == 0)).alias("cuts"))
            rows = todo.join(bounded(cuts, 64 + 8 * CUTS), ["id_record", "class_name"], "left")
        rows = rows.withColumn("cuts", F.coalesce("cuts", F.array().cast("array<double>")))
        own = F.size(F.filter("cuts", lambda c: c <= F.col("x")))
        rows = rows.withColumn("own", own).withColumn("strip", F.explode(F.sequence(F.greatest(F.lit(0), F.col("own") - 1), F.least(F.size("cuts"), F.col("own") + 1))))
        # the nearest place outside of the strip's neighbours, whose costs are at least twice as far
        inf = F.lit(float("inf"))
        since, until = F.get("cuts", F.col("strip") - 2), F.get("cuts", F.col("strip") + 1)
        beyond = F.least(F.coalesce(F.col("x") - since, inf), F.coalesce(until - F.col("x"), inf))
        rows = rows.select(*_GROUP, "starts", "id", *_STATE, "s_us", "e_us", "limit", (2 * beyond - 1e-8).alias("known"), (F.col("own") == F.col("strip")).alias("core"))
        found = rows.repartition(*_GROUP).sortWithinPartitions(*_GROUP).mapInArrow(met, out)
        if not left:
            return found if taken is None else taken.unionByName(found)
        found = store(found, "matched")
        pairs = store(found.filter("i is not null and j is not null").distinct(), "pairs")
        taken = pairs if taken is None else taken.unionByName(pairs)
        sides = (("i", True), ("j", False))
        open_ = [found.filter(F.col(o).isNull()).select("id_record", F.col(c).alias("id"), F.lit(s).alias("starts")).join(pairs.select("id_record", F.col(c).alias("id")), ["id_record", "id"], "left_anti") for (c, s), o in zip(sides, "ji", strict=True)]
        todo = store(todo.join(open_[0].unionByName(open_[1]), ["id_record", "id", "starts"], "left_semi"), "open")
