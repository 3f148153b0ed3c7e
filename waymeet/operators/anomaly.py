"""Unusual manoeuvres: local outlier factors over embeddings of trajectories."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..storage import bounded, store
from .near_frames import groups
from .tracks import KEY, ego


def cosine_distance(a: Column, b: Column) -> Column:
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return 1 - dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def _unit(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: x.cast("double") / F.nullif(norm, F.lit(0.0)))


#: Vectors of a block, groups up to which size are one cell, and bytes of all pivots, which are broadcast.
BLOCK_ROWS, ONE_CELL, PIVOT_BYTES = 1024, 1024, 16 << 20

#: Vectors of a chunk of cells, about; two chunks are what a task holds.
CHUNK_ROWS = 16_384


@dataclass
class Cells:
    """Per group: its pivots, and the radius of each one's cell; groups without pivots are one cell, number 0."""

    pivots: dict[object, np.ndarray]
    radius: dict[object, np.ndarray]

    def home(self, grp: object, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cell of each vector and its distance to the cell's pivot."""
        if grp not in self.pivots:
            return np.zeros(len(u), np.int64), np.zeros(len(u))
        far = _far(u, self.pivots[grp])
        return far.argmin(axis=1), far.min(axis=1)

    def may_hold(self, grp: object, u: np.ndarray, within: np.ndarray) -> np.ndarray:
        """(vector, cell): whether a cell may hold something within a vector's bound.

        By the triangle inequality a cell's members are at least its pivot's distance less its radius away, and at
        least half of what its pivot is farther away than the nearest one.
        """
        far = _far(u, self.pivots[grp])
        least = np.maximum(far - self.radius[grp][None, :], (far - far.min(axis=1, keepdims=True)) / 2)
        return least <= within[:, None] + 1e-9


def _far(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Euclidean distances of vectors of length one."""
    return np.sqrt(np.maximum(0.0, 2 - 2 * (u @ v.T)))


def _matrix(flat: list, n: int) -> np.ndarray:
    return np.array(flat, np.float64).reshape(n, -1)


def _pivots(unit: DataFrame) -> dict[object, np.ndarray]:
    """About the root of a group's size of its vectors, by a hash of the id; fewer where all groups' do not fit PIVOT_BYTES."""
    sizes = unit.groupBy("grp").agg(F.count("*").alias("n"), F.max(F.size("u")).alias("dims")).filter(F.col("n") > ONE_CELL)
    total = sizes.agg(F.sum(F.sqrt("n") * F.col("dims") * 8)).first()[0] or 0.0
    if not total:
        return {}
    share = F.sqrt("n") / F.col("n") * min(1.0, PIVOT_BYTES / total)
    drawn = unit.join(sizes.select(F.col("grp").alias("s_grp"), share.alias("share")), F.col("grp") == F.col("s_grp"))
    drawn = drawn.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < F.col("share") * (1 << 30)).select("grp", "u").distinct()
    got: dict[object, list] = {}
    for r in drawn.orderBy("grp", "u").toLocalIterator():
        got.setdefault(r["grp"], []).append(r["u"])
    return {g: np.array(v) for g, v in got.items() if len(v) > 1}


def _nearest(a: np.ndarray, b: np.ndarray, same: bool, order: np.ndarray, k: int, may: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of a, row of b, distance) of each a's first k of b by distance, then b's order; same: a is b, rows do not meet themselves."""
    d = np.round(1 - a @ b.T, 12)
    if same:
        np.fill_diagonal(d, np.inf)
    d[~may] = np.inf
    bound = np.partition(d, min(k, d.shape[1]) - 1, axis=1)[:, min(k, d.shape[1]) - 1]
    i, j = np.nonzero((d <= bound[:, None]) & np.isfinite(d))
    at = np.lexsort((order[j], d[i, j], i))
    i, j = i[at], j[at]
    first = np.flatnonzero(np.r_[True, i[1:] != i[:-1]]) if len(i) else np.zeros(0, int)
    rank = np.arange(len(i)) - np.repeat(first, np.diff(np.r_[first, len(i)]))
    return i[rank < k], j[rank < k], d[i[rank < k], j[rank < k]]


def knn(vectors: DataFrame, k: int = 20) -> DataFrame:
    """(grp, id, other, d, rank): the k nearest by cosine distance within each group (grp, id, embedding); ties by id.

    Vectors are scaled to length one, where distance and cosine distance have one order, and dealt to the cells of
    pivots. Blocks of a cell meet one another first, which bounds how far a vector's k-th neighbour can be; then they
    meet the blocks of other cells that may hold something nearer, chunk of cells by chunk of cells. Blocks are compared
    by one matrix product and only the k nearest leave a chunk. Vectors of length zero, or with components that are no numbers, take no part.
    """
    return _merged(_compared(vectors, k), k)


def _compared(vectors: DataFrame, k: int) -> DataFrame:
    """(grp, id, other, d) of the k nearest in each pair of blocks that met, and n_pairs, how many vectors met in it, once a pair."""
    spark = vectors.sparkSession
    unit = vectors.select("grp", "id", _unit(F.col("embedding")).alias("u"))
    unit = store(unit.filter(F.forall("u", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 2)) & (F.size("u") > 0)), "unit")
    cells = Cells(_pivots(unit), {})
    told = spark.sparkContext.broadcast(cells)
    g, i = (to_arrow_type(unit.schema[c].dataType) for c in ("grp", "id"))
    names = [f"{f.name} {f.dataType.simpleString()}" for f in unit.schema[:2]]

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grp, u = batch.column("grp").to_pylist(), batch.column("u").to_pylist()
            home, r = np.zeros(len(grp), np.int64), np.zeros(len(grp))
            for one in set(grp):
                at = [n for n, x in enumerate(grp) if x == one]
                if one in told.value.pivots:
                    home[at], r[at] = told.value.home(one, np.array([u[n] for n in at]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home), pa.array(r)], names=["grp", "id", "u", "cell", "r"])

    homes = store(unit.mapInArrow(dealt, f"{names[0]}, {names[1]}, u array<double>, cell long, r double"), "homes")
    sizes = homes.groupBy("grp", "cell").agg(F.count("*").alias("n"), F.max("r").alias("radius"))
    if cells.pivots:
        for row in sizes.collect():  # a row for each pivot
            if row["grp"] in cells.pivots:
                cells.radius.setdefault(row["grp"], np.full(len(cells.pivots[row["grp"]]), -np.inf))[row["cell"]] = row["radius"]
    shared = spark.sparkContext.broadcast(cells)
    n_blocks = F.ceil(F.col("n") / BLOCK_ROWS)
    blocked = homes.join(sizes.select(F.col("grp").alias("b_grp"), F.col("cell").alias("b_cell"), "n"), (F.col("grp") == F.col("b_grp")) & (F.col("cell") == F.col("b_cell")))
    blocked = blocked.groupBy("grp", "cell", F.pmod(F.xxhash64("id"), n_blocks).alias("block")).agg(F.array_sort(F.collect_list(F.struct("id", "u"))).alias("m"))
    blocks = store(blocked.select("grp", "cell", "block", F.col("m.id").alias("ids"), F.flatten("m.u").alias("u")), "blocks")
    b = blocks.select(*(F.col(c).alias(f"b_{c}") for c in blocks.columns))
    out = f"{names[0]}, {names[1]}, {names[1].replace('id ', 'other ', 1)}, d double, cell long, block long, n_pairs long"

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                a, c = _matrix(row["u"], len(row["ids"])), _matrix(row["b_u"], len(row["b_ids"]))
                order = np.empty(len(row["b_ids"]), np.int64)
                order[sorted(range(len(order)), key=row["b_ids"].__getitem__)] = np.arange(len(order))
                may = np.ones((len(a), len(c)), bool)
                met = int(may.sum())
                p, q, d = _nearest(a, c, row["same"], order, k, may)
                rest = [pa.array([row[c]] * len(p), pa.int64()) for c in ("cell", "block")]
                count = pa.array([met if n == 0 else 0 for n in range(len(p))], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([row["grp"]] * len(p), g), pa.array([row["ids"][n] for n in p], i), pa.array([row["b_ids"][n] for n in q], i), pa.array(d, pa.float64()), *rest, count], names=["grp", "id", "other", "d", "cell", "block", "n_pairs"])

    inside = blocks.join(b, (F.col("grp") == F.col("b_grp")) & (F.col("cell") == F.col("b_cell")))
    first = inside.withColumn("same", F.col("block") == F.col("b_block"))
    first = store(first.mapInArrow(meet, out), "first")
    if not cells.pivots:
        return first
    bound = _merged(first.select("grp", "id", "other", "d"), k).groupBy("grp", "id").agg(F.max("d").alias("last"), F.count("*").alias("n"))
    bound = bound.select(F.col("grp").alias("t_grp"), F.col("id").alias("t_id"), F.when(F.col("n") == k, F.sqrt(2 * F.greatest("last", F.lit(0.0)))).otherwise(2.0).alias("within"))
    ids = blocks.select("grp", "cell", "block", F.posexplode("ids").alias("at", "id"))
    within = ids.join(bound, (F.col("grp") == F.col("t_grp")) & (F.col("id") == F.col("t_id")), "left")
    within = within.groupBy("grp", "cell", "block").agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce("within", F.lit(2.0)).alias("within")))).alias("w"))
    within = within.select(F.col("grp").alias("w_grp"), F.col("cell").alias("w_cell"), F.col("block").alias("w_block"), F.col("w.within").alias("within"))
    asking = store(blocks.join(within, (F.col("grp") == F.col("w_grp")) & (F.col("cell") == F.col("w_cell")) & (F.col("block") == F.col("w_block"))).select(*blocks.columns, "within"), "asking")

    # cells are dealt to chunks, and every two chunks of a group meet in one task: a block goes to each chunk once
    # and not to each block, and of what a vector meets in a chunk only its k nearest leave the task
    number = F.ceil(F.sum("n").over(Window.partitionBy("grp")) / CHUNK_ROWS)
    chunks = sizes.withColumns({"chunks": number, "chunk": F.pmod(F.xxhash64("cell"), number)}).select(F.col("grp").alias("c_grp"), F.col("cell").alias("c_cell"), "chunk", "chunks")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("to")

    def sent(df: DataFrame, asks: bool, within: Column) -> DataFrame:
        dealt_ = df.join(chunks, (F.col("grp") == F.col("c_grp")) & (F.col("cell") == F.col("c_cell")))
        dealt_ = dealt_.select("grp", "cell", "block", "ids", "u", within.alias("within"), F.lit(asks).alias("asks"), "chunk", every)
        own, to = ("chunk_a", "chunk_b") if asks else ("chunk_b", "chunk_a")
        return dealt_.withColumnsRenamed({"chunk": own, "to": to})

    key = ("grp", "chunk_a", "chunk_b")
    many = F.col("grp").isin(list(cells.pivots))
    both = sent(asking.filter(many), True, F.col("within")).unionByName(sent(blocks.filter(many), False, F.lit(None).cast("array<double>")))

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, key):
            asks, cell, block = (table.column(c).to_numpy(zero_copy_only=False) for c in ("asks", "cell", "block"))
            ids = table.column("ids").combine_chunks()
            start, every_id = ids.offsets.to_numpy(), ids.values
            order = np.unique(every_id.to_numpy(zero_copy_only=False), return_inverse=True)[1]
            u = lambda r: table.column("u")[int(r)].values.to_numpy().reshape(start[r + 1] - start[r], -1)  # noqa: B023, E731
            grp, others = table.column("grp")[0].as_py(), [(r, u(r)) for r in np.flatnonzero(~asks)]
            for r in np.flatnonzero(asks):
                mine, within_r = u(r), table.column("within")[int(r)].values.to_numpy()
                hold, met, found = shared.value.may_hold(grp, mine, within_r), 0, []
                for s, theirs in others:
                    some = np.flatnonzero(hold[:, cell[s]])
                    if cell[s] == cell[r] or not len(some):
                        continue
                    met += len(some) * len(theirs)
                    p, q, d = _nearest(mine[some], theirs, False, order[start[s] : start[s + 1]], k, np.ones((len(some), len(theirs)), bool))
                    near = np.sqrt(2 * np.maximum(d, 0)) <= within_r[some[p]] + 1e-6  # nothing farther than the bound is needed
                    found.append((some[p][near], start[s] + q[near], d[near]))
                if not found:
                    continue
                p, q, d = (np.concatenate(v) for v in zip(*found, strict=True))
                at = np.lexsort((order[q], d, p))
                p, q, d = p[at], q[at], d[at]
                best = np.arange(len(p)) - np.searchsorted(p, p) < k
                p, q, d = p[best], q[best], d[best]
                rest = [pa.array(np.full(len(p), v[r]), pa.int64()) for v in (cell, block)]
                count = pa.array(np.where(np.arange(len(p)) == 0, met, 0), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([grp] * len(p), g), every_id.take(pa.array(start[r] + p)), every_id.take(pa.array(q)), pa.array(d, pa.float64()), *rest, count], names=["grp", "id", "other", "d", "cell", "block", "n_pairs"])

    both = both.select(*key, "cell", "block", "ids", "u", "within", "asks").repartition(*key).sortWithinPartitions(*key)
    return first.unionByName(both.mapInArrow(visit, out))


def _merged(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("grp", "id").orderBy("d", "other")
    return found.select("grp", "id", "other", "d").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def local_outlier_factor(vectors: DataFrame, k: int = 20, threshold: float = 1.5) -> DataFrame:
    """(grp, id, lof, is_anomaly): how much sparser a vector's surroundings are than those of its k neighbours.

    Groups of k or fewer vectors score 0 and have no anomalies.
    """
    sizes = bounded(vectors.groupBy(F.col("grp").alias("s_grp")).agg(F.count(F.lit(1)).alias("size")), 64)
    sized = vectors.join(sizes, F.col("grp").eqNullSafe(F.col("s_grp"))).drop("s_grp")
    near = store(knn(sized.filter(F.col("size") > k), k), "nearest")  # read four times
    reach = near.groupBy("grp", "id").agg(F.max("d").alias("k_distance"))
    right = reach.select(F.col("grp").alias("g2"), F.col("id").alias("other2"), "k_distance")
    pairs = near.join(right, (F.col("grp") == F.col("g2")) & (F.col("other") == F.col("other2"))).drop("g2", "other2")
    density = pairs.groupBy("grp", "id").agg((1 / (F.avg(F.greatest("d", "k_distance")) + 1e-10)).alias("lrd"))
    theirs = density.select(F.col("grp").alias("g3"), F.col("id").alias("other3"), F.col("lrd").alias("o_lrd"))
    mean = near.join(theirs, (F.col("grp") == F.col("g3")) & (F.col("other") == F.col("other3"))).groupBy("grp", "id").agg(F.avg("o_lrd").alias("around"))
    lof = mean.join(density, ["grp", "id"]).select("grp", "id", (F.col("around") / F.col("lrd")).alias("lof"))
    out = sized.select("grp", "id").join(lof, ["grp", "id"], "left").withColumn("lof", F.coalesce("lof", F.lit(0.0)))
    return out.withColumn("is_anomaly", F.col("lof") > threshold)


class Embedder(Protocol):
    """Anything that turns points into (id_record, id_vehicle, embedding)."""

    def __call__(self, points: DataFrame) -> DataFrame: ...


def motion_features(points: DataFrame, steps: int = 20) -> DataFrame:
    """A fixed embedding: a track's changes of ego position, averaged over `steps` equal stretches of its frames.

    Stands in for a trained encoder; tables of embeddings from elsewhere have the same columns.
    """
    moved = ego(points)
    w, each = Window.partitionBy(*KEY).orderBy("ord"), Window.partitionBy(*KEY)
    n = F.count(F.lit(1)).over(each)
    part = F.floor((F.row_number().over(w) - 1) * steps / n).alias("part")
    means = moved.select(*KEY, part, "d_ego_x", "d_ego_y").groupBy(*KEY, "part").agg(F.avg("d_ego_x").alias("dx"), F.avg("d_ego_y").alias("dy"))
    parts = means.groupBy(*KEY).agg(F.map_from_entries(F.collect_list(F.struct("part", F.array("dx", "dy")))).alias("m"))
    at = [F.coalesce(F.try_element_at("m", F.lit(i).cast("long")), F.array(F.lit(0.0), F.lit(0.0))) for i in range(steps)]
    return parts.select(*KEY, F.concat(*at).alias("embedding"))


def score_groups(conflicts: DataFrame, least: int = 20) -> DataFrame:
    """(c_a, c_b, cluster, class_name, id_record, id_vehicle): the trajectories scored together.

    For each pair of different clusters and each side, the vehicles of one class: of rule breakers where there are more
    than `least`, else of all if those are more.
    """
    ok = conflicts.filter("Vehicle_Cluster_1 <> -1 and Vehicle_Cluster_2 <> -1 and Vehicle_Cluster_1 <> Vehicle_Cluster_2")
    pair = [F.least("Vehicle_Cluster_1", "Vehicle_Cluster_2").alias("c_a"), F.greatest("Vehicle_Cluster_1", "Vehicle_Cluster_2").alias("c_b")]
    sides = F.explode(F.array(*(F.struct(F.col(f"Vehicle_Cluster_{s}").alias("cluster"), F.col(f"Vehicle_Class_{s}").alias("class_name"), F.col(f"idVehicle{s}").alias("id_vehicle")) for s in (1, 2))))
    broke = (~F.coalesce("Auto_Rule_Flag", F.lit(True))).alias("broke")
    rows = ok.select(*pair, F.col("idRecord").alias("id_record"), broke, sides.alias("v")).select("c_a", "c_b", "id_record", "broke", "v.*")
    group = Window.partitionBy("c_a", "c_b", "cluster", "class_name")
    counted = rows.withColumns({"n_broke": F.sum(F.col("broke").cast("int")).over(group), "n_all": F.count(F.lit(1)).over(group)})
    kept = counted.filter(((F.col("n_broke") > least) & F.col("broke")) | ((F.col("n_broke") <= least) & (F.col("n_all") > least)))
    return kept.select("c_a", "c_b", "cluster", "class_name", "id_record", "id_vehicle").distinct()


def write_scores(conflicts: DataFrame, scores: DataFrame, suffix: str = "") -> DataFrame:
    """LOF1, is_anomaly1, LOF2, is_anomaly2 from scores (id_record, id_vehicle, cluster, conflicting_cluster, lof, is_anomaly)."""
    out = conflicts
    for role, other in ((1, 2), (2, 1)):
        s = scores.groupBy("id_record", "id_vehicle", "cluster", "conflicting_cluster").agg(F.max(F.struct("lof", "is_anomaly")).alias("s"))
        s = s.select(*(F.col(c).alias(f"s_{c}") for c in ("id_record", "id_vehicle", "cluster", "conflicting_cluster")), "s")
        on = (
            (F.col("idRecord") == F.col("s_id_record"))
            & (F.col(f"idVehicle{role}") == F.col("s_id_vehicle"))
            & (F.col(f"Vehicle_Cluster_{role}") == F.col("s_cluster"))
            & (F.col(f"Vehicle_Cluster_{other}") == F.col("s_conflicting_cluster"))
        )
        old = lambda c: F.col(c) if c in conflicts.columns else F.lit(None)
        lof, odd = f"LOF{role}{suffix}", f"is_anomaly{role}{suffix}"
        out = out.join(s, on, "left").withColumns({lof: F.coalesce(F.col("s.lof"), old(lof)), odd: F.coalesce(F.col("s.is_anomaly"), old(odd).cast("boolean"))})
        out = out.drop("s", "s_id_record", "s_id_vehicle", "s_cluster", "s_conflicting_cluster")
    return out
