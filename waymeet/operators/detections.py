"""Detections: suppression of doubles, matching with ground truth, precision and recall."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import boxes
from ..storage import bounded, store, tasks_for
from .near_frames import runs

BOX = ("x1", "y1", "x2", "y2")


def suppress(found: DataFrame, *, iou: float = 0.65, conf: float = 0.25, most_in: int = 30_000, most_out: int = 300) -> DataFrame:
    """Per frame and class: boxes (frame_id, det_id, cls, conf, x1, y1, x2, y2) that no better box overlaps by more than iou.

    Candidates are the most_in best of a frame and results its most_out best; both are the operator's own limits.
    """
    rows = found.filter(F.col("conf") > conf).withColumn("frame_id", F.col("frame_id").cast("long"))

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in _whole_frames(batches):
            at, ids = {c: whole.column(c).to_numpy() for c in ("cls", *BOX)}, _frame_ids(whole)
            frame = np.cumsum(np.r_[False, ids[1:] != ids[:-1]])
            fits = np.flatnonzero(_nth(frame) < most_in)
            alive = fits[_best(frame[fits], at["cls"][fits], np.stack([at[c][fits] for c in BOX], axis=1), iou)]
            yield from whole.take(pa.array(alive[_nth(frame[alive]) < most_out])).combine_chunks().to_batches()

    return rows.repartition("frame_id").sortWithinPartitions("frame_id", F.desc("conf"), "det_id", *BOX).mapInArrow(judged, rows.schema)


def _frame_ids(rows: pa.RecordBatch | pa.Table) -> np.ndarray:
    """Rows without a frame are a frame, the first."""
    return np.asarray(rows.column("frame_id").fill_null(-(1 << 63)))


def _whole_frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of many frames, none of which is cut."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = _frame_ids(batch)
        cut = int(np.searchsorted(ids, ids[-1]))  # where the last frame begins, which may go on
        if held and (cut or _frame_ids(held[-1])[0] != ids[0]):
            yield pa.Table.from_batches([*held, batch.slice(0, cut)] if cut else held)
            held = []
        elif cut:
            yield pa.Table.from_batches([batch.slice(0, cut)])
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def _nth(group: np.ndarray) -> np.ndarray:
    """The place of each row in its group, from 0; groups are runs."""
    start = np.flatnonzero(np.r_[True, group[1:] != group[:-1]][: len(group)])
    return np.arange(len(group)) - np.repeat(start, np.diff(np.r_[start, len(group)]))


def _best(frame: np.ndarray, cls: np.ndarray, box: np.ndarray, iou: float) -> np.ndarray:
    """Rows that no better one of their frame and class that stays overlaps by more than iou; better ones come first.

    The first boxes of all frames and classes are laid on those after them at once, then the second ones that are left.
    """
    order = np.lexsort((cls, frame))
    f, c, b = frame[order], cls[order], box[order].T.copy()
    size = (b[2] - b[0]) * (b[3] - b[1])
    start = np.flatnonzero(np.r_[True, (f[1:] != f[:-1]) | (c[1:] != c[:-1])][: len(f)])
    end = np.repeat(np.r_[start[1:], len(f)], np.diff(np.r_[start, len(f)]))
    alive, first = np.ones(len(f), bool), start
    ends = end[start]
    while len(first):
        n = ends - first - 1
        p, q = np.repeat(first, n), runs(first + 1, n)
        some = alive[q]
        p, q = p[some], q[some]
        both = np.clip(np.minimum(b[2][p], b[2][q]) - np.maximum(b[0][p], b[0][q]), 0, None) * np.clip(np.minimum(b[3][p], b[3][q]) - np.maximum(b[1][p], b[1][q]), 0, None)
        alive[q[both > iou * (size[p] + size[q] - both)]] = False
        # the next of each group that is left
        left = np.r_[np.flatnonzero(alive), len(f)]
        after = left[np.searchsorted(left, first + 1)]
        first, ends = after[after < ends], ends[after < ends]
    return np.sort(order[alive])


def overlaps(found: DataFrame, truth: DataFrame) -> DataFrame:
    """Boxes of a frame against its true ones (frame_id, truth_id, t_cls, t_x1 ..): det_id, cls, conf, truth_id, t_cls, iou."""
    both = found.join(truth, "frame_id")
    iou = boxes.iou(tuple(F.col(c) for c in BOX), tuple(F.col(f"t_{c}") for c in BOX))
    return both.select("frame_id", "det_id", "cls", "conf", "truth_id", "t_cls", iou.alias("iou"))


def confusion(found: DataFrame, truth: DataFrame, *, iou: float = 0.45, conf: float = 0.25) -> DataFrame:
    """(cls, t_cls, n): one-to-one matches by falling IoU; null stands for a missing side."""
    good = found.filter(F.col("conf") > conf)
    pairs = overlaps(good, truth).filter(F.col("iou") > iou)
    # each detection keeps its best truth, then each truth its best detection
    pick = lambda side, other: F.row_number().over(Window.partitionBy("frame_id", side).orderBy(F.desc("iou"), other))
    pairs = pairs.withColumn("rn", pick("det_id", "truth_id")).filter("rn = 1").withColumn("rn", pick("truth_id", "det_id")).filter("rn = 1")
    hit = pairs.select("cls", "t_cls")
    missed = truth.join(pairs, ["frame_id", "truth_id"], "left_anti").select(F.lit(None).cast("int").alias("cls"), "t_cls")
    extra = good.join(pairs, ["frame_id", "det_id"], "left_anti").select("cls", F.lit(None).cast("int").alias("t_cls"))
    return hit.unionByName(missed).unionByName(extra).groupBy("cls", "t_cls").agg(F.count(F.lit(1)).alias("n"))


def _ranged(judged: DataFrame) -> tuple[DataFrame, int]:
    """judged by falling confidence in ranges that may cut a class anywhere, with the number of the range as part; and how many."""
    parts = tasks_for(judged.sparkSession, judged.count())
    return store(judged.repartitionByRange(parts, "cls", F.desc("conf"), "det_id").withColumn("part", F.spark_partition_id()), "judged"), parts


def precision_recall(judged: DataFrame, truth_counts: DataFrame) -> DataFrame:
    """judged: (cls, conf, det_id, tp); truth_counts: (cls, n_truth). Adds precision and recall at each confidence.

    Sums run inside ranges of a class and over the ranges' totals, so a class of any size is spread over many tasks.
    """
    rows, parts = _ranged(judged)
    before = Window.partitionBy("cls").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("part", "cls").agg(F.sum(F.col("tp").cast("long")).alias("tps"), F.count(F.lit(1)).alias("ns"))
    totals = totals.select("part", "cls", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in ("tps", "ns")))
    w = Window.partitionBy("part", "cls").orderBy(F.desc("conf"), "det_id").rowsBetween(Window.unboundedPreceding, 0)
    out = rows.repartitionById(parts, "part").join(bounded(totals, 40), ["part", "cls"])
    out = out.withColumns({"tp_sum": F.sum(F.col("tp").cast("long")).over(w) + F.col("tps"), "n_sum": F.count(F.lit(1)).over(w) + F.col("ns")}).drop("tps", "ns")
    out = out.join(bounded(truth_counts, 16), "cls")
    return out.withColumns({"precision": F.col("tp_sum") / F.col("n_sum"), "recall": F.col("tp_sum") / F.col("n_truth")})


def average_precision(judged: DataFrame, truth_counts: DataFrame, points: int = 101) -> DataFrame:
    """(cls, ap): area under the falling envelope of precision, read at equal steps of recall and summed by trapezoids.

    Every row of the envelope goes to the one step that it is next to, so a class is read in one row a step. Recall rises
    and the envelope falls along a class, so a step needs the ends of both; rows that leave recall as it is are below.
    """
    pr = precision_recall(judged, truth_counts)
    later = Window.partitionBy("cls").orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    tops = pr.groupBy("part", "cls").agg(F.max("precision").alias("top")).select("part", "cls", F.max("top").over(later).alias("top"))
    after = Window.partitionBy("part", "cls").orderBy(F.desc("n_sum")).rowsBetween(Window.unboundedPreceding, 0)
    env = pr.join(bounded(tops, 32), ["part", "cls"]).withColumn("env", F.greatest(F.max("precision").over(after), "top"))
    env = env.filter("tp or n_sum = 1")
    last = points - 1
    at = F.ceil(F.col("recall") * last).cast("int")
    at = F.when((at - 1) / last >= F.col("recall"), at - 1).when(at / last < F.col("recall"), at + 1).otherwise(at)
    ends = env.groupBy("cls", at.alias("k")).agg(*(f(c).alias(f"{n}_{c}") for f, n in ((F.min, "least"), (F.max, "most")) for c in ("recall", "env")))
    pair = lambda r, e: F.struct(F.col(r).alias("recall"), F.col(e).alias("env"))
    steps = ends.select("cls", "k", pair("most_recall", "least_env").alias("lo"), pair("least_recall", "most_env").alias("hi"))
    # a row is at or below the steps from its own on, and above all before it
    grid = truth_counts.select("cls", F.explode(F.sequence(F.lit(0), F.lit(last))).alias("k"))
    grid = grid.join(steps, ["cls", "k"], "full")
    down = Window.partitionBy("cls").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    up = Window.partitionBy("cls").orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, -1)
    read = grid.select("cls", "k", (F.col("k") / last).alias("r"), F.max("lo").over(down).alias("lo"), F.min("hi").over(up).alias("hi")).filter(F.col("k") <= last)
    # between two recalls the envelope runs straight; before the first it is 1, after the last 0
    r0, e0 = F.coalesce("lo.recall", F.lit(0.0)), F.coalesce("lo.env", F.lit(1.0))
    value = F.when(F.col("hi").isNull(), F.when(F.col("lo.recall") == F.col("r"), e0).otherwise(0.0)).otherwise(e0 + (F.col("hi.env") - e0) * (F.col("r") - r0) / (F.col("hi.recall") - r0))
    half = F.when(F.col("k").isin(0, last), 0.5).otherwise(1.0)
    return read.withColumn("v", value * half).groupBy("cls").agg((F.sum("v") / last).alias("ap"))


def best_f1(judged: DataFrame, truth_counts: DataFrame) -> DataFrame:
    """(cls, conf, precision, recall, f1): per class the confidence with the best harmonic mean of precision and recall, the highest of equals.

    Detections of one confidence stand or fall together.
    """
    pr = precision_recall(judged, truth_counts).groupBy("cls", "conf").agg(F.max_by(F.struct("precision", "recall"), "n_sum").alias("p"))
    f1 = 2 * F.col("p.precision") * F.col("p.recall") / (F.col("p.precision") + F.col("p.recall") + 1e-16)
    best = pr.withColumn("f1", F.round(f1, 9)).groupBy("cls").agg(F.max(F.struct("f1", "conf", "p")).alias("b"))
    return best.select("cls", "b.conf", "b.p.precision", "b.p.recall", "b.f1")


def fitness(metrics: DataFrame) -> DataFrame:
    """Adds fitness: a tenth of the mean precision at overlap 0.5 (map50) and nine of that over overlaps 0.5 to 0.95 (map)."""
    return metrics.withColumn("fitness", 0.1 * F.col("map50") + 0.9 * F.col("map"))


def image_weights(truth: DataFrame, weights: DataFrame) -> DataFrame:
    """(frame_id, weight): the sum of the class weights (cls, weight) of a frame's objects."""
    return truth.join(bounded(weights.select("cls", "weight"), 16), "cls").groupBy("frame_id").agg(F.sum("weight").alias("weight"))


def class_weights(truth: DataFrame) -> DataFrame:
    """Inverse frequencies of classes that sum to one."""
    n = truth.groupBy("cls").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("weight", (1 / F.col("n")) / F.sum(1 / F.col("n")).over(Window.partitionBy()))


def anchor_recall(sizes: DataFrame, anchors: list[tuple[float, float]], threshold: float = 4.0) -> DataFrame:
    """How well anchors fit boxes (w, h): the share that some anchor fits within a factor of threshold, and anchors above it per box."""
    ratio = lambda a: F.least(*(F.least(F.col(c) / v, F.lit(v) / F.col(c)) for c, v in zip("wh", a, strict=True)))
    fits = F.array(*(ratio(tuple(map(float, a))) for a in anchors))
    rows = sizes.select(F.array_max(fits).alias("best"), F.size(F.filter(fits, lambda r: r > 1 / threshold)).alias("above"))
    return rows.agg(F.avg((F.col("best") > 1 / threshold).cast("double")).alias("recall"), F.avg("above").alias("anchors_above"), F.count(F.lit(1)).alias("boxes"))


def fit_anchors(sizes: DataFrame, k: int = 9, seed: int = 1) -> list[tuple[float, float]]:
    """k anchors, by area, as the centres of box sizes (w, h); k numbers are all that reaches the driver."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=["w", "h"], outputCol="features", handleInvalid="skip").transform(sizes.select(F.col("w").cast("double"), F.col("h").cast("double")))
    centres = KMeans(k=k, seed=seed, maxIter=30).fit(rows).clusterCenters()
    return sorted(((float(w), float(h)) for w, h in centres), key=lambda a: a[0] * a[1])


def check_labels(rows: DataFrame, columns: int = 15, bounded: tuple[int, int] = (1, 7)) -> DataFrame:
    """Per label file (path, text: one object a line, numbers between spaces): n objects, and found, missing, empty or corrupt.

    Corrupt are files with a line of another length, with what is no number, a negative one, one above 1 in the bounded
    columns, or a line twice. A null text is a missing file.
    """
    lines = F.filter(F.split(F.trim("text"), r"\r?\n"), lambda s: F.trim(s) != "")
    values = F.transform(lines, lambda s: F.transform(F.split(F.trim(s), r"\s+"), lambda v: v.try_cast("double")))
    bad = lambda r: (F.size(r) != columns) | F.exists(r, lambda v: v.isNull() | (v < 0)) | F.exists(F.slice(r, bounded[0] + 1, bounded[1] - bounded[0]), lambda v: v > 1)
    out = rows.select("path", "text", values.alias("v")).withColumn("n", F.size("v"))
    corrupt = F.exists("v", bad) | (F.size(F.array_distinct("v")) != F.col("n"))
    state = F.when(F.col("text").isNull(), "missing").when(F.col("n") == 0, "empty").when(corrupt, "corrupt").otherwise("found")
    return out.select("path", F.when(F.col("text").isNull(), 0).otherwise(F.col("n")).alias("n"), state.alias("state"))
