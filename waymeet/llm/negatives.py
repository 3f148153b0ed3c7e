"""Hard negatives by blocked matrix products: every anchor against every row, in two passes.

Vectors become whole numbers, floor(scale * x), kept as float64: products are exact while they stay below 2^53. Anchors
are cut into blocks that fit a broadcast; for each block all rows stream by in blocks of their own and one matrix
product scores block against block. The first pass keeps the best few rows of an anchor's label (its positives), the
second the best few rows of other labels inside each positive's window of scores. A task only sends what it kept, and
what tasks kept merges by the same order, so nothing depends on how rows are dealt.

How much a task keeps does not shrink with its share of the rows. So a pilot of the rows goes first, and what it finds
is a lower bound that all tasks start from: later tasks send only rows that reach it.

Defined results: rows with a null label, a null vector or a null or non-finite component (times scale) take no part; a
shorter vector counts as padded with zeros; repeated rows are rows of their own (an anchor's copy is a positive of it, the row itself is
not) and repeated anchors give their results each; a null vec_id is no anchor and comes last among ties; other columns
are ignored; scores outside the range of a long are compared exactly and returned as the nearest long; an empty table
gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch_path, store, tune

#: Bytes of an anchor block's vectors, which bounds what is broadcast, and of the rows of one matrix product.
ANCHOR_BYTES = 16 << 20
TILE = 1024
#: Rows up to these are scored as float64.
EXACT = float(1 << 53)
#: The pilot is one row in so many.
PILOT = 16
LEAST_ID = -(1 << 63)
_KEPT = pa.schema([("anchor_row", pa.int64()), ("slot", pa.int32()), ("score", pa.int64()), ("exact", pa.string()), ("no_id", pa.bool_()), ("vec_id", pa.int64())])
KEPT_DDL = "anchor_row long, slot int, score long, exact string, no_id boolean, vec_id long"


@dataclass
class Anchors:
    """One block of anchors: row numbers, labels and whole-number vectors, with windows and bounds for each of their slots."""

    row: np.ndarray
    label: np.ndarray
    vectors: np.ndarray
    #: (anchor, slot): least and greatest score that counts, as whole numbers in object or float64 arrays.
    low: np.ndarray
    high: np.ndarray
    same: bool


def whole_numbers(rows: DataFrame, scale: int) -> DataFrame:
    """(vec_id, label, v): rows that take part, with floor(scale * x) of each component, as double."""
    cols = set(rows.columns)
    got = rows.select(*(F.col(f"`{c}`").cast(k).alias(a) if c in cols else F.lit(None).cast(k).alias(a) for c, k, a in (("vec_id", "long", "vec_id"), ("label", "long", "label"), ("embedding", "array<double>", "x"))))
    fine = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * scale) < F.lit(float("inf"))))
    # floor() of a double is a long, which large values do not fit; beyond 2^53 every double is a whole number
    one = lambda x: F.when(F.abs(x * scale) < EXACT, F.floor(x * scale).cast("double")).otherwise(x * scale)
    return got.filter(F.col("label").isNotNull() & F.col("x").isNotNull() & fine).select("vec_id", "label", F.transform("x", one).alias("v"))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """The vectors of a column of lists as rows of one matrix, padded with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == dims).all():
        return flat.reshape(len(sizes), dims)
    out = np.zeros((len(sizes), dims))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a times b transposed, exactly: float64 where every partial sum is below 2^53, Python's whole numbers elsewhere."""
    if not len(a) or not len(b) or not a.shape[1]:
        return np.zeros((len(a), len(b)))
    big_a, big_b = np.abs(a).max(axis=1), np.abs(b).max(axis=1)
    room = EXACT / a.shape[1]
    with np.errstate(over="ignore"):
        if big_a.max() * big_b.max() < room:
            return a @ b.T
        huge = np.multiply.outer(big_a, big_b) >= room
        plain = np.where(huge, 0, a @ b.T)
    out = np.where(np.isfinite(plain), plain, 0).astype(np.int64).astype(object)
    for i in np.flatnonzero(huge.any(axis=1)):
        mine = [int(x) for x in a[i]]
        for j in np.flatnonzero(huge[i]):
            out[i, j] = sum(x * int(y) for x, y in zip(mine, b[j], strict=True))
    return out


def _best(anchor: np.ndarray, score: np.ndarray, no_id: np.ndarray, vec_id: np.ndarray, k: int) -> list[np.ndarray]:
    """The first k of each anchor by falling score, then vec_id (nulls last)."""
    order = np.lexsort((vec_id, no_id, -score, anchor)) if score.dtype != object else np.array(sorted(range(len(score)), key=lambda i: (anchor[i], -score[i], no_id[i], vec_id[i])), int)
    cols = [c[order] for c in (anchor, score, no_id, vec_id)]
    of = cols[0]
    first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else np.zeros(0, int)
    rank = np.arange(len(of)) - np.repeat(first, np.diff(np.r_[first, len(of)]))
    return [c[rank < k] for c in cols]


def keep_best(block: Anchors, batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """The first k rows of every (anchor, slot) among `batches`, rows of (row, vec_id, label, v)."""
    n, slots = block.low.shape
    dims = block.vectors.shape[1]
    floor = block.low.copy()
    kept = [[np.zeros(0, np.int64), np.zeros(0), np.zeros(0, bool), np.zeros(0, np.int64)] for _ in range(slots)]
    for batch in batches:
        rows, labels = batch.column("row").to_numpy(), batch.column("label").to_numpy()
        no_id = np.asarray(batch.column("vec_id").is_null())
        ids = batch.column("vec_id").fill_null(LEAST_ID).to_numpy(zero_copy_only=False)
        vectors = _matrix(batch.column("v"), dims)
        for at in range(0, len(rows), TILE):
            cut = slice(at, at + TILE)
            for top in range(0, n, TILE):
                who = slice(top, min(n, top + TILE))
                score = products(block.vectors[who], vectors[cut])
                agree = block.label[who, None] == labels[None, cut]
                may = agree & (block.row[who, None] != rows[None, cut]) if block.same else ~agree
                for s in range(slots):
                    hit = may & (score >= floor[who, s, None]) & (score <= block.high[who, s, None])
                    i, j = np.nonzero(hit)
                    if not len(i):
                        continue
                    old = kept[s]
                    new_score = score[i, j]
                    if new_score.dtype == object or old[1].dtype == object:
                        old[1], new_score = (np.array([int(x) for x in y] + [None], object)[:-1] for y in (old[1], new_score))
                    here = (old[0] >= top) & (old[0] < top + TILE)
                    join = [np.concatenate((o[here], x)) for o, x in zip(old, (i + top, new_score, no_id[cut][j], ids[cut][j]), strict=True)]
                    join = _best(*join, k)
                    kept[s] = [np.concatenate((o[~here], x)) for o, x in zip(old, join, strict=True)]
                    if join[1].dtype == object:
                        continue
                    full, count = np.unique(join[0], return_counts=True)
                    ends = np.cumsum(count) - 1
                    whole = count == k
                    floor[full[whole], s] = np.maximum(floor[full[whole], s], join[1][ends[whole]])
    for s, (of, score, no_id, ids) in enumerate(kept):
        for at in range(0, len(of), 1 << 15):
            cut = slice(at, at + (1 << 15))
            exact = [int(x) for x in score[cut]]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(block.row[of[cut]]),
                    pa.array(np.full(len(exact), s, np.int32)),
                    pa.array([min(max(x, LEAST_ID), -LEAST_ID - 1) for x in exact], pa.int64()),
                    pa.array([None if -(1 << 63) <= x < 1 << 63 else str(x) for x in exact], pa.string()),
                    pa.array(no_id[cut]),
                    pa.array(ids[cut]),
                ],
                schema=_KEPT,
            )


def _merged(found: DataFrame, k: int) -> DataFrame:
    """The first k of every (anchor_row, slot), with rank; scores beyond a long are told apart by their digits."""
    digits = F.coalesce("exact", F.col("score").cast("string"))
    size = F.when(digits.startswith("-"), -F.length(digits)).otherwise(F.length(digits))
    # longer numbers are greater, and of equally long ones the greater text; for negative ones both turn round
    key = F.struct(F.col("score").alias("a"), size.alias("b"), F.when(~digits.startswith("-"), digits).alias("c"))
    tail = F.when(digits.startswith("-"), digits)
    order = Window.partitionBy("anchor_row", "slot").orderBy(key.desc(), tail.asc(), "no_id", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _window(score: int, low: tuple[int, int], high: tuple[int, int]) -> tuple[int, int]:
    """Whole numbers x with low * score <= x <= high * score, low and high being fractions."""
    return -((-score * low[0]) // low[1]), (score * high[0]) // high[1]


def _numbers(values: list[list[int]]) -> np.ndarray:
    """Bounds as float64 where that is exact, else as whole numbers."""
    flat = [x for row in values for x in row]
    fits = all(abs(x) < EXACT for x in flat)
    return np.array(values, np.float64 if fits else object).reshape(len(values), -1)


def mine(
    rows: DataFrame,
    *,
    anchors: str = "vec_id % 100 = 0",
    scale: int = 256,
    n_positives: int = 5,
    n_negatives: int = 10,
    low: tuple[int, int] = (30, 100),
    high: tuple[int, int] = (90, 100),
    anchor_bytes: int = ANCHOR_BYTES,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of every anchor.

    rows: (vec_id, label, embedding); anchors: which rows are anchors, an SQL condition over vec_id and label. Of an
    anchor, the n_positives other rows of its label with the highest inner products are its positives; for each of these
    the n_negatives best rows of other labels between low and high times the positive's score are returned.
    """
    spark = rows.sparkSession
    tune(spark)
    all_rows = store(whole_numbers(rows, scale).withColumn("row", F.monotonically_increasing_id()), "vectors")
    dims, n_anchors = all_rows.agg(F.coalesce(F.max(F.size("v")), F.lit(0)), F.count(F.when(F.expr(anchors), 1))).first()
    n_blocks = max(1, math.ceil(n_anchors * (dims + 8) * 8 / anchor_bytes))
    queries = store(all_rows.filter(anchors).withColumn("block", F.pmod(F.xxhash64("row"), F.lit(n_blocks))), "anchors")
    path = scratch_path(spark, "negatives")
    ddl = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    spark.createDataFrame([], ddl).write.parquet(path)
    for part in range(n_blocks if n_anchors else 0):
        _one_block(all_rows, queries.filter(F.col("block") == part), dims, n_positives, n_negatives, low, high).write.mode("append").parquet(path)
    return spark.read.schema(ddl).parquet(path)


def _pass(all_rows: DataFrame, block: Anchors, k: int) -> DataFrame:
    """The first k rows of every (anchor, slot) of the block, out of all rows."""
    spark = all_rows.sparkSession

    def run_with(sent):
        return lambda batches: keep_best(sent.value, batches, k)

    pilot = F.pmod(F.xxhash64("row", F.lit("pilot")), F.lit(PILOT)) == 0
    first = store(_merged(all_rows.filter(pilot).mapInArrow(run_with(spark.sparkContext.broadcast(block)), KEPT_DDL), k), "pilot")
    raised = _raise(block, first.filter(F.col("rank") == k).collect())
    rest = all_rows.filter(~pilot).mapInArrow(run_with(spark.sparkContext.broadcast(raised)), KEPT_DDL)
    return store(_merged(first.drop("rank").unionByName(rest), k), "best")


def _raise(block: Anchors, told: list) -> Anchors:
    """The block with the score of each slot's last kept row as its least one; as many rows as the block has slots."""
    at = {int(r): i for i, r in enumerate(block.row)}
    floor = block.low.copy()
    for r in told:
        value = int(r["exact"] or r["score"])
        if abs(value) >= EXACT and floor.dtype != object:
            floor = floor.astype(object)
        i, s = at[r["anchor_row"]], r["slot"]
        floor[i, s] = max(floor[i, s], value)
    return Anchors(block.row, block.label, block.vectors, floor, block.high, block.same)


def _one_block(all_rows, anchors, dims, n_positives, n_negatives, low, high) -> DataFrame:
    got = anchors.select("row", "vec_id", "label", "v").toArrow()
    got = got.combine_chunks()
    vectors = _matrix(got.column("v").combine_chunks() if got.num_rows else pa.array([], pa.list_(pa.float64())), dims)
    row, label = got.column("row").to_numpy(), got.column("label").to_numpy()
    endless = np.full((len(row), 1), np.inf)
    positives = _pass(all_rows, Anchors(row, label, vectors, -endless, endless, True), n_positives)
    at = {int(r): i for i, r in enumerate(row)}
    bounds = [[(1, 0)] * n_positives for _ in row]
    for p in positives.select("anchor_row", "rank", "score", "exact").toLocalIterator():
        bounds[at[p["anchor_row"]]][p["rank"] - 1] = _window(int(p["exact"] or p["score"]), low, high)
    windows = Anchors(row, label, vectors, _numbers([[b[0] for b in r] for r in bounds]), _numbers([[b[1] for b in r] for r in bounds]), False)
    negatives = _pass(all_rows, windows, n_negatives)
    named = positives.select(
        "anchor_row", (F.col("rank") - 1).alias("slot"), F.when(~F.col("no_id"), F.col("vec_id")).alias("positive_id"), F.col("score").alias("positive_score")
    )
    ids = anchors.select(F.col("row").alias("anchor_row"), F.col("vec_id").alias("anchor_id"))
    out = negatives.select("anchor_row", "slot", "rank", F.when(~F.col("no_id"), F.col("vec_id")).alias("negative_id"), F.col("score").alias("negative_score"))
    return out.join(named, ["anchor_row", "slot"]).join(ids, "anchor_row").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
