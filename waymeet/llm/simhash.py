"""SimHash fingerprints and near-duplicate groups by meet-in-the-middle ball hashing.

Two fingerprints differ in at most 2r bits exactly if some value lies within r bits of both. So every distinct
fingerprint emits all values within r bits, values that two fingerprints share are shuffled together, and sharing one
proves the link (the distance is verified all the same). A value is a prefix and a rest: the prefix part of the ball
is emitted before the shuffle, the rest of it inside the task that owns the prefix, so a few dozen small rows travel
for each fingerprint instead of some two thousand. Each task folds its links into a forest before it returns them.

Defined results: copies share a fingerprint, so they are one node; a null text is an empty one; texts without words
have fingerprint zero and link like any other; a null doc_id never names a component while another row can; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from .common import bounded, corpus, keep_rows, store, text_key, tune

BITS = 64


def fingerprint(text: bytes, width: int = 4, seed: int = 42) -> bytes:
    """The 8 bytes, highest first, of the SimHash of text's word shingles; A-Z are lower-cased, words split at white space."""
    words = text.lower().split()
    if not words:
        return bytes(8)
    line = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    starts = ends - size
    n = max(1, len(words) - width + 1)
    digest = xxhash.xxh64_digest
    ones = np.zeros(BITS, np.int64)
    for lo in range(0, n, 1 << 15):
        hi = min(n, lo + (1 << 15))
        stops = ends[lo + width - 1 : hi + width - 1].tolist() if len(words) >= width else [len(line)]
        raw = b"".join([digest(line[a:b], seed) for a, b in zip(starts[lo:hi].tolist(), stops, strict=True)])
        ones += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > n).tobytes()


def _fingerprints(width: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            raw = b"".join(fingerprint(t.as_py(), width, seed) for t in texts)
            fp = pa.array(np.frombuffer(raw, ">u8").astype(np.uint64).view(np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), fp], names=["doc_id", "text_key", "fp"])

    return run


def ball(bits: int, radius: int) -> list[tuple[int, int]]:
    """(mask, number of bits in it) for every mask of at most radius of the lowest bits."""
    return [(sum(1 << b for b in which), r) for r in range(radius + 1) for which in combinations(range(bits), r)]


def _rest_masks(bits: int, radius: int) -> list[np.ndarray]:
    return [np.array([m for m, _ in ball(bits, r)], np.uint64) for r in range(radius + 1)]


def links_of(fps: np.ndarray, left: np.ndarray, bits: int, limit: int, max_values: int = 2_000_000) -> tuple[np.ndarray, np.ndarray]:
    """Of fingerprints that emit values with up to left[i] flips among the lowest bits: (fp, root) forest of the links.

    Where the values would be too many for memory the next lower bits are dealt out first, part by part.
    """
    todo = [(np.arange(len(fps)), left.astype(np.int64), fps, bits)]
    a_s, b_s = [], []
    top = int(left.max()) if len(left) else 0
    while todo:
        who, may, at, low = todo.pop()
        if len(who) < 2:
            continue
        counts = [sum(math.comb(low, j) for j in range(r + 1)) for r in range(top + 1)]
        if sum(int((may == r).sum()) * counts[r] for r in range(top + 1)) > max_values and low > 8:
            step, next_low = 4, low - 4
            parts: dict[int, list] = {}
            for mask, used in ball(step, top):
                ok = may >= used
                moved = at[ok] ^ np.uint64(mask << next_low)
                part = (moved >> np.uint64(next_low)) & np.uint64((1 << step) - 1)
                for p in np.unique(part).tolist():
                    sel = part == p
                    parts.setdefault(p, []).append((who[ok][sel], may[ok][sel] - used, moved[sel]))
            todo += [(*(np.concatenate(x) for x in zip(*got, strict=True)), next_low) for got in parts.values()]
            continue
        masks = _rest_masks(low, top)
        keep = np.uint64((1 << low) - 1)
        values, owners = [], []
        for r in range(top + 1):
            sel = may == r
            if sel.any():
                values.append(((at[sel] & keep)[:, None] ^ masks[r][None, :]).ravel())
                owners.append(np.repeat(who[sel], len(masks[r])))
        value, owner = np.concatenate(values), np.concatenate(owners)
        order = np.argsort(value)
        value, owner = value[order], owner[order]
        same = value[1:] == value[:-1]
        if not same.any():
            continue
        first = np.maximum.accumulate(np.where(np.r_[True, ~same], np.arange(len(value)), 0))
        tail = np.flatnonzero(same) + 1
        pair = np.unique(owner[tail].astype(np.int64) * len(fps) + owner[first[tail]])
        a, b = pair // len(fps), pair % len(fps)
        good = (a != b) & (np.bitwise_count(fps[a] ^ fps[b]) <= limit)
        a_s.append(a[good])
        b_s.append(b[good])
    if not a_s:
        return fps[:0], fps[:0]
    a, b = np.concatenate(a_s), np.concatenate(b_s)
    root = np.arange(len(fps))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    moved = np.flatnonzero(root != np.arange(len(fps)))
    return fps[moved], fps[root[moved]]


def _bucket_links(rest: int, limit: int):
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(got: pa.Table) -> pa.Table:
        fps = got.column("fp").to_numpy().view(np.uint64)
        order = np.lexsort((got.column("may").to_numpy(), fps))
        a, b = links_of(fps[order], got.column("may").to_numpy()[order], rest, limit)
        return pa.table([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], schema=out)

    return run


def near_links(fps: DataFrame, max_bits: int = 4, bucket_values: int = 1_000_000) -> DataFrame:
    """(a, b): links between distinct fingerprints (fp long) at max_bits or fewer differing bits, as a forest per prefix."""
    half = -(-max_bits // 2)
    each = sum(math.comb(BITS, r) for r in range(half + 1))
    n = fps.count()
    prefix = min(28, max(4, math.ceil(math.log2(max(2, n * each / bucket_values)))))
    rest = BITS - prefix
    masks = F.array(*(F.struct(F.lit(m << rest if m << rest < 1 << 63 else (m << rest) - (1 << 64)).alias("mask"), F.lit(half - used).alias("may")) for m, used in ball(prefix, half)))
    sent = fps.select("fp", F.explode(masks).alias("m")).select("fp", F.col("m.may").alias("may"), F.shiftrightunsigned(F.col("fp").bitwiseXOR(F.col("m.mask")), rest).alias("prefix"))
    return sent.groupBy("prefix").applyInArrow(_bucket_links(rest, max_bits), "a long, b long")


def near_groups(docs: DataFrame, *, width: int = 4, max_bits: int = 4, seed: int = 42) -> DataFrame:
    """One row per document: doc_id, fp long, component_id (smallest doc_id reachable), text_key."""
    tune(docs.sparkSession)
    marked = store(corpus(docs).withColumn("text_key", text_key()).mapInArrow(_fingerprints(width, seed), "doc_id long, text_key long, fp long"), "fingerprints")
    nodes = store(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")), "nodes")
    edges = store(near_links(nodes.select("fp"), max_bits), "links")
    roots = components(edges)
    # only fingerprints that are linked to others travel: those that are alone name themselves
    linked = store(nodes.join(roots, nodes.fp == roots.node).select("fp", "root", "first_id"), "linked")
    whole = store(linked.groupBy("root").agg(F.min("first_id").alias("least")).select(F.col("root").alias("of"), "least"), "components")
    named = store(linked.join(bounded(whole, 24), F.col("root") == F.col("of")).select(F.col("fp").alias("node"), F.col("least").alias("component_id")), "named")
    alone = nodes.filter("n > 1").join(roots, nodes.fp == roots.node, "left_anti").select(F.col("fp").alias("node"), F.col("first_id").alias("component_id"))
    many = store(named.unionByName(alone), "many")
    out = marked.join(bounded(many, 24), marked.fp == many.node, "left")
    return out.select("doc_id", "fp", F.coalesce("component_id", "doc_id").alias("component_id"), "text_key")


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """One row of each group of linked fingerprints, the one with the smallest doc_id, with all its columns."""
    found = near_groups(docs)
    stays = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    # two rows may share the smallest doc_id: one text of them is enough
    stays = stays.groupBy("doc_id", F.when(F.col("doc_id").isNull(), F.col("fp")).alias("lone")).agg(F.min("text_key").alias("text_key"))
    return keep_rows(docs, stays.select("doc_id", "text_key"), "left_semi", one_each=True)
