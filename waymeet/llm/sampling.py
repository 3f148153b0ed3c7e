"""Bounded samples of labelled documents, the only sampling in this subpackage: models are fitted on them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import corpus

RANGE = 1 << 30
#: Parts of a Split.
READ, DEVELOP, POOL = 0, 1, 2


def fold_of(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null where the id is."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def _given(labels: DataFrame, column: str, usable: Column) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, label, draw) of usable labels 0 and 1, and how many there are of each.

    Ids labelled more than once take their largest label; null ids and labels are no labels. draw is a hash of the id.
    """
    given = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("label"))
        .filter(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1))
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
        .filter(usable)
        .withColumn("draw", F.pmod(F.xxhash64("doc_id", F.lit(column)), F.lit(RANGE)))
    )
    return given, {int(r["label"]): int(r["count"]) for r in given.groupBy("label").count().collect()}


def _texts_of(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """chosen with the text of each doc_id, one row each: of several documents with one id the smallest text counts.

    chosen is as many rows as its sampling rates allow, which is what bounds the broadcast.
    """
    text = corpus(docs)
    found = text.join(F.broadcast(chosen.withColumnRenamed("doc_id", "l_id")), text.doc_id == F.col("l_id")).drop("l_id")
    return found.groupBy("doc_id", *(c for c in chosen.columns if c != "doc_id")).agg(F.min("text").alias("text"))


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, usable: Column, per_class: int) -> tuple[DataFrame, dict[int, float]]:
    """(doc_id, label, text) of about per_class rows of each label among labels where `usable` holds, and each label's weight.

    Rows are chosen by a hash of doc_id, so the same on every run. A label's weight is how many rows each of its sampled
    rows stands for.
    """
    given, counts = _given(labels, column, usable)
    if not counts:
        return corpus(docs).withColumn("label", F.lit(None).cast("int")).filter(F.lit(False)), {}
    share = {k: min(1.0, per_class / n) for k, n in counts.items()}
    cut = F.coalesce(*(F.when(F.col("label") == k, F.lit(int(s * RANGE))) for k, s in share.items()), F.lit(0))
    return _texts_of(docs, given.filter(F.col("draw") < cut).drop("draw")), {k: 1 / s for k, s in share.items()}


@dataclass
class Split:
    """A sample (doc_id, part, label, text), the rate of label 1, and the weight of a seed row of each label.

    part READ and DEVELOP are the seeds, whose labels are known; part POOL is drawn without regard to the label, has
    none, and weighs 1 a row. Seeds weigh what makes both parts together look like the labelled rows.
    """

    rows: DataFrame
    rate: float
    counts: dict[int, int]
    weights: dict[int, float]


def seeds_and_pool(docs: DataFrame, labels: DataFrame, column: str, usable: Column, *, seed_share: float, seeds: int, pool: int) -> Split:
    """Of labels where `usable` holds, a share of each class (at most about `seeds` rows of it) as seeds, and about `pool` rows of the rest.

    Three fifths of the seeds are for reading off lexicons (READ), the others for judging them (DEVELOP).
    """
    given, counts = _given(labels, column, usable)
    total = sum(counts.values())
    rest = min(1.0, pool / max(1.0, (1 - seed_share) * total))
    kept = {k: min(1.0, seeds / (seed_share * n)) for k, n in counts.items()}
    top = {k: int(seed_share * s * RANGE) for k, s in kept.items()}
    of = lambda share: F.coalesce(*(F.when(F.col("label") == k, F.lit(int(share * t))) for k, t in top.items()), F.lit(0)) if top else F.lit(0)
    first = int(seed_share * RANGE)
    part = F.when(F.col("draw") < of(0.6), READ).when(F.col("draw") < of(1.0), DEVELOP).when((F.col("draw") >= first) & (F.col("draw") < first + rest * (RANGE - first)), POOL)
    chosen = given.select("doc_id", part.alias("part"), F.when(part != POOL, F.col("label")).alias("label")).filter("part is not null")
    return Split(_texts_of(docs, chosen), (counts.get(1, 0) + 1) / (total + 2), counts, {k: rest / s for k, s in kept.items()})
