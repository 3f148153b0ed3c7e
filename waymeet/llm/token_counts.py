"""Exact token counts by length histogram.

Tasks encode their documents and return how many have each length; Spark adds these up. Suffix sums over the histogram
then answer every context limit: how many documents and tokens there are, how many documents are longer, and what is
left if all are cut at the limit. Quantiles read off the same sums.

Defined results: a null text is an empty one of length zero; repeated rows count as often as they occur; other columns,
whatever their names, are ignored; an empty table gives an empty histogram.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import corpus, store, tune
from .packing import bpe_encoder

#: Lengths are summed in blocks of this many, and blocks among themselves.
BLOCK = 1024


def _lengths(spec: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = bpe_encoder(spec)
        seen: Counter[int] = Counter()
        for batch in batches:
            seen.update(len(encode(t.as_py())) for t in batch.column("text"))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())], names=["length", "documents"])

    return run


def histogram(docs: DataFrame, tokenizer: str | Path) -> DataFrame:
    """(length, documents): how many documents have each encoded length."""
    tune(docs.sparkSession)
    counts = corpus(docs).select("text").mapInArrow(_lengths(Path(tokenizer).read_text()), "length long, documents long")
    return counts.groupBy("length").agg(F.sum("documents").alias("documents"))


def suffix_sums(lengths: DataFrame) -> DataFrame:
    """For each length of a histogram: documents and tokens at it, at or above it, in all, and tokens left if cut there.

    Sums run inside blocks of lengths and over the blocks' totals, so no task holds all lengths.
    """
    lengths = store(lengths.withColumn("block", F.floor(F.col("length") / BLOCK)).withColumn("tokens", F.col("length") * F.col("documents")), "lengths")
    totals = lengths.groupBy("block").agg(F.sum("documents").alias("b_docs"), F.sum("tokens").alias("b_tokens"))
    above = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    totals = totals.select(
        "block",
        F.coalesce(F.sum("b_docs").over(above), F.lit(0)).alias("docs_above"),
        F.coalesce(F.sum("b_tokens").over(above), F.lit(0)).alias("tokens_above"),
        F.sum("b_docs").over(everything).alias("all_documents"),
        F.sum("b_tokens").over(everything).alias("all_tokens"),
    )
    down = Window.partitionBy("block").orderBy(F.col("length").desc())
    out = lengths.join(totals, "block")
    docs_from = F.sum("documents").over(down) + F.col("docs_above")
    tokens_from = F.sum("tokens").over(down) + F.col("tokens_above")
    return out.select(
        "length",
        "documents",
        "tokens",
        docs_from.alias("documents_from"),
        tokens_from.alias("tokens_from"),
        "all_documents",
        "all_tokens",
        (F.col("all_tokens") - tokens_from + docs_from * F.col("length")).alias("tokens_cut_here"),
        ((F.col("all_documents") - docs_from + F.col("documents")) / F.col("all_documents")).alias("share_up_to"),
    )


def quantile(sums: DataFrame, q: float) -> int | None:
    """The smallest length that at least a share q of documents do not exceed."""
    return sums.filter(F.col("share_up_to") >= q).agg(F.min("length")).first()[0]


def tokens_within(sums: DataFrame, limit: int) -> int:
    """Tokens left if every document is cut at limit."""
    row = sums.filter(F.col("length") >= limit).orderBy("length").select("documents_from", "tokens_from", "all_tokens").first()
    if row is None:
        return int(sums.agg(F.max("all_tokens")).first()[0] or 0)
    return int(row["all_tokens"] - row["tokens_from"] + row["documents_from"] * limit)
