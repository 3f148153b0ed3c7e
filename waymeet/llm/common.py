"""What the corpus operators share: scratch tables, row keys and Arrow settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import bounded, clean, discard, scratch, scratch_path, store

__all__ = ["bounded", "clean", "corpus", "discard", "keep_rows", "scratch", "scratch_path", "store", "table", "tasks_for", "text_key", "tune"]

#: Arrow batches are cut at this many bytes, so that a batch of very long texts fits a Python worker.
BATCH_BYTES = 4 << 20


def tune(spark: SparkSession) -> None:
    """Bound the bytes of an Arrow batch unless the session already does."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, None)
    if now is None or int("".join(c for c in now if c.isdigit()) or 0) > 64 << 20:
        spark.conf.set(key, str(BATCH_BYTES))


def corpus(docs: DataFrame, *more: str) -> DataFrame:
    """(doc_id, text, *more): the columns an operator needs, missing ones as null; null texts count as empty."""
    has = set(docs.columns)
    col = lambda c, kind: (F.col(f"`{c}`") if c in has else F.lit(None)).cast(kind).alias(c)
    return docs.select(
        col("doc_id", "long"),
        F.coalesce(F.col("text") if "text" in has else F.lit(None), F.lit("")).cast("string").alias("text"),
        *(col(c, "string") for c in more),
    )


def text_key() -> Column:
    """Tells rows of one doc_id apart by what they say."""
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


#: Tasks of a shuffle by size, at most, until they would hold LARGE_TASK bytes each.
MANY_TASKS, LARGE_TASK = 20_000, 1 << 30


def tasks_for(size: int, each: int, most: int = MANY_TASKS) -> int:
    """How many tasks take `size` bytes: one for every `each`, but no more than `most` unless they grew beyond LARGE_TASK."""
    return max(1, min(-(-size // each), most), -(-size // LARGE_TASK))


#: Stands for a null doc_id where rows are matched.
NO_DOC = -(1 << 63)


def keep_rows(docs: DataFrame, keys: DataFrame, how: str, one_each: bool = False) -> DataFrame:
    """Rows of docs, all columns as they are, whose (doc_id, text_key) is in keys (how="left_semi") or not ("left_anti").

    one_each keeps a single row of those that agree in doc_id and text, the least by a hash of the other columns. Null doc_ids compare as equal. The columns
    travel inside one struct, so none can clash with what is added here.
    """
    row = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    row = row.withColumn("k_id", F.coalesce(F.col("row.doc_id").cast("long"), F.lit(NO_DOC))).withColumn(
        "k_text", F.xxhash64(F.coalesce(F.col("row.text"), F.lit("")))
    )
    if one_each:  # every task keeps one of its copies before they travel: the least by a hash of what may differ
        others = [F.to_json(F.struct(F.col(f"row.`{c}`"))) if kind.startswith(("map", "variant")) else F.col(f"row.`{c}`") for c, kind in docs.dtypes if c not in ("doc_id", "text")]
        row = row.withColumn("k_rest", F.xxhash64(F.lit(0), *others)).groupBy("k_id", "k_text").agg(F.min_by("row", "k_rest").alias("row"))
    right = keys.select(F.coalesce("doc_id", F.lit(NO_DOC)).alias("r_id"), F.col("text_key").alias("r_text"))
    out = row.join(right, (F.col("k_id") == F.col("r_id")) & (F.col("k_text") == F.col("r_text")), how)
    return out.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


