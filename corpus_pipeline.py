"""From raw documents to packed training sequences, as five stages over Parquet.

Every stage takes (spark, docs, sf_dir) and judges all rows that the one before it kept. The first four return the
columns of documents, the last one the pieces of the packed sequences. run() writes each stage's result to the shared
folder and reads it again, so a lost executor costs at most one stage; what a stage and the one before it have stored is
deleted then.

Defined results, in all stages: a null text is an empty one; repeated rows are judged each, and of rows equal in doc_id
and text the dedup stages keep one; columns of docs with any names stay as they are; no documents give no pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymeet.llm import decontaminate, exact_dedup, packing, quality, simhash
from waymeet.llm.common import discard, scratch, store, table
from waymeet.llm.queries import tokenizer_path
from waymeet.llm.sampling import fold_of


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores 0.3 or more."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"), fold_of(F.col("doc_id"), 5) != 0)
    return quality.drop_rejected(docs, model)


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the longest as written, then the smallest doc_id."""
    return exact_dedup.drop_exact_copies(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group of linked fingerprints."""
    return simhash.drop_near_copies(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences, with their token ids."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality_classifier", quality_stage),
    ("exact_dedup", exact_dedup_stage),
    ("simhash_near_dedup", near_dedup_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("best_fit_packing", packing_stage),
]

#: A trained network and a tokenizer are not SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with scratch():
            made = store(stage(spark, docs, sf_dir), f"stage-{name}", keep=True)
        discard(docs)
        docs = made
    return docs
