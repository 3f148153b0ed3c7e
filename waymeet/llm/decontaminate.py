"""Benchmark decontamination: size-partitioned MinHash containment search, then exact shingle containment.

A document contains an item if at least a share t of the item's word shingles occur in it. Items are partitioned by
size; an item of n shingles is represented by its m smallest shingle hashes, those of shingles that fewer items share
first, where m is one more than the shingles that an item of its size class may lack. A document that contains the item has one of any m of them, so looking for the
signatures among a document's own hashes misses none, however long the document is. Document and item pairs found
this way are verified on the shingles themselves.

Only DataFrame functions run here. Tables of the items and of candidates are broadcast while their measured bytes are
below a bound and joined by a shuffle beyond it.

Defined results: null and empty texts contain nothing and are contained in nothing; a text of fewer words than a shingle
is one shingle of all its words; repeated rows count once; other columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, corpus, keep_rows, store, text_key
from .words import gram_at, gram_hashes, hashes_of, words_of

WIDTH = 5
THRESHOLD = 0.8


def _with_shingles(df: DataFrame, text: str, width: int) -> DataFrame:
    """df with words, n_shingles and shingle hashes of its texts."""
    df = df.withColumn("words", words_of(F.col(text))).withColumn("n_words", F.size("words"))
    df = df.withColumn("hashes", hashes_of(F.col("words")))
    whole = F.when(F.col("n_words") > 0, F.array(F.xxhash64(F.array_join("words", " ")))).otherwise(F.array().cast("array<bigint>"))
    df = df.withColumn("shingles", F.when(F.col("n_words") >= width, gram_hashes(F.col("hashes"), F.col("n_words"), width)).otherwise(whole))
    return df.drop("hashes")


def contained_items(docs: DataFrame, items: DataFrame, *, width: int = WIDTH, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_shared, containment, text_key): every item of which a document holds the share threshold.

    items: (item_id, text). Several rows of one item_id are several passages; the best of them counts.
    """
    passages = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).distinct()
    passages = _with_shingles(passages.withColumn("passage", F.xxhash64("item_id", "text")), "text", width)
    own = passages.select("item_id", "passage", "words", F.posexplode_outer("shingles").alias("at", "hash"))
    own = own.select("item_id", "passage", "hash", gram_at(F.col("words"), F.col("at"), width).alias("shingle"))
    own = own.filter("hash is not null").dropDuplicates(["item_id", "passage", "hash", "shingle"])
    each = Window.partitionBy("item_id", "passage")
    own = own.withColumns({"n": F.count("*").over(each), "common": F.count("*").over(Window.partitionBy("hash"))})
    # the sizes of a class are those above 2**(c-1) and up to 2**c; m holds for the largest of them
    size_class = F.pow(F.lit(2.0), F.ceil(F.log2("n")))
    m = F.floor(size_class * F.lit(1 - threshold) + F.lit(1e-9)) + 1
    own = own.withColumn("signed", F.row_number().over(each.orderBy("common", "hash", "shingle")) <= m)
    own = store(own.withColumn("need", F.ceil(F.col("n") * F.lit(threshold) - F.lit(1e-9))), "passages")

    signatures = own.filter("signed").groupBy("hash").agg(F.min("need").alias("least"), F.collect_set("passage").alias("passages"))
    signatures = store(signatures.select(F.col("hash").alias("sig"), "least", "passages"), "signatures")
    texts = corpus(docs).withColumn("text_key", text_key())
    hashed = _with_shingles(texts, "text", width)
    probes = hashed.select("doc_id", "text_key", F.size("shingles").alias("n_doc"), F.explode_outer("shingles").alias("hash"))
    found = probes.join(bounded(signatures, F.size("passages") * 8 + 32), (F.col("hash") == F.col("sig")) & (F.col("n_doc") >= F.col("least")))
    found = found.select("doc_id", "text_key", F.explode("passages").alias("passage")).distinct()
    found = store(found, "candidates")

    pairs = found.groupBy("doc_id", "text_key").agg(F.collect_set("passage").alias("wanted"))
    pairs = store(pairs.select(F.col("doc_id").alias("c_id"), F.col("text_key").alias("c_key"), "wanted"), "wanted")
    held = texts.join(bounded(pairs, F.size("wanted") * 8 + 40), F.col("doc_id").eqNullSafe(F.col("c_id")) & (F.col("text_key") == F.col("c_key")))
    held = _with_shingles(held, "text", width).select("doc_id", "text_key", "words", "wanted", F.posexplode_outer("shingles").alias("at", "hash"))
    right = own.select("item_id", F.col("passage").alias("p"), F.col("hash").alias("p_hash"), "shingle", "n")
    same = (F.col("hash") == F.col("p_hash")) & F.array_contains("wanted", F.col("p")) & (gram_at(F.col("words"), F.col("at"), width) == F.col("shingle"))
    shared = held.join(bounded(right, F.octet_length("shingle") + 48), same).select("doc_id", "text_key", "item_id", "p", "n", "shingle").distinct()
    counted = shared.groupBy("doc_id", "text_key", "item_id", "p", "n").agg(F.count("*").alias("n_shared"))
    counted = counted.withColumn("containment", F.col("n_shared") / F.col("n")).filter(F.col("containment") >= threshold - 1e-12)
    best = F.max(F.struct("containment", "n_shared", F.col("n").alias("n_shingles"))).alias("b")
    return counted.groupBy("doc_id", "text_key", "item_id").agg(best).select("doc_id", "item_id", "b.n_shingles", "b.n_shared", "b.containment", "text_key")


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs that contain no item, with all their columns."""
    found = store(contained_items(docs, items).select("doc_id", "text_key").distinct(), "contaminated")
    return keep_rows(docs, bounded(found, 24), "left_anti")  # a broadcast hint carries through the projection
