"""License scans by diagonal voting.

Templates are word sequences with a label. Every k words of a document are looked up, by hash, among every k words of
the templates, in one Spark join; a hit at document position p and template position q votes for the diagonal p - q.
Votes are summed by diagonal, and a diagonal is merged with its neighbours up to `slack` beyond it (words added or left
out). Such a span is verified by the places of the template that its votes come from: it counts if they are enough
different ones, however often a place is hit. The words of every hit are compared, so hashes decide nothing. A template
of k words is a phrase: each of its diagonals is a place.

Every document also sends one row of its own through the join, so documents without hits are in the result and no
second pass over the texts is needed. Only DataFrame functions run here; the templates are broadcast because their
number is that of the list given.

Defined results: a null text is an empty one with no words and no hits; repeated rows come out as often as they went
in; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import corpus, text_key
from .words import gram_at, gram_hashes, hashes_of, words_of

#: The base phrases and their labels (fixed values).
PHRASES = [("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved")]

#: Notices of common licenses, as words (fixed values, from the licenses' own texts).
NOTICES = [
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike"),
    ("copyright", "no part of this publication may be reproduced"),
]
SLACK = 3
COVERAGE = 0.7
DOCUMENT = -1
#: Copies of a row are given out again in slices of this many.
SLICE = 10_000


def template_grams(phrases: list[tuple[str, str]], notices: list[tuple[str, str]]) -> list[tuple]:
    """(template, label, base, k, position, gram, number of grams) of every gram; phrases have one, of all their words."""
    out = []
    for i, (base, (label, text)) in enumerate([(True, p) for p in phrases] + [(False, p) for p in notices]):
        words = text.split()
        k = len(words) if base else 3
        n = len(words) - k + 1
        out += [(i, label, base, k, q, " ".join(words[q : q + k]), n) for q in range(n)]
    return out


def scan(docs: DataFrame, *, phrases: list[tuple[str, str]] = PHRASES, notices: list[tuple[str, str]] = NOTICES, slack: int = SLACK, coverage: float = COVERAGE) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    phrases: of two or three words each. score: the best share of a template's grams
    that one span reaches, 1 where a phrase is.
    """
    spark = docs.sparkSession
    grams = spark.createDataFrame(template_grams(phrases, notices), "template int, label string, base boolean, k int, q int, gram string, n_grams int")
    word = F.split("gram", " ")
    by_k = lambda k: F.xxhash64(F.lit(k), *(F.xxhash64(F.get(word, F.lit(j))) for j in range(k)))
    grams = grams.withColumn("hash", F.when(F.col("k") == 2, by_k(2)).otherwise(by_k(3)))
    itself = spark.createDataFrame([(DOCUMENT, None, False, 0, 0, "", 1, 0)], grams.schema)
    grams = grams.unionByName(itself)

    text = corpus(docs).withColumn("text_key", text_key()).withColumn("words", words_of(F.col("text")))
    text = text.withColumn("n_words", F.size("words")).withColumn("hashes", hashes_of(F.col("words")))
    # the document's own row comes first, then its grams of two words, then those of three
    sent = F.concat(F.array(F.lit(0).cast("bigint")), gram_hashes(F.col("hashes"), F.col("n_words"), 2), gram_hashes(F.col("hashes"), F.col("n_words"), 3))
    rows = text.withColumn("sent", sent).select("doc_id", "text_key", "n_words", "words", F.posexplode_outer("sent").alias("nth", "hash"))
    twos = F.greatest(F.col("n_words") - 1, F.lit(0))
    kind = F.when(F.col("nth") == 0, 0).when(F.col("nth") <= twos, 2).otherwise(3)
    at = F.when(F.col("nth") == 0, 0).when(F.col("nth") <= twos, F.col("nth") - 1).otherwise(F.col("nth") - 1 - twos)
    hits = rows.join(F.broadcast(grams.withColumnRenamed("hash", "t_hash")), F.col("hash") == F.col("t_hash"))
    hits = hits.withColumn("at", at).filter((F.col("k") == kind) & ((F.col("k") == 0) | (gram_at(F.col("words"), F.col("at"), F.greatest(F.col("k"), F.lit(1))) == F.col("gram"))))

    doc = ["doc_id", "text_key"]
    template = ["template", "label", "base", "n_grams"]
    spots = hits.groupBy(*doc, *template, (F.col("at") - F.col("q")).alias("diagonal"), "q").agg(F.count("*").alias("rows"), F.max("n_words").alias("n_words"))
    # a span is a diagonal and those up to slack beyond it; what counts is how many places of the template it reaches
    span = Window.partitionBy(*doc, "template").orderBy("diagonal").rangeBetween(0, slack)
    spots = spots.withColumn("share", F.size(F.collect_set("q").over(span)) / F.col("n_grams"))
    base = F.when(F.col("base"), F.col("diagonal"))
    best = spots.groupBy(*doc, *template).agg(
        F.max("share").alias("share"), F.max("rows").alias("rows"), F.max("n_words").alias("n_words"),
        F.count(base).alias("n"), F.min(base).alias("first"), F.max(base).alias("last"),
    )

    own = F.col("template") == DOCUMENT
    per = best.groupBy(*doc).agg(
        F.max(F.when(own, F.col("rows"))).alias("times"),
        F.max("n_words").alias("n_words"),
        F.sum("n").alias("n_base"),
        F.min("first").alias("first_word"),
        F.max("last").alias("last_word"),
        F.max(F.when(~own, F.col("share"))).alias("score"),
        F.collect_set(F.when(F.col("base"), F.col("label"))).alias("base_labels"),
        F.collect_set(F.when(~own & (F.col("share") >= coverage), F.col("label"))).alias("labels"),
    )
    joined = lambda c: F.array_join(F.array_sort(c), ",")
    return per.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        "n_base",
        F.col("first_word").cast("long").alias("first_word"),
        F.col("last_word").cast("long").alias("last_word"),
        joined("base_labels").alias("base_labels"),
        joined("labels").alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
        "times",
        F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("times") - 1) / SLICE))).alias("slice"),
    ).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(SLICE), F.col("times") - F.col("slice") * SLICE)))).drop("times", "slice", "copy")
