"""Words and word shingles as column expressions.

Explode these with the outer variants: the optimizer pushes a plain explode's "not empty" filter below the projections
that build the arrays, where it would compute them anew inside one another.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Between words: all ASCII but digits and lower-case letters (the text is lower-cased first). A fixed value.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """The words of a text, A-Z lower-cased and other letters as they are; an empty array for null or no words."""
    found = F.split(F.translate(F.coalesce(text, F.lit("")), CAPITALS, SMALL), BETWEEN)
    return F.filter(found, lambda w: w != "")


def hashes_of(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def gram_hashes(hashes: Column, n: Column, k: int) -> Column:
    """The hash of every k consecutive words, from the words' hashes; empty for fewer than k."""
    one = lambda i: F.xxhash64(F.lit(k), *(F.get(hashes, i + j) for j in range(k)))
    return F.when(n >= k, F.transform(F.sequence(F.lit(0), F.greatest(n - k, F.lit(0))), one)).otherwise(F.array().cast("array<bigint>"))


def gram_at(words: Column, at: Column, k: Column | int) -> Column:
    """The k words from position at (0 is the first), joined by spaces."""
    k = k if isinstance(k, Column) else F.lit(k)
    return F.array_join(F.slice(words, at + 1, k), " ")
