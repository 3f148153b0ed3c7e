"""URL filters by a sort-merge range join.

A host reversed by labels makes "host and its subdomains" a prefix, and a prefix an interval of sorted keys. Pages and
rules are dealt to ranges of the key (a rule to every range that its interval meets), sorted, and swept: the open rules
form a stack, because intervals of prefixes nest or are apart. A page is judged by the longest open rule whose path its
own path starts with. Ranges are cut by page counts over host, path and row, so a host, or one url repeated, with a
third of all pages spans many.

Defined results: a null url, or one without "://", has an empty host and path and fits no rule; a page without a rule
gets the default verdict; control characters in hosts are characters like others; repeated rows are judged each; other
columns, whatever their names, are ignored; empty tables give empty results. Of
rules equally long the longer host wins, then block over allow.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import store, tune

END = "\U0010ffff"
#: Keys sampled for each range. Only the balance depends on them.
SAMPLES = 32
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): the host with A-Z lower-cased; both empty without "://"."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, CAPITALS, SMALL), path


def host_key(host: Column) -> Column:
    """The labels of a host in reverse, each ended by \\x01, which no label holds, as are the other marks of keys."""
    for held, stands in (("\x02", "\x02\x02"), ("\x01", "\x02\x03"), ("\x00", "\x02\x04"), (END, "\x02\x05")):
        host = F.replace(host, F.lit(held), F.lit(stands))
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "\x01"), F.lit("\x01"))


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by range, key and kind (rules first): pages with the rule that judges them."""
    open_: list[tuple[str, list]] = []  # (prefix of keys, [(path, rule, verdict, rank)])
    now = None
    for batch in batches:
        ids, rules, verdicts, hosts, paths = [], [], [], [], []
        cols = (batch.column(c).to_pylist() for c in ("range_no", "key", "is_page", "page_id", "host", "path", "rule", "verdict"))
        for range_no, key, is_page, page_id, host, path, rule, verdict in zip(*cols, strict=True):
            if range_no != now:
                now, open_ = range_no, []
            while open_ and not key.startswith(open_[-1][0]):
                open_.pop()
            if not is_page:
                rank = (len(rule), len(host), verdict == "block")
                if open_ and open_[-1][0] == key:
                    open_[-1][1].append((path, rule, verdict, rank))
                else:
                    open_.append((key, [(path, rule, verdict, rank)]))
                continue
            fits = [r for _, level in open_ for r in level if path.startswith(r[0])]
            best = max(fits, key=lambda r: r[3], default=(None, None, None, None))
            ids.append(page_id)
            hosts.append(host)
            paths.append(path)
            rules.append(best[1])
            verdicts.append(best[2])
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(c, pa.string()) for c in (hosts, paths, rules, verdicts))], names=["page_id", "host", "path", "rule", "verdict"])


def _range_of(cuts: list[str]):
    """Adds to each row the ranges that its interval [key, key_end] meets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = [bisect.bisect_right(cuts, k) for k in batch.column("sort_key").to_pylist()]
            last = [bisect.bisect_right(cuts, k) for k in batch.column("sort_end").to_pylist()]
            kept = [c for c in batch.schema.names if c != "sort_end"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(first, pa.int32()), pa.array(last, pa.int32())], names=[*kept, "first_range", "last_range"])

    return run


def _every(n: int):
    """The first of every n keys of a sorted partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = 0
        for batch in batches:
            keys = batch.column("sort_key").to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(keys[-at % n :: n], pa.string())], names=["sort_key"])
            at += len(keys)

    return run


def _cuts(rows: DataFrame, range_rows: int) -> list[str]:
    """Keys that cut rows (sort_key) into ranges of about range_rows: one short string a range reaches the driver."""
    spark = rows.sparkSession
    n, least = rows.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(least, -(-n // range_rows))
    step = max(1, n // (SAMPLES * ranges))
    picked = rows.filter(F.pmod(F.xxhash64("sort_key"), F.lit(step)) == 0).select("sort_key")
    cuts = picked.repartitionByRange(max(1, min(least, ranges)), "sort_key").sortWithinPartitions("sort_key").mapInArrow(_every(max(1, n // (step * ranges))), "sort_key string")
    return sorted({r[0] for r in cuts.collect()})[1:]


def judge(pages: DataFrame, rules: DataFrame, *, default: str = "allow", range_rows: int = 200_000) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict.

    pages: (page_id, url). rules: (host, path, verdict), the path with its leading "/".
    """
    spark = pages.sparkSession
    tune(spark)
    has = set(pages.columns)
    url = F.col("url").cast("string") if "url" in has else F.lit(None).cast("string")
    page_id = F.col("page_id").cast("long") if "page_id" in has else F.lit(None).cast("long")
    host, path = split_url(url)
    rows = pages.select(page_id.alias("page_id"), host.alias("host"), path.alias("path")).withColumn("key", host_key(F.col("host")))
    # the last part tells repeated rows apart, so that ranges can split them
    sort_key = F.concat("key", F.lit("\x00"), "path", F.lit("\x00"), F.monotonically_increasing_id().cast("string"))
    rows = rows.select("key", sort_key.alias("sort_key"), F.lit(True).alias("is_page"), "page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"))
    rows = store(rows, "urls")
    cuts = _cuts(rows, range_rows)

    given = rules.select(F.translate("host", CAPITALS, SMALL).alias("host"), F.col("path"), F.col("verdict")).filter("host is not null and path is not null").distinct()
    given = given.select(host_key(F.col("host")).alias("key"), "host", "path", F.concat("host", "path").alias("rule"), "verdict")
    given = given.select("key", F.col("key").alias("sort_key"), F.lit(False).alias("is_page"), F.lit(None).cast("long").alias("page_id"), "host", "path", "rule", "verdict")

    ends = F.when(F.col("is_page"), F.col("sort_key")).otherwise(F.concat("sort_key", F.lit(END)))
    both = rows.unionByName(given).withColumn("sort_end", ends)
    ddl = "key string, sort_key string, is_page boolean, page_id long, host string, path string, rule string, verdict string, first_range int, last_range int"
    dealt = both.select("key", "sort_key", "is_page", "page_id", "host", "path", "rule", "verdict", "sort_end").mapInArrow(_range_of(cuts), ddl)
    dealt = dealt.withColumn("range_no", F.explode(F.sequence("first_range", "last_range"))).drop("first_range", "last_range")
    swept = dealt.repartitionByRange(max(1, len(cuts) + 1), "range_no").sortWithinPartitions("range_no", "sort_key", "is_page").mapInArrow(_sweep, "page_id long, host string, path string, rule string, verdict string")
    return swept.withColumn("verdict", F.coalesce("verdict", F.lit(default)))
