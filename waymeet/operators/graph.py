"""Connected components of a large graph by smallest-label spreading with short cuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import bounded, discard, store


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a long, b long); root is the smallest node of its component.

    A round takes the smallest label among a node's neighbours and then the label of that label, so paths shrink by
    half or better. Only labels are kept between rounds, as tables in the shared folder. A label that many nodes carry
    is looked up once, and only labels that moved go back to the nodes: as a broadcast while they are few, else by a
    join whose large keys Spark can split.
    """
    both = store(edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct(), "edges")
    labels = store(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("root")), "labels")
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("root").alias("near"))
        spread = store(labels.join(near, labels.node == near.a).select("node", F.least("root", "near").alias("root"), F.col("root").alias("was")), "spread")
        up = spread.select(F.col("node").alias("up"), F.col("root").alias("up_root"))
        shorter = store(spread.select("root").distinct().join(up, F.col("root") == F.col("up")).filter("up_root < root").select("up", "up_root"), "shorter")
        new = spread.join(bounded(shorter, 16), spread.root == F.col("up"), "left").select("node", F.coalesce("up_root", "root").alias("root"), "was")
        new = store(new, "labels")
        moved = not new.filter("root <> was").isEmpty()
        for table in (spread, labels, shorter):
            discard(table)
        labels = new.select("node", "root")
        labels._scratch_path = new._scratch_path
        if not moved:
            discard(both)
            return labels
