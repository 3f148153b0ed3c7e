"""Post-encroachment time on a stream: every frame against the footprints that others have left just before."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry
from ..operators.interactions import CELLS, around, cell_of, size_level


def stream_encounters(points: DataFrame, *, threshold_s: float = 3.0, late: str = "10 seconds") -> DataFrame:
    """Pairs of frames of two vehicles whose boxes overlap at most threshold_s apart, the later one first.

    points: a stream with event_time timestamp, id_record, id_vehicle, x, y, yaw, length, width. Both sides of the
    stream-stream join carry the watermark and the time bound, so the state holds threshold_s and the lateness of
    footprints and no more. Cells of space keep apart what cannot meet; they grow with the vehicle: a frame spreads over
    the cells around it at the level of its own size and stands in one cell at every level.
    """
    cols = ["id_vehicle", "x", "y", "yaw", "length", "width", "event_time"]
    side = lambda s: [F.col(c).alias(f"{s}_{c}") for c in cols]
    level = size_level(F.sqrt(F.col("length") * F.col("length") + F.col("width") * F.col("width")))

    def cells(s: str) -> DataFrame:
        """Rows (cell: at, cx, cy; spread: whether it is one of those around) of one side."""
        own = F.transform(around(F.col("x"), F.col("y"), F.col("level")), lambda c: F.struct(F.col("level").alias("at"), c.cx.alias("cx"), c.cy.alias("cy"), F.lit(True).alias("spread")))
        each = F.array(*(F.struct(F.lit(k).alias("at"), cell_of(F.col("x"), F.lit(k)).alias("cx"), cell_of(F.col("y"), F.lit(k)).alias("cy"), F.lit(False).alias("spread")) for k in range(len(CELLS) + 1)))
        rows = points.withColumn("level", level).filter("x is not null and y is not null")
        rows = rows.select(F.col("id_record").alias(f"{s}_record"), *side(s), F.col("level").alias(f"{s}_level"), F.explode(F.concat(own, F.filter(each, lambda c: c.at >= F.col("level")))).alias("c"))
        return rows.select("*", *(F.col(f"c.{c}").alias(f"{s}_{c}") for c in ("at", "cx", "cy", "spread"))).drop("c")

    now, was = cells("n"), cells("w")
    now, was = now.withWatermark("n_event_time", late), was.withWatermark("w_event_time", late)
    apart = F.expr(f"w_event_time <= n_event_time and w_event_time >= n_event_time - interval {int(threshold_s * 1000)} milliseconds")
    same = [F.col(f"n_{c}") == F.col(f"w_{c}") for c in ("record", "at", "cx", "cy")]
    # one side spreads at the level of the larger vehicle, the earlier one where both are alike, the other stands there
    turn = (F.col("n_spread") & ~F.col("w_spread") & (F.col("n_level") > F.col("w_level"))) | (F.col("w_spread") & ~F.col("n_spread") & (F.col("w_level") >= F.col("n_level")))
    on = same[0] & same[1] & same[2] & same[3] & turn & (F.col("n_id_vehicle") != F.col("w_id_vehicle")) & apart
    box = lambda s: [F.col(f"{s}_{c}") for c in ("x", "y", "length", "width", "yaw")]
    hits = now.join(was, on).filter(geometry.boxes_overlap(*box("n"), *box("w")))
    pet = (F.unix_micros("n_event_time") - F.unix_micros("w_event_time")) / 1e6
    return hits.select(F.col("n_record").alias("id_record"), F.col("n_event_time").alias("event_time"), F.col("n_id_vehicle").alias("later"), F.col("w_id_vehicle").alias("earlier"), pet.alias("pet"))


def first_encounters(hits: DataFrame, late: str = "10 seconds", window: str = "10 minutes") -> DataFrame:
    """The least time between each ordered pair in every window, emitted when the watermark has passed it."""
    return (
        hits.withWatermark("event_time", late)
        .groupBy(F.window("event_time", window), "id_record", "later", "earlier")
        .agg(F.min("pet").alias("pet"), F.min("event_time").alias("first_seen"))
        .select("id_record", "later", "earlier", "pet", "first_seen")
    )
