"""Finished tracks made whole: smoothed, split where they jump, linked to their continuations, filled and filtered."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import store
from . import matching, tracks
from .link_match import match_links
from .tracks import KEY


def _renumbered(points: DataFrame) -> DataFrame:
    w = Window.partitionBy(*KEY).orderBy("us")
    return points.withColumn("ord", (F.row_number().over(w) - 1).cast("long"))


def _smoothed(points: DataFrame) -> DataFrame:
    out = tracks.smooth(points)
    return out.withColumns({c: F.col(f"{c}_smooth") for c in ("x", "y", "z", "yaw")}).drop("x_smooth", "y_smooth", "z_smooth", "yaw_smooth")


def split(points: DataFrame, degrees: float = 45.0) -> DataFrame:
    """Tracks cut where their yaw jumps; further pieces get numbers above all of their record, those without a detection go."""
    new = tracks.pieces(points, degrees).select(*KEY, "piece", "new_vehicle")
    cut = tracks.split_at_jumps(points, degrees).join(new, [*KEY, "piece"])
    return _renumbered(cut.withColumn("id_vehicle", F.col("new_vehicle")).drop("piece", "new_vehicle"))


def link(points: DataFrame, limits: dict[str, float], *, within_us: int = 1_500_000, least: int = 6) -> DataFrame:
    """(id_record, id_vehicle, into): tracks of `least` rows or more that continue another, and the first of their chain."""
    first, last = (lambda c: F.min_by(c, "ord").alias(f"s_{c}")), (lambda c: F.max_by(c, "ord").alias(f"e_{c}"))
    state = ("x", "y", "z", "yaw", "us")
    ends = points.groupBy("id_record", F.col("id_vehicle").alias("id")).agg(
        F.count(F.lit(1)).alias("n"), F.min_by("class_name", "ord").alias("class_name"), *map(first, state), *map(last, state), *(F.avg(c).alias(c) for c in ("length", "width", "height"))
    )
    found = match_links(ends.filter(F.col("n") >= least).drop("n"), limits, within_us)
    return matching.chains(found, ["id_record"]).select("id_record", F.col("i").alias("id_vehicle"), F.col("root").alias("into"))


def join_linked(points: DataFrame, links: DataFrame) -> DataFrame:
    """Rows of linked tracks as one: where several have a row at one instant, the mean of the detected ones, or of all if none is."""
    both = points.join(links, list(KEY), "left").withColumn("id_vehicle", F.coalesce("into", "id_vehicle")).drop("into")
    seen = lambda c: F.coalesce(F.avg(F.when(F.col("detected"), F.col(c))), F.avg(c)).alias(c)
    sin, cos = (F.coalesce(F.avg(F.when(F.col("detected"), f("yaw"))), F.avg(f("yaw"))) for f in (F.sin, F.cos))
    one = both.groupBy(*KEY, "us").agg(*map(seen, ("x", "y", "z", "length", "width", "height")), F.atan2(sin, cos).alias("yaw"), F.max("detected").alias("detected"), F.min("class_name").alias("class_name"))
    return _renumbered(one)


def fill(points: DataFrame, fps: int, longest_s: float) -> DataFrame:
    """points with the frames that gaps leave out, on cubics; what else a filled row has is that of the row before it, undetected."""
    new = tracks.fill_gaps(points, fps, longest_s).select(*KEY, F.col("ord").alias("after"), "us", "x", "y", "z")
    before = points.select(*KEY, F.col("ord").alias("after"), "yaw", "length", "width", "height", "class_name")
    filled = new.join(before, [*KEY, "after"]).drop("after").withColumn("detected", F.lit(False))
    return _renumbered(points.drop("ord").unionByName(filled))


def enhance(points: DataFrame, limits: dict[str, float], *, fps: int = 30, degrees: float = 45.0, longest_s: float = 1.5) -> DataFrame:
    """Finished tracks (id_record, id_vehicle, ord, us, x, y, z, yaw, length, width, height, class_name, detected) made whole.

    Tracks that are seldom detected or short go; the others are smoothed, split at jumps of the yaw, linked one to one to
    what continues them, joined, filled and smoothed again, and those good enough at the end stay. Tables in the shared
    folder stand between the steps, so each is worked out once.
    """
    cols = [*KEY, "ord", "us", "x", "y", "z", "yaw", "length", "width", "height", "class_name", "detected"]
    kept = points.select(*cols).join(tracks.initial_filter(points).select(*KEY), list(KEY), "left_semi")
    cut = store(split(_smoothed(kept), degrees).select(*cols), "pieces")
    whole = join_linked(cut, link(cut, limits, within_us=int(longest_s * 1_000_000))).select(*cols)
    done = store(_smoothed(fill(store(whole, "linked"), fps, longest_s)).select(*cols), "enhanced")
    return done.join(tracks.final_filter(done).select(*KEY), list(KEY), "left_semi")
