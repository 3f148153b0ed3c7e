"""The shape of tracks: curvature, adaptive smoothing, greedy segments, borders, and rows made ready for encoders."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kinematics
from .tracks import KEY, along, arc_length
from .walks import each_track


def curvature(points: DataFrame) -> DataFrame:
    """Adds curvature, from gradients of gradients along the rows; null where a track stands still."""
    w = along()
    out = points.withColumns({f"g{c}": kinematics.gradient(F.col(c), w) for c in "xy"})
    out = out.withColumns({f"gg{c}": kinematics.gradient(F.col(f"g{c}"), w) for c in "xy"})
    speed = F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")
    bend = F.abs(F.col("gx") * F.col("ggy") - F.col("gy") * F.col("ggx")) / F.nullif(F.pow(speed, F.lit(1.5)), F.lit(0.0))
    return out.withColumn("curvature", bend).drop("gx", "gy", "ggx", "ggy")


def smoothing_width(points: DataFrame, *, share: float = 15.0, least: float = 0.5, most: float = 5.0) -> DataFrame:
    """Per track the width of a Gaussian: share times the interquartile range of its steps, between least and most.

    A track of one row has no steps and gets the least width.
    """
    steps = arc_length(points).filter("ord > 0").groupBy(*KEY).agg((F.percentile("step", F.lit(0.75)) - F.percentile("step", F.lit(0.25))).alias("iqr"))
    sigma = F.least(F.lit(most), F.greatest(F.lit(least), F.coalesce(F.col("iqr") * share, F.lit(least))))
    return points.select(*KEY).distinct().join(steps, list(KEY), "left").select(*KEY, sigma.alias("sigma"))


def gaussian_smooth(points: DataFrame, *, share: float = 15.0, reach: float = 4.0) -> DataFrame:
    """x and y under a Gaussian of each track's smoothing_width, cut at `reach` widths; ends are mirrored.

    A track is one array of at most a record's frames, and its weights one of some forty.
    """
    rows = points.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("ord", "x", "y"))).alias("p"))
    rows = rows.join(smoothing_width(points, share=share), list(KEY)).withColumn("r", F.floor(F.col("sigma") * reach + 0.5).cast("int"))
    rows = rows.withColumn("n", F.size("p")).withColumn("w", F.transform(F.sequence(-F.col("r"), F.col("r")), lambda k: F.exp(-(k * k) / (2 * F.col("sigma") * F.col("sigma")))))
    rows = rows.withColumn("total", F.aggregate("w", F.lit(0.0), lambda s, v: s + v))

    def mirrored(i: Column) -> Column:
        m = F.pmod(i, 2 * F.col("n"))
        return F.when(m < F.col("n"), m).otherwise(2 * F.col("n") - 1 - m)

    def mean(c: str, i: Column) -> Column:
        near = F.transform("w", lambda v, k: v * F.get("p", mirrored(i + k - F.col("r"))).getField(c))
        return F.aggregate(near, F.lit(0.0), lambda s, v: s + v) / F.col("total")

    out = F.transform("p", lambda p, i: F.struct(p.ord.alias("ord"), mean("x", i).alias("x_smooth"), mean("y", i).alias("y_smooth")))
    return rows.select(*KEY, "sigma", F.explode(out).alias("s")).select(*KEY, "sigma", "s.*")


def _cut(points: DataFrame, starts) -> DataFrame:
    """Adds segment, counted from 0: starts(x, y) tells, for the rows of one track, which begin a new one."""
    return each_track(points, ["x", "y"], lambda at: {"segment": np.cumsum(starts(at["x"].tolist(), at["y"].tolist()))}, "segment int")


def distance_segments(points: DataFrame, *, distance: float = 3.0, rows: int = 6) -> DataFrame:
    """A new segment where the way since the last cut exceeds distance and the segment has `rows` rows; shorter ones are left out.

    What comes next depends on where the last cut fell, so a track is walked row by row, in one task with its peers.
    """

    def starts(x, y) -> list[int]:
        out, way, n = [0] * len(x), 0.0, 1
        for i in range(1, len(x)):
            way += math.hypot(x[i] - x[i - 1], y[i] - y[i - 1])
            n += 1
            if way > distance and n > rows:
                out[i], way, n = 1, 0.0, 1
        return out

    return _long_enough(_cut(points, starts), rows)


def angle_segments(points: DataFrame, *, degrees: float = 20.0, rows: int = 5) -> DataFrame:
    """A new segment where the way turns by more than degrees and the segment has `rows` rows; shorter ones are left out.

    The row before a turn ends one segment and begins the next; it is counted with the first, and lead_ord names it.
    """

    def starts(x, y) -> list[int]:
        out, n = [0] * len(x), 2
        for i in range(2, len(x)):
            a, b = (x[i - 1] - x[i - 2], y[i - 1] - y[i - 2]), (x[i] - x[i - 1], y[i] - y[i - 1])
            size = math.hypot(*a) * math.hypot(*b)
            turn = math.degrees(math.acos(max(-1.0, min(1.0, (a[0] * b[0] + a[1] * b[1]) / size)))) if size else 0.0
            if turn > degrees and n >= rows:
                out[i], n = 1, 2
            else:
                n += 1
        return out

    cut = _cut(points, starts)
    lead = F.when(F.col("segment") > 0, F.min("ord").over(Window.partitionBy(*KEY, "segment")) - 1)
    return _long_enough(cut.withColumn("lead_ord", lead), rows, F.col("lead_ord").isNotNull().cast("int"))


def _long_enough(cut: DataFrame, rows: int, more: Column | None = None) -> DataFrame:
    n = F.count(F.lit(1)).over(Window.partitionBy(*KEY, "segment"))
    return cut.withColumn("n", n if more is None else n + more).filter(F.col("n") >= rows).drop("n")


def smooth_between_jumps(points: DataFrame, *, jump: float = 3.0, longest: int = 60) -> DataFrame:
    """(key, ord, yaw, yaw_even): yaw as its centred mean inside the stretches between jumps of more than `jump`.

    A jump cuts behind its first row, which ends one stretch and, with the mean it has there, begins the next; that
    stretch says what it is in the end. The mean runs over as many rows as the stretch has, without its last one unless
    the track ends there, `longest` at most, and one more if that is even; beyond a stretch's ends the end row counts
    again. A stretch's last mean never reaches back to its first row, so stretches do not wait for one another: each is
    an array of its rows with running sums, and each mean a difference of two of these.
    """
    w = along()
    here = points.select(*KEY, "ord", "yaw", (F.abs(F.lead("yaw").over(w) - F.col("yaw")) > jump).alias("jumps"))
    stretch = F.coalesce(F.sum(F.col("jumps").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    here = here.select(*KEY, "ord", "yaw", stretch.alias("stretch"), F.sum("yaw").over(kinematics.so_far(w)).alias("sum"))
    rows = here.groupBy(*KEY, "stretch").agg(F.array_sort(F.collect_list(F.struct("ord", "yaw", "sum"))).alias("rows"))
    order = Window.partitionBy(*KEY).orderBy("stretch")
    n, own = F.size("rows"), F.col("rows")
    span = n + F.when(F.col("stretch") > 0, 1).otherwise(0)  # with the row that the stretch before has handed on
    rows = rows.withColumn("ends", F.lead("stretch").over(order).isNull())
    length = F.least(F.when(F.col("ends"), span).otherwise(span - 1), F.lit(longest))
    rows = rows.withColumns({"n": n, "lead": span - n, "half": F.floor(length / 2).cast("int")})
    rows = rows.withColumn("half", F.when(length < 2, 0).otherwise(F.col("half")))
    row = lambda k: F.get("rows", k - 1)
    between = lambda lo, hi: row(hi).sum - row(lo).sum + row(lo).yaw
    last_mean = (between(F.col("n") - F.least("half", F.col("n") - 1), F.col("n")) + F.col("half") * row(F.col("n")).yaw) / (2 * F.col("half") + 1)
    rows = rows.withColumn("tail", F.struct(row(F.col("n")).ord.alias("ord"), row(F.col("n")).yaw.alias("yaw"), last_mean.alias("mean")))
    rows = rows.withColumn("head", F.lag("tail").over(order))

    def mean(k: Column) -> Column:
        """Of the k-th row of the stretch, the handed row being row 0 where there is one."""
        first, lo, hi = 1 - F.col("lead"), k - F.col("half"), k + F.col("half")
        inner = between(F.greatest(lo, F.lit(1)), F.least(hi, F.col("n")))
        of_first = F.when(F.col("lead") == 1, F.col("head.mean")).otherwise(row(F.lit(1)).yaw)
        before = F.greatest(first - lo, F.lit(0)) + F.when((F.col("lead") == 1) & (lo <= 0), 1).otherwise(0)
        after = F.greatest(hi - F.col("n"), F.lit(0)) * row(F.col("n")).yaw
        return (F.when(hi >= 1, inner).otherwise(0.0) + F.when(before > 0, before * of_first).otherwise(0.0) + after) / (2 * F.col("half") + 1)

    at = F.sequence(1 - F.col("lead"), F.col("n") - F.when(F.col("ends"), 0).otherwise(1))
    old = lambda k: F.when(k == 0, F.struct(F.col("head.ord"), F.col("head.yaw"))).otherwise(F.struct(row(k).ord.alias("ord"), row(k).yaw.alias("yaw")))
    at = F.when(1 - F.col("lead") <= F.col("n") - F.when(F.col("ends"), 0).otherwise(1), at).otherwise(F.array().cast("array<int>"))
    out = rows.select(*KEY, F.explode(F.transform(at, lambda k: F.struct(old(k).alias("row"), mean(k).alias("yaw_even")))).alias("r"))
    return out.select(*KEY, "r.row.ord", "r.row.yaw", "r.yaw_even")


def trim_borders(points: DataFrame, metres: float = 1.0) -> DataFrame:
    """Rows more than `metres` of path from the start up to the last one more than that from the end."""
    each = Window.partitionBy(*KEY)
    out = arc_length(points).withColumn("total", F.max("arc").over(each))
    first = F.min(F.when(F.col("arc") > metres, F.col("ord"))).over(each)
    last = F.max(F.when(F.col("arc") < F.col("total") - metres, F.col("ord"))).over(each)
    return out.withColumns({"first": first, "last": last}).filter(F.col("ord").between(F.col("first"), F.col("last"))).drop("first", "last", "total", "step", "arc")


def banned(points: DataFrame, *, early: tuple[int, int] = (11, 29), back: int = 9, at: int = 100, least: float = 0.5, pixels: float = 5.0) -> DataFrame:
    """Adds banned: from the first row on which a track fails, for good.

    In its early rows it fails where it is outside the zones now or `back` rows ago, or has come less than `least`
    metres; on row `at` where that is less than `least` from its first row, or, if points have px and py, less than
    `pixels` in the image.
    """
    w = along()
    out = arc_length(points).withColumn("nth", F.row_number().over(w))
    inside = F.col("valid") & F.coalesce(F.lag("valid", back).over(w), F.lit(False))
    net = F.hypot(F.col("x") - F.first("x").over(kinematics.whole(w)), F.col("y") - F.first("y").over(kinematics.whole(w)))
    still = net < least
    if {"px", "py"} <= set(points.columns):
        from_first = [F.col(c) - F.first(c).over(kinematics.whole(w)) for c in ("px", "py")]
        still = still | (F.hypot(*from_first) < pixels)
    fails = (F.col("nth").between(*early) & (~inside | (F.col("arc") < least))) | ((F.col("nth") == at) & still)
    return out.withColumn("banned", F.max(fails).over(kinematics.so_far(w))).drop("nth", "step", "arc")


def extents(points: DataFrame) -> DataFrame:
    """Per record the smallest box that holds all points."""
    return points.groupBy("id_record").agg(*(f(c).alias(f"{c}_{n}") for c in "xyz" for f, n in ((F.min, "min"), (F.max, "max"))))


def active_at(points: DataFrame, instants: DataFrame) -> DataFrame:
    """For instants (id_record, ask_us): the tracks with a row just then, that row, and how many rows came before it."""
    return instants.distinct().join(points.withColumnRenamed("us", "ask_us"), ["id_record", "ask_us"]).withColumn("history", F.col("ord") + 1)


def split_tracks(points: DataFrame, cuts: DataFrame) -> DataFrame:
    """Tracks cut by hand: cuts (id_record, id_vehicle, at array<long>) name rows, and each piece runs from one cut to the next, both included.

    Pieces of fewer than two steps are dropped; the others get vehicle numbers above all of their record.
    """
    ends = cuts.select(*KEY, F.posexplode(F.transform(F.slice("at", 1, F.size("at") - 1), lambda a, i: F.struct(a.alias("lo"), F.get("at", i + 1).alias("hi")))).alias("nth", "c"))
    ends = ends.select(*KEY, "nth", "c.lo", "c.hi").filter("hi - lo >= 2")
    top = points.groupBy("id_record").agg(F.max("id_vehicle").alias("top"))
    number = F.row_number().over(Window.partitionBy("id_record").orderBy("id_vehicle", "nth"))
    ends = ends.withColumn("k", number).join(top, "id_record").withColumn("new_vehicle", F.col("top") + F.col("k")).drop("top", "k", "nth")
    return points.join(ends, list(KEY)).filter(F.col("ord").between(F.col("lo"), F.col("hi"))).drop("lo", "hi")


def strided(points: DataFrame, most: int = 1200) -> DataFrame:
    """Every stride-th row of tracks longer than `most`, so that at most that many are left."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*KEY))
    at = F.row_number().over(along()) - 1
    out = points.withColumns({"stride": F.ceil(n / most), "at": at})
    return out.filter((F.col("at") % F.col("stride") == 0) & (F.col("at") < F.col("stride") * most)).drop("stride", "at")


def step_scale(points: DataFrame) -> DataFrame:
    """Per record the sums behind the mean change of x and y from row to row, in the order of vehicles: dx, dy and n steps.

    Steps inside tracks and those from one track's end to the next one's start are summed apart, so no task sorts a record.
    """
    inside = points.select("id_record", *(F.abs(F.col(c) - F.lag(c).over(along())).alias(f"d{c}") for c in "xy"))
    ends = points.groupBy(*KEY).agg(*(f(c, "ord").alias(f"{n}_{c}") for c in "xy" for n, f in (("first", F.min_by), ("last", F.max_by))))
    w = Window.partitionBy("id_record").orderBy("id_vehicle")  # a row a track
    between = ends.select("id_record", *(F.abs(F.col(f"first_{c}") - F.lag(f"last_{c}").over(w)).alias(f"d{c}") for c in "xy"))
    return inside.unionByName(between).groupBy("id_record").agg(F.sum("dx").alias("dx"), F.sum("dy").alias("dy"), F.count("dx").alias("n"))


def padded(points: DataFrame, most: int = 1200) -> DataFrame:
    """Rows k = 0 .. most - 1 of every track: its strided rows, then rows of zeros where pad is true."""
    kept = strided(points, most).withColumn("k", (F.row_number().over(along()) - 1).cast("int"))
    grid = points.select(*KEY).distinct().withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(most - 1))))
    out = grid.join(kept.select(*KEY, "k", "x", "y"), [*KEY, "k"], "left")
    return out.select(*KEY, "k", F.coalesce("x", F.lit(0.0)).alias("x"), F.coalesce("y", F.lit(0.0)).alias("y"), F.col("x").isNull().alias("pad"))


def reconstruction_error(rows: DataFrame, *key: str) -> DataFrame:
    """Per key the mean square error of (x_hat, y_hat) against (x, y) over rows that are not padding, its root, and a hundred times the mean."""
    square = lambda c: F.pow(F.col(f"{c}_hat") - F.col(c), 2)
    error = rows.filter(~F.col("pad")).groupBy(*key).agg(((F.sum(square("x")) + F.sum(square("y"))) / (2 * F.count(F.lit(1)))).alias("mse"))
    return error.withColumns({"rmse": F.sqrt("mse"), "loss": F.col("mse") * 100})


def consistent(*, error: Column, frames: Column, seen: Column, expected: Column, turn: Column, distance: float = 2.0, factor: float = 3.0, most_turn: float = math.pi / 2, settled: int = 150) -> Column:
    """Whether a detection fits a track's motion: error from the predicted place, seen and expected speed, turn between their directions.

    Until a track has `settled` frames the distance allowed grows with the error itself, so only the later test decides.
    """
    early = error < F.greatest(F.lit(distance), error * 1.5 * 30)
    speeds = (seen <= factor * expected) & (seen >= expected / factor)
    straight = F.when((seen > 0) & (expected > 0), F.pmod(F.abs(turn), F.lit(2 * math.pi)) < most_turn).otherwise(True)
    return F.when(frames < settled, early).otherwise((error < distance) & speeds & straight)


#: What place, slope and bend at a row and at the next weigh on the way between, by powers of the share.
_ENDS = ((1, 0, 0, -10, 15, -6), (0, 1, 0, -6, 8, -3), (0, 0, 0.5, -1.5, 1.5, -0.5), (0, 0, 0, 10, -15, 6), (0, 0, 0, -4, 7, -3), (0, 0, 0, 0.5, -1, 0.5))


def _by_powers(t: Column, weights: tuple[float, ...], d: int) -> Column:
    """The d-th derivative of a polynomial."""
    for _ in range(d):
        weights = tuple(i * w for i, w in enumerate(weights))[1:]
    return sum((F.lit(float(w)) * F.pow(t, F.lit(float(i))) for i, w in enumerate(weights) if i), F.lit(float(weights[0])))


def bernstein_paths(points: DataFrame, shares: tuple[float, ...] = (0.0,)) -> DataFrame:
    """(key, ord, share, place, velocity, acceleration, yaw, yaw_rate) on a smooth path through every row, at shares of the way to the next.

    A track runs from 0 to 1 over its rows. Between two rows the path is the polynomial of degree five, in Bernstein form,
    that has at both the place, the central difference of places and the central difference of those. Rows on the path
    are taken at share 0, the last row only so. The yaw rate is the change of yaw from sample to sample. Tracks of one
    row have none.
    """
    w, each = along(), Window.partitionBy(*KEY)
    axes = [c for c in "xyz" if c in points.columns]
    rows = points.select(*KEY, "ord", *axes, (1 / F.nullif(F.count(F.lit(1)).over(each) - 1, F.lit(0))).alias("h")).filter("h is not null")
    rows = rows.withColumns({f"v{c}": kinematics.gradient(F.col(c), w) / F.col("h") for c in axes})
    rows = rows.withColumns({f"a{c}": kinematics.gradient(F.col(f"v{c}"), w) / F.col("h") for c in axes})
    rows = rows.withColumns({f"{d}{c}2": F.lead(f"{d}{c}").over(w) for c in axes for d in ("", "v", "a")})
    rows = rows.withColumn("share", F.explode(F.array(*map(F.lit, shares)))).filter((F.col("share") == 0) | F.col(f"{axes[0]}2").isNotNull())
    h, t = F.col("h"), F.col("share")

    def fitted(c: str) -> list[Column]:
        p, v, a, p2, v2, a2 = (F.col(f"{d}{c}{k}") for k in ("", "2") for d in ("", "v", "a"))
        # the Bernstein form by its weights at both ends, so that a coordinate that stands still has slopes of one sign on all engines
        hermite = lambda d: sum((x * _by_powers(t, w, d) for x, w in zip((h * v, h * h * a, p2, h * v2, h * h * a2), _ENDS[1:], strict=True)), p * _by_powers(t, _ENDS[0], d)) / F.pow(h, F.lit(float(d)))
        own = lambda at_row, between: F.when(t == 0, at_row).otherwise(between)
        return [own(p, hermite(0)).alias(f"f{c}"), own(v, hermite(1)).alias(f"fv{c}"), own(a, hermite(2)).alias(f"fa{c}")]

    out = rows.select(*KEY, "ord", "share", *(e for c in axes for e in fitted(c)))
    out = out.select(*KEY, "ord", "share", *(F.col(f"f{d}{c}").alias(f"{d}{c}") for d in ("", "v", "a") for c in axes))
    out = out.withColumn("yaw", F.atan2("vy", "vx"))
    return out.withColumn("yaw_rate", kinematics.gradient(F.col("yaw"), Window.partitionBy(*KEY).orderBy("ord", "share")))
