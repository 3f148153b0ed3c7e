"""Tracks and trajectories as tables of points: (id_record, id_vehicle, ord, us, x, y, z, yaw, ...), one row a frame."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions import angles, kinematics
from ..functions.geometry import quadratic_fit

KEY = ("id_record", "id_vehicle")


def along(*key: str) -> WindowSpec:
    return Window.partitionBy(*(key or KEY)).orderBy("ord")


def displacements(points: DataFrame) -> DataFrame:
    w = along()
    return points.withColumns({"dx": kinematics.displacement(F.col("x"), w), "dy": kinematics.displacement(F.col("y"), w)})


def arc_length(points: DataFrame) -> DataFrame:
    """Adds step and arc, the way from the track's start."""
    w = along()
    out = points.withColumn("step", kinematics.step_length(F.col("x"), F.col("y"), w))
    return out.withColumn("arc", F.sum("step").over(kinematics.so_far(w)))


def smooth(points: DataFrame, half: int = 5) -> DataFrame:
    w = along()
    out = {f"{c}_smooth": kinematics.moving_average(F.col(c), w, half) for c in ("x", "y", "z")}
    return points.withColumns(out | {"yaw_smooth": kinematics.direction_average(F.col("yaw"), w, half)})


def velocities(points: DataFrame, dt: float) -> DataFrame:
    w = along()
    return points.withColumns({f"v{c}": kinematics.central_velocity(F.col(c), w, dt) for c in "xyz"} | {f"a{c}": kinematics.central_acceleration(F.col(c), w, dt) for c in "xyz"})


def gradients(points: DataFrame, fps: int = 30) -> DataFrame:
    """Velocities by gradient at fps frames a second, their gradients without that factor, and the yaw rate."""
    w = along()
    out = points.withColumns({f"g{c}": kinematics.gradient(F.col(c), w) * fps for c in "xy"})
    return out.withColumns({f"gg{c}": kinematics.gradient(F.col(f"g{c}"), w) for c in "xy"} | {"yaw_rate": kinematics.gradient(F.col("yaw"), w, 1 / fps)})


def hold_yaw(points: DataFrame, least_step: float = 0.1) -> DataFrame:
    w = along()
    out = points.withColumn("step", kinematics.step_length(F.col("x"), F.col("y"), w))
    return out.withColumn("yaw_held", kinematics.held_yaw(F.col("yaw"), F.col("step"), w, least_step))


def yaw_ranges(points: DataFrame) -> DataFrame:
    """Per track: the range of the yaw without whole turns, its fluctuation about the mean direction, and the arc covered in degrees."""
    w = along()
    steps = points.withColumn("turn", F.coalesce(kinematics.short_way(F.col("yaw") - F.lag("yaw").over(w)), F.lit(0.0)))
    steps = steps.withColumn("unwrapped", F.first("yaw").over(kinematics.whole(w)) + F.sum("turn").over(kinematics.so_far(w)))
    key = Window.partitionBy(*KEY)
    steps = steps.withColumn("mean", F.atan2(F.avg(F.sin("yaw")).over(key), F.avg(F.cos("yaw")).over(key)))
    off = angles.wrap(F.col("yaw") - F.col("mean"))
    return steps.groupBy(*KEY).agg(
        (F.max("unwrapped") - F.min("unwrapped")).alias("yaw_range"),
        (F.max(off) - F.min(off)).alias("fluctuation"),
    )


def circular_range_degrees(points: DataFrame) -> DataFrame:
    """Per track: 360 less the largest gap between neighbouring directions, in degrees."""
    deg = F.pmod(F.degrees("yaw"), F.lit(360.0))
    w = Window.partitionBy(*KEY).orderBy("deg")
    each = Window.partitionBy(*KEY)
    out = points.select(*KEY, deg.alias("deg")).withColumn("gap", F.coalesce(F.lead("deg").over(w), F.min("deg").over(each) + 360) - F.col("deg"))
    return out.groupBy(*KEY).agg((F.lit(360.0) - F.max("gap")).alias("circular_range"))


def trim_ends(points: DataFrame, first: int = 10, last: int = 10) -> DataFrame:
    """Without the first and last rows of every track."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*KEY))
    out = points.withColumns({"rn": F.row_number().over(along()), "n": n})
    return out.filter((F.col("rn") > first) & (F.col("rn") <= F.col("n") - last)).drop("rn", "n")


def trim_after_last(points: DataFrame, flag: str) -> DataFrame:
    """Rows up to the last on which flag holds; tracks where it never does are gone."""
    last = F.max(F.when(F.col(flag), F.col("ord"))).over(Window.partitionBy(*KEY))
    return points.withColumn("last", last).filter("ord <= last").drop("last")


def vote_class(points: DataFrame) -> DataFrame:
    """The most frequent class among detected rows; the smallest name of equals."""
    votes = points.filter("detected").groupBy(*KEY, "class_name").count()
    return votes.groupBy(*KEY).agg(F.min(F.struct((-F.col("count")).alias("n"), "class_name")).alias("best")).select(*KEY, F.col("best.class_name").alias("class_name"))


def mean_dimensions(points: DataFrame) -> DataFrame:
    return points.filter("detected").groupBy(*KEY).agg(*(F.avg(c).alias(c) for c in ("length", "width", "height")))


def scalars(points: DataFrame) -> DataFrame:
    """Per track: frames, share detected, duration, path, net distance, and where and when it starts and ends."""
    w = along()
    steps = points.withColumn("step", kinematics.step_length(F.col("x"), F.col("y"), w))
    first = lambda c: F.min_by(c, "ord")
    last = lambda c: F.max_by(c, "ord")
    return steps.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("frames"),
        F.avg(F.col("detected").cast("double")).alias("share_detected"),
        ((F.max("us") - F.min("us")) / 1e6).alias("seconds"),
        F.sum("step").alias("path"),
        F.hypot(last("x") - first("x"), last("y") - first("y")).alias("net"),
        first("x").alias("x_first"),
        first("y").alias("y_first"),
        last("x").alias("x_last"),
        last("y").alias("y_last"),
        first("yaw").alias("yaw_first"),
        last("yaw").alias("yaw_last"),
    )


def final_filter(points: DataFrame, *, share: float = 0.5, frames: int = 60, path: float = 5.0, fluctuation: float = 3.2) -> DataFrame:
    """Tracks good enough to keep, by their rows up to the last detected one."""
    trimmed = trim_after_last(points, "detected")
    found = scalars(trimmed).join(yaw_ranges(trimmed), list(KEY))
    return found.filter((F.col("share_detected") >= share) & (F.col("frames") >= frames) & (F.col("path") >= path) & (F.col("fluctuation") <= fluctuation))


def valid_for_scoring(points: DataFrame, *, frames: int = 60, distance: float = 5.0, turn: float = 3.2, trim: int = 10) -> DataFrame:
    """Tracks that anomaly scores are worked out for."""
    inner = trim_ends(points, trim, trim)
    return scalars(inner).join(yaw_ranges(inner), list(KEY)).filter((F.col("frames") >= frames) & (F.col("net") >= distance) & (F.col("yaw_range") <= turn))


def split_at_jumps(points: DataFrame, degrees: float = 45.0) -> DataFrame:
    """Adds piece, counted from 0: a new one starts on the row before the yaw jumps by more than degrees."""
    w = along()
    jump = F.abs(angles.wrap(F.lead("yaw").over(w) - F.col("yaw"))) > F.radians(F.lit(degrees))
    out = points.withColumn("starts", (F.coalesce(jump, F.lit(False)) & (F.row_number().over(w) > 1)).cast("int"))
    return out.withColumn("piece", F.sum("starts").over(kinematics.so_far(w))).drop("starts")


def pieces(points: DataFrame, degrees: float = 45.0) -> DataFrame:
    """Per piece of split_at_jumps that has a detection: its rows and a new vehicle number above all of its record."""
    cut = split_at_jumps(points, degrees).groupBy(*KEY, "piece").agg(F.count(F.lit(1)).alias("frames"), F.max("detected").alias("seen"), F.min("ord").alias("first_ord")).filter("seen")
    top = points.groupBy("id_record").agg(F.max("id_vehicle").alias("top"))
    number = F.row_number().over(Window.partitionBy("id_record").orderBy("id_vehicle", "piece"))
    new = cut.withColumn("nth", number).join(top, "id_record")
    return new.select(*KEY, "piece", "first_ord", "frames", F.when(F.col("piece") == 0, F.col("id_vehicle")).otherwise(F.col("top") + F.col("nth")).alias("new_vehicle"))


def undetected_runs(points: DataFrame) -> DataFrame:
    """Adds for how many rows a track has not been detected."""
    return points.withColumn("undetected", kinematics.since_last(F.col("detected"), F.col("ord"), along()))


def lifecycle(
    points: DataFrame, *, lost_after: int = 10, early: int = 10, early_share: float = 0.5, judged: tuple[int, int] = (110, 300), most_banned: int = 100
) -> DataFrame:
    """Per row the state of its track: candidate, dropped, finished or active.

    A track is a candidate before its row `early`, and dropped there if too few of its rows are detected; it is finished
    when lost_after rows in a row are not detected, or not valid (points may have a column valid), and dropped when it
    has been banned (points may have a column banned) for most_banned rows while its length lies between `judged`.
    """
    w = along()
    has = set(points.columns)
    valid = F.col("valid") if "valid" in has else F.lit(True)
    since_valid = kinematics.since_last(valid, F.col("ord"), w)
    so_banned = F.sum((F.col("banned") if "banned" in has else F.lit(False)).cast("int")).over(kinematics.so_far(w))
    runs = undetected_runs(points).withColumn("frames", F.row_number().over(w)).withColumn("share", F.avg(F.col("detected").cast("double")).over(kinematics.so_far(w)))
    runs = runs.withColumns({"invalid_run": since_valid, "so_banned": so_banned})
    lost = (F.coalesce("undetected", F.col("frames")) >= lost_after) | (F.coalesce("invalid_run", F.col("frames")) >= lost_after)
    out = (F.col("frames") > judged[0]) & (F.col("frames") < judged[1]) & (F.col("so_banned") >= most_banned)
    now = F.when(F.col("frames") < early, 0).when((F.col("frames") == early) & (F.col("share") < early_share), 3).when(lost, 2).when(out, 3).otherwise(1)
    runs = runs.withColumn("now", now)
    ended = F.first(F.when(F.col("now") >= 2, F.col("now")), ignorenulls=True).over(kinematics.so_far(w))
    state = F.coalesce(ended, F.col("now"))
    return runs.withColumn("state", F.element_at(F.array(*map(F.lit, ("candidate", "active", "finished", "dropped"))), state + 1)).drop("now", "share", "frames", "invalid_run", "so_banned")


def fill_gaps(points: DataFrame, fps: int = 30, longest_s: float = 1.5) -> DataFrame:
    """Rows for the frames missing between two rows of a track, on the cubic through two rows before and two after.

    A gap of n frames spans places 2 .. n+1 between rows at 0, 1 and n+2, n+3. Gaps without two rows on both sides, or
    longer than longest_s, stay.
    """
    w = along()
    frame = 1_000_000 / fps
    gap = points.withColumn("n", F.rint((F.lead("us").over(w) - F.col("us")) / frame).cast("int") - 1)
    at = {f"{c}{k}": (F.lag(c).over(w), F.col(c), F.lead(c, 1).over(w), F.lead(c, 2).over(w))[k] for c in ("x", "y", "z") for k in range(4)}
    gap = gap.withColumns(at).filter((F.col("n") >= 1) & (F.col("n") <= longest_s * fps) & F.col("x0").isNotNull() & F.col("x3").isNotNull())
    gap = gap.withColumn("k", F.explode(F.expr("sequence(1, n)")))
    t, n = F.col("k") + 1.0, F.col("n") + 0.0
    knots = (F.lit(0.0), F.lit(1.0), n + 2, n + 3)

    def lagrange(c: str):
        total = None
        for i in range(4):
            term = F.col(f"{c}{i}")
            for j in range(4):
                if i != j:
                    term = term * (t - knots[j]) / (knots[i] - knots[j])
            total = term if total is None else total + term
        return total

    return gap.select(*KEY, "ord", "k", (F.col("us") + F.rint(F.col("k") * frame).cast("long")).alias("us"), *(lagrange(c).alias(c) for c in ("x", "y", "z")))


def merge_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two tracks of one vehicle row by row (id_vehicle, us, x, y, z, detected): the mean where both or neither are detected, else the detected one."""
    both = a.alias("a").join(b.alias("b"), [F.col("a.id_vehicle") == F.col("b.id_vehicle"), F.col("a.us") == F.col("b.us")], "full")
    da, db = F.coalesce("a.detected", F.lit(False)), F.coalesce("b.detected", F.lit(False))

    def pick(c: str):
        p, q = F.col(f"a.{c}"), F.col(f"b.{c}")
        return F.when(p.isNull(), q).when(q.isNull(), p).when(da == db, (p + q) / 2).when(da, p).otherwise(q)

    return both.select(F.coalesce("a.id_vehicle", "b.id_vehicle").alias("id_vehicle"), F.coalesce("a.us", "b.us").alias("us"), *(pick(c).alias(c) for c in ("x", "y", "z")), (da | db).alias("detected"))


def key_points(points: DataFrame, k: int = 5) -> DataFrame:
    """Per track k points at equal shares of its path: the first row whose share reaches i / (k - 1), without interpolation.

    Tracks that do not move have none.
    """
    arcs = arc_length(points)
    total = F.max("arc").over(Window.partitionBy(*KEY))
    share = arcs.withColumn("share", F.col("arc") / F.nullif(total, F.lit(0.0))).filter("share is not null")
    at = lambda i: F.min_by(F.struct("x", "y", "z"), F.when(F.col("share") >= i / (k - 1) - 1e-12, F.col("ord")))
    return share.groupBy(*KEY).agg(F.array(*(at(i) for i in range(k))).alias("points"))


def curves(keyed: DataFrame) -> DataFrame:
    """Quadratics through the key points, over t = 0 .. 4: cx, cy, cz with the highest power first."""
    at = lambda c: quadratic_fit([F.col("points").getItem(i).getField(c) for i in range(5)])
    return keyed.select(*KEY, "points", *(at(c).alias(f"c{c}") for c in "xyz"))


def ego(points: DataFrame) -> DataFrame:
    """Positions from the first row's place and heading, seconds since it, and their changes."""
    w = along()
    first = lambda c: F.first(c).over(kinematics.whole(w))
    dx, dy, a = F.col("x") - first("x"), F.col("y") - first("y"), -first("yaw")
    out = points.withColumns({"ego_x": F.cos(a) * dx - F.sin(a) * dy, "ego_y": F.sin(a) * dx + F.cos(a) * dy, "t": (F.col("us") - first("us")) / 1e6})
    return out.withColumns({f"d_{c}": kinematics.displacement(F.col(c), w) for c in ("ego_x", "ego_y", "t")})


def hourly_classes(points: DataFrame, classes: list[str]) -> DataFrame:
    """Tracks by class and the hour of their first row."""
    first = points.groupBy(*KEY).agg(F.min("ts").alias("ts"), F.min_by("class_name", "ord").alias("class_name"))
    hour = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd_HH")
    counts = first.groupBy(hour.alias("hour")).pivot("class_name", classes).count().na.fill(0)
    return counts.select("hour", *(F.col(f"`{c}`").alias(c.replace("-", "_")) for c in classes), sum((F.col(f"`{c}`") for c in classes[1:]), F.col(f"`{classes[0]}`")).alias("total"))


def class_numbers(points: DataFrame) -> DataFrame:
    """Distinct classes in order, numbered from 0. There are as many rows as classes."""
    return points.select("class_name").distinct().withColumn("number", F.dense_rank().over(Window.orderBy("class_name")) - 1)


def nearest_in_time(points: DataFrame, asked: DataFrame, tolerance_us: int) -> DataFrame:
    """For (id_record, id_vehicle, ask_us): the row nearest in time within the tolerance, the earlier of equals.

    Both sides are put in time slots of the tolerance's length; a row can only match in its own slot or the next ones.
    """
    slot = lambda c: F.floor(F.col(c) / tolerance_us)
    left = asked.distinct().withColumn("slot", F.explode(F.array(slot("ask_us") - 1, slot("ask_us"), slot("ask_us") + 1)))
    near = left.join(points.withColumn("slot", slot("us")), [*KEY, "slot"]).filter(F.abs(F.col("us") - F.col("ask_us")) <= tolerance_us)
    best = F.min_by(F.struct("us", "x", "y", "ord"), F.struct(F.abs(F.col("us") - F.col("ask_us")), F.col("ord"))).alias("b")
    return near.groupBy(*KEY, "ask_us").agg(best).select(*KEY, "ask_us", "b.us", "b.x", "b.y", "b.ord")


def from_base(points: DataFrame, base: DataFrame) -> DataFrame:
    """Adds seconds since the record's base instant (id_record, base_us), negative before it."""
    return points.join(base, "id_record").withColumn("seconds", (F.col("us") - F.col("base_us")) / 1e6).drop("base_us")


def initial_filter(points: DataFrame, *, share: float = 0.2, frames: int = 15) -> DataFrame:
    """Tracks (with frames and share_detected) detected often and seen long enough to be worth enhancing."""
    found = points.groupBy(*KEY).agg(F.count(F.lit(1)).alias("frames"), F.avg(F.col("detected").cast("double")).alias("share_detected"))
    return found.filter((F.col("share_detected") >= share) & (F.col("frames") >= frames))


def finished_at_end(points: DataFrame, least: int = 3) -> DataFrame:
    """Tracks that count as finished when their record ends: those of at least that many frames."""
    return points.groupBy(*KEY).agg(F.count(F.lit(1)).alias("frames")).filter(F.col("frames") >= least)


def merge_tracks(points: DataFrame, pairs: DataFrame) -> DataFrame:
    """Tracks joined by hand: pairs (id_record, id_vehicle, into); rows of both are one track in order of time."""
    both = points.join(pairs.select(*KEY, "into"), list(KEY), "left").withColumn("id_vehicle", F.coalesce("into", "id_vehicle")).drop("into")
    w = Window.partitionBy(*KEY).orderBy("us", "ord", "event_id" if "event_id" in points.columns else "ord")
    return both.withColumn("ord", (F.row_number().over(w) - 1).cast("long"))


def remove_tracks(points: DataFrame, tracks: DataFrame) -> DataFrame:
    return points.join(tracks.select(*KEY).distinct(), list(KEY), "left_anti")


def rebuilt(points: DataFrame, *key: str) -> DataFrame:
    """Per piece of a track (KEY and key): frames, rows since the last detection, class by vote and mean size of its detected rows.

    Pieces without a detection are gone.
    """
    by = [*KEY, *key]
    votes = points.filter("detected").groupBy(*by, "class_name").count()
    voted = votes.groupBy(*by).agg(F.min(F.struct((-F.col("count")).alias("n"), "class_name")).alias("v")).select(*by, F.col("v.class_name").alias("class_name"))
    seen = F.when(F.col("detected"), F.col("ord"))
    sizes = [F.avg(F.when(F.col("detected"), F.col(c))).alias(c) for c in ("length", "width", "height")]
    found = points.groupBy(*by).agg(F.count(F.lit(1)).alias("frames"), (F.max("ord") - F.max(seen)).alias("undetected"), *sizes)
    return found.join(voted, by)


def fitted_or_raw(points: DataFrame, *columns: str) -> DataFrame:
    """Each column from its fitted one (column_fit) where there is a value, else as measured."""
    return points.withColumns({c: F.coalesce(f"{c}_fit", c) for c in columns})


def history_slice(points: DataFrame, first: int, end: int) -> DataFrame:
    """Rows first .. end - 1 of every track; negative ends count from its last row."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*KEY))
    at = F.row_number().over(along()) - 1
    place = lambda v: F.lit(v) if v >= 0 else F.col("n") + v
    return points.withColumns({"n": n, "at": at}).filter((F.col("at") >= place(first)) & (F.col("at") < place(end))).drop("n", "at")


def lagged_positions(points: DataFrame, rows: int = 3) -> DataFrame:
    """Adds where the track was `rows` rows before, null on its first ones, and the instant in seconds of the epoch."""
    w = along()
    return points.withColumns({f"{c}_before": F.lag(c, rows).over(w) for c in "xyz"} | {"epoch": F.col("us") / 1e6})


def record_counts(points: DataFrame, size: tuple[int, int] = (640, 480)) -> DataFrame:
    """Per record its tracks, frames and rows, and the size of its image."""
    found = points.groupBy("id_record").agg(F.countDistinct("id_vehicle").alias("tracks"), F.countDistinct("us").alias("frames"), F.count(F.lit(1)).alias("rows"))
    return found.withColumns({"width": F.lit(size[0]), "height": F.lit(size[1])})


def new_numbers(tracks: DataFrame, taken: DataFrame) -> DataFrame:
    """tracks (KEY) with new_vehicle: numbers above all of the record's in taken, in order; the first is 1 where there are none."""
    top = taken.groupBy("id_record").agg(F.max("id_vehicle").alias("top"))
    number = F.row_number().over(Window.partitionBy("id_record").orderBy("id_vehicle"))
    return tracks.withColumn("nth", number).join(top, "id_record", "left").withColumn("new_vehicle", F.coalesce("top", F.lit(0)) + F.col("nth")).drop("nth", "top")


def appended_sizes(points: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id_record, id_vehicle, length, width, height) of tracks after others are appended: means weighted by frames."""
    each = points.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), *(F.min_by(c, "ord").alias(c) for c in ("length", "width", "height")))
    into = each.join(pairs.select(*KEY, "into"), list(KEY), "left").withColumn("id_vehicle", F.coalesce("into", "id_vehicle"))
    return into.groupBy(*KEY).agg(*((F.sum(F.col(c) * F.col("n")) / F.sum("n")).alias(c) for c in ("length", "width", "height")))
