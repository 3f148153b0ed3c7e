"""Queries over the operators, each with SQL that says the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import boxes as box_functions
from ..functions import camera, geometry
from ..operators import anomaly, barycentre, clustering, conflicts, detections, interactions, matching, shapes, tracker, tracks
from ..operators.conflicts import ConflictFilter
from ..operators.link_match import match_links
from ..operators.near_frames import near_frames
from ..schemas import FRAME_US, OBJECT_CLASSES
from ..storage import store
from . import views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


P, C = views.points_sql(), views.CONFLICTS_SQL
W = "over (partition by id_record, id_vehicle order by ord)"
LIMITS = {c[0]: 60.0 for c in OBJECT_CLASSES}
HOUR_US = 3_600_000_000


def r6(df: DataFrame, *cols: str) -> DataFrame:
    """Sums differ in their last digits by order; six are compared."""
    return df.withColumns({c: F.round(c, 6) + F.lit(0.0) for c in cols})  # no negative zero


# ---- conflicts -------------------------------------------------------------------------------------------------


@query(
    "rule_extraction",
    f"""with {C}
    select least(Vehicle_Cluster_1, Vehicle_Cluster_2) as cluster_A, greatest(Vehicle_Cluster_1, Vehicle_Cluster_2) as cluster_B,
           count(*) filter (Vehicle_Cluster_1 = least(Vehicle_Cluster_1, Vehicle_Cluster_2)) as A_as_vehicle1,
           count(*) filter (Vehicle_Cluster_1 = greatest(Vehicle_Cluster_1, Vehicle_Cluster_2)) as B_as_vehicle1, count(*) as total_pairs
    from conflicts where Vehicle_Cluster_1 <> -1 and Vehicle_Cluster_2 <> -1 and "Value" <= 3 and Indicator = 'PET3D'
    group by 1, 2""",
)
def rule_extraction(spark, sf):
    kept = conflicts.select(conflicts.with_clusters(views.conflicts(spark, sf)), ConflictFilter(indicator="PET3D"))
    return conflicts.mine_rules(kept)


_RULES_SQL = """rules as (
        select least(Vehicle_Cluster_1, Vehicle_Cluster_2) as a, greatest(Vehicle_Cluster_1, Vehicle_Cluster_2) as b,
               count(*) filter (Vehicle_Cluster_1 = least(Vehicle_Cluster_1, Vehicle_Cluster_2)) as na,
               count(*) filter (Vehicle_Cluster_1 = greatest(Vehicle_Cluster_1, Vehicle_Cluster_2)) as nb
        from conflicts where "Value" <= 1.5 group by 1, 2)"""


@query(
    "rule_assignment",
    f"""with {C}, {_RULES_SQL},
    j as (select conflicts.*, case when Vehicle_Cluster_1 = a then na else nb end as p1, case when Vehicle_Cluster_1 = a then nb else na end as p2
          from conflicts left join rules on a = least(Vehicle_Cluster_1, Vehicle_Cluster_2) and b = greatest(Vehicle_Cluster_1, Vehicle_Cluster_2)),
    f as (select Vehicle_Cluster_1, Vehicle_Cluster_2, Auto_Type,
                 case when Auto_Type in ('Following', 'Diverging') then true when Vehicle_Cluster_1 = Vehicle_Cluster_2 then true
                      when p1 > p2 then true when p1 < p2 then p2 / (p1 + p2) < 0.66 end as Auto_Rule_Flag from j)
    select Vehicle_Cluster_1, Vehicle_Cluster_2, Auto_Type, Auto_Rule_Flag, count(*) as n from f group by all""",
)
def rule_assignment(spark, sf):
    all_ = views.conflicts(spark, sf)
    rules = conflicts.mine_rules(conflicts.select(all_, ConflictFilter(most_value=1.5)))
    flagged = conflicts.assign_rules(all_, rules)
    return flagged.groupBy("Vehicle_Cluster_1", "Vehicle_Cluster_2", "Auto_Type", "Auto_Rule_Flag").agg(F.count(F.lit(1)).alias("n"))


_SHOWN = ["key", "FrameTimeStamp_MicroSec", "Indicator", "Vehicle_Class_1", "Auto_Type", "Value"]


@query(
    "filter_conflicts",
    f"""with {C} select {', '.join(f'"{c}"' for c in _SHOWN)} from conflicts
    where Indicator in ('PET3D') and Vehicle_Class_1 in ('BUILDING', 'MACHINERY') and Auto_Type in ('Crossing', 'Merging', 'Head-on') and Vehicle_Cluster_1 = 3
      and "Value" <= 2.5 and Auto_Rule_Flag = false and LOF2 >= 0.5""",
)
def filter_conflicts(spark, sf):
    what = ConflictFilter(indicator="pet3d", class_1=" building, MACHINERY", auto_type="Crossing,merging,HEAD-ON", cluster_1=3, most_value=2.5, rule_flag=False, lof_2=0.5)
    return conflicts.select(views.conflicts(spark, sf), what).select(*_SHOWN)


@query("filter_lofor", f"""with {C} select {', '.join(f'"{c}"' for c in _SHOWN)} from conflicts where "Value" <= 1 and (LOF1 > 1.8 or LOF2 > 1.8)""")
def filter_lofor(spark, sf):
    return conflicts.select(views.conflicts(spark, sf), ConflictFilter(most_value=1, either_lof=1.8)).select(*_SHOWN)


def _overview_sql() -> str:
    parts = {"pet2d_1s": "Indicator = 'PET2D' and \"Value\" <= 1", "pet3d_1s": "Indicator = 'PET3D' and \"Value\" <= 1"}
    know = "Indicator = 'PET3D' and \"Value\" <= 3 and Auto_Rule_Flag = false and "
    parts |= {"pet3d_knowledge": know + "LOF2 >= 1.5", "pet3d_knowledge_lstm": know + "LOF2_LSTM >= 1.5"}
    labels = {"tp": "Manual_Conflict_Check", "fp": "not Manual_Conflict_Check", "unchecked": "Manual_Conflict_Check is null"}
    cols = ", ".join(f"count(*) filter ({w} and {h}) as {n}_{k}" for n, w in parts.items() for k, h in labels.items())
    return f"with {C} select coalesce(Auto_Type, 'all') as Type, {cols} from conflicts group by rollup (Auto_Type)"


@query("overview_pivot", _overview_sql())
def overview_pivot(spark, sf):
    return conflicts.overview(views.conflicts(spark, sf))


@query("distinct_types", f"with {C} select distinct Auto_Type from conflicts")
def distinct_types(spark, sf):
    return conflicts.distinct_types(views.conflicts(spark, sf))


@query("class_pairs", f"with {C} select least(Vehicle_Class_1, Vehicle_Class_2) as class_a, greatest(Vehicle_Class_1, Vehicle_Class_2) as class_b, count(*) as n from conflicts group by 1, 2")
def class_pairs(spark, sf):
    return conflicts.class_pairs(views.conflicts(spark, sf))


@query("report_filter", f"""with {C} select {', '.join(f'"{c}"' for c in _SHOWN)} from conflicts where Auto_Type not in ('Following', 'Diverging') and Manual_Conflict_Check is null and "Value" <= 1""")
def report_filter(spark, sf):
    return conflicts.to_review(conflicts.select(views.conflicts(spark, sf), ConflictFilter(most_value=1))).select(*_SHOWN)


@query(
    "conflict_labels",
    f"""with {C} select key, FrameTimeStamp_MicroSec, concat_ws('_', strftime(FrameTimeStamp, '%Y%m%dT%H%M%S'), Auto_Type, Vehicle_Class_1, Vehicle_Cluster_1::varchar,
        Vehicle_Class_2, Vehicle_Cluster_2::varchar, round_even("Value", 2)::decimal(18, 2)::varchar) as label from conflicts where "Value" <= 2""",
)
def conflict_labels(spark, sf):
    kept = conflicts.select(views.conflicts(spark, sf), ConflictFilter(most_value=2))
    label = conflicts.label_text(F.col("FrameTimeStamp"), F.col("Auto_Type"), F.col("Vehicle_Class_1"), F.col("Vehicle_Cluster_1"), F.col("Vehicle_Class_2"), F.col("Vehicle_Cluster_2"), F.col("Value"))
    return kept.select("key", "FrameTimeStamp_MicroSec", label.alias("label"))


@query(
    "conflict_dedupe",
    f"""with {C}, d as (select * from conflicts union all select * from conflicts),
    r as (select *, row_number() over (partition by Indicator, idVehicle1, idVehicle2, idRecord, FrameTimeStamp, FrameTimeStamp_MicroSec order by key) as rn from d)
    select Indicator, idRecord, count(*) as n, sum(key)::bigint as keys from r where rn = 1 group by 1, 2""",
)
def conflict_dedupe(spark, sf):
    all_ = views.conflicts(spark, sf)
    twice = 2 * views.read(spark, sf, "lineitem").count()  # no line item makes two conflicts
    return conflicts.dedupe(all_.unionByName(all_), "key", twice).groupBy("Indicator", "idRecord").agg(F.count(F.lit(1)).alias("n"), F.sum("key").alias("keys"))


@query(
    "manual_label_writeback",
    f"""with {C}, m as (select distinct key, FrameTimeStamp_MicroSec, key % 2 = 0 as v from conflicts where key % 5 = 0)
    select Indicator, coalesce(v, Manual_Conflict_Check) as Manual_Conflict_Check, count(*) as n
    from conflicts left join m on conflicts.key = m.key and conflicts.FrameTimeStamp_MicroSec = m.FrameTimeStamp_MicroSec group by 1, 2""",
)
def manual_label_writeback(spark, sf):
    all_ = views.conflicts(spark, sf)
    labels = all_.filter("key % 5 = 0").select("key", "FrameTimeStamp_MicroSec", (F.col("key") % 2 == 0).alias("Manual_Conflict_Check"))
    return conflicts.write_labels(all_, labels, ["key", "FrameTimeStamp_MicroSec"]).groupBy("Indicator", "Manual_Conflict_Check").agg(F.count(F.lit(1)).alias("n"))


@query(
    "maneuver_lookup",
    f"""with {C}, {views.maneuvers_sql()} select Vehicle_Cluster_1, Vehicle_Cluster_2, known as Auto_Type, count(*) as n
    from conflicts left join maneuvers on Vehicle_Cluster_1 = c1 and Vehicle_Cluster_2 = c2 group by 1, 2, 3""",
)
def maneuver_lookup(spark, sf):
    known = views.maneuvers(spark).withColumnRenamed("ManeuverClass", "Auto_Type")
    rows = views.conflicts(spark, sf).drop("Auto_Type")
    out = rows.join(F.broadcast(known), (F.col("Vehicle_Cluster_1") == F.col("ClusterVehicle1")) & (F.col("Vehicle_Cluster_2") == F.col("ClusterVehicle2")), "left")
    return out.groupBy("Vehicle_Cluster_1", "Vehicle_Cluster_2", "Auto_Type").agg(F.count(F.lit(1)).alias("n"))


# ---- tracks ----------------------------------------------------------------------------------------------------


@query("displacements", f"with {P} select id_vehicle, ord, round(coalesce(x - lag(x) {W}, 0), 6) as dx, round(coalesce(y - lag(y) {W}, 0), 6) as dy from points")
def displacements(spark, sf):
    return r6(tracks.displacements(views.points(spark, sf)).select("id_vehicle", "ord", "dx", "dy"), "dx", "dy")


_STEPS = f"steps as (select *, coalesce(sqrt((x - lag(x) {W}) ** 2 + (y - lag(y) {W}) ** 2), 0) as step from points)"


@query("arc_length", f"with {P}, {_STEPS} select id_vehicle, ord, round(step, 6) as step, round(sum(step) over (partition by id_record, id_vehicle order by ord), 6) as arc from steps")
def arc_length(spark, sf):
    return r6(tracks.arc_length(views.points(spark, sf)).select("id_vehicle", "ord", "step", "arc"), "step", "arc")




@query(
    "moving_average_edge",
    f"""with {P}, p as (select *, count(*) over (partition by id_record, id_vehicle) as n from points),
    k as (select p.*, unnest(range(ord - 5, ord + 6)) as k from p)
    select k.id_vehicle, k.ord, round(sum(q.x) / 11, 6) as x_smooth, round(sum(q.y) / 11, 6) as y_smooth
    from k join points q on q.id_record = k.id_record and q.id_vehicle = k.id_vehicle and q.ord = greatest(0, least(n - 1, k)) group by 1, 2""",
)
def moving_average_edge(spark, sf):
    return r6(tracks.smooth(views.points(spark, sf)).select("id_vehicle", "ord", "x_smooth", "y_smooth"), "x_smooth", "y_smooth")


@query(
    "circular_yaw_smooth",
    f"""with {P}, p as (select *, count(*) over (partition by id_record, id_vehicle) as n from points),
    k as (select p.*, unnest(range(ord - 5, ord + 6)) as k from p),
    s as (select k.id_vehicle, k.ord, sum(sin(q.yaw)) as s, sum(cos(q.yaw)) as c
          from k join points q on q.id_record = k.id_record and q.id_vehicle = k.id_vehicle and q.ord = greatest(0, least(n - 1, k)) group by 1, 2)
    select id_vehicle, ord, round(atan2(s, c), 6) as yaw_smooth from s where s * s + c * c > 1e-9""",
)
def circular_yaw_smooth(spark, sf):
    pts = tracks.smooth(views.points(spark, sf))
    w = tracks.along()
    from ..functions import kinematics

    s, c = (kinematics.moving_average(f("yaw"), w) * 11 for f in (F.sin, F.cos))
    return r6(pts.withColumns({"s": s, "c": c}).filter("s * s + c * c > 1e-9").select("id_vehicle", "ord", "yaw_smooth"), "yaw_smooth")


@query(
    "central_velocity",
    f"""with {P} select id_vehicle, ord,
        round((case when lag(x) {W} is null then lead(x, 2) {W} - x when lead(x) {W} is null then x - lag(x, 2) {W} else lead(x) {W} - lag(x) {W} end) * 15, 6) as vx,
        round((case when lag(x) {W} is null then lead(x, 2) {W} - 2 * lead(x) {W} + x when lead(x) {W} is null then x - 2 * lag(x) {W} + lag(x, 2) {W}
               else lead(x) {W} - 2 * x + lag(x) {W} end) * 900, 6) as ax from points""",
)
def central_velocity(spark, sf):
    return r6(tracks.velocities(views.points(spark, sf), 1 / 30).select("id_vehicle", "ord", "vx", "ax"), "vx", "ax")


@query(
    "gradient_ends",
    f"""with {P}, g as (select *, 30 * (case when lag(x) {W} is null then lead(x) {W} - x when lead(x) {W} is null then x - lag(x) {W} else (lead(x) {W} - lag(x) {W}) / 2 end) as gx,
        30 * (case when lag(yaw) {W} is null then lead(yaw) {W} - yaw when lead(yaw) {W} is null then yaw - lag(yaw) {W} else (lead(yaw) {W} - lag(yaw) {W}) / 2 end) as yr from points)
    select id_vehicle, ord, round(gx, 6) as gx, round(yr, 6) as yaw_rate,
           round(case when lag(gx) {W} is null then lead(gx) {W} - gx when lead(gx) {W} is null then gx - lag(gx) {W} else (lead(gx) {W} - lag(gx) {W}) / 2 end, 6) as ggx from g""",
)
def gradient_ends(spark, sf):
    return r6(tracks.gradients(views.points(spark, sf)).select("id_vehicle", "ord", "gx", "yaw_rate", "ggx"), "gx", "yaw_rate", "ggx")


@query(
    "yaw_hold",
    f"""with {P}, {_STEPS} select id_vehicle, ord, round(coalesce(last_value(case when step >= 20 then yaw end ignore nulls)
        over (partition by id_record, id_vehicle order by ord rows unbounded preceding), first_value(yaw) {W}), 6) as yaw_held from steps""",
)
def yaw_hold(spark, sf):
    return r6(tracks.hold_yaw(views.points(spark, sf), 20.0).select("id_vehicle", "ord", "yaw_held"), "yaw_held")


@query(
    "yaw_ranges",
    f"""with {P}, t as (select *, coalesce((yaw - lag(yaw) {W}) - 2 * pi() * round_even((yaw - lag(yaw) {W}) / (2 * pi()), 0), 0) as turn,
        atan2(avg(sin(yaw)) over (partition by id_record, id_vehicle), avg(cos(yaw)) over (partition by id_record, id_vehicle)) as m from points),
    u as (select *, sum(turn) over (partition by id_record, id_vehicle order by ord) as un, (yaw - m + pi()) - 2 * pi() * floor((yaw - m + pi()) / (2 * pi())) - pi() as off from t)
    select id_vehicle, round(max(un) - min(un), 5) as yaw_range, round(max(off) - min(off), 5) as fluctuation from u group by id_record, id_vehicle""",
)
def yaw_ranges(spark, sf):
    found = tracks.yaw_ranges(views.points(spark, sf))
    return found.select("id_vehicle", F.round("yaw_range", 5).alias("yaw_range"), F.round("fluctuation", 5).alias("fluctuation"))


@query(
    "circular_range",
    f"""with {P}, d as (select id_record, id_vehicle, (event_id * 37) % 360 as d from points),
    g as (select id_record, id_vehicle, coalesce(lead(d) over w, min(d) over (partition by id_record, id_vehicle) + 360) - d as gap from d window w as (partition by id_record, id_vehicle order by d))
    select id_vehicle, round(360.0::double - max(gap), 6) as circular_range from g group by id_record, id_vehicle""",
)
def circular_range(spark, sf):
    return r6(tracks.circular_range_degrees(views.points(spark, sf)).select("id_vehicle", "circular_range"), "circular_range")


@query("trim_10_10", f"with {P}, t as (select *, row_number() {W} as rn, count(*) over (partition by id_record, id_vehicle) as n from points) select id_vehicle, ord, x, y from t where rn > 10 and rn <= n - 10")
def trim_10_10(spark, sf):
    return tracks.trim_ends(views.points(spark, sf)).select("id_vehicle", "ord", "x", "y")


@query("trim_trailing_undetected", f"with {P}, t as (select *, max(ord) filter (detected) over (partition by id_record, id_vehicle) as m from points) select id_vehicle, count(*) as frames, max(ord) as last_ord from t where ord <= m group by id_record, id_vehicle")
def trim_trailing_undetected(spark, sf):
    return tracks.trim_after_last(views.points(spark, sf), "detected").groupBy("id_record", "id_vehicle").agg(F.count(F.lit(1)).alias("frames"), F.max("ord").alias("last_ord")).drop("id_record")


@query(
    "vote_class",
    f"""with {P}, q as (select id_record, id_vehicle, event_id % 3 as k, count(*) filter (detected) as n from points group by all)
    select id_vehicle, arg_min(k, (-n) * 10 + k)::varchar as class_name from q where n > 0 group by id_record, id_vehicle""",
)
def vote_class(spark, sf):
    pts = views.points(spark, sf).withColumn("class_name", (F.col("event_id") % 3).cast("string"))
    return tracks.vote_class(pts).select("id_vehicle", "class_name")


@query("mean_dimensions", f"with {P} select id_vehicle, round(avg(length), 6) as length, round(avg(width), 6) as width, round(avg(height), 6) as height from points where detected group by id_record, id_vehicle")
def mean_dimensions(spark, sf):
    return r6(tracks.mean_dimensions(views.points(spark, sf)).drop("id_record"), "length", "width", "height")


@query(
    "track_scalars",
    f"""with {P}, {_STEPS} select id_vehicle, count(*) as frames, round(avg(detected::int), 6) as share_detected, round((max(us) - min(us)) / 1e6, 6) as seconds, round(sum(step), 6) as path,
        round(sqrt((arg_max(x, ord) - arg_min(x, ord)) ** 2 + (arg_max(y, ord) - arg_min(y, ord)) ** 2), 6) as net, arg_min(x, ord) as x_first, arg_max(x, ord) as x_last
    from steps group by id_record, id_vehicle""",
)
def track_scalars(spark, sf):
    return r6(tracks.scalars(views.points(spark, sf)).select("id_vehicle", "frames", "share_detected", "seconds", "path", "net", "x_first", "x_last"), "share_detected", "seconds", "path", "net")


@query(
    "final_track_filter",
    f"""with {P}, t as (select *, max(ord) filter (detected) over (partition by id_record, id_vehicle) as m from points), k as (select * from t where ord <= m),
    s as (select *, coalesce(sqrt((x - lag(x) {W}) ** 2 + (y - lag(y) {W}) ** 2), 0) as step,
                 atan2(avg(sin(yaw)) over (partition by id_record, id_vehicle), avg(cos(yaw)) over (partition by id_record, id_vehicle)) as mean from k),
    o as (select *, (yaw - mean + pi()) - 2 * pi() * floor((yaw - mean + pi()) / (2 * pi())) - pi() as off from s)
    select id_vehicle, count(*) as frames, round(sum(step), 6) as path from o group by id_record, id_vehicle
    having avg(detected::int) >= 0.5 and count(*) >= 60 and sum(step) >= 5 and max(off) - min(off) <= 6.2""",
)
def final_track_filter(spark, sf):
    return r6(tracks.final_filter(views.points(spark, sf), fluctuation=6.2).select("id_vehicle", "frames", "path"), "path")


_WRAP = "((({d}) + pi()) - 2 * pi() * floor((({d}) + pi()) / (2 * pi())) - pi())"


@query(
    "split_on_yaw_jump",
    f"""with {P}, s as (select *, coalesce(abs({_WRAP.format(d=f'lead(yaw) {W} - yaw')}) > 100.5 * pi() / 180, false) and row_number() {W} > 1 as starts from points),
    q as (select *, sum(starts::int) over (partition by id_record, id_vehicle order by ord) as piece from s)
    select id_vehicle, piece::bigint as piece, count(*) as frames, min(ord) as first_ord from q group by id_record, id_vehicle, piece having bool_or(detected)""",
)
def split_on_yaw_jump(spark, sf):
    return tracks.pieces(views.points(spark, sf), 100.5).select("id_vehicle", "piece", "frames", "first_ord")


@query("gap_runs", f"with {P} select id_vehicle, ord, ord - max(case when detected then ord end) over (partition by id_record, id_vehicle order by ord) as undetected from points")
def gap_runs(spark, sf):
    return tracks.undetected_runs(views.points(spark, sf)).select("id_vehicle", "ord", "undetected")


@query(
    "track_lifecycle",
    # duration below 10: candidate; at 10 with less than the share detected: removed; 2 frames not detected or not valid:
    # finished; between 12 and 40 frames with 4 banned ones or more up to now: removed; else active
    f"""with {P}, z as (select *, y >= 30 and detected as valid from points),
    b0 as (select *, bool_or(y > 90) over (partition by id_record, id_vehicle order by ord) as banned from z),
    a as (
        select *, count(*) over t as f, sum(detected::int) over t as n_detected, max(case when detected then ord end) over t as last_seen,
               max(case when valid then ord end) over t as last_valid, sum(banned::int) over t as n_banned
        from b0 window t as (partition by id_record, id_vehicle order by ord)
    ),
    now as (
        select *, case when f < 10 then 'candidate' when f = 10 and n_detected / f < 0.8 then 'dropped'
                       when f - 1 - coalesce(last_seen, -1) >= 2 then 'finished' when f - 1 - coalesce(last_valid, -1) >= 2 then 'finished'
                       when f > 12 and f < 40 and n_banned >= 4 then 'dropped' else 'active' end as one
        from a
    )
    select id_vehicle, ord, coalesce(arg_min(one, ord) filter (one in ('finished', 'dropped')) over (partition by id_record, id_vehicle order by ord), one) as state from now""",
)
def track_lifecycle(spark, sf):
    pts = views.points(spark, sf).withColumn("valid", (F.col("y") >= 30) & F.col("detected"))
    pts = pts.withColumn("banned", F.max(F.col("y") > 90).over(tracks.along().rowsBetween(Window.unboundedPreceding, 0)))
    return tracks.lifecycle(pts, lost_after=2, early_share=0.8, judged=(12, 40), most_banned=4).select("id_vehicle", "ord", "state")


@query("prior_mean_yaw", f"with {P} select id_vehicle, ord, round(avg(yaw) over (partition by id_record, id_vehicle order by ord rows between 30 preceding and 1 preceding), 6) as yaw_before from points")
def prior_mean_yaw(spark, sf):
    from ..functions import kinematics

    return r6(views.points(spark, sf).withColumn("yaw_before", kinematics.mean_before(F.col("yaw"), tracks.along())).select("id_vehicle", "ord", "yaw_before"), "yaw_before")


_TERM = " + ".join("{c}%d * %s" % (i, " * ".join(f"(t - k{j}) / (k{i} - k{j})" for j in range(4) if j != i)) for i in range(4))


@query(
    "gap_fill_cubic",
    f"""with {P}, g as (select *, round_even((lead(us) {W} - us) / (3600 * 1e6), 0)::int - 1 as n, lag(x) {W} as x0, x as x1, lead(x) {W} as x2, lead(x, 2) {W} as x3,
        lag(y) {W} as y0, y as y1, lead(y) {W} as y2, lead(y, 2) {W} as y3 from points),
    f as (select *, unnest(range(1, n + 1)) as k from g where n between 1 and 24 and x0 is not null and x3 is not null),
    h as (select *, k + 1.0::double as t, 0.0::double as k0, 1.0::double as k1, n + 2.0::double as k2, n + 3.0::double as k3 from f)
    select id_vehicle, ord, k, us + round_even(k * 3600 * 1e6, 0)::bigint as us, round({_TERM.format(c='x')}, 6) + 0.0 as x, round({_TERM.format(c='y')}, 6) + 0.0 as y from h""",
)
def gap_fill_cubic(spark, sf):
    filled = tracks.fill_gaps(views.points(spark, sf), fps=1 / 3600, longest_s=24 * 3600)
    return r6(filled.select("id_vehicle", "ord", "k", "us", "x", "y"), "x", "y")


_SHARE = f"""{_STEPS}, arcs as (select *, sum(step) over (partition by id_record, id_vehicle order by ord) as arc, sum(step) over (partition by id_record, id_vehicle) as total from steps),
    keyed as (select id_record, id_vehicle, {', '.join(f"arg_min(struct_pack(x := x, y := y, z := z), ord) filter (arc / total >= {i / 4} - 1e-12) as p{i}" for i in range(5))}
              from arcs where total > 0 group by 1, 2)"""


@query("keypoint_resample", f"with {P}, {_SHARE} select id_vehicle, {', '.join(f'p{i}.x as x{i}, p{i}.y as y{i}' for i in range(5))} from keyed")
def keypoint_resample(spark, sf):
    keyed = tracks.key_points(views.points(spark, sf))
    return keyed.select("id_vehicle", *(F.col("points").getItem(i).getField(c).alias(f"{c}{i}") for i in range(5) for c in "xy"))


def _fit_sql(c: str) -> str:
    rows = geometry._pseudo_inverse(5)
    return ", ".join(f"round({' + '.join(f'({w}) * p{i}.{c}' for i, w in enumerate(row))}, 5) as c{c}{k}" for k, row in enumerate(rows))


@query("quadratic_fit", f"with {P}, {_SHARE} select id_vehicle, {_fit_sql('x')}, {_fit_sql('y')} from keyed")
def quadratic_fit(spark, sf):
    fitted = tracks.curves(tracks.key_points(views.points(spark, sf)))
    return fitted.select("id_vehicle", *(F.round(F.get(f"c{c}", F.lit(k)), 5).alias(f"c{c}{k}") for c in "xy" for k in range(3)))


@query(
    "ego_coordinates",
    f"""with {P}, e as (select *, x - first_value(x) {W} as ex, y - first_value(y) {W} as ey, -first_value(yaw) {W} as a, (us - first_value(us) {W}) / 1e6 as t from points)
    select id_vehicle, ord, round(cos(a) * ex - sin(a) * ey, 6) + 0.0 as ego_x, round(sin(a) * ex + cos(a) * ey, 6) + 0.0 as ego_y, round(t, 6) as t from e""",
)
def ego_coordinates(spark, sf):
    return r6(tracks.ego(views.points(spark, sf)).select("id_vehicle", "ord", "ego_x", "ego_y", "t"), "ego_x", "ego_y", "t")


def _hourly_sql() -> str:
    names = [c[0] for c in OBJECT_CLASSES]
    cols = ", ".join(f"count(*) filter (class_name = '{n}') as {n.replace('-', '_')}" for n in names)
    return f"""with {views.points_sql('%Y%m%d')}, f as (select id_record, id_vehicle, min(ts) as ts, arg_min(class_name, ord) as class_name from points group by 1, 2)
    select strftime(ts, '%Y-%m-%d_%H') as hour, {cols}, count(*) as total from f group by 1"""


@query("hourly_class_distribution", _hourly_sql())
def hourly_class_distribution(spark, sf):
    return tracks.hourly_classes(views.points(spark, sf, "yyyyMMdd"), [c[0] for c in OBJECT_CLASSES])


@query("class_map", f"with {P} select class_name, (dense_rank() over (order by class_name) - 1)::int as number from (select distinct class_name from points)")
def class_map(spark, sf):
    return tracks.class_numbers(views.points(spark, sf))


@query("frame_timestamps", f"select event_id, timestamp '2024-01-01 00:00:00' + to_microseconds(event_id * {FRAME_US}) as frame_ts from events")
def frame_timestamps(spark, sf):
    at = F.expr(f"timestampadd(MICROSECOND, event_id * {FRAME_US}, TIMESTAMP_NTZ '2024-01-01 00:00:00')")
    return views.read(spark, sf, "events").select("event_id", at.alias("frame_ts"))


@query(
    "nearest_time_lookup",
    f"""with {P}, a as (select distinct id_record, id_vehicle, us + 1800000000 as ask_us from points),
    n as (select a.*, p.us, p.ord, row_number() over (partition by a.id_record, a.id_vehicle, ask_us order by abs(p.us - ask_us), p.ord) as rn
          from a join points p on a.id_record = p.id_record and a.id_vehicle = p.id_vehicle and abs(p.us - ask_us) <= {HOUR_US})
    select id_vehicle, ask_us, us, ord from n where rn = 1""",
)
def nearest_time_lookup(spark, sf):
    pts = views.points(spark, sf)
    asked = pts.select("id_record", "id_vehicle", (F.col("us") + 1_800_000_000).alias("ask_us"))
    return tracks.nearest_in_time(pts, asked, HOUR_US).select("id_vehicle", "ask_us", "us", "ord")


@query(
    "overlap_merge",
    f"""with {P}, p as (select id_vehicle, us, avg(x) as x, bool_or(detected) as detected from points group by 1, 2), a as (select * from p where us % 3 <> 0), b as (select id_vehicle, us, x + 1 as x, us % 2 = 0 as detected from p where us % 5 <> 0)
    select coalesce(a.id_vehicle, b.id_vehicle) as id_vehicle, coalesce(a.us, b.us) as us,
           round(case when a.x is null then b.x when b.x is null then a.x when a.detected = b.detected then (a.x + b.x) / 2 when a.detected then a.x else b.x end, 6) as x,
           coalesce(a.detected, false) or coalesce(b.detected, false) as detected
    from a full join b on a.id_vehicle = b.id_vehicle and a.us = b.us""",
)
def overlap_merge(spark, sf):
    p = views.points(spark, sf).groupBy("id_vehicle", "us").agg(*(F.avg(c).alias(c) for c in "xyz"), F.max("detected").alias("detected"))
    b = p.filter("us % 5 <> 0").withColumns({"x": F.col("x") + 1, "detected": F.col("us") % 2 == 0})
    return r6(tracks.merge_overlap(p.filter("us % 3 <> 0"), b).select("id_vehicle", "us", "x", "detected"), "x")


# ---- linking ---------------------------------------------------------------------------------------------------


def _ends(spark, sf):
    pts = views.points(spark, sf, "yyyyMMdd")
    first, last = (lambda c: F.min_by(c, "ord").alias(f"s_{c}")), (lambda c: F.max_by(c, "ord").alias(f"e_{c}"))
    return pts.groupBy("id_record", F.col("id_vehicle").alias("id")).agg(F.min("class_name").alias("class_name"), *(first(c) for c in ("x", "y", "z", "yaw", "us")), *(last(c) for c in ("x", "y", "z", "yaw", "us")), *(F.min(c).alias(c) for c in ("length", "width", "height")))


_LINKS = f"""{views.points_sql('%Y%m%d')}, ends as (select id_record, id_vehicle as id, min(class_name) as class_name, min(length) as length,
        {', '.join(f'arg_min({c}, ord) as s_{c}, arg_max({c}, ord) as e_{c}' for c in ('x', 'y', 'z', 'yaw', 'us'))} from points group by 1, 2),
    links as (select i.id_record, i.id as i, j.id as j, sqrt(4 * ((i.s_x - j.e_x) ** 2 + (i.s_y - j.e_y) ** 2 + (i.s_z - j.e_z) ** 2)) * (2 - cos(i.s_yaw - j.e_yaw)) as cost
        from ends i join ends j on i.id_record = j.id_record and i.id <> j.id and i.class_name = j.class_name
        where i.e_us >= j.e_us and not (i.s_us <= j.s_us and i.e_us <= j.e_us) and abs(i.s_us - j.e_us) <= {4 * HOUR_US})"""


@query("track_link_candidates", f"with {_LINKS} select id_record, i, j, round(cost, 6) as cost from links where cost <= 60")
def track_link_candidates(spark, sf):
    return r6(matching.link_candidates(_ends(spark, sf), LIMITS, 4 * HOUR_US), "cost")


@query(
    "greedy_match",
    f"""with recursive {_LINKS}, c as (select id_record, i, j, round(cost, 9) as cost, row_number() over (partition by id_record order by round(cost, 9), i, j) as n from links where cost <= 60),
    m as (select id_record, 0::bigint as n, []::bigint[] as si, []::bigint[] as sj, null::bigint as i, null::bigint as j from (select distinct id_record from c)
          union all
          select m.id_record, c.n, case when ok then list_append(si, c.i) else si end, case when ok then list_append(sj, c.j) else sj end, case when ok then c.i end, case when ok then c.j end
          from m join (select * from c) c on c.id_record = m.id_record and c.n = m.n + 1, lateral (select not list_contains(si, c.i) and not list_contains(sj, c.j) as ok))
    select id_record, i, j from m where i is not null""",
)
def greedy_match(spark, sf):
    return match_links(_ends(spark, sf), LIMITS, 4 * HOUR_US, digits=9)


@query(
    "chain_resolution",
    SQL["greedy_match"].rsplit("select id_record, i, j from m", 1)[0].rstrip()
    + """, l as (select id_record, i, j from m where i is not null), r as (select id_record, i, j, 1 as steps from l union all select r.id_record, r.i, l.j, steps + 1 from r join l on l.id_record = r.id_record and l.i = r.j)
    select id_record, i, arg_max(j, steps) as root from r group by 1, 2""",
)
def chain_resolution(spark, sf):
    return matching.chains(greedy_match(spark, sf), ["id_record"]).select("id_record", "i", "root")


_AXES6 = ("x", "y", "z", "length", "width", "height")
_PACE = "case class_name when 'motorcycle' then 30 when 'car' then 50 when 'truck' then 25 when 'bus' then 25 when 'person' then 7 when 'bicycle' then 15 when 'e-scooter' then 20 end / 3.6::double"


def _filter_sql() -> str:
    """Predict with x + v dt, P = F P F' + Q, then gain K = P H' (H P H' + R)^-1; p11, p12, p22 are of an axis, s of a size."""
    ahead = ", ".join(f"s{c} + v{c} / 30 as f{c}" for c in "xyz") + ", " + ", ".join(f"s{c} as f{c}" for c in _AXES6[3:])
    place = ", ".join(f"f{c} + gain * (m{c} - f{c}) as s{c}" for c in "xyz") + ", " + ", ".join(f"f{c} + size_gain * (m{c} - f{c}) as s{c}" for c in _AXES6[3:])
    return f"""with recursive {P},
    first as (
        select id_record, id_vehicle, ord, {', '.join(f'{c} as s{c}' for c in _AXES6)}, {_PACE} * cos(yaw) as vx, {_PACE} * sin(yaw) as vy, 0.0::double as vz,
               10.0::double as p11, 0.0::double as p12, 10.0::double as p22, 10.0::double as s
        from points where ord = 0
    ),
    steps as (
        select * from first
        union all
        select id_record, id_vehicle, o as ord, {place}, {', '.join(f'v{c} + speed_gain * (m{c} - f{c}) as v{c}' for c in 'xyz')},
               q11 - gain * q11, q12 - gain * q12, q22 - speed_gain * q12, q - size_gain * q
        from (
            select *, case when seen then q11 / (q11 + 1) else 0 end as gain, case when seen then q12 / (q11 + 1) else 0 end as speed_gain, case when seen then q / (q + 10) else 0 end as size_gain
            from (
                select t.*, p.ord as o, p.detected as seen, {', '.join(f'p.{c} as m{c}' for c in _AXES6)}, {ahead},
                       (p11 + p12 / 30) + (p12 + p22 / 30) / 30 + 1 as q11, p12 + p22 / 30 as q12, p22 + 0.01 as q22, s + 1 as q
                from steps t join points p on p.id_record = t.id_record and p.id_vehicle = t.id_vehicle and p.ord = t.ord + 1
            )
        )
    )
    select id_vehicle, ord, {', '.join(f'round(s{c}, 6) as k{c}' for c in _AXES6)}, {', '.join(f'round(v{c}, 6) as kv{c}' for c in 'xyz')} from steps"""


@query("kalman_track", _filter_sql())
def kalman_track(spark, sf):
    from ..operators.walks import FILTERED

    return r6(matching.kalman(views.points(spark, sf)).drop("id_record"), *FILTERED)


# the state machine of tests/test_tracker.py says the same in full matrices and histories
@query("tracked_objects")
def tracked_objects(spark, sf):
    found = tracker.track(views.detections(spark, sf))
    return r6(found, *(c for c, kind in found.dtypes if kind == "double"))


# ---- geometry --------------------------------------------------------------------------------------------------


@query(
    "bev_corners",
    f"""with {P} select id_vehicle, ord, {', '.join(f"round(x + cos(yaw) * length * {a} / 2 - sin(yaw) * width * {b} / 2, 6) as x{i}, round(y + sin(yaw) * length * {a} / 2 + cos(yaw) * width * {b} / 2, 6) as y{i}" for i, (a, b) in enumerate([(1, -1), (1, 1), (-1, 1), (-1, -1)]))} from points""",
)
def bev_corners(spark, sf):
    c = geometry.bev_corners(*(F.col(n) for n in ("x", "y", "length", "width", "yaw")))
    out = views.points(spark, sf).select("id_vehicle", "ord", c.alias("c"))
    return out.select("id_vehicle", "ord", *(F.round(F.col("c").getItem(i).getField(k), 6).alias(f"{k}{i}") for i in range(4) for k in "xy"))


def _edge_sql(x1: float, y1: float, x2: float, y2: float) -> str:
    span = f"x between {min(x1, x2)} - 1e-9 and {max(x1, x2)} + 1e-9 and y between {min(y1, y2)} - 1e-9 and {max(y1, y2)} + 1e-9"
    return f"(abs(({x2} - {x1}) * (y - {y1}) - ({y2} - {y1}) * (x - {x1})) <= 1e-9 and {span})"


def _zone_sql(v: list[tuple[float, float]]) -> str:
    """Inside by the even-odd rule, and on no edge."""
    sides = [(*p, *q) for p, q in zip(v, v[1:] + v[:1], strict=True)]
    crossed = " + ".join(f"(case when ({y1} > y) <> ({y2} > y) and x < ({x2} - {x1}) * (y - {y1}) / ({y2} - {y1}) + {x1} then 1 else 0 end)" for x1, y1, x2, y2 in sides if y1 != y2)
    return f"(({crossed}) % 2 = 1 and not ({' or '.join(_edge_sql(*e) for e in sides)}))"


_INSIDE = " or ".join(_zone_sql(v) for _, _, v in views.ZONE_LIST)


@query("point_in_zone", f"with {P} select event_id from points where {_INSIDE}")
def point_in_zone(spark, sf):
    return interactions.in_zones(views.points(spark, sf), views.zones(spark)).select("event_id")


_AXES = "(greatest(abs({dx} * cos({yaw}) + {dy} * sin({yaw})) - ({l} + {ol} * abs(cos({t})) + {ow} * abs(sin({t}))) / 2, abs({dy} * cos({yaw}) - {dx} * sin({yaw})) - ({w} + {ol} * abs(sin({t})) + {ow} * abs(cos({t}))) / 2) < 0)"


def _sat(a: str, b: str) -> str:
    d = {"dx": f"({b}.x - {a}.x)", "dy": f"({b}.y - {a}.y)", "t": f"({b}.yaw - {a}.yaw)"}
    one = lambda p, q: _AXES.format(**d, yaw=f"{p}.yaw", l=f"{p}.length", w=f"{p}.width", ol=f"{q}.length", ow=f"{q}.width")
    return f"({one(a, b)} and {one(b, a)})"


_VRU = "('person', 'bicycle', 'e-scooter')"
_NEAR = f"""near as (select a.id_record, a.id_vehicle as a, b.id_vehicle as b, a.ord as ao, b.ord as bo, a.us as aus, b.us as bus, a.x as ax, a.y as ay, b.x as bx, b.y as by_,
        a.class_name as ac, b.class_name as bc, a.cluster as acl, b.cluster as bcl, a.yb as ayb, b.yb as byb, abs(a.us - b.us) as gap, {_sat('a', 'b')} as boxes
    from pts a join pts b on a.id_record = b.id_record and a.id_vehicle < b.id_vehicle and abs(a.us - b.us) <= {HOUR_US} and not (a.class_name in {_VRU} and b.class_name in {_VRU})
     and sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) <= (greatest(a.length, a.width, a.height) + greatest(b.length, b.width, b.height)) / 2)"""
_DAY = f"""{views.points_sql('%Y%m%d')}, pts as (select *, avg(yaw) over (partition by id_record, id_vehicle order by ord rows between 30 preceding and 1 preceding) as yb from points),
    slots as (select distinct id_record, id_vehicle, us // {HOUR_US} as slot from points),
    met as (select distinct s.id_record, s.id_vehicle as a, t.id_vehicle as b from slots s join slots t on s.id_record = t.id_record and s.slot = t.slot and s.id_vehicle < t.id_vehicle), {views.maneuvers_sql()}"""


def _day_sql(factor: float) -> str:
    """_DAY and _NEAR for vehicles `factor` times as long."""
    return f"{_DAY}, {_NEAR}".replace("pts as (select *,", f"pts as (select * replace (length * {factor} as length),", 1)


_TYPE = """case when known is null or known = 'Check individual' then (case when d > 45 then 'Crossing' when d < 45 and d > 15 then 'Merging' else 'Following' end) else known end"""


def _angle(p: str, q: str) -> str:
    return f"least(abs({p} - {q}), 2 * pi() - abs({p} - {q})) * 180 / pi()"


@query("sat_overlap", f"with {_DAY}, {_NEAR} select id_record, a, b, ao, bo from near where boxes")
def sat_overlap(spark, sf):
    pairs = near_frames(views.points(spark, sf, "yyyyMMdd"), band_us=HOUR_US, carry=("ord",), boxes=True)
    return pairs.select("id_record", F.col("a_id_vehicle").alias("a"), F.col("b_id_vehicle").alias("b"), F.col("a_ord").alias("ao"), F.col("b_ord").alias("bo"))


@query("pet_pairs_min", f"with {_DAY}, {_NEAR} select id_record, a, b, min(gap) as gap_us from near group by 1, 2, 3")
def pet_pairs_min(spark, sf):
    pairs = near_frames(views.points(spark, sf, "yyyyMMdd"), band_us=HOUR_US, pairs=True)
    return pairs.select("id_record", F.col("a_id_vehicle").alias("a"), F.col("b_id_vehicle").alias("b"), "gap_us")


_OUT = ["id_record", "us", "idVehicle1", "idVehicle2", "Vehicle_Class_1", "Vehicle_Class_2", "Vehicle_Cluster_1", "Vehicle_Cluster_2", "posX", "posY", "Value", "Auto_Type"]


def _conflict_sql(factor: float = 1.0) -> str:
    return f"""with {_day_sql(factor)},
    f as (select near.*, min(gap) over (partition by near.id_record, near.a, near.b) as least, row_number() over (partition by near.id_record, near.a, near.b order by ao, bo) as rn
          from near join met on near.id_record = met.id_record and near.a = met.a and near.b = met.b where boxes),
    g as (select *, aus > bus as late, {_angle('ayb', 'byb')} as d from f where rn = 1),
    h as (select *, case when late then a else b end as v1, case when late then b else a end as v2, case when late then ac else bc end as k1, case when late then bc else ac end as k2,
                 case when late then acl else bcl end as u1, case when late then bcl else acl end as u2 from g)
    select id_record, greatest(aus, bus) as us, v1 as "idVehicle1", v2 as "idVehicle2", k1 as "Vehicle_Class_1", k2 as "Vehicle_Class_2", u1 as "Vehicle_Cluster_1", u2 as "Vehicle_Cluster_2",
           round((ax + bx) / 2, 6) as "posX", round((ay + by_) / 2, 6) as "posY", round(least / 1e6, 6) as "Value", {_TYPE} as "Auto_Type"
    from h left join maneuvers on u1 = c1 and u2 = c2"""


@query("pet3d", _conflict_sql())
def pet3d(spark, sf):
    found = interactions.pet3d(views.points(spark, sf, "yyyyMMdd"), views.maneuvers(spark), threshold_s=3600, slot_us=HOUR_US)
    return r6(found.select(*_OUT), "posX", "posY", "Value")


@query(
    "pet2d",
    f"""with {_DAY}, s as (select *, lead(x) over w as x2, lead(y) over w as y2, lead(us) over w as us2 from pts window w as (partition by id_record, id_vehicle order by ord)),
    g as (select * from s where x2 is not null and (x2 <> x or y2 <> y)),
    c as (select a.id_record, a.id_vehicle as a, b.id_vehicle as b, a.ord as ao, b.ord as bo, a.us as aus, a.us2 as aus2, b.us as bus, b.us2 as bus2, a.x, a.y, a.x2, a.y2, a.class_name as ac, b.class_name as bc,
                 a.cluster as acl, b.cluster as bcl, a.yb as ayb, b.yb as byb, (a.x2 - a.x) * (b.y2 - b.y) - (a.y2 - a.y) * (b.x2 - b.x) as cr,
                 (b.x - a.x) * (b.y2 - b.y) - (b.y - a.y) * (b.x2 - b.x) as nf, (b.x - a.x) * (a.y2 - a.y) - (b.y - a.y) * (a.x2 - a.x) as ng
          from g a join g b on a.id_record = b.id_record and a.id_vehicle < b.id_vehicle and not (a.class_name in {_VRU} and b.class_name in {_VRU})),
    i as (select *, nf / cr as f, ng / cr as h from c where abs(cr) > 1e-9),
    j as (select i.*, aus + round_even(f * (aus2 - aus), 0)::bigint as ta, bus + round_even(h * (bus2 - bus), 0)::bigint as tb from i join met using (id_record, a, b) where f between 0 and 1 and h between 0 and 1),
    k as (select *, row_number() over (partition by id_record, a, b order by abs(ta - tb), ao, bo) as rn from j),
    l as (select *, ta <= tb as early, {_angle('ayb', 'byb')} as d from k where rn = 1 and abs(ta - tb) <= {HOUR_US}),
    m as (select *, case when early then a else b end as v1, case when early then b else a end as v2, case when early then ac else bc end as k1, case when early then bc else ac end as k2,
                 case when early then acl else bcl end as u1, case when early then bcl else acl end as u2 from l)
    select id_record, greatest(ta, tb) as us, v1 as "idVehicle1", v2 as "idVehicle2", k1 as "Vehicle_Class_1", k2 as "Vehicle_Class_2", u1 as "Vehicle_Cluster_1", u2 as "Vehicle_Cluster_2",
           round(x + f * (x2 - x), 6) as "posX", round(y + f * (y2 - y), 6) as "posY", round(abs(ta - tb) / 1e6, 6) as "Value", {_TYPE} as "Auto_Type"
    from m left join maneuvers on u1 = c1 and u2 = c2""",
)
def pet2d(spark, sf):
    found = interactions.pet2d(views.points(spark, sf, "yyyyMMdd"), views.maneuvers(spark), threshold_s=3600, slot_us=HOUR_US, cell=10.0)
    return r6(found.select(*_OUT), "posX", "posY", "Value")


@query("world_to_pixel", f"""with {P}, c as (select id_vehicle, ord, (x - 20) / (30 + z) as u, (y - 50) / (30 + z) as v from points), d as (select *, u * u + v * v as r2 from c)
    select id_vehicle, ord, round(800 * (u * (1 + r2 * (0.01 + r2 * 0.001)) + 2 * 0.0005 * u * v + 0.0002 * (r2 + 2 * u * u)) + 640, 4) as px,
           round(800 * (v * (1 + r2 * (0.01 + r2 * 0.001)) + 0.0005 * (r2 + 2 * v * v) + 2 * 0.0002 * u * v) + 360, 4) as py from d""")
def world_to_pixel(spark, sf):
    ext = [[1, 0, 0, -20], [0, 1, 0, -50], [0, 0, 1, 30], [0, 0, 0, 1]]
    px, py = camera.world_to_pixel(F.col("x"), F.col("y"), F.col("z"), ext, [[800, 0, 640], [0, 800, 360], [0, 0, 1]], (0.01, 0.001, 0.0005, 0.0002, 0.0))
    return views.points(spark, sf).select("id_vehicle", "ord", F.round(px, 4).alias("px"), F.round(py, 4).alias("py"))


# ---- clusters --------------------------------------------------------------------------------------------------

EPS = 70.0


def _keyed(spark, sf):
    return tracks.key_points(views.points(spark, sf)).select(F.col("id_vehicle").alias("id"), "points")


_CHEB = "greatest(" + ", ".join(f"sqrt((a.p{i}.x - b.p{i}.x) ** 2 + (a.p{i}.y - b.p{i}.y) ** 2 + (a.p{i}.z - b.p{i}.z) ** 2)" for i in range(5)) + ")"
_CLUSTER = f"""{P}, {_SHARE}, near as (select a.id_vehicle as i, b.id_vehicle as j from keyed a join keyed b on a.id_vehicle <> b.id_vehicle where {_CHEB} <= {EPS}),
    deg as (select id_vehicle as id, 1 + (select count(*) from near where i = id_vehicle) as degree from keyed)"""


@query("keypoint_neighbours", f"with {_CLUSTER} select i, j from near")
def keypoint_neighbours(spark, sf):
    return clustering.neighbours(_keyed(spark, sf), EPS)


@query("dbscan_core", f"with {_CLUSTER} select id, degree, degree >= 5 as core from deg")
def dbscan_core(spark, sf):
    return clustering.core_tracks(_keyed(spark, sf), EPS, 5)


@query(
    "dbscan_labels",
    f"""with recursive {_CLUSTER}, core as (select id from deg where degree >= 5), e as (select i, j from near where i in (from core) and j in (from core)),
    r as (select id as node, id as seen from core union select r.node, e.j from r join e on r.seen = e.i),
    root as (select node, min(seen) as root from r group by 1), lab as (select node, dense_rank() over (order by root) - 1 as label from root),
    border as (select i as node, min(label) as label from near join lab on j = node where i not in (from core) group by 1)
    select id, coalesce(lab.label, border.label, -1)::int as label from deg left join lab on id = lab.node left join border on id = border.node""",
)
def dbscan_labels(spark, sf):
    return clustering.dbscan_tracks(store(_keyed(spark, sf), "keyed"), EPS, 5)


@query(
    "cluster_means",
    f"""with {P}, {_SHARE}, u as (select id_vehicle % 3 as label, unnest([{', '.join(f'struct_pack(k := {i}, p := p{i})' for i in range(5))}]) as s from keyed)
    select label::int as label, s.k as k, round(avg(s.p.x), 6) as x, round(avg(s.p.y), 6) as y, count(*) as size from u group by 1, 2""",
)
def cluster_means(spark, sf):
    keyed = _keyed(spark, sf)
    return r6(clustering.cluster_means(keyed, keyed.select("id", (F.col("id") % 3).cast("int").alias("label"))).drop("z"), "x", "y")


def _curves(spark, sf, keyed: DataFrame | None = None) -> DataFrame:
    """Curves of the clusters that DBSCAN finds among all tracks, after merging; there are none where no cluster is."""
    keyed = store(_keyed(spark, sf), "keyed") if keyed is None else keyed
    labels = clustering.dbscan_tracks(keyed, EPS, 5)
    return store(clustering.merge_means(clustering.cluster_means(keyed, labels), most=10.0, total=40.0), "curves")


@query("curve_distance_assign")
def curve_distance_assign(spark, sf):
    keyed = store(_keyed(spark, sf), "keyed")
    return r6(clustering.assign(keyed, _curves(spark, sf, keyed), total=200.0, most=60.0).drop("most"), "total")


# ---- the same on tracks that cluster: vehicles on lanes

LANE_EPS = 12.0
_LANES = f"""{views.LANE_SQL}, {_SHARE}, near as (select a.id_vehicle as i, b.id_vehicle as j from keyed a join keyed b on a.id_vehicle <> b.id_vehicle where {_CHEB} <= {LANE_EPS}),
    deg as (select id_vehicle as id, 1 + (select count(*) from near where i = id_vehicle) as degree from keyed)"""
_LABELS = f"""{_LANES}, core as (select id from deg where degree >= 5), e as (select i, j from near where i in (from core) and j in (from core)),
    r as (select id as node, id as seen from core union select r.node, e.j from r join e on r.seen = e.i),
    root as (select node, min(seen) as root from r group by 1), lab as (select node, dense_rank() over (order by root) - 1 as label from root),
    border as (select i as node, min(label) as label from near join lab on j = node where i not in (from core) group by 1),
    labels as (select id, coalesce(lab.label, border.label, -1)::int as label from deg left join lab on id = lab.node left join border on id = border.node)"""


def _lanes(spark, sf):
    """Key points of the tracks on lanes, and their clusters."""
    keyed = store(tracks.key_points(views.lane_points(spark, sf)).select(F.col("id_vehicle").alias("id"), "points"), "keyed")
    return keyed, store(clustering.dbscan_tracks(keyed, LANE_EPS, 5), "labels")


def _lane_curves(spark, sf):
    keyed, labels = _lanes(spark, sf)
    return keyed, store(clustering.fitted_curves(clustering.cluster_means(keyed, labels)), "curves")


@query("lane_clusters", f"with recursive {_LABELS} select id, label from labels")
def lane_clusters(spark, sf):
    return _lanes(spark, sf)[1]


def _lane_curves_sql() -> str:
    """The normal equations of a quadratic through five means, by their sums over t = 0 .. 4."""
    fit = "{c}2 := (7 * s2 - 28 * s1 + 14 * s0) / 98, {c}1 := (-140 * s2 + 609 * s1 - 378 * s0) / 490, {c}0 := (70 * s2 - 378 * s1 + 434 * s0) / 490"
    one = lambda c: f"(select struct_pack({fit.format(c=c)}) from (select sum(v) as s0, sum(k * v) as s1, sum(k * k * v) as s2 from (select unnest([m0{c}, m1{c}, m2{c}, m3{c}, m4{c}]) as v, unnest([0, 1, 2, 3, 4]) as k))) as f{c}"
    means = ", ".join(f"avg(p{i}.{c}) as m{i}{c}" for i in range(5) for c in "xy")
    return f"means as (select label, {means} from keyed join labels on id = id_vehicle where label >= 0 group by 1), curves as (select label, {one('x')}, {one('y')} from means)"


@query(
    "lane_assign",
    # the least distance by a grid of t and golden sections around its best place
    f"""with recursive {_LABELS}, {_lane_curves_sql()},
    pairs as (select id_vehicle as id, label, fx, fy, unnest([p0, p1, p2, p3, p4]) as p, unnest([0, 1, 2, 3, 4]) as k from keyed, curves),
    grid as (select *, list_min(list_transform(range(0, 161), lambda i: {{'d': (fx.x0 + fx.x1 * (i / 20 - 2) + fx.x2 * (i / 20 - 2) ** 2 - p.x) ** 2 + (fy.y0 + fy.y1 * (i / 20 - 2) + fy.y2 * (i / 20 - 2) ** 2 - p.y) ** 2, 't': i / 20 - 2}})).t as t from pairs),
    fine as (select *, 0 as turn, greatest(t - 0.05, -2) as lo, least(t + 0.05, 6) as hi from grid union all
             select id, label, fx, fy, p, k, t, turn + 1, case when dl < dh then lo else a end, case when dl < dh then b else hi end
             from (select *, (fx.x0 + fx.x1 * a + fx.x2 * a * a - p.x) ** 2 + (fy.y0 + fy.y1 * a + fy.y2 * a * a - p.y) ** 2 as dl, (fx.x0 + fx.x1 * b + fx.x2 * b * b - p.x) ** 2 + (fy.y0 + fy.y1 * b + fy.y2 * b * b - p.y) ** 2 as dh
                   from (select *, lo + (hi - lo) / 3 as a, hi - (hi - lo) / 3 as b from fine where turn < 40))),
    d as (select id, label, k, fx, fy, p, sqrt((fx.x0 + fx.x1 * lo + fx.x2 * lo * lo - p.x) ** 2 + (fy.y0 + fy.y1 * lo + fy.y2 * lo * lo - p.y) ** 2) as d from fine where turn = 40),
    s as (select id, label, sum(d) as total, max(d) as most,
                 sqrt(max((p.x - fx.x0) ** 2 + (p.y - fy.y0) ** 2) filter (k = 4)) < sqrt(max((p.x - fx.x0) ** 2 + (p.y - fy.y0) ** 2) filter (k = 0)) as back from d group by 1, 2),
    best as (select * from s qualify row_number() over (partition by id order by total, label) = 1)
    select id, (case when total < 10 or most <= 3 then label + case when back then (select count(*) from curves) else 0 end else -1 end)::int as cluster, round(total, 3) as total from best""",
)
def lane_assign(spark, sf):
    keyed, curves = _lane_curves(spark, sf)
    found = clustering.assign(keyed, curves).select("id", "cluster", F.round("total", 3).alias("total"))
    return found.withColumn("cluster", F.col("cluster").cast("int"))


# held against plain loops on the whole table by tests/test_barycentre.py
@query("lane_barycentres")
def lane_barycentres(spark, sf):
    labels = _lanes(spark, sf)[1]
    found = barycentre.barycentres(views.lane_points(spark, sf), labels.select(F.col("id").alias("id_vehicle"), "label"))
    return found.select("label", "place", *(F.round(c, 4).alias(c) for c in ("x", "y", "cost")))


@query("lane_maneuvers")
def lane_maneuvers(spark, sf):
    return clustering.classify_maneuvers(_lane_curves(spark, sf)[1])


@query("maneuver_classify")
def maneuver_classify(spark, sf):
    return clustering.classify_maneuvers(_curves(spark, sf))


@query("cluster_merge")
def cluster_merge(spark, sf):
    keyed = _keyed(spark, sf)
    means = clustering.cluster_means(keyed, keyed.select("id", (F.col("id") % 8).cast("int").alias("label")))
    return clustering.merge_means(means, most=10.0, total=40.0)


# ---- anomalies -------------------------------------------------------------------------------------------------


def _vectors(spark, sf):
    return views.read(spark, sf, "embeddings").select(F.col("label").alias("grp"), F.col("vec_id").alias("id"), "embedding")


_KNN = """v as (select label as grp, vec_id as id, embedding::double[] as e from embeddings), u as (select grp, id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) as e from v),
    d as (select a.grp, a.id, b.id as other, round(1 - list_dot_product(a.e, b.e), 12) as d from u a join u b on a.grp = b.grp and a.id <> b.id),
    knn as (select *, row_number() over (partition by grp, id order by d, other) as rank from d qualify rank <= 20)"""
_LOF = f"""{_KNN}, kd as (select grp, id, max(d) as kd from knn group by 1, 2),
    lrd as (select knn.grp, knn.id, 1 / (avg(greatest(d, kd)) + 1e-10) as lrd from knn join kd on kd.grp = knn.grp and kd.id = other group by 1, 2),
    lof as (select knn.grp, knn.id, avg(o.lrd) / any_value(m.lrd) as lof from knn join lrd o on o.grp = knn.grp and o.id = other join lrd m on m.grp = knn.grp and m.id = knn.id group by 1, 2)"""


@query("knn_cosine", f"with {_KNN} select grp, id, other, round(d, 6) as d, rank from knn where rank <= 5")
def knn_cosine(spark, sf):
    return r6(anomaly.knn(_vectors(spark, sf), 20).filter("rank <= 5"), "d")


@query("lof_scores", f"with {_LOF} select grp, id, round(lof, 6) as lof, lof > 1.05 as is_anomaly from lof")
def lof_scores(spark, sf):
    return r6(anomaly.local_outlier_factor(_vectors(spark, sf), 20, 1.05), "lof")


@query(
    "lof_writeback",
    f"""with {C}, s as (select idVehicle1 as v, Vehicle_Cluster_1 as c, Vehicle_Cluster_2 as o, idRecord as r, max(LOF2) as lof from conflicts group by 1, 2, 3, 4)
    select idRecord, count(*) as n, count(*) filter (s1.lof is not null) as set1, count(*) filter (s2.lof is not null) as set2,
           round(sum(coalesce(s1.lof, LOF1)), 4) as lof1, round(sum(coalesce(s2.lof, LOF2)), 4) as lof2
    from conflicts left join s s1 on idRecord = s1.r and idVehicle1 = s1.v and Vehicle_Cluster_1 = s1.c and Vehicle_Cluster_2 = s1.o
         left join s s2 on idRecord = s2.r and idVehicle2 = s2.v and Vehicle_Cluster_2 = s2.c and Vehicle_Cluster_1 = s2.o group by 1""",
)
def lof_writeback(spark, sf):
    all_ = views.conflicts(spark, sf)
    scores = all_.groupBy(F.col("idRecord").alias("id_record"), F.col("idVehicle1").alias("id_vehicle"), F.col("Vehicle_Cluster_1").alias("cluster"), F.col("Vehicle_Cluster_2").alias("conflicting_cluster")).agg(F.max("LOF2").alias("lof"))
    out = anomaly.write_scores(all_, scores.withColumn("is_anomaly", F.col("lof") > 1.5))
    n = lambda c: F.sum(F.col(c).isNotNull().cast("long"))
    return out.groupBy("idRecord").agg(F.count(F.lit(1)).alias("n"), n("is_anomaly1").alias("set1"), n("is_anomaly2").alias("set2"), F.round(F.sum("LOF1"), 4).alias("lof1"), F.round(F.sum("LOF2"), 4).alias("lof2"))


@query(
    "score_groups",
    f"""with {C}, ok as (select * from conflicts where Vehicle_Cluster_1 <> -1 and Vehicle_Cluster_2 <> -1 and Vehicle_Cluster_1 <> Vehicle_Cluster_2),
    v as (select least(Vehicle_Cluster_1, Vehicle_Cluster_2) as c_a, greatest(Vehicle_Cluster_1, Vehicle_Cluster_2) as c_b, Vehicle_Cluster_1 as cluster, Vehicle_Class_1 as class_name,
                 idRecord as r, idVehicle1 as v, not coalesce(Auto_Rule_Flag, true) as broke from ok
          union all
          select least(Vehicle_Cluster_1, Vehicle_Cluster_2), greatest(Vehicle_Cluster_1, Vehicle_Cluster_2), Vehicle_Cluster_2, Vehicle_Class_2, idRecord, idVehicle2, not coalesce(Auto_Rule_Flag, true) from ok),
    w as (select *, sum(broke::int) over g as n_broke, count(*) over g as n_all from v window g as (partition by c_a, c_b, cluster, class_name))
    select c_a, c_b, cluster, class_name, count(distinct (r, v)) as n from w where (n_broke > 20 and broke) or (n_broke <= 20 and n_all > 20) group by 1, 2, 3, 4""",
)
def score_groups(spark, sf):
    found = anomaly.score_groups(views.conflicts(spark, sf))
    return found.groupBy("c_a", "c_b", "cluster", "class_name").agg(F.count(F.lit(1)).alias("n"))


def _embedding_sql() -> str:
    return ", ".join(f"round(coalesce(max(case when part = {i} then d{c} end), 0), 6) + 0.0 as e{2 * i + k}" for i in range(20) for k, c in enumerate("xy"))


@query(
    "motion_embeddings",
    f"""with {P}, e as (select *, x - first_value(x) {W} as ex, y - first_value(y) {W} as ey, -first_value(yaw) {W} as a, count(*) over (partition by id_record, id_vehicle) as n from points),
    r as (select *, cos(a) * ex - sin(a) * ey as rx, sin(a) * ex + cos(a) * ey as ry from e),
    d as (select id_record, id_vehicle, floor(ord * 20 / n) as part, coalesce(rx - lag(rx) {W}, 0) as dx, coalesce(ry - lag(ry) {W}, 0) as dy from r),
    m as (select id_record, id_vehicle, part, avg(dx) as dx, avg(dy) as dy from d group by 1, 2, 3)
    select id_vehicle, {_embedding_sql()} from m group by id_record, id_vehicle""",
)
def motion_embeddings(spark, sf):
    found = anomaly.motion_features(views.points(spark, sf))
    cols = [f"e{i}" for i in range(40)]
    return r6(found.select("id_vehicle", *(F.get("embedding", F.lit(i)).alias(c) for i, c in enumerate(cols))), *cols)


# ---- detections ------------------------------------------------------------------------------------------------


_BOX = f"struct_pack({', '.join(f'{c} := r.{c}' for c in ('frame_id', 'det_id', 'cls', 'conf', 'x1', 'y1', 'x2', 'y2'))})"
_SHARED = "greatest(0, least(k.x2, r.x2) - greatest(k.x1, r.x1)) * greatest(0, least(k.y2, r.y2) - greatest(k.y1, r.y1))"


@query(
    "nms",
    f"""with recursive {views.BOXES_SQL}, r as (select *, row_number() over (partition by frame_id, cls order by conf desc, det_id, x1, y1, x2, y2) as rn from boxes where conf > 0.25),
    s as (select frame_id, cls, rn, [{_BOX}] as kept from r where rn = 1
          union all
          select r.frame_id, r.cls, r.rn,
                 case when len(list_filter(s.kept, lambda k: {_SHARED} > 0.45 * ((k.x2 - k.x1) * (k.y2 - k.y1) + (r.x2 - r.x1) * (r.y2 - r.y1) - {_SHARED}))) = 0
                      then list_append(s.kept, {_BOX}) else s.kept end
          from s join r on r.frame_id = s.frame_id and r.cls = s.cls and r.rn = s.rn + 1),
    f as (select unnest(arg_max(kept, rn)) as b from s group by frame_id, cls)
    select b.* from f""",
)
def nms(spark, sf):
    return detections.suppress(views.boxes(spark, sf), iou=0.45)


_JUDGED = f"{views.BOXES_SQL}, judged as (select cls, round(conf, 6) as conf, det_id, (det_id * 7) % 10 < 6 as tp from boxes), truth as (select cls, count(*) + 500 as n_truth from judged where tp group by 1)"


def _judged(spark, sf):
    judged = views.boxes(spark, sf).select("cls", F.round("conf", 6).alias("conf"), "det_id", ((F.col("det_id") * 7) % 10 < 6).alias("tp"))
    return judged, judged.filter("tp").groupBy("cls").agg((F.count(F.lit(1)) + 500).alias("n_truth"))


@query(
    "precision_recall",
    f"""with {_JUDGED} select judged.cls, det_id, round(sum(tp::int) over w / count(*) over w, 6) as precision, round(sum(tp::int) over w / n_truth, 6) as recall
    from judged join truth on judged.cls = truth.cls window w as (partition by judged.cls order by conf desc, det_id rows unbounded preceding)""",
)
def precision_recall(spark, sf):
    return r6(detections.precision_recall(*_judged(spark, sf)).select("cls", "det_id", "precision", "recall"), "precision", "recall")


@query(
    "ap_per_class",
    f"""with {_JUDGED}, pr as (select judged.cls, conf, det_id, sum(tp::int) over w / count(*) over w as p, sum(tp::int) over w / n_truth as r
        from judged join truth on judged.cls = truth.cls window w as (partition by judged.cls order by conf desc, det_id rows unbounded preceding)),
    env as (select cls, r, max(p) over (partition by cls order by conf, det_id desc rows unbounded preceding) as e from pr), c as (select cls, r, max(e) as e from env group by 1, 2),
    k as (select cls, unnest(range(0, 101)) as k from truth),
    v as (select k.cls, k.k, max(struct_pack(r := c.r, e := c.e)) filter (c.r <= k.k / 100.0::double) as lo, min(struct_pack(r := c.r, e := c.e)) filter (c.r > k.k / 100.0::double) as hi from k left join c on c.cls = k.cls group by 1, 2),
    x as (select cls, k, case when hi is null then case when lo.r = k / 100.0::double then lo.e else 0 end
                 else coalesce(lo.e, 1) + (hi.e - coalesce(lo.e, 1)) * (k / 100.0::double - coalesce(lo.r, 0)) / (hi.r - coalesce(lo.r, 0)) end as y from v)
    select cls, round(sum(y * case when k in (0, 100) then 0.5 else 1 end) / 100, 6) as ap from x group by 1""",
)
def ap_per_class(spark, sf):
    return r6(detections.average_precision(*_judged(spark, sf)), "ap")


def _box_sql(rest: str) -> str:
    """SQL after pr: precision p and recall r at the n-th detection of a class."""
    return f"""with {_JUDGED}, pr as (select judged.cls, conf, sum(tp::int) over w / count(*) over w as p, sum(tp::int) over w / n_truth as r, count(*) over w as n
        from judged join truth on judged.cls = truth.cls window w as (partition by judged.cls order by conf desc, det_id rows unbounded preceding)), {rest}"""


def _truth(spark, sf):
    found = views.boxes(spark, sf)
    moved = found.filter("det_id % 4 <> 0")
    return moved.select("frame_id", F.col("det_id").alias("truth_id"), ((F.col("cls") + (F.col("det_id") % 5 == 0).cast("int")) % 3).alias("t_cls"), (F.col("x1") + 3).alias("t_x1"), (F.col("y1") + 2).alias("t_y1"), (F.col("x2") + 3).alias("t_x2"), (F.col("y2") + 2).alias("t_y2"))


@query(
    "confusion_matrix",
    f"""with {views.BOXES_SQL}, good as (select * from boxes where conf > 0.25),
    truth as (select frame_id, det_id as truth_id, (cls + (det_id % 5 = 0)::int) % 3 as t_cls, x1 + 3 as u1, y1 + 2 as w1, x2 + 3 as u2, y2 + 2 as w2 from boxes where det_id % 4 <> 0),
    i as (select g.frame_id, det_id, cls, truth_id, t_cls, greatest(0, least(x2, u2) - greatest(x1, u1)) * greatest(0, least(y2, w2) - greatest(y1, w1)) as inter, (x2 - x1) * (y2 - y1) + (u2 - u1) * (w2 - w1) as both_
          from good g join truth t on g.frame_id = t.frame_id),
    p as (select *, inter / (both_ - inter) as iou from i where inter / (both_ - inter) > 0.45),
    q as (select * from p qualify row_number() over (partition by frame_id, det_id order by iou desc, truth_id) = 1),
    r as (select * from q qualify row_number() over (partition by frame_id, truth_id order by iou desc, det_id) = 1),
    a as (select cls, t_cls from r union all select null, t_cls from truth t where not exists (select 1 from r where r.frame_id = t.frame_id and r.truth_id = t.truth_id)
          union all select cls, null from good g where not exists (select 1 from r where r.frame_id = g.frame_id and r.det_id = g.det_id))
    select cls, t_cls, count(*) as n from a group by 1, 2""",
)
def confusion_matrix(spark, sf):
    return detections.confusion(views.boxes(spark, sf), _truth(spark, sf))


@query(
    "iou_family",
    f"""with {views.BOXES_SQL}, a as (select det_id, x1, y1, x2, y2, x1 + 5 as u1, y1 + 7 as w1, x1 + 45 as u2, y1 + 50 as w2 from boxes),
    b as (select *, greatest(0, least(x2, u2) - greatest(x1, u1)) * greatest(0, least(y2, w2) - greatest(y1, w1)) as i, (x2 - x1) * (y2 - y1) as s, (u2 - u1) * (w2 - w1) as t, greatest(x2, u2) - least(x1, u1) as hw, greatest(y2, w2) - least(y1, w1) as hh from a),
    c as (select *, i / (s + t - i) as iou, (((x1 + x2 - u1 - u2) / 2) ** 2 + ((y1 + y2 - w1 - w2) / 2) ** 2) / (hw * hw + hh * hh) as far, 4 / pi() ** 2 * (atan((u2 - u1) / (w2 - w1)) - atan((x2 - x1) / (y2 - y1))) ** 2 as v from b)
    select det_id, round(iou, 6) as iou, round(i / t, 6) as ioa, round(iou - (hw * hh - (s + t - i)) / (hw * hh), 6) as giou, round(iou - far, 6) as diou, round(iou - far - case when v > 0 then v * v / (v - iou + 1) else 0 end, 6) as ciou from c""",
)
def iou_family(spark, sf):
    a = tuple(F.col(c) for c in ("x1", "y1", "x2", "y2"))
    b = (a[0] + 5, a[1] + 7, a[0] + 45, a[1] + 50)
    f = box_functions
    named = {"iou": f.iou(a, b), "ioa": f.over_second(a, b), "giou": f.giou(a, b), "diou": f.diou(a, b), "ciou": f.ciou(a, b)}
    return views.boxes(spark, sf).select("det_id", *(F.round(c, 6).alias(n) for n, c in named.items()))


@query("class_weights", f"with {views.BOXES_SQL}, n as (select cls, count(*) as n from boxes group by 1) select cls, n, round((1 / n) / sum(1 / n) over (), 6) as weight from n")
def class_weights(spark, sf):
    return r6(detections.class_weights(views.boxes(spark, sf)), "weight")


@query(
    "box_candidates",
    f"""with {views.BOXES_SQL}, c as (select *, least(x2, 450) - x1 as w, least(y2, 380) - y1 as h from boxes)
    select det_id, w > 2 and h > 2 and w * h / ((x2 - x1) * (y2 - y1) + 1e-16) > 0.1 and greatest(w / (h + 1e-16), h / (w + 1e-16)) < 20 as usable from c""",
)
def box_candidates(spark, sf):
    before = tuple(F.col(c) for c in ("x1", "y1", "x2", "y2"))
    after = (before[0], before[1], F.least(before[2], F.lit(450.0)), F.least(before[3], F.lit(380.0)))
    return views.boxes(spark, sf).select("det_id", box_functions.still_usable(before, after).alias("usable"))


@query(
    "letterbox_sizes",
    f"""with {views.BOXES_SQL}, g as (select det_id, x2 + 100 as w, y2 + 50 as h, least(640 / (x2 + 100), 640 / (y2 + 50)) as gain from boxes)
    select det_id, round(gain, 6) as gain, ((640 - round_even(w * gain, 0)::int) % 32) / 2 as pad_x, ((640 - round_even(h * gain, 0)::int) % 32) / 2 as pad_y from g""",
)
def letterbox_sizes(spark, sf):
    sized = box_functions.letterbox(F.col("x2") + 100, F.col("y2") + 50)
    return r6(views.boxes(spark, sf).select("det_id", *(c.alias(n) for n, c in sized.items())), "gain")


_ANCHORS = [(30, 60), (50, 50), (10, 13), (64, 80)]


@query(
    "anchor_recall",
    f"""with {views.BOXES_SQL}, r as (select [{', '.join(f'least((x2 - x1) / {w}, {w} / (x2 - x1), (y2 - y1) / {h}, {h} / (y2 - y1))' for w, h in _ANCHORS)}] as r from boxes)
    select round(avg((list_max(r) > 1 / 1.3)::int), 6) as recall, round(avg(len(list_filter(r, lambda v: v > 1 / 1.3))), 6) as anchors_above, count(*) as boxes from r""",
)
def anchor_recall(spark, sf):
    sizes = views.boxes(spark, sf).select((F.col("x2") - F.col("x1")).alias("w"), (F.col("y2") - F.col("y1")).alias("h"))
    return r6(detections.anchor_recall(sizes, _ANCHORS, 1.3), "recall", "anchors_above")


# ---- shapes of tracks ------------------------------------------------------------------------------------------


def _gradient_sql(c: str) -> str:
    return f"case when lag({c}) {W} is null then lead({c}) {W} - {c} when lead({c}) {W} is null then {c} - lag({c}) {W} else (lead({c}) {W} - lag({c}) {W}) / 2 end"


@query(
    "curvature",
    f"""with {P}, g as (select *, {_gradient_sql('x')} as gx, {_gradient_sql('y')} as gy from points), h as (select *, {_gradient_sql('gx')} as ggx, {_gradient_sql('gy')} as ggy from g)
    select id_vehicle, ord, round(abs(gx * ggy - gy * ggx) / nullif((gx * gx + gy * gy) ** 1.5, 0), 6) as curvature from h""",
)
def curvature(spark, sf):
    return r6(shapes.curvature(views.points(spark, sf)).select("id_vehicle", "ord", "curvature"), "curvature")


@query(
    "gaussian_smooth",
    f"""with {P}, {_STEPS}, i as (select id_record, id_vehicle, quantile_cont(step, 0.75) - quantile_cont(step, 0.25) as iqr from steps where ord > 0 group by 1, 2),
    s as (select points.*, least(5, greatest(0.5, coalesce(0.05 * iqr, 0.5)))::double as sigma, count(*) over (partition by points.id_record, points.id_vehicle) as n
          from points left join i on points.id_record = i.id_record and points.id_vehicle = i.id_vehicle),
    k as (select *, unnest(range(-floor(4 * sigma + 0.5)::bigint, floor(4 * sigma + 0.5)::bigint + 1)) as k from s),
    m as (select *, exp(-(k * k) / (2 * sigma * sigma)) as w, ((ord + k) % (2 * n) + 2 * n) % (2 * n) as j from k)
    select m.id_vehicle, m.ord, round(any_value(sigma), 6) as sigma, round(sum(w * q.x) / sum(w), 6) as x_smooth, round(sum(w * q.y) / sum(w), 6) as y_smooth
    from m join points q on q.id_record = m.id_record and q.id_vehicle = m.id_vehicle and q.ord = case when j < n then j else 2 * n - 1 - j end
    group by m.id_record, m.id_vehicle, m.ord""",
)
def gaussian_smooth(spark, sf):
    return r6(shapes.gaussian_smooth(views.points(spark, sf), share=0.05).drop("id_record"), "sigma", "x_smooth", "y_smooth")


@query(
    "distance_segments",
    f"""with recursive {P}, {_STEPS},
    s as (select id_record, id_vehicle, ord, 0.0::double as way, 1 as n, 0 as segment from steps where ord = 0
          union all
          select t.id_record, t.id_vehicle, t.ord, case when s.way + t.step > 400 and s.n >= 6 then 0 else s.way + t.step end,
                 case when s.way + t.step > 400 and s.n >= 6 then 1 else s.n + 1 end, s.segment + (s.way + t.step > 400 and s.n >= 6)::int
          from s join steps t on t.id_record = s.id_record and t.id_vehicle = s.id_vehicle and t.ord = s.ord + 1)
    select id_vehicle, segment, count(*) as frames, min(ord) as first_ord from s group by id_record, id_vehicle, segment having count(*) >= 6""",
)
def distance_segments(spark, sf):
    cut = shapes.distance_segments(views.points(spark, sf), distance=400.0)
    return cut.groupBy("id_record", "id_vehicle", "segment").agg(F.count(F.lit(1)).alias("frames"), F.min("ord").alias("first_ord")).drop("id_record")


@query(
    "angle_segments",
    f"""with recursive {P}, d as (select *, x - lag(x) {W} as bx, y - lag(y) {W} as by_, lag(x) {W} - lag(x, 2) {W} as ax, lag(y) {W} - lag(y, 2) {W} as ay from points),
    t as (select *, case when sqrt(ax * ax + ay * ay) * sqrt(bx * bx + by_ * by_) > 0
          then degrees(acos(greatest(-1, least(1, (ax * bx + ay * by_) / (sqrt(ax * ax + ay * ay) * sqrt(bx * bx + by_ * by_)))))) else 0 end as turn from d),
    s as (select id_record, id_vehicle, ord, 1 as n, 0 as segment from t where ord = 0
          union all
          select t.id_record, t.id_vehicle, t.ord, case when t.ord > 1 and t.turn > 100.5 and s.n >= 5 then 2 else s.n + 1 end, s.segment + (t.ord > 1 and t.turn > 100.5 and s.n >= 5)::int
          from s join t on t.id_record = s.id_record and t.id_vehicle = s.id_vehicle and t.ord = s.ord + 1)
    select id_vehicle, segment, count(*) as frames, case when segment > 0 then min(ord) - 1 end as lead_ord from s
    group by id_record, id_vehicle, segment having count(*) + (segment > 0)::int >= 5""",
)
def angle_segments(spark, sf):
    cut = shapes.angle_segments(views.points(spark, sf), degrees=100.5)
    return cut.groupBy("id_record", "id_vehicle", "segment").agg(F.count(F.lit(1)).alias("frames"), F.max("lead_ord").alias("lead_ord")).drop("id_record")


@query(
    "border_trim",
    f"""with {P}, {_STEPS}, a as (select *, sum(step) over (partition by id_record, id_vehicle order by ord) as arc, sum(step) over (partition by id_record, id_vehicle) as total from steps),
    b as (select *, min(ord) filter (arc > 200) over (partition by id_record, id_vehicle) as lo, max(ord) filter (arc < total - 200) over (partition by id_record, id_vehicle) as hi from a)
    select id_vehicle, ord, x, y from b where ord between lo and hi""",
)
def border_trim(spark, sf):
    return shapes.trim_borders(views.points(spark, sf), 200.0).select("id_vehicle", "ord", "x", "y")


@query(
    "banned_tracks",
    f"""with {P}, {_STEPS}, a as (select *, row_number() {W} as nth, sum(step) over (partition by id_record, id_vehicle order by ord) as arc, coalesce(lag(detected, 9) {W}, false) as was,
        sqrt((x - first_value(x) {W}) ** 2 + (y - first_value(y) {W}) ** 2) as net from steps)
    select id_vehicle, ord, bool_or((nth between 11 and 29 and (not (detected and was) or arc < 500)) or (nth = 40 and net < 60)) over (partition by id_record, id_vehicle order by ord) as banned from a""",
)
def banned_tracks(spark, sf):
    pts = views.points(spark, sf).withColumn("valid", F.col("detected"))
    near = shapes.banned(pts, least=500.0, at=-1).select("id_record", "id_vehicle", "ord", F.col("banned").alias("early"))
    far = shapes.banned(pts, early=(0, -1), at=40, least=60.0).select("id_record", "id_vehicle", "ord", F.col("banned").alias("late"))
    return near.join(far, ["id_record", "id_vehicle", "ord"]).select("id_vehicle", "ord", (F.col("early") | F.col("late")).alias("banned"))


@query("extents", f"with {P} select id_record, min(x) as x_min, max(x) as x_max, min(y) as y_min, max(y) as y_max, min(z) as z_min, max(z) as z_max from points group by 1")
def extents(spark, sf):
    return shapes.extents(views.points(spark, sf))


@query(
    "active_tracks",
    f"""with {P}, asked as (select distinct id_record, us from points)
    select points.id_record, us as ask_us, id_vehicle, x, y, ord + 1 as history from asked join points using (id_record, us)""",
)
def active_tracks(spark, sf):
    pts = views.points(spark, sf)
    asked = pts.select("id_record", F.col("us").alias("ask_us"))
    return shapes.active_at(pts, asked).select("id_record", "ask_us", "id_vehicle", "x", "y", "history")


@query(
    "manual_split",
    f"""with {P}, c(k, lo, hi) as (values (0, 2, 6), (2, 7, 12)), top as (select id_record, max(id_vehicle) as top from points group by 1),
    v as (select distinct id_record, id_vehicle from points where id_vehicle % 5 = 0),
    e as (select v.*, lo, hi, row_number() over (partition by id_record order by id_vehicle, k) as n from v cross join c)
    select points.id_vehicle, top + n as new_vehicle, ord, x, y from points join e on points.id_record = e.id_record and points.id_vehicle = e.id_vehicle and ord between lo and hi
    join top on top.id_record = points.id_record""",
)
def manual_split(spark, sf):
    pts = views.points(spark, sf)
    cuts = pts.filter("id_vehicle % 5 = 0").select("id_record", "id_vehicle").distinct().withColumn("at", F.array(*(F.lit(v).cast("long") for v in (2, 6, 7, 12))))
    return shapes.split_tracks(pts, cuts).select("id_vehicle", "new_vehicle", "ord", "x", "y")


@query(
    "stride_rows",
    f"""with {P}, n as (select *, ceil(count(*) over (partition by id_record, id_vehicle) / 7) as stride from points)
    select id_vehicle, ord, x, y from n where ord % stride = 0 and ord < stride * 7""",
)
def stride_rows(spark, sf):
    return shapes.strided(views.points(spark, sf), 7).select("id_vehicle", "ord", "x", "y")


@query(
    "step_scale",
    f"""with {P}, d as (select id_record, abs(x - lag(x) over w) as dx, abs(y - lag(y) over w) as dy from points window w as (partition by id_record order by id_vehicle, ord))
    select id_record, round(sum(dx) / count(dx), 6) as mean_dx, round(sum(dy) / count(dx), 6) as mean_dy, count(dx) as n from d group by 1""",
)
def step_scale(spark, sf):
    scale = shapes.step_scale(views.points(spark, sf))
    return r6(scale.select("id_record", (F.col("dx") / F.col("n")).alias("mean_dx"), (F.col("dy") / F.col("n")).alias("mean_dy"), "n"), "mean_dx", "mean_dy")


@query(
    "motion_gate",
    f"""with {P}, l as (select *, 2 * lag(x) {W} - lag(x, 2) {W} as px, 2 * lag(y) {W} - lag(y, 2) {W} as py, lag(x) {W} as lx, lag(y) {W} as ly, lag(x, 3) {W} as hx, lag(y, 3) {W} as hy from points),
    e as (select *, sqrt((px - x) ** 2 + (py - y) ** 2) as err, sqrt((x - hx) ** 2 + (y - hy) ** 2) / 3 as seen, sqrt((px - hx) ** 2 + (py - hy) ** 2) / 3 as expected,
                 abs(atan2(py - ly, px - lx) - atan2(y - ly, x - lx)) as turn from l where hx is not null)
    select id_vehicle, ord, case when ord < 10 then err < greatest(250, err * 45) else err < 250 and seen <= 3 * expected and seen >= expected / 3
        and case when seen > 0 and expected > 0 then turn - 2 * pi() * floor(turn / (2 * pi())) < pi() / 2 else true end end as fits from e""",
)
def motion_gate(spark, sf):
    w = tracks.along()
    lag = lambda c, k: F.lag(c, k).over(w)
    at = {f"{p}{c}": e for c in "xy" for p, e in (("p", 2 * lag(c, 1) - lag(c, 2)), ("l", lag(c, 1)), ("h", lag(c, 3)))}
    rows = views.points(spark, sf).withColumns(at).filter("hx is not null")
    far = lambda a, b: F.sqrt(F.pow(F.col(f"{a}x") - F.col(f"{b}x"), 2) + F.pow(F.col(f"{a}y") - F.col(f"{b}y"), 2))
    way = lambda a: F.atan2(F.col(f"{a}y") - F.col("ly"), F.col(f"{a}x") - F.col("lx"))
    fits = shapes.consistent(error=far("p", ""), frames=F.col("ord"), seen=far("", "h") / 3, expected=far("p", "h") / 3, turn=way("p") - way(""), distance=250.0, settled=10)
    return rows.select("id_vehicle", "ord", fits.alias("fits"))


from . import more  # noqa: E402, F401  registers its queries here
