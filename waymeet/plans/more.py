"""Further queries over the operators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import boxes as box_functions
from ..functions import geometry
from ..operators import detect3d, detections, interactions, matching, shapes, tracks, walks
from ..operators.near_frames import near_frames
from ..schemas import OBJECT_CLASSES
from ..sources import tables
from . import views
from .queries import HOUR_US, SQL, P, W, _box_sql, _conflict_sql, _day_sql, _truth, query, r6

# ---- tracks ----------------------------------------------------------------------------------------------------


@query("normalised_times", f"with {P}, b as (select id_record, min(us) as base from points group by 1) select id_vehicle, ord, round((us - base) / 1e6, 6) as seconds from points join b using (id_record)")
def normalised_times(spark, sf):
    pts = views.points(spark, sf)
    base = pts.groupBy("id_record").agg(F.min("us").alias("base_us"))
    return r6(tracks.from_base(pts, base).select("id_vehicle", "ord", "seconds"), "seconds")


@query("initial_filter", f"with {P} select id_vehicle, count(*) as frames, round(avg(detected::int), 6) as share_detected from points group by id_record, id_vehicle having avg(detected::int) >= 0.2 and count(*) >= 15")
def initial_filter(spark, sf):
    return r6(tracks.initial_filter(views.points(spark, sf)).drop("id_record"), "share_detected")


@query("finished_at_end", f"with {P} select id_vehicle, count(*) as frames from points group by id_record, id_vehicle having count(*) >= 3")
def finished_at_end(spark, sf):
    return tracks.finished_at_end(views.points(spark, sf)).drop("id_record")


@query(
    "valid_for_scoring",
    f"""with {P}, r as (select *, row_number() {W} as rn, count(*) over (partition by id_record, id_vehicle) as n from points), i as (select * from r where rn > 3 and rn <= n - 3),
    t as (select *, coalesce((yaw - lag(yaw) {W}) - 2 * pi() * round_even((yaw - lag(yaw) {W}) / (2 * pi()), 0), 0) as turn from i),
    u as (select *, sum(turn) over (partition by id_record, id_vehicle order by ord) as un from t)
    select id_vehicle, count(*) as frames, round(sqrt((arg_max(x, ord) - arg_min(x, ord)) ** 2 + (arg_max(y, ord) - arg_min(y, ord)) ** 2), 6) as net from u
    group by id_record, id_vehicle having count(*) >= 20 and sqrt((arg_max(x, ord) - arg_min(x, ord)) ** 2 + (arg_max(y, ord) - arg_min(y, ord)) ** 2) >= 50 and max(un) - min(un) <= 15.5""",
)
def valid_for_scoring(spark, sf):
    found = tracks.valid_for_scoring(views.points(spark, sf), frames=20, distance=50.0, turn=15.5, trim=3)
    return r6(found.select("id_vehicle", "frames", "net"), "net")


_INTO = "case when id_vehicle % 5 = 1 then id_vehicle - 1 else id_vehicle end"


@query("manual_merge", f"with {P} select {_INTO} as id_vehicle, event_id, row_number() over (partition by id_record, {_INTO} order by us, ord, event_id) - 1 as ord, x from points")
def manual_merge(spark, sf):
    pts = views.points(spark, sf)
    pairs = pts.filter("id_vehicle % 5 = 1").select("id_record", "id_vehicle", (F.col("id_vehicle") - 1).alias("into")).distinct()
    return tracks.merge_tracks(pts, pairs).select("id_vehicle", "event_id", "ord", "x")


@query("manual_remove", f"with {P}, gone as (select id_record, id_vehicle from points group by 1, 2 having count(*) % 3 = 0) select id_vehicle, ord, x, y from points where (id_record, id_vehicle) not in (from gone)")
def manual_remove(spark, sf):
    pts = views.points(spark, sf)
    gone = pts.groupBy("id_record", "id_vehicle").count().filter("count % 3 = 0")
    return tracks.remove_tracks(pts, gone).select("id_vehicle", "ord", "x", "y")


_PIECES = f"""s as (select *, coalesce(abs(((lead(yaw) {W} - yaw + pi()) - 2 * pi() * floor((lead(yaw) {W} - yaw + pi()) / (2 * pi()))) - pi()) > 100.5 * pi() / 180, false) and row_number() {W} > 1 as starts,
        (event_id % 3)::varchar as voted from points),
    q as (select *, sum(starts::int) over (partition by id_record, id_vehicle order by ord) as piece from s)"""


@query(
    "rebuilt_tracks",
    f"""with {P}, {_PIECES}, v as (select id_record, id_vehicle, piece, voted, count(*) as n from q where detected group by all),
    w as (select id_record, id_vehicle, piece, voted from v qualify row_number() over (partition by id_record, id_vehicle, piece order by n desc, voted) = 1)
    select q.id_vehicle, q.piece::bigint as piece, count(*) as frames, max(ord) - max(ord) filter (detected) as undetected, any_value(w.voted) as class_name, round(avg(length) filter (detected), 6) as length
    from q join w using (id_record, id_vehicle, piece) group by q.id_record, q.id_vehicle, q.piece""",
)
def rebuilt_tracks(spark, sf):
    pts = tracks.split_at_jumps(views.points(spark, sf).withColumn("class_name", (F.col("event_id") % 3).cast("string")), 100.5)
    return r6(tracks.rebuilt(pts, "piece").select("id_vehicle", "piece", "frames", "undetected", "class_name", "length"), "length")


@query("fitted_or_raw", f"with {P} select id_vehicle, ord, case when detected then x + 1 else x end as x, case when ord % 2 = 0 then y * 2 else y end as y from points")
def fitted_or_raw(spark, sf):
    pts = views.points(spark, sf).withColumns({"x_fit": F.when(F.col("detected"), F.col("x") + 1), "y_fit": F.when(F.col("ord") % 2 == 0, F.col("y") * 2)})
    return tracks.fitted_or_raw(pts, "x", "y").select("id_vehicle", "ord", "x", "y")


@query("history_slice", f"with {P}, n as (select *, count(*) over (partition by id_record, id_vehicle) as n from points) select id_vehicle, ord, x, y from n where ord >= 4 and ord < n - 2")
def history_slice(spark, sf):
    return tracks.history_slice(views.points(spark, sf), 4, -2).select("id_vehicle", "ord", "x", "y")


@query("lagged_positions", f"with {P} select id_vehicle, ord, lag(x, 3) {W} as x_before, lag(y, 3) {W} as y_before, lag(z, 3) {W} as z_before, us / 1e6 as epoch from points")
def lagged_positions(spark, sf):
    return tracks.lagged_positions(views.points(spark, sf)).select("id_vehicle", "ord", "x_before", "y_before", "z_before", "epoch")


@query("record_counts", f"with {P} select id_record, count(distinct id_vehicle) as tracks, count(distinct us) as frames, count(*) as \"rows\", 640 as width, 480 as height from points group by 1")
def record_counts(spark, sf):
    return tracks.record_counts(views.points(spark, sf))


@query(
    "new_numbers",
    f"""with {P}, t as (select distinct id_record, id_vehicle from points where not detected), top as (select id_record, max(id_vehicle) as top from points where detected group by 1)
    select t.id_record, t.id_vehicle, coalesce(top, 0) + row_number() over (partition by t.id_record order by t.id_vehicle) as new_vehicle from t left join top using (id_record)""",
)
def new_numbers(spark, sf):
    pts = views.points(spark, sf)
    return tracks.new_numbers(pts.filter("not detected").select("id_record", "id_vehicle").distinct(), pts.filter("detected"))


@query(
    "appended_sizes",
    f"""with {P}, e as (select id_record, {_INTO} as v, id_vehicle, count(*) as n, any_value(length) as l, any_value(width) as w, any_value(height) as h from points group by all)
    select v as id_vehicle, round(sum(l * n) / sum(n), 6) as length, round(sum(w * n) / sum(n), 6) as width, round(sum(h * n) / sum(n), 6) as height from e group by id_record, v""",
)
def appended_sizes(spark, sf):
    pts = views.points(spark, sf)
    pairs = pts.filter("id_vehicle % 5 = 1").select("id_record", "id_vehicle", (F.col("id_vehicle") - 1).alias("into")).distinct()
    return r6(tracks.appended_sizes(pts, pairs).drop("id_record"), "length", "width", "height")


@query(
    "padded_rows",
    f"""with {P}, n as (select *, ceil(count(*) over (partition by id_record, id_vehicle) / 7) as stride from points),
    s as (select id_record, id_vehicle, (ord // stride)::int as k, x, y from n where ord % stride = 0 and ord < stride * 7),
    g as (select id_record, id_vehicle, unnest(range(0, 7))::int as k from (select distinct id_record, id_vehicle from points))
    select g.id_vehicle, g.k, coalesce(x, 0) as x, coalesce(y, 0) as y, x is null as pad from g left join s using (id_record, id_vehicle, k)""",
)
def padded_rows(spark, sf):
    return shapes.padded(views.points(spark, sf), 7).drop("id_record")


@query(
    "reconstruction_error",
    f"""with {P}, d as (select *, lag(x) {W} as hx, lag(y) {W} as hy from points),
    m as (select id_record, (sum((hx - x) ** 2) + sum((hy - y) ** 2)) / (2 * count(*)) as mse from d where hx is not null group by 1)
    select id_record, round(mse, 4) as mse, round(sqrt(mse), 4) as rmse, round(mse * 100, 2) as loss from m""",
)
def reconstruction_error(spark, sf):
    w = tracks.along()
    rows = views.points(spark, sf).withColumns({f"{c}_hat": F.lag(c).over(w) for c in "xy"}).withColumn("pad", F.col("x_hat").isNull())
    return shapes.reconstruction_error(rows, "id_record").select("id_record", F.round("mse", 4).alias("mse"), F.round("rmse", 4).alias("rmse"), F.round("loss", 2).alias("loss"))


@query(
    "banned_by_pixels",
    f"""with {P}, a as (select *, row_number() {W} as nth, sqrt((x - first_value(x) {W}) ** 2 + (y - first_value(y) {W}) ** 2) as net, abs(z * 40 - first_value(z * 40) {W}) as moved from points)
    select id_vehicle, ord, bool_or(nth = 12 and (net < 30 or moved < 5)) over (partition by id_record, id_vehicle order by ord) as banned from a""",
)
def banned_by_pixels(spark, sf):
    pts = views.points(spark, sf).withColumns({"valid": F.col("detected"), "px": F.col("z") * 40, "py": F.lit(0.0)})
    return shapes.banned(pts, early=(0, -1), at=12, least=30.0).select("id_vehicle", "ord", "banned")


@query(
    "metre_yaw",
    f"""with recursive {P}, s as (select id_record, id_vehicle, ord, x as sx, y as sy, ord as start, false as cut, null::double as way from points where ord = 0
        union all
        select p.id_record, p.id_vehicle, p.ord, case when far then p.x else sx end, case when far then p.y else sy end, case when far then p.ord else start end, far, case when far then atan2(p.y - sy, p.x - sx) end
        from s join points p on p.id_record = s.id_record and p.id_vehicle = s.id_vehicle and p.ord = s.ord + 1, lateral (select p.ord > 1 and sqrt((p.x - sx) ** 2 + (p.y - sy) ** 2) > 200 as far)),
    c as (select id_record, id_vehicle, ord, way from s where cut)
    select p.id_vehicle, p.ord, round(coalesce((select arg_min(way, c.ord) from c where c.id_record = p.id_record and c.id_vehicle = p.id_vehicle and c.ord > p.ord), yaw), 6) as yaw_way from points p""",
)
def metre_yaw(spark, sf):
    return r6(walks.metre_yaw(views.points(spark, sf), 200.0).select("id_vehicle", "ord", "yaw_way"), "yaw_way")


@query(
    "jump_smoothed_yaw",
    # every stretch as a list, led by the last mean of the one before it, and means over indices that stop at its ends
    f"""with recursive {P}, j as (select *, abs(lead(yaw) {W} - yaw) > 3 as jumps from points),
    k as (select *, coalesce(sum(jumps::int) over (partition by id_record, id_vehicle order by ord rows between unbounded preceding and 1 preceding), 0)::int as stretch from j),
    parts as (select id_record, id_vehicle, stretch, list(yaw order by ord) as v, list(ord order by ord) as o from k group by all),
    own as (select *, stretch = max(stretch) over (partition by id_record, id_vehicle) as ends from parts),
    run as (
        select id_record, id_vehicle, stretch, o, v, ends from own where stretch = 0
        union all
        select n.id_record, n.id_vehicle, n.stretch, [e.o[-1]] || n.o, [e.means[-1]] || n.v, n.ends
        from (
            select r.*, list_transform(range(1, len(v) + 1), lambda i: list_sum(list_transform(range(i - half, i + half + 1), lambda m: v[greatest(1, least(len(v), m))])) / (2 * half + 1)) as means
            from (select *, (case when least(len(v) - (not ends)::int, 60) < 2 then 0 else least(len(v) - (not ends)::int, 60) // 2 end)::bigint as half from run) r
        ) e join own n on n.id_record = e.id_record and n.id_vehicle = e.id_vehicle and n.stretch = e.stretch + 1
    ),
    m as (
        select *, list_transform(range(1, len(v) + 1), lambda i: list_sum(list_transform(range(i - half, i + half + 1), lambda m: v[greatest(1, least(len(v), m))])) / (2 * half + 1)) as means
        from (select *, (case when least(len(v) - (not ends)::int, 60) < 2 then 0 else least(len(v) - (not ends)::int, 60) // 2 end)::bigint as half from run)
    ),
    u as (select id_vehicle, unnest(o) as ord, unnest(means) as yaw_even, ends, generate_subscripts(o, 1) = len(o) as tail from m)
    select id_vehicle, ord, round(yaw_even, 6) + 0.0 as yaw_even from u where ends or not tail""",
)
def jump_smoothed_yaw(spark, sf):
    return r6(shapes.smooth_between_jumps(views.points(spark, sf)).select("id_vehicle", "ord", "yaw_even"), "yaw_even")


def _quintic(c: str, d: int) -> str:
    """The d-th derivative of the Hermite form of degree five: weights of place, slope and bend at both ends, by powers of s."""
    weights = {f"{c}": (1, 0, 0, -10, 15, -6), f"h * v{c}": (0, 1, 0, -6, 8, -3), f"h * h * a{c}": (0, 0, 0.5, -1.5, 1.5, -0.5),
               f"{c}2": (0, 0, 0, 10, -15, 6), f"h * v{c}2": (0, 0, 0, -4, 7, -3), f"h * h * a{c}2": (0, 0, 0, 0.5, -1, 0.5)}
    for _ in range(d):
        weights = {k: tuple(i * v for i, v in enumerate(w))[1:] for k, w in weights.items()}
    return "(" + " + ".join(f"{k} * ({' + '.join(f'({v}) * s ** {i}' for i, v in enumerate(w))})" for k, w in weights.items()) + f") / h ** {d}"


def _central(c: str) -> str:
    return f"case when lag({c}) {W} is null then lead({c}) {W} - {c} when lead({c}) {W} is null then {c} - lag({c}) {W} else (lead({c}) {W} - lag({c}) {W}) / 2 end / h"


@query(
    "bernstein_paths",
    f"""with {P}, n as (select *, 1.0::double / nullif(count(*) over (partition by id_record, id_vehicle) - 1, 0) as h from points),
    v as (select *, {_central('x')} as vx, {_central('y')} as vy from n where h is not null), a as (select *, {_central('vx')} as ax, {_central('vy')} as ay from v),
    b as (select *, {', '.join(f'lead({c}) {W} as {c}2' for c in ('x', 'y', 'vx', 'vy', 'ax', 'ay'))} from a),
    q as (select *, unnest([0.0::double, 0.25::double, 0.5::double]) as s from b),
    f as (select id_record, id_vehicle, ord, s, {', '.join(f"case when s = 0 then {o}{c} else {_quintic(c, d)} end as f{o}{c}" for c in 'xy' for d, o in enumerate(('', 'v', 'a')))} from q where s = 0 or x2 is not null),
    y as (select *, atan2(fvy, fvx) as yaw from f)
    select id_vehicle, ord, s as share, round(fx + 1e-8, 6) as x, round(fy + 1e-8, 6) as y, round(fvx + 1e-6, 4) as vx, round(fvy + 1e-6, 4) as vy, round(yaw + 1e-7, 5) + 0.0 as yaw from y""",
)
def bernstein_paths(spark, sf):
    found = shapes.bernstein_paths(views.points(spark, sf), (0.0, 0.25, 0.5))
    # many values lie just between two roundings, so both sides are moved off that
    near = lambda c, n: (F.round(F.col(c) + 10.0 ** (-n - 2), n) + F.lit(0.0)).alias(c)
    return found.select("id_vehicle", "ord", "share", near("x", 6), near("y", 6), near("vx", 4), near("vy", 4), near("yaw", 5))


def _slope(v: str) -> str:
    """Central differences of a list, one-sided at its ends."""
    return f"list_transform(range(1, len({v}) + 1), lambda m: case when m = 1 then {v}[2] - {v}[1] when m = len({v}) then {v}[m] - {v}[m - 1] else ({v}[m + 1] - {v}[m - 1]) / 2 end)"


@query(
    "adaptive_segments",
    # row by row: the whole segment so far with this row, its slopes and their slopes; 0 / 0 is no curvature, other / 0 any
    f"""with recursive {P}, whole as (select id_record, id_vehicle, list(x order by ord) as xs, list(y order by ord) as ys from points group by all),
    walk as (
        select id_record, id_vehicle, 0::bigint as i, 0::bigint as start, 0 as segment from whole
        union all
        select id_record, id_vehicle, i, case when bent then i else start end, segment + bent::int
        from (
            select *, i - start >= 3 and len(list_filter(range(1, len(gx) + 1), lambda m: case when gx[m] ** 2 + gy[m] ** 2 = 0 then gx[m] * ggy[m] - gy[m] * ggx[m] <> 0
                          else abs(gx[m] * ggy[m] - gy[m] * ggx[m]) / (gx[m] ** 2 + gy[m] ** 2) ** 1.5 > 0.2 end)) > 0 as bent
            from (
                select *, {_slope('gx')} as ggx, {_slope('gy')} as ggy
                from (
                    select *, {_slope('px')} as gx, {_slope('py')} as gy
                    from (
                        select w.id_record, w.id_vehicle, w.i + 1 as i, start, segment, xs[start + 1 : w.i + 2] as px, ys[start + 1 : w.i + 2] as py
                        from walk w join whole on whole.id_record = w.id_record and whole.id_vehicle = w.id_vehicle where w.i + 1 < len(xs)
                    )
                )
            )
        )
    ),
    counted as (select id_vehicle, segment, count(*) as frames, min(i) as first_ord, segment = max(segment) over (partition by id_record, id_vehicle) as is_last from walk group by id_record, id_vehicle, segment)
    select id_vehicle, segment, frames, first_ord from counted where not (is_last and frames < 4)""",
)
def adaptive_segments(spark, sf):
    cut = walks.adaptive_segments(views.points(spark, sf), bent=0.2).filter("segment is not null")
    return cut.groupBy("id_record", "id_vehicle", F.col("segment").cast("int").alias("segment")).agg(F.count(F.lit(1)).alias("frames"), F.min("ord").alias("first_ord")).drop("id_record")


@query(
    "track_summaries",
    f"""with {P}, d as (select *, coalesce(sqrt((x - lag(x) {W}) ** 2 + (y - lag(y) {W}) ** 2), 0) as step from points),
    new as (select id_record, id_vehicle, (id_vehicle % 4)::int as new_cluster from points where id_vehicle % 2 = 0 group by all)
    select d.id_vehicle, ord, coalesce(new_cluster, cluster) as cluster from d left join new using (id_record, id_vehicle)""",
)
def track_summaries(spark, sf):
    pts = views.points(spark, sf)
    new = pts.filter("id_vehicle % 2 = 0").select("id_record", "id_vehicle", (F.col("id_vehicle") % 4).cast("int").alias("cluster")).distinct()
    return tables.write_clusters(pts, new).select("id_vehicle", "ord", "cluster")


# ---- linking ---------------------------------------------------------------------------------------------------

_LIMIT = 90.0
_DETS = "d as (select *, case when event_id % 2 = 0 then class_name else 'car' end as dc, (event_id % 10) / 10 as conf from points where event_id % 4 <> 1), t as (select * from points where event_id % 4 = 1)"


def _frames(spark, sf):
    """Detections and tracks that share an hour of a record, as if it were a frame."""
    pts = views.points(spark, sf).withColumn("frame_id", F.floor(F.col("us") / HOUR_US))
    state = ["x", "y", "z", "length", "width", "height", "yaw"]
    kind = F.when(F.col("event_id") % 2 == 0, F.col("class_name")).otherwise("car")
    d = pts.filter("event_id % 4 <> 1").select("id_record", "frame_id", F.col("event_id").alias("d_id"), kind.alias("d_class"), ((F.col("event_id") % 10) / 10).alias("d_conf"), *(F.col(c).alias(f"d_{c}") for c in state))
    t = pts.filter("event_id % 4 = 1").select("id_record", "frame_id", F.col("event_id").alias("t_id"), F.col("class_name").alias("t_class"), *(F.col(c).alias(f"t_{c}") for c in state))
    return d, t


@query(
    "detection_costs",
    f"""with {P}, {_DETS}, b as (select d.id_record, d.us // {HOUR_US} as frame_id, d.event_id as i, t.event_id as j,
        sqrt(4 * ((d.x - t.x) ** 2 + (d.y - t.y) ** 2 + (d.z - t.z) ** 2) + (d.length - t.length) ** 2 + (d.width - t.width) ** 2 + (d.height - t.height) ** 2) * (2 - cos(d.yaw - t.yaw))
        * (1 + 0.5 * case when dc = t.class_name then 1 - conf else conf end) as cost from d join t on d.id_record = t.id_record and d.us // {HOUR_US} = t.us // {HOUR_US})
    select frame_id, i, j, round(cost, 6) as cost from b where cost <= {_LIMIT}""",
)
def detection_costs(spark, sf):
    return r6(matching.detection_costs(*_frames(spark, sf), {c[0]: _LIMIT for c in OBJECT_CLASSES}).drop("id_record"), "cost")


@query(
    "new_tracks",
    f"""with {P}, {_DETS} select event_id as d_id from d where not exists (select 1 from t where t.id_record = d.id_record and t.us // {HOUR_US} = d.us // {HOUR_US} and abs(t.x - d.x) < 40 and abs(t.y - d.y) < 40)""",
)
def new_tracks(spark, sf):
    near = (F.abs(F.col("t.t_x") - F.col("d.d_x")) < 40) & (F.abs(F.col("t.t_y") - F.col("d.d_y")) < 40)
    return matching.new_tracks(*_frames(spark, sf), near).select("d_id")


# ---- boxes -----------------------------------------------------------------------------------------------------

_RAW = "raw as (select det_id, conf, x1, y1, x2, y2, case cls when 0 then 'car' when 1 then 'bus' else 'person' end as class_name, (x1 + x2) / 2 as kx, y2 as ky, (det_id % 7) / 10 as dl, (det_id % 11) as turn from boxes)"
_SIZES = ", ".join(f"('{c[0]}', {c[2]}::double, {c[3]}::double, {c[4]}::double)" for c in OBJECT_CLASSES)


def _world(spark, sf):
    kind = F.when(F.col("cls") == 0, "car").when(F.col("cls") == 1, "bus").otherwise("person")
    turn = F.col("det_id") % 11
    raw = views.boxes(spark, sf).select(
        "det_id", "conf", "x1", "y1", "x2", "y2", kind.alias("class_name"), ((F.col("x1") + F.col("x2")) / 2).alias("kx"), F.col("y2").alias("ky"),
        *(((F.col("det_id") % 7) / 10).alias(c) for c in ("d_len", "d_wid", "d_hei")), F.sin(turn).alias("sin"), F.cos(turn).alias("cos"),
    )
    pixels = spark.range(260 * 230).select((F.col("id") % 260).alias("px"), F.floor(F.col("id") / 260).alias("py"))
    pixels = pixels.select("px", "py", (F.col("px") / 4 + 1).alias("wx"), (F.col("py") / 2 + 3).alias("wy"), F.lit(-5.0).alias("cam_x"), F.lit(-7.0).alias("cam_y"))
    return detect3d.world_boxes(raw, pixels, views.object_sizes(spark), gain=2.0, pad=(4.0, 6.0), size=(260, 230))


@query(
    "world_boxes",
    f"""with {views.BOXES_SQL}, {_RAW}, s(class_name, l, w, h) as (values {_SIZES}),
    p as (select *, round_even((kx - 4) / 2, 0)::bigint as px, round_even((ky - 6) / 2, 0)::bigint as py from raw),
    q as (select p.*, l, w, h, atan2(px / 4 + 1 + 5, py / 2 + 3 + 7) + atan2(sin(turn), cos(turn)) as a from p join s using (class_name) where px between 0 and 259 and py between 0 and 229)
    select det_id, round(least(260, greatest(0, (x1 - 4) / 2)), 6) as x1, round(least(230, greatest(0, (y2 - 6) / 2)), 6) as y2, round(l * exp(dl), 6) as length, round(w * exp(dl), 6) as width,
           round(a - 2 * pi() * floor(a / (2 * pi())), 6) as yaw from q""",
)
def world_boxes(spark, sf):
    return r6(_world(spark, sf).select("det_id", "x1", "y2", "length", "width", "yaw"), "x1", "y2", "length", "width", "yaw")


@query(
    "confident_boxes",
    f"""with {views.BOXES_SQL}, {_RAW}, p as (select *, round_even((kx - 4) / 2, 0)::bigint as px, round_even((ky - 6) / 2, 0)::bigint as py from raw)
    select det_id from p where px between 0 and 259 and py between 0 and 229 and conf > 0.45 and px > 20.5 and px < 200.5 and py > 30.5 and py < 150.5""",
)
def confident_boxes(spark, sf):
    square = [{"x": x, "y": y} for x, y in ((20.5, 30.5), (200.5, 30.5), (200.5, 150.5), (20.5, 150.5))]
    zone = spark.createDataFrame([(1, "square", square)], "zone_id int, name string, vertices array<struct<x: double, y: double>>")
    return detect3d.confident(_world(spark, sf), zone, 0.45).select("det_id")


@query("best_f1", _box_sql("""f as (select cls, conf, max(p) filter (n = last) as p, max(r) filter (n = last) as r from (select *, max(n) over (partition by cls, conf) as last from pr) group by 1, 2),
    g as (select *, round(2 * p * r / (p + r + 1e-16), 9) as f1 from f)
    select cls, conf, round(p, 6) as precision, round(r, 6) as recall, round(f1, 6) as f1 from g qualify row_number() over (partition by cls order by g.f1 desc, conf desc) = 1"""))
def best_f1(spark, sf):
    from .queries import _judged

    return r6(detections.best_f1(*_judged(spark, sf)), "conf", "precision", "recall", "f1")


@query("fitness", f"with {views.BOXES_SQL} select det_id, round(0.1 * (conf / 10) + 0.9 * (x1 / 500), 6) as fitness from boxes")
def fitness(spark, sf):
    rows = views.boxes(spark, sf).select("det_id", (F.col("conf") / 10).alias("map50"), (F.col("x1") / 500).alias("map"))
    return r6(detections.fitness(rows).select("det_id", "fitness"), "fitness")


@query("image_weights", f"with {views.BOXES_SQL}, n as (select cls, count(*) as n from boxes group by 1), w as (select cls, (1 / n) / sum(1 / n) over () as weight from n) select frame_id, round(sum(weight), 6) as weight from boxes join w using (cls) group by 1")
def image_weights(spark, sf):
    found = views.boxes(spark, sf)
    return r6(detections.image_weights(found, detections.class_weights(found)), "weight")


@query(
    "polygon_resample",
    f"""with {views.BOXES_SQL}, r as (select det_id, [x1, x2, x2 + 3, x1, x1] as xs, [y1, y1 + 2, y2, y2, y1] as ys from boxes), k as (select *, unnest(range(0, 7)) as k from r), t as (select *, k * 4.0 / 6 as pos, least(floor(k * 4.0 / 6), 3)::int as i from k)
    select det_id, k::int as k, round(xs[i + 1] + (pos - i) * (xs[i + 2] - xs[i + 1]), 6) as x, round(ys[i + 1] + (pos - i) * (ys[i + 2] - ys[i + 1]), 6) as y from t""",
)
def polygon_resample(spark, sf):
    p = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    ring = F.array(p(x1, y1), p(x2, y1 + 2), p(x2 + 3, y2), p(x1, y2))
    rows = views.boxes(spark, sf).select("det_id", F.posexplode(box_functions.resample_ring(ring, 7)).alias("k", "p"))
    return r6(rows.select("det_id", "k", "p.x", "p.y"), "x", "y")


@query(
    "polygon_boxes",
    f"""with {views.BOXES_SQL}, v as (select det_id, list_filter([struct_pack(x := x1, y := y1), struct_pack(x := x2, y := y1 + 2), struct_pack(x := x2 + 3, y := y2), struct_pack(x := x1, y := y2)],
        lambda p: p.x between 0 and 450 and p.y between 0 and 380) as ps from boxes)
    select det_id, {', '.join(f"coalesce(list_{f}(list_transform(ps, lambda p: p.{c})), 0) as {c}{k}" for k, f in ((1, 'min'), (2, 'max')) for c in 'xy')} from v""",
)
def polygon_boxes(spark, sf):
    p = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    box = box_functions.box_of_points(F.array(p(x1, y1), p(x2, y1 + 2), p(x2 + 3, y2), p(x1, y2)), 450, 380)
    return views.boxes(spark, sf).select("det_id", *(c.alias(n) for n, c in zip(("x1", "y1", "x2", "y2"), box, strict=True)))


# ---- near misses -----------------------------------------------------------------------------------------------

_CORNERS = "unnest([{0}])".format(", ".join(f"struct_pack(k := {i}, a := {a}, b := {b})" for i, (a, b) in enumerate([(1, -1), (1, 1), (-1, 1), (-1, -1)])))


def _corners_sql(s: str) -> str:
    return f"""{s}c as (select id_record, a, b, ao, bo, k.k as k, {s}x + cos({s}yaw) * {s}l * k.a / 2 - sin({s}yaw) * {s}w * k.b / 2 as x, "{s}y" + sin({s}yaw) * {s}l * k.a / 2 + cos({s}yaw) * {s}w * k.b / 2 as y
        from (select *, {_CORNERS} as k from h)),
    {s}e as (select p.*, q.x as x2, q.y as y2 from {s}c p join {s}c q on p.id_record = q.id_record and p.a = q.a and p.b = q.b and p.ao = q.ao and p.bo = q.bo and q.k = (p.k + 1) % 4)"""


def _inside_sql(s: str) -> str:
    u = f'((c.x - h.{s}x) * cos(h.{s}yaw) + (c.y - h."{s}y") * sin(h.{s}yaw))'
    v = f'((c.y - h."{s}y") * cos(h.{s}yaw) - (c.x - h.{s}x) * sin(h.{s}yaw))'
    return f"abs({u}) <= h.{s}l / 2 + 1e-9 and abs({v}) <= h.{s}w / 2 + 1e-9"


_KEYS = "id_record, a, b, ao, bo"


@query(
    "bev_iou",
    f"""with {_day_sql(3.0)}, h as (select id_record, a, b, ao, bo, ax, ay, aw_.yaw as ayaw, aw_.length as al, aw_.width as aw, bx, by_ as "by", bw_.yaw as byaw, bw_.length as bl, bw_.width as bw from near
        join pts aw_ using (id_record) join pts bw_ using (id_record) where boxes and aw_.id_vehicle = a and aw_.ord = ao and bw_.id_vehicle = b and bw_.ord = bo),
    {_corners_sql('a')}, {_corners_sql('b')},
    v as (select {_KEYS}, c.x, c.y from ac c join h using ({_KEYS}) where {_inside_sql('b')} union all select {_KEYS}, c.x, c.y from bc c join h using ({_KEYS}) where {_inside_sql('a')}
          union all select {_KEYS}, x + t * (x2 - x), y + t * (y2 - y) from (
            select e.*, ((f.x - e.x) * (f.y2 - f.y) - (f.y - e.y) * (f.x2 - f.x)) / nullif((e.x2 - e.x) * (f.y2 - f.y) - (e.y2 - e.y) * (f.x2 - f.x), 0) as t,
                   ((f.x - e.x) * (e.y2 - e.y) - (f.y - e.y) * (e.x2 - e.x)) / nullif((e.x2 - e.x) * (f.y2 - f.y) - (e.y2 - e.y) * (f.x2 - f.x), 0) as s
            from ae e join be f using ({_KEYS})) where t between 0 and 1 and s between 0 and 1),
    m as (select *, x - avg(x) over g as dx, y - avg(y) over g as dy from v window g as (partition by {_KEYS})),
    o as (select *, coalesce(lead(dx) over g, first_value(dx) over g) as ex, coalesce(lead(dy) over g, first_value(dy) over g) as ey from m window g as (partition by {_KEYS} order by atan2(dy, dx), dx, dy)),
    i as (select {_KEYS}, sum(dx * ey - dy * ex) / 2 as inter from o group by all)
    select id_record, a, b, ao, bo, round(inter / (al * aw + bl * bw - inter), 5) as iou from h join i using ({_KEYS}) where inter > 0.01""",
)
def bev_iou(spark, sf):
    pairs = near_frames(_long(spark, sf), band_us=HOUR_US, carry=("ord", "x", "y", "length", "width", "yaw"), boxes=True)
    out = interactions.box_overlaps(pairs).filter("inter > 0.01")
    return out.select("id_record", F.col("a_id_vehicle").alias("a"), F.col("b_id_vehicle").alias("b"), F.col("a_ord").alias("ao"), F.col("b_ord").alias("bo"), F.round("iou", 5).alias("iou"))


def _long(spark, sf):
    """Points whose vehicles are three times as long: the largest is beyond 40 m."""
    return views.points(spark, sf, "yyyyMMdd").withColumn("length", F.col("length") * 3)


@query("pet3d_long_vehicles", _conflict_sql(3.0))
def pet3d_long_vehicles(spark, sf):
    from .queries import _OUT

    found = interactions.pet3d(_long(spark, sf), views.maneuvers(spark), threshold_s=3600, slot_us=HOUR_US)
    return r6(found.select(*_OUT), "posX", "posY", "Value")


assert SQL and _truth
