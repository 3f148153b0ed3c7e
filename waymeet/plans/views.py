"""Trajectories, conflicts and other inputs derived from the test tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import OBJECT_CLASSES
from ..storage import bounded, dealt

DEGREE = 0.017453292519943295
TYPES = {"1": "Following", "2": "Diverging", "3": "Crossing", "4": "Merging", "5": "Head-on"}
CLUSTERS = 6


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def object_sizes(spark: SparkSession) -> DataFrame:
    rows = [(i, *c) for i, c in enumerate(OBJECT_CLASSES)]
    return spark.createDataFrame(rows, "nth int, class_name string, class_code int, length double, width double, height double")


def points(spark: SparkSession, sf_dir: str, record: str = "yyyyMM") -> DataFrame:
    """Trajectory points from events: a user is a vehicle, a month (or day) a record."""
    ev = read(spark, sf_dir, "events")
    us = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)")
    from pyspark.sql import Window

    rows = ev.select(
        F.date_format(F.col("ts").cast("timestamp"), record).cast("long").alias("id_record"),
        F.col("user_id").alias("id_vehicle"),
        "event_id",
        "ts",
        us.alias("us"),
        F.col("value").alias("x"),
        F.regexp_extract("props", "([0-9]+)", 1).cast("double").alias("y"),
        ((F.col("event_id") % 3) * F.lit(0.1)).alias("z"),
        (((F.col("event_id") * 37) % 360) * F.lit(DEGREE)).alias("yaw"),
        (F.col("event_type") != "error").alias("detected"),
        (F.col("user_id") % CLUSTERS - 1).cast("int").alias("cluster"),
        (F.col("user_id") % 7).cast("int").alias("nth"),
    )
    w = Window.partitionBy("id_record", "id_vehicle").orderBy("ts", "event_id")
    rows = rows.withColumn("ord", (F.row_number().over(w) - 1).cast("long"))
    return rows.join(F.broadcast(object_sizes(spark)), "nth").drop("nth")


def points_sql(record: str = "%Y%m") -> str:
    sizes = ", ".join(f"({i}, '{c[0]}', {c[1]}, {c[2]}::double, {c[3]}::double, {c[4]}::double)" for i, c in enumerate(OBJECT_CLASSES))
    return f"""
        sizes(nth, class_name, class_code, length, width, height) as (values {sizes}),
        points as (
            select strftime(ts, '{record}')::bigint as id_record, user_id as id_vehicle, event_id, ts, epoch_us(ts) as us, value as x,
                   regexp_extract(props, '([0-9]+)', 1)::double as y, (event_id % 3) * 0.1::double as z,
                   ((event_id * 37) % 360) * {DEGREE}::double as yaw, event_type <> 'error' as detected, (user_id % {CLUSTERS} - 1)::int as cluster,
                   row_number() over (partition by strftime(ts, '{record}'), user_id order by ts, event_id) - 1 as ord,
                   class_name, class_code, length, width, height
            from events join sizes on nth = user_id % 7
        )"""


def detections(spark: SparkSession, sf_dir: str, lanes: int = 4) -> DataFrame:
    """Detections in frames, from events: the events of a record are sightings of the objects of four lanes.

    A day is a record and 4 events a frame; a lane's object moves on with its frames, and errors are not detected.
    """
    from pyspark.sql import Window

    ev = read(spark, sf_dir, "events").withColumn("id_record", F.date_format(F.col("ts").cast("timestamp"), "yyyyMMdd").cast("long"))
    nth = F.row_number().over(Window.partitionBy("id_record").orderBy("ts", "event_id")) - 1
    rows = ev.withColumns({"at": nth, "nth": (F.col("user_id") % lanes).cast("int")}).withColumn("frame_id", F.floor(F.col("at") / lanes))
    rows = rows.join(F.broadcast(object_sizes(spark)), "nth").filter("event_type <> 'error'")
    return rows.select(
        "id_record",
        "frame_id",
        (F.col("frame_id") * 0.4 + F.col("value") / 1000).alias("x"),
        (F.col("nth") * 6.0 + F.col("event_id") % 7 * 0.05).alias("y"),
        F.lit(0.0).alias("z"),
        (F.col("length") + F.col("event_id") % 3 * 0.1).alias("length"),
        "width",
        "height",
        (F.col("event_id") % 5 * 0.02).alias("yaw"),
        "class_name",
        (0.5 + F.col("event_id") % 5 * 0.1).alias("score"),
    )


#: Lanes of the tracks below: where each begins, its direction and its bend (fixed values).
LANES = [(0.0, 0.0, 1.0, 0.0, 0.0), (0.0, 40.0, 1.0, 0.0, 0.002), (90.0, 100.0, -1.0, 0.0, 0.0), (50.0, -30.0, 0.0, 1.0, 0.0), (20.0, 90.0, 0.0, -1.0, 0.004), (0.0, -60.0, 0.8, 0.6, 0.0), (150.0, 0.0, 0.0, 1.0, -0.003)]


def lane_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of vehicles on lanes, from orders: a customer with four orders or more drives along the lane of its number."""
    from pyspark.sql import Window

    each, by = Window.partitionBy("o_custkey"), Window.partitionBy("o_custkey").orderBy("o_orderkey")
    o = read(spark, sf_dir, "orders").withColumns({"n": F.count("*").over(each), "k": F.row_number().over(by) - 1}).filter("n >= 4")
    lane = F.element_at(F.array(*(F.struct(*(F.lit(v).alias(c) for v, c in zip(row, ("ox", "oy", "dx", "dy", "bend")))) for row in LANES)), (F.col("o_custkey") % len(LANES) + 1).cast("int"))
    o = o.select(F.lit(1).cast("long").alias("id_record"), F.col("o_custkey").alias("id_vehicle"), F.col("k").cast("long").alias("ord"), lane.alias("l"), (F.col("k") * 100.0 / (F.col("n") - 1)).alias("s"), (F.col("o_orderkey") % 11 * 0.2 - 1).alias("off"))
    side = F.col("off") + F.col("l.bend") * F.col("s") * F.col("s")
    return o.select("id_record", "id_vehicle", "ord", (F.col("l.ox") + F.col("l.dx") * F.col("s") - F.col("l.dy") * side).alias("x"), (F.col("l.oy") + F.col("l.dy") * F.col("s") + F.col("l.dx") * side).alias("y"), F.lit(0.0).alias("z"))


LANE_SQL = f"""
        lanes(lane, ox, oy, dx, dy, bend) as (values {', '.join(f"({i}, {', '.join(f'{v}::double' for v in row)})" for i, row in enumerate(LANES))}),
        driven as (
            select o_custkey as id_vehicle, row_number() over (partition by o_custkey order by o_orderkey) - 1 as ord, count(*) over (partition by o_custkey) as n,
                   o_orderkey % 11 * 0.2::double - 1 as off_lane
            from orders
        ),
        points as (
            select 1::bigint as id_record, id_vehicle, ord, ox + dx * s - dy * side as x, oy + dy * s + dx * side as y, 0.0::double as z
            from (select *, off_lane + bend * s * s as side from (select *, ord * 100.0::double / (n - 1) as s from driven where n >= 4) join lanes on lane = id_vehicle % {len(LANES)})
        )"""


def conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conflicts from line items: customers meet suppliers."""
    li, o = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "orders")
    c, s = read(spark, sf_dir, "customer"), read(spark, sf_dir, "supplier")
    # line items, the most by far, are dealt once; the others meet before or are looked up
    n, s = li.count(), bounded(s.select("s_suppkey", "s_nationkey"), 24)
    o = o.join(c, o.o_custkey == c.c_custkey)
    rows = dealt(li, n, "l_orderkey").join(dealt(o, n, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    kind = F.create_map(*(F.lit(v) for kv in TYPES.items() for v in kv))
    third = F.col("l_linenumber") % 3
    return rows.select(
        F.year("o_orderdate").cast("long").alias("idRecord"),
        F.col("l_shipdate").alias("FrameTimeStamp"),
        F.col("l_linenumber").alias("FrameTimeStamp_MicroSec"),
        F.when(F.col("l_linestatus") == "O", "PET3D").otherwise("PET2D").alias("Indicator"),
        F.col("o_custkey").alias("idVehicle1"),
        F.col("l_suppkey").alias("idVehicle2"),
        F.col("c_mktsegment").alias("Vehicle_Class_1"),
        F.col("l_returnflag").alias("Vehicle_Class_2"),
        (F.col("c_nationkey") - 1).alias("Vehicle_Cluster_1"),
        (F.col("s_nationkey") - 1).alias("Vehicle_Cluster_2"),
        F.col("l_extendedprice").alias("posX"),
        F.col("l_orderkey").alias("key"),
        (F.col("l_quantity") / 10).alias("Value"),
        F.element_at(kind, F.substring("o_orderpriority", 1, 1)).alias("Auto_Type"),
        F.when(third == 0, True).when(third == 1, False).alias("Auto_Rule_Flag"),
        (F.col("l_tax") * 25).alias("LOF1"),
        (F.col("l_discount") * 20).alias("LOF2"),
        (F.col("l_discount") * 18).alias("LOF2_LSTM"),
        F.when(F.col("l_returnflag") == "A", True).when(F.col("l_returnflag") == "R", False).alias("Manual_Conflict_Check"),
    )


CONFLICTS_SQL = f"""
        conflicts as (
            select year(o_orderdate)::bigint as idRecord, l_shipdate as FrameTimeStamp, l_linenumber as FrameTimeStamp_MicroSec,
                   case when l_linestatus = 'O' then 'PET3D' else 'PET2D' end as Indicator, o_custkey as idVehicle1, l_suppkey as idVehicle2,
                   c_mktsegment as Vehicle_Class_1, l_returnflag as Vehicle_Class_2, c_nationkey - 1 as Vehicle_Cluster_1,
                   s_nationkey - 1 as Vehicle_Cluster_2, l_extendedprice as posX, l_orderkey as key, l_quantity / 10 as "Value",
                   case substr(o_orderpriority, 1, 1) {' '.join(f"when '{k}' then '{v}'" for k, v in TYPES.items())} end as Auto_Type,
                   case l_linenumber % 3 when 0 then true when 1 then false end as Auto_Rule_Flag,
                   l_tax * 25 as LOF1, l_discount * 20 as LOF2, l_discount * 18 as LOF2_LSTM,
                   case l_returnflag when 'A' then true when 'R' then false end as Manual_Conflict_Check
            from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey
        )"""

#: A manoeuvre for most pairs of clusters; every ninth pair has none.
MANEUVER_LIST = ("Following", "Head-on", "Crossing", "Merging", "Diverging", "Turn-left-across-path", "Turn-right-across-path", "Check individual")


def maneuvers(spark: SparkSession) -> DataFrame:
    rows = [(a, b, MANEUVER_LIST[(a * CLUSTERS + b) % 9]) for a in range(-1, CLUSTERS - 1) for b in range(-1, CLUSTERS - 1) if (a * CLUSTERS + b) % 9 < 8]
    return spark.createDataFrame(rows, "ClusterVehicle1 int, ClusterVehicle2 int, ManeuverClass string")


def maneuvers_sql() -> str:
    rows = ", ".join(f"({a}, {b}, '{MANEUVER_LIST[(a * CLUSTERS + b) % 9]}')" for a in range(-1, CLUSTERS - 1) for b in range(-1, CLUSTERS - 1) if (a * CLUSTERS + b) % 9 < 8)
    return f"maneuvers(c1, c2, known) as (values {rows})"


#: Two zones over the points' plane.
ZONE_LIST = [(1, "west", [(5.0, 5.0), (60.0, 10.0), (45.0, 80.0), (10.0, 60.0)]), (2, "east", [(100.0, 20.0), (200.0, 20.0), (150.0, 90.0)])]


def zones(spark: SparkSession) -> DataFrame:
    rows = [(i, n, [{"x": x, "y": y} for x, y in v]) for i, n, v in ZONE_LIST]
    return spark.createDataFrame(rows, "zone_id int, name string, vertices array<struct<x: double, y: double>>")


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections as image boxes, from line items: 20 orders a frame."""
    li = read(spark, sf_dir, "lineitem")
    x, y = F.col("l_partkey") % 500 + 0.0, F.col("l_suppkey") % 400 + 0.0
    return li.select(
        F.floor(F.col("l_orderkey") / 20).alias("frame_id"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("det_id"),
        (F.col("l_linenumber") % 3).cast("int").alias("cls"),
        (F.col("l_discount") * 10).alias("conf"),
        x.alias("x1"),
        y.alias("y1"),
        (x + 20 + F.col("l_quantity")).alias("x2"),
        (y + 60).alias("y2"),
    )


BOXES_SQL = """
        boxes as (
            select floor(l_orderkey / 20)::bigint as frame_id, l_orderkey * 10 + l_linenumber as det_id, (l_linenumber % 3)::int as cls, l_discount * 10 as conf,
                   (l_partkey % 500)::double as x1, (l_suppkey % 400)::double as y1, l_partkey % 500 + 20 + l_quantity as x2, (l_suppkey % 400 + 60)::double as y2
            from lineitem
        )"""
