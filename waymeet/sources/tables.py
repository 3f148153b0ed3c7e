"""Reading and writing the tables of a measurement campaign."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas
from ..operators.tracks import trim_ends


def records(spark: SparkSession, path: str, first: int, last: int) -> DataFrame:
    """Records of a list (csv) with ids from first to last: start instant (null if it cannot be read) and its name pattern, in order."""
    rows = spark.read.schema(schemas.RECORDS).csv(path, header=True, enforceSchema=False).filter(F.col("RecordID").between(first, last))
    start = F.to_timestamp_ntz(F.try_to_timestamp("RecordFrameStartTime", F.lit("yyyy-MM-dd HH:mm:ss")).cast("string"))
    out = rows.select("RecordID", start.alias("start_ts"))
    return out.withColumn("pattern", F.date_format(F.col("start_ts").cast("timestamp"), "yyyyMMdd'T'HHmmss")).orderBy("RecordID")


def matching_files(spark: SparkSession, folder: str, wanted: DataFrame) -> DataFrame:
    """(RecordID, path): for each record the first file of a folder, by name, that holds its pattern; null without one.

    Patterns are all alike (yyyyMMdd'T'HHmmss), so they are cut out of the names and joined on equality.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path")
    held = files.select("path", F.explode(F.regexp_extract_all(F.element_at(F.split("path", "/"), -1), F.lit(r"(?=(\d{8}T\d{6}))"))).alias("f_pattern"))
    return wanted.join(held, F.col("pattern") == F.col("f_pattern"), "left").groupBy("RecordID").agg(F.min("path").alias("path"))


def folder_records(spark: SparkSession, names: DataFrame, first_folder: str, first_record: int) -> DataFrame:
    """(folder, id_record) by position: folders in order from first_folder on take consecutive record ids. A row per record."""
    w = Window.orderBy("folder")
    kept = names.select("folder").distinct().filter(F.col("folder") >= first_folder)
    return kept.withColumn("id_record", (F.row_number().over(w) - 1 + first_record).cast("long"))


def frame_instants(frames: DataFrame, start: str = "start_ts") -> DataFrame:
    """Adds frame_ts: the start and frame_id whole frame steps."""
    return frames.withColumn("frame_ts", F.expr(f"timestampadd(MICROSECOND, frame_id * {schemas.FRAME_US}, {start})"))


def snippet_frames(events: DataFrame, fps: int = schemas.FPS) -> DataFrame:
    """A row for each frame from start_ts up to and including the first at or after end_ts."""
    step = 1_000_000 // fps
    n = F.ceil(F.expr("timestampdiff(MICROSECOND, start_ts, end_ts)") / step)
    return frame_instants_of(events.withColumn("frame_id", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(n, F.lit(0)).cast("long")))), step)


def frame_instants_of(frames: DataFrame, step_us: int) -> DataFrame:
    return frames.withColumn("frame_ts", F.expr(f"timestampadd(MICROSECOND, frame_id * {step_us}, start_ts)"))


def trajectories(spark: SparkSession, path: str, *, trim: int = 10) -> DataFrame:
    """Points of trajectory csv files in the library's column names, each track without its first and last `trim` rows.

    Instants are kept to the microsecond: whole seconds and the microsecond column are put together. Sizes and cluster
    of a track are those of its first row.
    """
    raw = spark.read.schema(schemas.TRAJ_POINTS).csv(path, header=True)
    sizes = F.create_map(*(F.lit(v) for c in schemas.OBJECT_CLASSES for v in (c[1], c[0])))
    us = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', date_trunc('SECOND', FrameTimeStamp))") + F.col("FrameTimeStamp_MicroSec")
    rows = raw.select(
        F.col("idRecord").alias("id_record"),
        F.col("idVehicle").alias("id_vehicle"),
        us.alias("us"),
        F.element_at(sizes, F.col("ObjectClass")).alias("class_name"),
        *(F.col(f"{c}Fit").alias(n) for c, n in (("posX", "x"), ("posY", "y"), ("posZ", "z"), ("Yaw", "yaw"), ("Vx", "vx"), ("Vy", "vy"))),
        *(F.col(c).alias(c.lower()) for c in ("Length", "Width", "Height", "Cluster")),
    )
    w = Window.partitionBy("id_record", "id_vehicle").orderBy("us")
    rows = rows.withColumn("ord", (F.row_number().over(w) - 1).cast("long"))
    rows = rows.withColumns({c: F.first(c).over(w) for c in ("length", "width", "height", "cluster")})
    return trim_ends(rows, trim, trim) if trim else rows


def conflicts(spark: SparkSession, *paths: str) -> DataFrame:
    """Conflict csv files, older ones with fewer columns too, without vehicles outside clusters."""
    want = schemas.CONFLICTS
    fields = [f.split() for f in want.split(", ")]
    out = None
    for path in paths:
        got = spark.read.csv(path, header=True)
        got = got.select(*((F.col(n) if n in got.columns else F.lit(None)).try_cast(t).alias(n) for n, t in fields))
        out = got if out is None else out.unionByName(got)
    return out.filter((F.coalesce("Vehicle_Cluster_1", F.lit(0)) != -1) & (F.coalesce("Vehicle_Cluster_2", F.lit(0)) != -1))


def rules(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.RULES).csv(path, header=True)


def maneuvers(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.MANEUVER_CLASSES).csv(path, header=True)


def split_files(files: DataFrame, share: int = 5) -> DataFrame:
    """Adds validation: true for one in `share` of the different paths, rounded down but at least one.

    They are the first in the order of a hash of the path, so the same list is always split alike.
    """
    paths = files.select("path").filter("path is not null").distinct()
    most = max(paths.count() // share, 1)
    drawn = paths.orderBy(F.xxhash64("path"), "path").limit(most).select(F.col("path").alias("drawn"))
    return files.join(drawn, F.col("path") == F.col("drawn"), "left").withColumn("validation", F.col("drawn").isNotNull()).drop("drawn")


def write_points(points: DataFrame, path: str) -> None:
    """Points as Parquet by record; records written again replace themselves and no others."""
    points.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("id_record").parquet(path)


def write_conflicts(found: DataFrame, path: str) -> None:
    found.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("id_record").parquet(path)


def not_written(wanted: DataFrame, path: str) -> DataFrame:
    """Records (id_record) of wanted that the table at path does not have."""
    have = wanted.sparkSession.read.parquet(path).select("id_record").distinct()
    return wanted.join(have, "id_record", "left_anti")


def write_small_csv(rows: DataFrame, path: str) -> None:
    """One csv file with header, for tables that people open: rules, manoeuvres, overviews."""
    rows.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_embeddings(rows: DataFrame, path: str, width: int, group: str = "grp") -> None:
    """Embeddings as columns emb_0 .. by group."""
    wide = rows.select(group, "id_record", "id_vehicle", *(F.get("embedding", F.lit(i)).cast("float").alias(f"emb_{i}") for i in range(width)))
    wide.write.mode("overwrite").partitionBy(group).parquet(path)


def write_clusters(points: DataFrame, clusters: DataFrame) -> DataFrame:
    """points with the clusters (id_record, id_vehicle, cluster) of those tracks that have a new one."""
    new = clusters.select("id_record", "id_vehicle", F.col("cluster").alias("new_cluster"))
    return points.join(new, ["id_record", "id_vehicle"], "left").withColumn("cluster", F.coalesce("new_cluster", "cluster")).drop("new_cluster")


def timing_report(times: DataFrame) -> DataFrame:
    """Rows (id_record, items, seconds) with a last one of totals."""
    return times.rollup("id_record").agg(F.sum("items").alias("items"), F.sum("seconds").alias("seconds"))


def database_records(spark: SparkSession, url: str, table: str, key: DataFrame, **options: str) -> DataFrame:
    """Rows of a database table of records (idMeasurementSeries, idSensor, idRecord, path, start_ts) for the keys asked for.

    options are those of Spark's JDBC source: driver, user, partitionColumn and bounds for a parallel read.
    """
    rows = spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()
    return rows.join(key, ["idMeasurementSeries", "idSensor", "idRecord"], "left_semi")


def conflict_files(spark: SparkSession, folder: str) -> list[str]:
    """Paths of a folder's conflict tables, *_conflicts.csv in any case of the c, in order."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*_[Cc]onflicts.csv").load(folder)
    return sorted(r[0] for r in found.select("path").collect())  # a file a record of conflicts


def cluster_means(spark: SparkSession, path: str) -> DataFrame | None:
    """Stored cluster curves, or None where there are none yet and clusters have to be found first."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there):
        return None
    rows = spark.read.schema(schemas.CLUSTER_MEANS).parquet(path)
    return None if rows.isEmpty() else rows


def trajectory_index(spark: SparkSession, *paths: str) -> DataFrame:
    """(path, id_vehicle) of every track in trajectory csv files."""
    raw = spark.read.schema(schemas.TRAJ_POINTS).csv(list(paths), header=True)
    return raw.select(F.input_file_name().alias("path"), F.col("idVehicle").alias("id_vehicle")).distinct()


def write_raw_csv(points: DataFrame, path: str) -> None:
    """Points in the layout of 34 columns, measured and fitted, as csv by record; a column that points lack is empty."""
    fields = [f.split() for f in schemas.TRAJ_POINTS_RAW.split(", ")]
    out = points.select(*((F.col(n) if n in points.columns else F.lit(None)).cast(t).alias(n) for n, t in fields), F.col("idRecord").alias("record"))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("header", True).partitionBy("record").csv(path)


def raw_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("recursiveFileLookup", "true").schema(schemas.TRAJ_POINTS_RAW).csv(path, header=True)


def write_group_scores(scores: DataFrame, path: str) -> None:
    """Scored trajectories as csv, a folder for each pair of clusters (c_a, c_b); groups written again replace themselves."""
    scores.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("header", True).partitionBy("c_a", "c_b").csv(path)


def label_paths(images: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """images (path) with a column for each kind: the path of its file, in the folder that stands for "images" and with that ending."""
    to = lambda kind, ending: F.regexp_replace(F.regexp_replace("path", "/images/", f"/{kind}/"), r"\.[^./]+$", ending)
    return images.withColumns({kind: to(kind, ending) for kind, ending in kinds.items()})
