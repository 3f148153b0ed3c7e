"""Tables in the shared folder, for cutting lineage in iterative operators, and bounds of what is broadcast."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table is broadcast up to this many bytes.
BROADCAST_BYTES = 32 << 20
#: Rows that one task sorts, about, where their number is known.
TASK_ROWS = 1_500_000

_own_folder: dict[str, str] = {}
_tracked: list[list[DataFrame]] = []


def scratch_root(spark: SparkSession) -> str:
    """The shared folder from spark.checkpoint.dir; a temporary one only in local mode, where one machine is all there is."""
    given = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if given:
        return given.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_folder:
        _own_folder[app] = "file://" + tempfile.mkdtemp(prefix="waymeet-")
    return _own_folder[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/waymeet/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def store(df: DataFrame, name: str, *, keep: bool = False) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage and survives lost executors.

    keep: a surrounding scratch() leaves the table.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    if _tracked and not keep:
        _tracked[-1].append(out)
    return out


def _delete(spark: SparkSession, path: str) -> None:
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


def discard(df: DataFrame) -> None:
    """Delete the files of a stored table that nothing reads any more."""
    path = getattr(df, "_scratch_path", None)
    if path:
        _delete(df.sparkSession, path)


@contextlib.contextmanager
def scratch() -> Iterator[None]:
    """Tables stored inside are deleted at the end; results that read them must have been written by then."""
    _tracked.append([])
    try:
        yield
    finally:
        for df in _tracked.pop():
            discard(df)


def clean(spark: SparkSession) -> None:
    """Delete all that this application has stored; for the end of a job."""
    _delete(spark, f"{scratch_root(spark)}/waymeet/{spark.sparkContext.applicationId}")


def bounded(df: DataFrame, row_bytes: Column | int = 64, most: int = BROADCAST_BYTES) -> DataFrame:
    """df, to be broadcast if its rows, measured, take at most `most` bytes; row_bytes is what one takes."""
    size = row_bytes if isinstance(row_bytes, Column) else F.lit(row_bytes)
    return F.broadcast(df) if (df.agg(F.sum(size.cast("long"))).first()[0] or 0) <= most else df


def tasks_for(spark: SparkSession, rows: int, each: int = TASK_ROWS) -> int:
    """Partitions to deal rows to: those of a shuffle, or more, so that what a task sorts does not grow with the table."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // each))


def dealt(df: DataFrame, rows: int, *key: str) -> DataFrame:
    """df, dealt by key to as many partitions as so many rows need, where that is more than those of a shuffle."""
    parts = tasks_for(df.sparkSession, rows)
    return df.repartition(parts, *key) if parts > tasks_for(df.sparkSession, 0) else df
