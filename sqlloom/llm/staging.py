"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sqlloom.session import ship_package


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where it is unset, a temporary one in local mode, else an error."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        path = getattr(spark.sparkContext, "_sqlloom_dir", None)
        if not path:
            if spark.sparkContext.master.partition("[")[0] != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            path = "file://" + tempfile.mkdtemp(prefix="sqlloom-")
            spark.sparkContext._sqlloom_dir = path
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(path)
    return path


def _file_system(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def stage(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lost executors recompute nothing before it.

    The table is deleted by ``drop``, or when the driver's JVM ends, since the returned frame is lazy.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sqlloom-{uuid.uuid4().hex}-{name}"
    df.write.parquet(path)
    target, files = _file_system(spark, path)
    files.deleteOnExit(target)
    out = spark.read.schema(df.schema).parquet(path)
    out._sqlloom_path = path
    return out


def drop(*frames: DataFrame) -> None:
    """Delete staged tables that nothing reads any more, and the shuffle files of plans that are gone."""
    for df in frames:
        target, files = _file_system(df.sparkSession, df._sqlloom_path)
        files.delete(target, True)
    if frames:
        release(frames[0].sparkSession)


def release(spark: SparkSession, wait: float = 0) -> None:
    """Let Spark's cleaner delete the shuffle files of plans that nothing refers to; it learns of them from the collectors.

    Listeners may still refer to a plan that has just ended; before large shuffles, ``wait`` (seconds) lets them catch up, and a small query takes that plan's place where the last one is held.
    """
    if wait:
        time.sleep(wait)
        spark.range(1).count()
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a checkpoint in the shared folder; for small frames."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def broadcast_if(df: DataFrame, limit: int) -> DataFrame:
    """``df`` hinted for broadcast where it is counted to have at most ``limit`` rows; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def in_arrow(df: DataFrame, run: Callable, schema: str | StructType) -> DataFrame:
    """``df.mapInArrow`` where executors may not have this package yet."""
    ship_package(df.sparkSession)
    return df.mapInArrow(run, schema)


def batches_of(spark: SparkSession, rows: int):
    """Jobs started within hand Arrow maps at most so many rows at once, which bounds their buffers on both sides."""
    return _with_conf(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def shuffles_cleaned(spark: SparkSession):
    """Tables staged within have their shuffle files deleted as soon as they are written, whatever the collectors do.

    A frame that is made within and read outside is not concerned.
    """
    return _with_conf(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


@contextmanager
def _with_conf(spark: SparkSession, key: str, value: str | int) -> Iterator[None]:
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
