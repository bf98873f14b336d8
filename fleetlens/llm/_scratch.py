"""Intermediate tables in the folder that the whole cluster shares."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the checkpoint folder already set; where neither is set (as in tests on one machine) a temporary one."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if path is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="fleetlens-")
        spark.sparkContext.setCheckpointDir(path)
        path = spark.sparkContext.getCheckpointDir()
    return path


_collecting: list[list[str]] = []


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/fleetlens/{name}-{uuid.uuid4().hex}"
    if _collecting:
        _collecting[-1].append(path)
    return path


def deleted(spark: SparkSession, *paths: str) -> None:
    """Deletes folders, wherever they are; one that is not there is no error."""
    jvm = spark.sparkContext._jvm
    for p in map(jvm.org.apache.hadoop.fs.Path, paths):
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@contextlib.contextmanager
def freed_tables(spark: SparkSession):
    """Intermediate tables that are written meanwhile go at the end; what is read of them must have been written elsewhere by then."""
    paths: list[str] = []
    _collecting.append(paths)
    try:
        yield
    finally:
        _collecting.remove(paths)
        deleted(spark, *paths)


@contextlib.contextmanager
def freed_shuffles(spark: SparkSession):
    """Shuffle files of a write go when it ends, where this Spark can do so; a setting of the session, put back after."""
    try:
        before = spark.conf.get(_CLEANUP)
        spark.conf.set(_CLEANUP, "true")
    except Exception:  # an older Spark has no such setting
        before = None
    try:
        yield
    finally:
        if before is not None:
            spark.conf.set(_CLEANUP, before)


def stored(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """df, written as Parquet to the shared folder and read again: lineage ends there and lost executors cost no rework."""
    spark = df.sparkSession
    path = new_path(spark, name)
    with freed_shuffles(spark):
        df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path) if not partition_by else spark.read.parquet(path)
