"""Incremental ingestion and upkeep of history tables, all as joins: nothing is updated in place."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def incremental(new: DataFrame, stored: DataFrame, by: list[str], mark: str, floor) -> DataFrame:
    """Rows of new beyond the highest stored mark (a time or an id) of their source, or beyond floor where none is stored."""
    high = stored.groupBy(*by).agg(F.max(mark).alias("_high"))
    low = F.lit(floor).cast(new.schema[mark].dataType)
    return new.join(high, by, "left").where(F.col(mark) > F.coalesce("_high", low)).select(*new.columns)


def insert_new(target: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """target with the rows of new whose key it does not have; a key that is new twice comes once."""
    fresh = new.dropDuplicates(keys).join(target.select(*keys), keys, "left_anti")
    return target.unionByName(fresh.select(*target.columns))


def only_new(target: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return new.join(target.select(*keys), keys, "left_anti")


def archive_snapshot(current: DataFrame, history: DataFrame, within: str) -> DataFrame:
    """history with the rows of the current snapshot that a SQL condition picks."""
    return history.unionByName(current.where(within).select(*history.columns))


def replace_slice(target: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """target, with the slices (key values) that new has replaced as a whole."""
    return target.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new.select(*target.columns))


def replace_group(target: DataFrame, primary: str, keys: list[str]) -> DataFrame:
    """target without any row of a group that has a row for which primary (SQL) holds."""
    return target.join(target.where(primary).select(*keys).distinct(), keys, "left_anti")


def upsert(dest: DataFrame, src: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """dest with cols of matching rows taken from src, and the rows that only src has."""
    both = dest.alias("d").join(src.withColumn("_src", F.lit(True)).alias("s"), keys, "full")
    out = [F.col(k) for k in keys]
    for c in dest.columns:
        if c not in keys:
            out.append((F.when(F.col("_src"), F.col(f"s.{c}")).otherwise(F.col(f"d.{c}")) if c in cols else F.coalesce(F.col(f"d.{c}"), F.col(f"s.{c}")) if c in src.columns else F.col(f"d.{c}")).alias(c))
    return both.select(*out).select(*dest.columns)


def _rewritten(spark: SparkSession, path: str, staging: str, day: str, after: DataFrame) -> None:
    """Puts the rows of after in place of the day partitions that it has; other partitions keep their files.

    The rows are written to staging first: a job that fails before the last step has changed nothing, and the last one only moves
    finished files in place, partition by partition.
    """
    after.write.partitionBy(day).parquet(staging)
    ready = spark.read.schema(after.schema).parquet(staging)
    ready.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)


def replace_stored(spark: SparkSession, path: str, new: DataFrame, day: str, staging: str) -> None:
    """replace_slice() for a table stored at path in partitions by day: days that new has rows for are replaced as a whole; nothing stored is read."""
    names = [c for c in spark.read.parquet(path).columns if c != day]
    _rewritten(spark, path, staging, day, new.select(*names, day))


def upsert_stored(spark: SparkSession, path: str, src: DataFrame, keys: list[str], cols: list[str], day: str, staging: str) -> None:
    """upsert() into a table that is stored at path in partitions by day, one of its columns and part of what identifies a row.

    Only partitions that src has rows for are read (the others are pruned when the job runs) and written again.
    """
    schema = spark.read.parquet(path).schema
    dest = spark.read.schema(schema).parquet(path)
    days = src.select(day).distinct()
    touched = dest.join(days, day, "left_semi")
    _rewritten(spark, path, staging, day, upsert(touched, src, [*keys, day], cols).select(*(c for c in schema.names if c != day), day))


def insert_stored(spark: SparkSession, path: str, new: DataFrame, keys: list[str], day: str) -> None:
    """Appends the rows of new whose (keys, day) a stored table does not have; only partitions of their days are read for that."""
    dest = spark.read.parquet(path)
    known = dest.join(new.select(day).distinct(), day, "left_semi")
    only_new(known, new.dropDuplicates([*keys, day]), [*keys, day]).select(*dest.columns).write.mode("append").partitionBy(day).parquet(path)


def purge_stored(spark: SparkSession, path: str, day: str, days: int | None, as_of: str) -> list[str]:
    """Drops the day partitions of a stored table that are older than days before as_of (0 or None: none) and returns their names.

    No file is read: folders are deleted by their names. Partitions of other names stay.
    """
    if not days:
        return []
    last = datetime.date.fromisoformat(as_of[:10]) - datetime.timedelta(days=days)
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    gone = []
    for status in fs.listStatus(root):
        name = status.getPath().getName()
        value = name.partition("=")[2]
        if name.startswith(f"{day}=") and len(value) == 10 and value[:4].isdigit() and value < last.isoformat():
            fs.delete(status.getPath(), True)
            gone.append(name)
    return sorted(gone)


def sync_active(dest: DataFrame, src: DataFrame, keys: list[str], scope: str, active: str = "active") -> DataFrame:
    """Members in scope (SQL) are active if src has them and else not; others stay as they are."""
    seen = src.select(*keys).distinct().withColumn("_seen", F.lit(True))
    x = dest.join(seen, keys, "left")
    return x.withColumn(active, F.when(F.expr(scope), F.coalesce("_seen", F.lit(False))).otherwise(F.col(active))).select(*dest.columns)


def drift(catalog: DataFrame, observed: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that are new (observed only) or gone (in the catalog only), with their status."""
    new = observed.select(*keys).distinct().join(catalog.select(*keys), keys, "left_anti").withColumn("status", F.lit("new"))
    gone = catalog.select(*keys).distinct().join(observed.select(*keys), keys, "left_anti").withColumn("status", F.lit("gone"))
    return new.unionByName(gone)


def seed(dest: DataFrame, defaults: DataFrame, keys: list[str]) -> DataFrame:
    return insert_new(dest, defaults, keys)


def purge(tables: dict[str, DataFrame], policy: dict[str, tuple[str, int | None]], as_of: str) -> dict[str, DataFrame]:
    """Each table without rows older than its days before as_of; 0 or None days keep all, as does a table without a policy."""
    out = {}
    for name, df in tables.items():
        clock, days = policy.get(name, ("", None))
        out[name] = df.where(F.col(clock) >= F.expr(f"timestamp_ntz'{as_of}' - interval {days} days")) if days else df
    return out


def cascade_remove(tables: dict[str, DataFrame], key: dict[str, str], member, owners: tuple[str, str, str] | None = None) -> dict[str, DataFrame]:
    """Every table in key (name to column) without the member's rows; others as they are.

    owners (parent table, its key, child table) also drops parents that have no child any more but had one before.
    """
    out = {n: df.where(~F.col(key[n]).eqNullSafe(F.lit(member))) if n in key else df for n, df in tables.items()}
    if owners:
        parent, k, child = owners
        had = tables[child].select(k).distinct()
        left = out[child].select(k).distinct()
        orphans = had.join(left, k, "left_anti")
        out[parent] = out[parent].join(orphans, k, "left_anti")
    return out
