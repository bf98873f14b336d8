"""Aggregations, windows, run slicing and top-N used by reports and alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.functions.times import boundary_diff


def exact(c: str | Column, scale: int = 2) -> Column:
    """A double as decimal, so that sums do not depend on their order."""
    return (F.col(c) if isinstance(c, str) else c).cast(f"decimal(18,{scale})")


def first_and_last(df: DataFrame, keys: list[str], time: str, values: list[str], tie: str) -> DataFrame:
    """For each key first_ and last_ values by time, ties by tie; one partial aggregation, no sort."""
    row = F.struct(time, tie, *values)
    x = df.groupBy(*keys).agg(F.min(row).alias("_f"), F.max(row).alias("_l"))
    return x.select(*keys, *(F.col(f"_f.{v}").alias(f"first_{v}") for v in values), *(F.col(f"_l.{v}").alias(f"last_{v}") for v in values))


def newest(df: DataFrame, keys: list[str], time: str, tie: str) -> DataFrame:
    """The newest row of each key."""
    others = [c for c in df.columns if c not in keys]
    x = df.groupBy(*keys).agg(F.max(F.struct(time, tie, F.struct(*others).alias("_row"))).alias("_n"))
    return x.select(*keys, "_n._row.*").select(*df.columns)


def gaps(df: DataFrame, keys: list[str], time: str, tie: str, unit: str = "hour") -> DataFrame:
    """df with sequence (1 is the newest) and gap: boundaries of the unit since the row before; null for the first."""
    w = Window.partitionBy(*keys).orderBy(time, tie)
    back = Window.partitionBy(*keys).orderBy(F.col(time).desc(), F.col(tie).desc())
    return df.withColumn("gap", boundary_diff(unit, F.lag(time).over(w), F.col(time))).withColumn("sequence", F.row_number().over(back))


def newest_two(df: DataFrame, keys: list[str], time: str, tie: str) -> DataFrame:
    """The newest row of each key, with the time of the one before as _before. No task keeps more than two rows of a key before it shuffles."""
    w = Window.partitionBy(*keys).orderBy(F.col(time).desc(), F.col(tie).desc())
    x = df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= 2)
    row = F.struct(*(c for c in df.columns if c not in keys))
    x = x.groupBy(*keys).agg(F.max_by(row, -F.col("_n")).alias("_row"), F.max(F.when(F.col("_n") == 2, F.col(time))).alias("_before"))
    return x.select(*keys, "_row.*", "_before").select(*df.columns, "_before")


def position_and_total(df: DataFrame, owner: list[str], order: list[Column]) -> DataFrame:
    """df with row_no and row_count inside the owner's section."""
    return df.withColumn("row_no", F.row_number().over(Window.partitionBy(*owner).orderBy(*order))).withColumn("row_count", F.count("*").over(Window.partitionBy(*owner)))


def top_per_owner(df: DataFrame, owner: list[str], order: list[Column], most: int) -> DataFrame:
    """The first rows of each owner; 0 is no cap. Spark keeps no more than most rows of a partition before it shuffles."""
    if not most:
        return df
    return df.withColumn("row_no", F.row_number().over(Window.partitionBy(*owner).orderBy(*order))).where(F.col("row_no") <= most)


def largest(df: DataFrame, value: str, tie: list[str], most: int) -> DataFrame:
    """The most rows with the largest values of all, in that order."""
    return df.orderBy(F.col(value).desc(), *tie).limit(most)


def last_occurrence(df: DataFrame, keys: list[str], message: str, time: str) -> DataFrame:
    """Last time of each message of a key, and how often it came."""
    return df.groupBy(*keys, message).agg(F.max(time).alias("last_time"), F.count("*").alias("occurrences"))


def pivot_sums(df: DataFrame, keys: list[str], kind: str, value: Column, kinds: dict[str, str]) -> DataFrame:
    """A sum a kind, as columns; a kind without rows is 0."""
    sums = [F.coalesce(F.sum(F.when(F.col(kind) == k, value)), F.lit(0)).alias(name) for k, name in kinds.items()]
    return df.groupBy(*keys).agg(*sums)


def distinct_list(df: DataFrame, keys: list[str], value: str, name: str, separator: str = ", ") -> DataFrame:
    """Distinct values of a key, in order, joined."""
    return df.groupBy(*keys).agg(F.array_join(F.sort_array(F.collect_set(value)), separator).alias(name))


def max_or_open(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """The largest value; null, which stands for more than any, if one is null."""
    return df.groupBy(*keys).agg(F.when(~F.bool_or(F.col(value).isNull()), F.max(value)).alias(name))


def blocking_degree(df: DataFrame, session: str, blocker: str, keys: list[str]) -> DataFrame:
    """Each session that blocks others or is blocked, with how many wait for it."""
    waits = df.where(F.col(blocker).isNotNull() & (F.col(blocker) != F.col(session)))
    blockers = waits.groupBy(*keys, F.col(blocker).alias("session")).agg(F.count("*").alias("waiters"))
    blocked = waits.select(*keys, F.col(session).alias("session"), F.lit(0).cast("long").alias("waiters"))
    return blockers.unionByName(blocked).groupBy(*keys, "session").agg(F.max("waiters").alias("waiters"))


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """A row (table_name, n_rows) for each table."""
    parts = [t.agg(F.lit(n).alias("table_name"), F.count("*").alias("n_rows")) for n, t in sorted(tables.items())]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def run_slices(df: DataFrame, keys: list[str], marker: Column, order: list[str]) -> DataFrame:
    """Rows of the current run (after the last marker) and of the last finished run (between the last two), as run_state.

    The last two markers of a key are found first, of which a task keeps no more before it shuffles, and told to the key's rows by
    a join, so no task sorts the history of a key. Markers themselves are left out, and a key without one has a current run only.
    """
    at = F.struct(*order)
    marks = df.where(marker).select(*(F.col(k).alias(f"_{k}") for k in keys), at.alias("_at"))
    newest = Window.partitionBy(*(f"_{k}" for k in keys)).orderBy(F.col("_at").desc())
    marks = marks.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= 2)
    marks = marks.groupBy(*(f"_{k}" for k in keys)).agg(F.max("_at").alias("_last"), F.max(F.when(F.col("_n") == 2, F.col("_at"))).alias("_one_before"))
    x = df.where(~marker).join(marks, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "left")
    state = F.when(F.col("_last").isNull() | (at > F.col("_last")), "current").when(F.col("_one_before").isNull() | (at > F.col("_one_before")), "finished")
    return x.withColumn("run_state", state).where("run_state is not null").select(*df.columns, "run_state")


def with_group_count(df: DataFrame, keys: list[str], name: str = "group_count") -> DataFrame:
    """df with the number of rows of its group."""
    return df.withColumn(name, F.count("*").over(Window.partitionBy(*keys)))


def rollup_twice(df: DataFrame, inner: list[str], outer: list[str], value: Column) -> DataFrame:
    """Sums by inner keys, then groups and total of those by outer keys."""
    x = df.groupBy(*inner).agg(F.sum(value).alias("_sum"))
    return x.groupBy(*outer).agg(F.count("*").alias("n_groups"), F.sum("_sum").alias("total"), F.max("_sum").alias("largest"))


def arg_max(df: DataFrame, keys: list[str], value: str, order: list[str], name: str) -> DataFrame:
    """The value of the row that is last by order."""
    return df.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias(name))


def ranked(df: DataFrame, order: list[Column], name: str, path: str) -> DataFrame:
    """df with its rows' places in order over all rows, from 1, without one task that sees them all.

    Rows go to ranges of the order, are sorted there and written to path with their place in the range; a range starts behind the
    rows of those before it. The driver gets a number a range. Rows that tie in all of order get places next to each other.
    """
    spark = df.sparkSession
    x = df.repartitionByRange(*order).sortWithinPartitions(*order)
    x = x.withColumns({"_range": F.spark_partition_id(), name: F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) + 1})
    x.write.parquet(path)
    rows = spark.read.schema(x.schema).parquet(path)
    before, total = [], 0
    for r in sorted(rows.groupBy("_range").count().collect()):
        before.append((r["_range"], total))
        total += r["count"]
    starts = spark.createDataFrame(before, "_range int, _before long")
    return rows.join(F.broadcast(starts), "_range").select(*df.columns, (F.col("_before") + F.col(name)).alias(name))  # a row a range
