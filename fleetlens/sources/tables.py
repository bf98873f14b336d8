"""Reading and writing telemetry: tables, several sources at once, payloads and delimited lines."""

from __future__ import annotations

import datetime
from time import time as now
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Tables of the star schema and the event log.
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def load(spark: SparkSession, path: str, names: tuple[str, ...] = TABLES) -> dict[str, DataFrame]:
    """The named Parquet tables below path; nothing is read before it is used."""
    return {n: spark.read.parquet(f"{path}/{n}.parquet") for n in names}


def load_jdbc(spark: SparkSession, url: str, table: str, partition_column: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 16, **options: str) -> DataFrame:
    """A table of a live repository, in parts by a numeric column if one is named; filters are pushed to the source.

    Without bounds the source is asked for the column's least and largest value first; they only say where parts end, so rows
    that come meanwhile are read too. An empty table is one part.
    """
    r = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if partition_column and bounds is None:
        ends = spark.read.format("jdbc").options(url=url, query=f"select min({partition_column}) as low, max({partition_column}) as high from {table}", **options).load().first()
        bounds = None if ends[0] is None else (int(ends[0]), int(ends[1]) + 1)
    if partition_column and bounds:
        r = r.options(partitionColumn=partition_column, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=parts)
    return r.load()


def pull_jdbc(spark: SparkSession, url: str, table: str, mark: str, after: int | None, parts: int = 16, **options: str) -> DataFrame:
    """Rows of a live table whose mark, a rising number, is beyond `after` (None: all): the source filters, and reads in parts of the marks that are new."""
    new = table if after is None else f"(select * from {table} where {mark} > {int(after)}) new_rows"
    return load_jdbc(spark, url, new, mark, None, parts, **options)


def fan_in(sources: dict[str, Callable[[], DataFrame]], tag: str = "source_name") -> tuple[DataFrame | None, list[tuple[str, str]]]:
    """The same extract of every source, tagged and put together; and (source, error) for each that could not be opened."""
    out, errors = None, []
    for name, read in sources.items():
        try:
            df = read().withColumn(tag, F.lit(name))
            df.schema  # noqa: B018  resolves the source
        except Exception as e:  # one source must not stop the others
            errors.append((name, str(e).splitlines()[0][:500]))
            continue
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out, errors


def collect_sources(spark: SparkSession, sources: dict[str, Callable[[], DataFrame]], target: str, descriptor: str, tag: str = "source_name") -> tuple[DataFrame | None, DataFrame]:
    """The same extract of every source, and error_rows() of those that failed, while opened or while read.

    Each source is written below target with a commit of its own, so one that fails after any number of rows leaves none of them
    and one error row, and the others arrive. A source that failed can be collected again into another target.
    """
    out, errors = None, []
    for i, (name, read) in enumerate(sources.items()):
        path = f"{target}/source-{i}"
        try:
            df = read().withColumn(tag, F.lit(name))
            df.write.parquet(path)
        except Exception as e:  # one source must not stop the others
            errors.append((name, str(e).splitlines()[0][:500]))
            continue
        part = spark.read.schema(df.schema).parquet(path)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out, error_rows(spark, errors, descriptor)


def error_rows(spark: SparkSession, errors: list[tuple[str, str]], descriptor: str) -> DataFrame:
    """Dead-letter rows (source_name, descriptor, message)."""
    return spark.createDataFrame([(s, descriptor, m) for s, m in errors], "source_name string, descriptor string, message string")


def parse_lines(df: DataFrame, column: str, names: list[tuple[str, str]], separator: str = "|") -> tuple[DataFrame, DataFrame]:
    """Delimited lines as typed columns (name, type), and the rows whose line does not fit, null ones too, as dead letters: one parse, no shuffle."""
    parts = F.split(F.col(column), f"\\Q{separator}\\E", -1)
    x = df.withColumn("_parts", parts)
    for i, (name, kind) in enumerate(names):
        x = x.withColumn(name, F.trim(F.get("_parts", F.lit(i))).try_cast(kind))
    ok = F.coalesce(F.size("_parts") == len(names), F.lit(False))
    for name, _ in names:
        ok = ok & F.col(name).isNotNull()
    return x.where(ok).drop("_parts"), x.where(~ok).select(*df.columns)


def parse_fixed(df: DataFrame, column: str, fields: list[tuple[str, int, int, str]]) -> DataFrame:
    """Fixed-offset lines: (name, start from 1, length, type)."""
    return df.withColumns({n: F.trim(F.substring(F.col(column), s, k)).try_cast(t) for n, s, k, t in fields})


def shred(df: DataFrame, column: str, schema: StructType | str, prefix: str = "") -> DataFrame:
    """XML payloads as typed columns; a payload that is no XML gives nulls."""
    x = df.withColumn("_x", F.from_xml(F.col(column), schema))
    names = x.schema["_x"].dataType.names
    return x.select(*df.columns, *(F.col(f"_x.`{n}`").alias(prefix + n) for n in names))


def shred_json(df: DataFrame, column: str, schema: str) -> DataFrame:
    """JSON payloads as typed columns."""
    return df.withColumn("_x", F.from_json(F.col(column), schema)).select(*df.columns, "_x.*")


def pivot_properties(df: DataFrame, keys: list[str], bag: str, names: list[str]) -> DataFrame:
    """A property bag <Object><Property Name="..">value</Property>..</Object> as one row of columns per key."""
    schema = "Property array<struct<_Name: string, _VALUE: string>>"
    x = df.select(*keys, F.explode(F.from_xml(F.col(bag), schema)["Property"]).alias("p"))
    return x.groupBy(*keys).agg(*(F.max(F.when(F.col("p._Name") == n, F.col("p._VALUE"))).alias(n) for n in names))


def to_payload(fields: list[str], root: str = "detail") -> Column:
    """An XML payload of columns; nulls are left out."""
    parts = [F.coalesce(F.concat(F.lit(f"<{f}>"), F.replace(F.replace(F.col(f).cast("string"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(f"</{f}>")), F.lit("")) for f in fields]
    return F.concat(F.lit(f"<{root}>"), *parts, F.lit(f"</{root}>"))


def write_daily(df: DataFrame, time: str, path: str) -> None:
    """Appends by day partitions; dynamic overwrite replaces only the days that df has."""
    df.withColumn("day", F.to_date(time)).write.partitionBy("day").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def missing_days(df: DataFrame, time: str, first: str, last: str) -> DataFrame:
    """Days from first to last without a row."""
    days = df.sparkSession.sql(f"select explode(sequence(date'{first}', date'{last}')) as day")
    return days.join(df.select(F.to_date(time).alias("day")).distinct(), "day", "left_anti")


def save_report(sections: dict[str, DataFrame], path: str, project: str, flags: int) -> DataFrame:
    """Each section as a Parquet folder below path, and one row more in path/runs: when the run was built, in how many ms, and its issues by section."""
    spark = next(iter(sections.values())).sparkSession
    began = now()
    counts = {}
    for name, df in sections.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
        counts[name] = spark.read.parquet(f"{path}/{name}").count()
    row = (project, flags, datetime.datetime.fromtimestamp(began, datetime.timezone.utc).replace(tzinfo=None), int((now() - began) * 1000), counts)
    run = spark.createDataFrame([row], "project string, flags int, build_at timestamp_ntz, build_duration_ms long, issues map<string,long>")
    run.write.mode("append").parquet(f"{path}/runs")
    return run


def step_rows(df: DataFrame, keys: list[str], column: str, item: str, schema: str, number: str | None = None) -> DataFrame:
    """A row for each repeated element of an XML payload, such as the steps of a job's history; number names its position, from 1."""
    x = df.select(*keys, F.posexplode(F.from_xml(F.col(column), f"{item} array<struct<{schema}>>")[item]).alias("_i", "_s"))
    return x.select(*keys, *([(F.col("_i") + 1).cast("long").alias(number)] if number else []), "_s.*")
