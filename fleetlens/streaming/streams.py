"""Structured Streaming jobs over the event log.

Windows, sessions and deduplication are Spark's own, closed by watermarks. Gaps and runs keep state by key, with timers (gap_stream(),
run_stream() and state.py), where rows of a key that come between two watermarks fit a task. For a first load of a long history
the same is computed batch by batch with windows, which Spark sorts (occurrence_gaps(), marker_runs()), as alerts are: see carry().
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fleetlens.operators.alerts import decide_alerts
from fleetlens.streaming.state import in_order, rocksdb

Step = Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]]


def event_stream(spark: SparkSession, path: str, schema: StructType, time: str = "ts", pattern: str | None = None, files_a_trigger: int = 1000) -> DataFrame:
    """Parquet files below path as a stream; a time without zone becomes a timestamp, which watermarks need."""
    r = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_trigger)
    r = r.option("pathGlobFilter", pattern) if pattern else r
    return r.parquet(path).withColumn(time, F.col(time).cast("timestamp"))


def windowed_counts(events: DataFrame, keys: list[str], time: str, width: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Counts in tumbling or sliding windows, for append mode: a window is given out and forgotten once it ended late ago; rows later than that are lost."""
    window = F.window(time, width, slide) if slide else F.window(time, width)
    x = events.withWatermark(time, late).groupBy(window, *keys).agg(F.count("*").alias("n"))
    return x.select(F.col("window.start").alias("window_start"), *keys, "n")


def deduplicated(events: DataFrame, keys: list[str], time: str, late: str = "1 hour") -> DataFrame:
    """The first row of each key within the watermark."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def sessions(events: DataFrame, keys: list[str], time: str, gap: str, late: str = "1 hour") -> DataFrame:
    """Runs of events without a pause of gap, for append mode as windowed_counts()."""
    x = events.withWatermark(time, late).groupBy(F.session_window(time, gap), *keys).agg(F.count("*").alias("n"))
    return x.select(F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), *keys, "n")


def _run(writer, spark: SparkSession, idle_batches: bool = True) -> None:
    with rocksdb(spark, idle_batches):
        writer.trigger(availableNow=True).start().awaitTermination()


def drain(stream: DataFrame, target: str, checkpoint: str, mode: str = "append", idle_batches: bool = True) -> DataFrame:
    """Runs a stream over all there is into Parquet below target, and reads that. A stream with timers on the clock's time needs idle_batches False to end."""
    _run(stream.writeStream.format("parquet").outputMode(mode).option("path", target).option("checkpointLocation", checkpoint), stream.sparkSession, idle_batches)
    return stream.sparkSession.read.schema(stream.schema).parquet(target)


def drain_closed(events: DataFrame, build: Callable[[DataFrame], DataFrame], last: DataFrame, path: str, time: str = "ts") -> DataFrame:
    """build(events) in append mode to its very end: when all there is has been read, last (a row far in the future) comes as
    one more event and moves the watermark past all others; what it belongs to itself stays open and is not given out. All is
    kept below path; a job that is started again goes on from there.
    """
    spark = events.sparkSession
    last = last.select(*(F.col(f.name).cast(f.dataType) for f in events.schema))
    last.limit(0).write.mode("append").parquet(f"{path}/closing")
    out = build(events.unionByName(event_stream(spark, f"{path}/closing", last.schema, time)))
    with rocksdb(spark):
        job = out.writeStream.format("parquet").outputMode("append").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state").start()
        try:
            job.processAllAvailable()
            last.write.mode("append").parquet(f"{path}/closing")
            job.processAllAvailable()
        finally:
            job.stop()
    return spark.read.schema(out.schema).parquet(f"{path}/rows")


def ingest(stream: DataFrame, target: str, keys: list[str], checkpoint: str, time: str | None = None) -> None:
    """Appends rows whose keys target does not have yet; the checkpoint keeps what was read. Ends when all there is has been read.

    With time, a column that rows of one key share, a batch looks only at what target has between its first and last time, so
    that a growing target is not read as a whole for each batch.
    """
    spark = stream.sparkSession
    spark.createDataFrame([], stream.schema).write.mode("append").parquet(target)  # so that the first batch finds a table

    def append(batch: DataFrame, _: int) -> None:
        known = spark.read.schema(batch.schema).parquet(target)
        if time:
            first, last = batch.agg(F.min(time), F.max(time)).first()
            known = known.where(F.col(time).between(F.lit(first), F.lit(last)) | F.col(time).isNull())
        known = known.select(*(F.col(k).alias(f"_{k}") for k in keys))
        batch.dropDuplicates(keys).join(known, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "left_anti").write.mode("append").parquet(target)

    _run(stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint), spark)


def carry(stream: DataFrame, target: str, checkpoint: str, step: Step, carried: str, schema: str) -> DataFrame:
    """Runs step(batch, state) -> (rows, next state) over all micro-batches; state is a small table (carried) of what later rows need.

    Rows and state are written by the number of their batch, over what a failed try may have left, so a batch that is run again
    gives the same. No group is held in a Python worker: a step is DataFrame code, in which a large key is sorted by Spark.
    """
    spark = stream.sparkSession
    read = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet
    spark.createDataFrame([], schema).write.mode("append").parquet(f"{target}/batch-none")

    def run(batch: DataFrame, number: int) -> None:
        state = spark.read.schema(carried).parquet(f"{checkpoint}-carried/{number - 1}") if number else spark.createDataFrame([], carried)
        rows, after = step(batch, state)
        rows.write.mode("overwrite").parquet(f"{target}/batch-{number}")
        after.write.mode("overwrite").parquet(f"{checkpoint}-carried/{number}")
        old = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}-carried/{number - 2}")  # a batch may be run again, the one before it not
        old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)

    _run(stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint), spark)
    return read(target)


def _unexpired(rows: DataFrame, time: str, keep: str | None) -> DataFrame:
    """Rows not older than keep (an interval) before the newest one."""
    if keep is None:
        return rows
    newest = rows.agg(F.max(time).alias("_newest"))
    return rows.join(F.broadcast(newest), F.col(time) >= F.col("_newest") - F.expr(f"interval {keep}")).drop("_newest")  # one row


def gap_stream(events: DataFrame, key: str, time: str = "ts", id_col: str = "event_id", late: str = "1 hour", keep: str | None = None) -> DataFrame:
    """A stream (key, event_id, gap_seconds): seconds since the event before of the same key, in order of time; null for the first,
    and for one that comes more than keep after the last.
    """

    def step(kept, row):
        return (row[0],), (row[1], None if kept is None else row[0] // 1000000 - kept[0] // 1000000)

    return in_order(events, key, time, step, "at long", "event_id long, gap_seconds long", late, keep, id_col)


def run_stream(events: DataFrame, key: str, marker: Column, time: str = "ts", id_col: str = "event_id", late: str = "1 hour", keep: str | None = None) -> DataFrame:
    """A stream (key, run_no, marker_id, steps): closes a run of a key at each marker, with the rows since the marker before, in
    order of time. After a silence of more than keep a key starts anew, with run 1 and without what was open.
    """

    def step(kept, row):
        _, steps, number = kept or (0, 0, 0)
        return ((row[0], 0, number + 1), (number + 1, row[1], steps)) if row[2] else ((row[0], steps + 1, number), None)

    return in_order(events, key, time, step, "at long, steps long, number long", "run_no long, marker_id long, steps long", late, keep, id_col, marker)


def occurrence_gaps(events: DataFrame, target: str, checkpoint: str, key: str, time: str = "ts", id_col: str = "event_id", keep: str | None = None) -> DataFrame:
    """(key, event_id, gap_seconds): seconds since the event before of the same key, over batches; events of a batch are taken in order of time.

    The last event of each key is carried on, for as long as it is not older than keep before the newest one.
    """

    def step(batch: DataFrame, last: DataFrame) -> tuple[DataFrame, DataFrame]:
        x = batch.select(F.col(key).cast("string").alias("key"), F.col(id_col).alias("event_id"), F.col(time).cast("timestamp").alias("time"), F.lit(True).alias("new"))
        x = x.unionByName(last.withColumn("new", F.lit(False)))
        seconds = F.unix_seconds("time")
        w = Window.partitionBy("key").orderBy("new", "time", "event_id")
        rows = x.withColumn("gap_seconds", seconds - F.lag(seconds).over(w)).where("new").select("key", "event_id", "gap_seconds")
        after = x.groupBy("key").agg(F.max(F.struct("new", "time", "event_id")).alias("m")).select("key", "m.event_id", "m.time")
        return rows, _unexpired(after, "time", keep)

    return carry(events, target, checkpoint, step, "key string, event_id long, time timestamp", "key string, event_id long, gap_seconds long")


def marker_runs(events: DataFrame, target: str, checkpoint: str, key: str, marker: Column, time: str = "ts", keep: str | None = None) -> DataFrame:
    """(key, run_no, marker_id, steps): closes a run of a key at each marker, with the rows since the marker before, over batches."""

    def step(batch: DataFrame, before: DataFrame) -> tuple[DataFrame, DataFrame]:
        x = batch.select(F.col(key).cast("string").alias("key"), "event_id", F.col(time).cast("timestamp").alias("time"), marker.alias("marker"))
        w = Window.partitionBy("key").orderBy("time", "event_id").rowsBetween(Window.unboundedPreceding, 0)
        x = x.withColumn("others", F.count(F.when(~F.col("marker"), 1)).over(w)).withColumn("run", F.count(F.when(F.col("marker"), 1)).over(w))
        state = before.select("key", F.col("open").alias("_open"), F.col("number").alias("_number"))
        at = Window.partitionBy("key").orderBy("run")
        closed = x.where("marker").join(state.withColumnRenamed("key", "_key"), F.col("key").eqNullSafe(F.col("_key")), "left").drop("_key").withColumn("steps", F.col("others") - F.coalesce(F.lag("others").over(at), -F.coalesce("_open", F.lit(0))))
        rows = closed.select("key", (F.col("run") + F.coalesce("_number", F.lit(0))).alias("run_no"), F.col("event_id").alias("marker_id"), "steps")
        sums = x.groupBy(F.col("key").alias("_key")).agg(F.max("others").alias("o"), F.max("run").alias("r"), F.max(F.when(F.col("marker"), F.col("others"))).alias("c"), F.max("time").alias("t"))
        after = before.withColumn("_had", F.lit(True)).join(sums, F.col("key").eqNullSafe(F.col("_key")), "full").select(
            F.when(F.col("_had"), F.col("key")).otherwise(F.col("_key")).alias("key"), (F.coalesce("o", F.lit(0)) - F.coalesce("c", -F.coalesce("open", F.lit(0)))).alias("open"), (F.coalesce("number", F.lit(0)) + F.coalesce("r", F.lit(0))).alias("number"), F.coalesce("t", "time").alias("time")
        )
        return rows, _unexpired(after, "time", keep)

    return carry(events, target, checkpoint, step, "key string, open long, number long, time timestamp", "key string, run_no long, marker_id long, steps long")


def alert_stream(events: DataFrame, target: str, checkpoint: str, cap: int = 50, minutes: int = 5, repeat_minutes: int = 60) -> DataFrame:
    """Suppression and flood control on a stream: the batch rules; what was sent within the limits is carried on, older events go."""
    fields = "instance string, event_id long, ts timestamp_ntz, alert_key string, event_type int"

    def step(batch: DataFrame, sent: DataFrame) -> tuple[DataFrame, DataFrame]:
        done = decide_alerts(batch.withColumn("ts", F.col("ts").cast("timestamp_ntz")), cap, minutes, repeat_minutes, sent)
        names = [x.split()[0] for x in fields.split(", ")]
        after = done.where("is_sent").select(*names).unionByName(sent.select(*names))
        return done.select("instance", "event_id", "is_sent", "flood_control"), _unexpired(after, "ts", f"{max(minutes, repeat_minutes) + 1} minutes")

    return carry(events, target, checkpoint, step, fields, "instance string, event_id long, is_sent boolean, flood_control boolean")
