"""Queries that run the event log as a stream to its end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.plans.alerting import decided
from fleetlens.plans.registry import place, query, table
from fleetlens.streaming import streams as P
from fleetlens.streaming.state import returned


def _events(spark: SparkSession, d: str) -> DataFrame:
    return P.event_stream(spark, d, table(spark, d, "events").schema, pattern="events.parquet")


@query("select event_id, user_id, event_type from events")
def stream_ingest(spark: SparkSession, d: str) -> DataFrame:
    at = place(spark)
    P.ingest(_events(spark, d).select("event_id", "user_id", "event_type", "ts"), f"{at}/rows", ["event_id"], f"{at}/state", "ts")
    return spark.read.parquet(f"{at}/rows").select("event_id", "user_id", "event_type")


def _ended(spark: SparkSession, d: str, build) -> DataFrame:
    """What a stream over all columns has given when a last event in the year 2100 has passed."""
    last = spark.sql("select -1L as event_id, -1L as user_id, 'end' as event_type, timestamp'2100-01-01' as ts")
    e = _events(spark, d)
    missing = [c for c in e.columns if c not in last.columns]
    return P.drain_closed(e, build, last.select("*", *(F.lit(None).alias(c) for c in missing)), place(spark))


def _closed(spark: SparkSession, d: str, build) -> DataFrame:
    """A stream's windows, all of them: a last event in the year 2100 ends the others."""
    e = _events(spark, d).select("ts", "event_type")
    return P.drain_closed(e, build, spark.sql("select timestamp'2100-01-01' as ts, 'end' as event_type"), place(spark))


@query("select time_bucket(interval 1 day, ts) as window_start, event_type, count(*) as n from events group by all")
def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    x = _closed(spark, d, lambda e: P.windowed_counts(e, ["event_type"], "ts", "1 day"))
    return x.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")


@query("""
with w as (select time_bucket(interval 1 hour, ts) - i * interval 1 hour as window_start, event_type from events, (values (0), (1), (2), (3), (4), (5)) t(i))
select window_start, event_type, count(*) as n from w group by all
""")
def stream_sliding(spark: SparkSession, d: str) -> DataFrame:
    x = _closed(spark, d, lambda e: P.windowed_counts(e, ["event_type"], "ts", "6 hours", "1 hour"))
    return x.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")


@query("""
with s as (select event_type, ts, case when ts - lag(ts) over w < interval 30 minute then 0 else 1 end as new from events window w as (partition by event_type order by ts)),
r as (select *, sum(new) over (partition by event_type order by ts rows unbounded preceding) as k from s)
select min(ts) as session_start, event_type, count(*) as n from r group by event_type, k
""")
def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    x = _closed(spark, d, lambda e: P.sessions(e, ["event_type"], "ts", "30 minutes"))
    return x.select(F.col("session_start").cast("timestamp_ntz").alias("session_start"), "event_type", "n")


@query("select distinct user_id, event_type from events")
def stream_dedup(spark: SparkSession, d: str) -> DataFrame:
    at = place(spark)
    return P.drain(P.deduplicated(_events(spark, d), ["user_id", "event_type"], "ts").select("user_id", "event_type"), f"{at}/rows", f"{at}/state")


@query("select cast(user_id as varchar) as key, event_id, cast(floor(epoch(ts)) - floor(epoch(lag(ts) over (partition by user_id order by ts, event_id))) as bigint) as gap_seconds from events")
def stream_gaps(spark: SparkSession, d: str) -> DataFrame:
    return _ended(spark, d, lambda e: P.gap_stream(e, "user_id"))


@query("""
with m as (select *, sum(case when event_type = 'purchase' then 1 else 0 end) over (partition by user_id order by ts, event_id rows unbounded preceding) as after, event_type = 'purchase' as marker from events),
k as (select user_id, event_id, after from m where marker), s as (select user_id, after + 1 as after, count(*) as n from m where not marker group by all)
select cast(k.user_id as varchar) as key, cast(k.after as bigint) as run_no, k.event_id as marker_id, coalesce(n, 0) as steps from k left join s on s.user_id = k.user_id and s.after = k.after
""")
def stream_runs(spark: SparkSession, d: str) -> DataFrame:
    return _ended(spark, d, lambda e: P.run_stream(e, "user_id", F.col("event_type") == "purchase"))


@query("""
with d as (select event_id, ts, case when user_id % 7 = 0 then null else cast(user_id as varchar) end as key from events)
select key, event_id, cast(floor(epoch(ts)) - floor(epoch(lag(ts) over (partition by key order by ts, event_id))) as bigint) as gap_seconds from d
""")
def stream_gaps_by_batch(spark: SparkSession, d: str) -> DataFrame:
    at = place(spark)
    e = _events(spark, d).withColumn("key", F.when(F.col("user_id") % 7 != 0, F.col("user_id")))
    return P.occurrence_gaps(e, f"{at}/rows", f"{at}/state", "key")


@query("""
with m as (select *, case when user_id % 7 = 0 then null else cast(user_id as varchar) end as key, event_type = 'purchase' as marker from events),
a as (select *, sum(marker::int) over (partition by key order by ts, event_id rows unbounded preceding) as after from m),
k as (select key, event_id, after from a where marker), s as (select key, after + 1 as after, count(*) as n from a where not marker group by all)
select k.key, cast(k.after as bigint) as run_no, k.event_id as marker_id, coalesce(n, 0) as steps from k left join s on s.key is not distinct from k.key and s.after = k.after
""")
def stream_runs_by_batch(spark: SparkSession, d: str) -> DataFrame:
    at = place(spark)
    e = _events(spark, d).withColumn("key", F.when(F.col("user_id") % 7 != 0, F.col("user_id")))
    return P.marker_runs(e, f"{at}/rows", f"{at}/state", "key", F.col("event_type") == "purchase")


@query("select cast(user_id as varchar) as key, min(ts) as first_time from events group by 1")
def stream_returned(spark: SparkSession, d: str) -> DataFrame:
    at = place(spark)
    x = P.drain(returned(_events(spark, d), "user_id", "ts", "30 days"), f"{at}/rows", f"{at}/state", idle_batches=False)
    return x.select("key", F.col("first_time").cast("timestamp_ntz").alias("first_time"))


@query(decided(cap=3, minutes=120, repeat=60).replace("select instance, event_id, ts, alert_key, event_type,", "select instance, event_id,"))
def stream_alerts(spark: SparkSession, d: str) -> DataFrame:
    at = place(spark)
    e = _events(spark, d)
    kind = F.when(F.col("event_type") == "error", 1).when(F.col("event_type") == "purchase", 6).otherwise(0)
    rows = e.select((F.col("user_id") % 8).cast("string").alias("instance"), "event_id", "ts", F.concat_ws("|", F.col("user_id").cast("string"), "event_type").alias("alert_key"), kind.alias("event_type"), (F.col("event_type") == "view").alias("ignored"))
    return P.alert_stream(rows, f"{at}/rows", f"{at}/state", cap=3, minutes=120)
