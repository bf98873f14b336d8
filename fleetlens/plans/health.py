"""Queries of health rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.operators import frames
from fleetlens.operators import health as H
from fleetlens.operators.filters import Sections
from fleetlens.plans.registry import place, query, table
from fleetlens.sources.tables import save_report


def _parts(spark: SparkSession, d: str) -> DataFrame:
    """Per part: data and log size, and percent used, from its lines."""
    q = F.col("l_quantity").cast("long")
    x = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.sum(F.when(F.col("l_linestatus") == "O", q)).alias("data_size"), F.sum(F.when(F.col("l_linestatus") == "F", q)).alias("log_size"), F.count("*").alias("n"))
    return x.select("l_partkey", F.coalesce("data_size", F.lit(0)).cast("double").alias("data_size"), F.coalesce("log_size", F.lit(0)).cast("double").alias("log_size"), (F.col("l_partkey") % 100).cast("double").alias("used"))


_PARTS = """with p as (
  select l_partkey, cast(coalesce(sum(cast(l_quantity as bigint)) filter (l_linestatus = 'O'), 0) as double) as data_size, cast(coalesce(sum(cast(l_quantity as bigint)) filter (l_linestatus = 'F'), 0) as double) as log_size,
    cast(l_partkey % 100 as double) as used from lineitem group by 1)
"""


@query("select user_id, event_type, max(ts) as last_time, count(*) as occurrences from events join supplier on s_suppkey = user_id where s_acctbal <= 2000 group by all")
def offline_instances(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "supplier").select(F.col("s_suppkey").alias("user_id"), (F.col("s_acctbal") > 2000).alias("active"))
    return H.offline(m, table(spark, d, "events").select("user_id", "event_type", "ts"), "user_id", "active", "event_type", "ts")


@query("select s_nationkey, count(*) as n, count(c_custkey) as matched from supplier left join customer on c_custkey = s_suppkey and c_nationkey = s_nationkey group by 1")
def online_pairs(spark: SparkSession, d: str) -> DataFrame:
    s, c = table(spark, d, "supplier"), table(spark, d, "customer")
    return s.join(c, (F.col("c_custkey") == F.col("s_suppkey")) & (F.col("c_nationkey") == F.col("s_nationkey")), "left").groupBy("s_nationkey").agg(F.count("*").alias("n"), F.count("c_custkey").alias("matched"))


@query("""
select s_suppkey, coalesce(n, 0) as n_databases, b as size_total from supplier left join (select c_custkey % 100 as k, count(*) as n, cast(sum(cast(c_acctbal as decimal(18,2))) as double) as b from customer where c_custkey % 100 < 80 group by 1) on k = s_suppkey where s_acctbal > 2000
""")
def online_instances(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "supplier").withColumn("active", F.col("s_acctbal") > 2000)
    c = table(spark, d, "customer").withColumn("s_suppkey", F.when(F.col("c_custkey") % 100 < 80, F.col("c_custkey") % 100))
    return H.online(m, c, "s_suppkey", "active", frames.exact("c_acctbal")).select("s_suppkey", "n_databases", F.col("size_total").cast("double").alias("size_total"))


@query("select c_custkey, (select count(*) from orders where o_custkey = c_custkey) as orders, (select count(*) from events where user_id = c_custkey) as events from customer")
def availability_counters(spark: SparkSession, d: str) -> DataFrame:
    facts = {"orders": table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "events": table(spark, d, "events").select(F.col("user_id").alias("c_custkey"))}
    return H.availability(table(spark, d, "customer").select("c_custkey"), "c_custkey", facts)


@query("select s_nationkey, s_suppkey % 2 = 0 as role, count(distinct l_partkey) as n_databases from lineitem join supplier on s_suppkey = l_suppkey group by all")
def replica_overview(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select("s_suppkey", "s_nationkey", (F.col("s_suppkey") % 2 == 0).alias("role"))
    x = table(spark, d, "lineitem").join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    return H.replica_overview(x, ["s_nationkey"], "role", "l_partkey")


@query("""
with x as (select user_id, json_extract_string(props, '$.k') as message, max(ts) as last_time from events where event_type = 'error' group by all)
select user_id, message, last_time, count(*) over (partition by user_id) as n_messages from x
""")
def error_digest(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").where("event_type = 'error'").select("user_id", F.get_json_object("props", "$.k").alias("message"), "ts")
    return H.error_digest(e, "user_id", "message", "ts").select("user_id", "message", "last_time", "n_messages")


@query("select event_id from events where event_type in ('error', 'signup') and ts >= timestamp '2024-01-30' - interval 48 hour")
def failed_recent(spark: SparkSession, d: str) -> DataFrame:
    return H.failed_recent(table(spark, d, "events").withColumn("local", F.col("ts")), "event_type", ("error", "signup"), "ts", "local", 48, "2024-01-30 00:00:00").select("event_id")


@query("select event_id, value from events where event_type = 'view' and value * 60 >= 2 * 3600")
def long_running(spark: SparkSession, d: str) -> DataFrame:
    return H.long_running(table(spark, d, "events"), F.col("event_type") == "view", F.col("value") * 60, 2).select("event_id", "value")


@query("""
with x as (select source, regexp_extract(text, '([A-Za-z]+)[.] ', 1) as login_name, lang as reason from documents),
g as (select source, login_name, reason, count(*) as n from x where login_name <> '' group by all having count(*) >= 2)
select * exclude (row_no) from (select *, row_number() over (partition by source order by n desc, login_name, reason) as row_no from g) where row_no <= 5
""")
def failed_text_groups(spark: SparkSession, d: str) -> DataFrame:
    login = F.nullif(F.regexp_extract("text", r"([A-Za-z]+)[.] ", 1), F.lit(""))
    return H.failed_logins(table(spark, d, "documents"), "source", login, F.col("lang"), 2, 5).drop("row_no")


@query("""
with m as (select c_custkey, c_name, c_nationkey, c_mktsegment, max(o_orderdate) as t from customer left join orders on o_custkey = c_custkey group by all),
a as (select *, t is null or date_diff('day', t, date '2001-08-01') > 90 as old from m)
select c_custkey, t as last_time from a where old and not exists (select 1 from a f where not f.old and f.c_mktsegment = 'BUILDING' and f.c_nationkey = a.c_nationkey and f.c_mktsegment = a.c_mktsegment)
""")
def outdated_members(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("last_time"))
    m = table(spark, d, "customer").join(o, F.col("o_custkey") == F.col("c_custkey"), "left")
    return H.outdated(m, "c_name", "last_time", "2001-08-01", 90, 14, ["c_nationkey", "c_mktsegment"], F.col("c_mktsegment") == "BUILDING").select("c_custkey", "last_time")


@query("select p_partkey from part where p_size % 7 = 0 or p_size % 11 = 0")
def flagged_members(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", (F.col("p_size") % 7 == 0).alias("auto_close"), F.when(F.col("p_size") % 11 == 0, True).alias("auto_shrink"))
    return H.flagged(p, "auto_close", "auto_shrink").select("p_partkey")


@query("select o_orderkey from orders where case when o_custkey % 120 >= 90 then o_orderstatus <> 'F' else o_orderstatus = 'O' end")
def weak_verify(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 120).alias("level"), F.when(F.col("o_orderstatus") == "F", "CHECKSUM").when(F.col("o_orderstatus") == "O", "NONE").otherwise("TORN").alias("option"))
    return H.weak_verify(x, "option", "level").select("o_orderkey")


@query("""
with s as (select s_nationkey, s_acctbal as free, s_acctbal * 3 as total, case when s_suppkey % 3 = 0 then null else s_acctbal / 100 end as pct from supplier where s_nationkey in (select c_nationkey from customer where c_acctbal > 9000))
select s_nationkey, max(total) as total_mb, min(free) as available_mb, min(pct) as percent_available from s where pct < 10 or (pct is null and free < 3000) group by 1
""")
def low_capacity(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select("s_nationkey", F.col("s_acctbal").alias("free"), (F.col("s_acctbal") * 3).alias("total"), F.when(F.col("s_suppkey") % 3 != 0, F.col("s_acctbal") / 100).alias("pct"))
    hosted = table(spark, d, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("s_nationkey"))
    return H.low_disk(s, hosted, ["s_nationkey"], "pct", "free", "total", 10.0, 3000.0)


@query(_PARTS + "select l_partkey, log_size, (100 - used) * log_size / 100 as reclaimable from p where log_size >= 450")
def size_outliers(spark: SparkSession, d: str) -> DataFrame:
    return H.size_outliers(_parts(spark, d), "log_size", 450, "used").select("l_partkey", "log_size", "reclaimable")


@query(_PARTS + "select l_partkey, (100 - used) * data_size / 100 as reclaimable from p where data_size >= 300 and used <= 50 and (100 - used) * data_size / 100 >= 200")
def low_usage(spark: SparkSession, d: str) -> DataFrame:
    return H.low_usage(_parts(spark, d), "data_size", "used", 300, 50, 200).select("l_partkey", "reclaimable")


@query(_PARTS + "select l_partkey from p where used >= 80 and (100 - used) * log_size / 100 >= 20")
def high_log_usage(spark: SparkSession, d: str) -> DataFrame:
    return H.high_log_usage(_parts(spark, d), "log_size", "used", 80, 20).select("l_partkey")


@query(_PARTS + "select l_partkey, log_size / data_size as log_data_ratio from p where data_size <> 0 and log_size / data_size > 1.5")
def ratio_outliers(spark: SparkSession, d: str) -> DataFrame:
    return H.log_ratio(_parts(spark, d), "log_size", "data_size", 1.5).select("l_partkey", "log_data_ratio")


@query("""
with x as (select event_id, user_id, event_type, ts from events where ts >= timestamp '2024-01-30' - interval 240 hour and not (event_type ilike 'sign%' or event_type ilike '%ick')),
n as (select *, row_number() over (partition by user_id order by ts desc, event_id) as row_no, count(*) over (partition by user_id) as row_count from x)
select event_id, row_no, row_count from n where row_no <= 3
""")
def log_issues(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("local", F.col("ts"))
    return H.log_issues(e, "user_id", "event_type", "ts", "local", ["sign%", "%ick"], 240, "2024-01-30 00:00:00", 3, [F.col("ts").desc(), F.col("event_id")]).select("event_id", "row_no", "row_count")


@query("select o_orderkey, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as row_no, count(*) over (partition by o_custkey) as row_count from orders")
def complete_detail(spark: SparkSession, d: str) -> DataFrame:
    return H.complete_detail(table(spark, d, "orders"), ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")]).select("o_orderkey", "row_no", "row_count")


@query("""
with v as (select l_suppkey, l_linenumber, max(cast(l_extendedprice as decimal(18,2))) as t, min(cast(l_extendedprice as decimal(18,2))) as f from lineitem group by all)
select l_suppkey, count(*) as n_volumes, cast(sum(t) as double) as total, cast(sum(f) as double) as free from v group by 1
""")
def disk_detail(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "lineitem").withColumn("price", frames.exact("l_extendedprice"))
    return H.disk_detail(x, ["l_suppkey"], "l_linenumber", "price", "price").select("l_suppkey", "n_volumes", F.col("total").cast("double").alias("total"), F.col("free").cast("double").alias("free"))


@query("""
select 'backups' as section, count(*) as n_issues from orders where o_orderstatus = 'F' and o_totalprice > 400000
union all select 'disks', count(*) from supplier where s_acctbal < 1000
""")
def report_index(spark: SparkSession, d: str) -> DataFrame:
    sections = {
        Sections.BACKUPS: ("backups", lambda: table(spark, d, "orders").where("o_orderstatus = 'F' and o_totalprice > 400000")),
        Sections.DISKS: ("disks", lambda: table(spark, d, "supplier").where("s_acctbal < 1000")),
        Sections.LOGS: ("logs", lambda: table(spark, d, "events")),
    }
    return H.issue_index(H.report(sections, Sections.BACKUPS | Sections.DISKS))


_FRAGMENTED = """
with e as (select *, lag(ts) over w as before, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) as n from events window w as (partition by user_id, event_type order by ts, event_id)),
x as (select * from e where event_type in ('click', 'view') and n = 1 and before is not null and ceil(date_diff('hour', before, ts) / 24.0) <= 3 and event_id >= 50 and event_id % 100 >= 30)
"""


def _fragmented(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, d, "events").select("user_id", "event_type", "event_id", "ts", F.col("event_id").alias("pages"), (F.col("event_id") % 100).alias("fill"), (F.col("user_id") % 10).alias("instance"))
    return H.fragmented_indexes(e, ["user_id"], "ts", "event_id", "event_type", ("click", "view"), 3, "pages", 50, "fill", 30, "instance")


@query(_FRAGMENTED + "select event_id, event_type from x")
def fragmented_indexes(spark: SparkSession, d: str) -> DataFrame:
    return _fragmented(spark, d)[0].select("event_id", "event_type")


@query(_FRAGMENTED + "select user_id % 10 as instance, count(*) as index_count from x group by 1")
def fragmented_counts(spark: SparkSession, d: str) -> DataFrame:
    return _fragmented(spark, d)[1]


_JOBS = "with x as (select distinct o_custkey, o_orderpriority, o_orderstatus, o_orderdate from orders)"


def _jobs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    order = [F.col(c) for c in ("o_orderpriority", "o_orderdate", "o_orderstatus")]
    return H.jobs_detail(table(spark, d, "orders"), "o_custkey", ["o_orderpriority", "o_orderstatus", "o_orderdate"], "o_orderpriority", F.to_date("o_orderdate"), order)


@query(_JOBS + "select *, row_number() over (partition by o_custkey order by o_orderpriority, o_orderdate, o_orderstatus) as row_no, count(*) over (partition by o_custkey) as row_count from x")
def jobs_detail(spark: SparkSession, d: str) -> DataFrame:
    return _jobs(spark, d)[0]


@query("select o_custkey, count(distinct (o_orderpriority, cast(o_orderdate as date))) as n_runs from orders group by 1")
def job_runs(spark: SparkSession, d: str) -> DataFrame:
    return _jobs(spark, d)[1]


@query("""
select 'backups' as section, count(*) as n_issues from orders where o_orderstatus = 'F' and o_totalprice > 300000
union all select 'disks', count(*) from supplier where s_acctbal < 2000 union all select 'logs', count(*) from events where event_type = 'error'
""")
def saved_report(spark: SparkSession, d: str) -> DataFrame:
    """All enabled sections written with one row of the run: its issues by section."""
    sections = {
        Sections.BACKUPS: ("backups", lambda: table(spark, d, "orders").where("o_orderstatus = 'F' and o_totalprice > 300000")),
        Sections.DISKS: ("disks", lambda: table(spark, d, "supplier").where("s_acctbal < 2000")),
        Sections.LOGS: ("logs", lambda: table(spark, d, "events").where("event_type = 'error'")),
        Sections.GROWTH: ("growth", lambda: table(spark, d, "no_such_table")),
    }
    flags, at = Sections.BACKUPS | Sections.DISKS | Sections.LOGS, place(spark)
    save_report(H.report(sections, flags), at, "fleet", int(flags))
    return spark.read.parquet(f"{at}/runs").where("build_at is not null and build_duration_ms >= 0").select(F.explode("issues").alias("section", "n_issues"))
