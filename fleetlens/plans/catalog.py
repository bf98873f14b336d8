"""Queries of the catalog views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.functions import texts
from fleetlens.operators import catalog as V
from fleetlens.plans.registry import query, table


@query("select n_nationkey as id, n_name as code, r_name as solution_name from nation left join region on r_regionkey = n_regionkey and r_regionkey <> 3")
def catalog_projects(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("code"), F.col("n_regionkey").alias("solution_id"))
    s = table(spark, d, "region").where("r_regionkey <> 3").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"))
    return V.projects(p, s).select("id", "code", "solution_name")


@query("""
with m as (select s_suppkey as id, s_nationkey as project_id, s_name as name, case when s_suppkey % 3 = 0 then null else 'corp.example' end as domain from supplier)
select i.id, n.n_name as project_code, m.name as machine_name, case when m.domain is null then m.name else m.name || '.' || m.domain end as host_name, c.name as cluster_node_machine_name
from m i join nation n on n_nationkey = i.project_id join m on m.id = i.id and m.project_id = i.project_id left join m c on c.id = i.id + 1 and c.project_id = i.project_id
""")
def catalog_instances(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("project_id"), F.col("s_name").alias("name"), F.when(F.col("s_suppkey") % 3 != 0, F.lit("corp.example")).alias("domain"))
    i = m.select("id", "project_id", F.col("id").alias("machine_id"), (F.col("id") + 1).alias("cluster_node_machine_id"))
    p = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("code"))
    return V.instances(p, m, i).select("id", "project_code", "machine_name", "host_name", "cluster_node_machine_name")


@query("""
select c_custkey as id, c_name as name, s_name as instance_name, n_name as project_code from customer
join supplier on s_suppkey = c_custkey % 10 and s_nationkey = c_nationkey join nation on n_nationkey = c_nationkey
""")
def catalog_databases(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("code"))
    i = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("project_id"), F.col("s_name").alias("name"), F.lit(True).alias("active"))
    x = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("project_id"), (F.col("c_custkey") % 10).alias("instance_id"))
    return V.databases(p, i, x).select("id", "name", "instance_name", "project_code")


@query("""
select o_orderkey as id, s_name as for_instance_name, case cast(o_orderkey % 7 as int) - 1 when -1 then 'Not executed' when 0 then 'Failed' when 1 then 'Succeded' when 2 then 'Retry' when 3 then 'Canceled' when 4 then 'In progress' else 'Unknown' end as status_desc
from orders left join supplier on s_suppkey = o_custkey
""")
def job_queue(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("for_instance_id"), (F.col("o_orderkey") % 7 - 1).alias("status"))
    i = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return V.job_queue(q, i).select("id", "for_instance_name", "status_desc")


@query("select o_orderkey, o_orderstatus, o_totalprice from orders where o_orderstatus <> 'P' union all select o_orderkey, o_orderstatus, null from orders where o_orderstatus = 'P'")
def job_history_union(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return V.job_history(o.where("o_orderstatus <> 'P'").select("o_orderkey", "o_orderstatus", "o_totalprice"), o.where("o_orderstatus = 'P'").select("o_orderkey", "o_orderstatus"))


@query("""
select user_id, round((max(epoch(date_trunc('second', ts)) + cast(floor(value) as bigint)) - min(epoch(date_trunc('second', ts)))) / 60.0, 2) as duration_minutes_parallel, round(sum(cast(floor(value) as bigint)) / 60.0, 2) as duration_minutes_serial from events group by 1
""")
def job_statistics(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("seconds", F.col("value").cast("long"))
    none = spark.createDataFrame([], "user_id long, duration_minutes_parallel double, duration_minutes_serial double")
    return V.job_statistics(none, e, ["user_id"], "ts", "seconds")


@query("""
with x as (select p_partkey, case when p_partkey % 3 = 0 then 8 when p_partkey % 3 = 1 then 4 else 64 end as ft, p_size as fi, (p_partkey % 24) * 10000 + (p_partkey % 60) * 100 as st from part)
select p_partkey, case ft when 8 then 'Weekly' when 4 then 'Daily' else 'At agent startup' end as frequency,
  case when ft = 8 then concat_ws(', ', case when fi & 1 <> 0 then 'Sunday' end, case when fi & 2 <> 0 then 'Monday' end, case when fi & 4 <> 0 then 'Tuesday' end, case when fi & 8 <> 0 then 'Wednesday' end,
    case when fi & 16 <> 0 then 'Thursday' end, case when fi & 32 <> 0 then 'Friday' end, case when fi & 64 <> 0 then 'Saturday' end) else '' end as days,
  substr(lpad(st::varchar, 6, '0'), 1, 2) || ':' || substr(lpad(st::varchar, 6, '0'), 3, 2) || ':' || substr(lpad(st::varchar, 6, '0'), 5, 2) as start_clock,
  make_timestamp(2024, 3, cast(1 + p_partkey % 28 as bigint), cast(st // 10000 as bigint), cast(st // 100 % 100 as bigint), 0.0) as next_run from x
""")
def schedule_decode(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    x = table(spark, d, "part").select("p_partkey", F.when(k % 3 == 0, 8).when(k % 3 == 1, 4).otherwise(64).alias("freq_type"), F.col("p_size").alias("freq_interval"), ((k % 24) * 10000 + (k % 60) * 100).alias("start_time"))
    x = x.withColumns({"next_run_date": (F.lit(20240301) + k % 28), "next_run_time": F.col("start_time")})
    return V.job_schedules(x).select("p_partkey", "frequency", "days", "start_clock", "next_run")


@query("select c_custkey, s_suppkey from customer join supplier on c_custkey = s_suppkey or replace(c_name, 'Customer', 'Supplier') = replace(s_name, '0000000', '0000001')")
def either_key_join(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_custkey", F.replace("c_name", F.lit("Customer"), F.lit("Supplier")).alias("c_as"))
    s = table(spark, d, "supplier").select("s_suppkey", F.replace("s_name", F.lit("0000000"), F.lit("0000001")).alias("s_as"))
    return V.either_key(c, s, ("c_custkey", "s_suppkey"), ("c_as", "s_as")).select("c_custkey", "s_suppkey")


def _members(spark: SparkSession, d: str) -> DataFrame:
    s, k = table(spark, d, "supplier"), F.col("s_suppkey")
    return s.select(k.alias("id"), (k % 5).alias("project_id"), F.col("s_name").alias("name"), (F.col("s_acctbal") > 2000).alias("active"), (k % 3).alias("machine_id"))


def _databases(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("p_partkey") % 20 + 1
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), i.alias("instance_id"), (i % 5).alias("project_id"), F.col("p_name").alias("name"), (F.col("p_size") > 5).alias("active"))


_OF_DATABASE = """
with f as (select *, case when l_linenumber = 7 then 0 else l_partkey % 20 + 1 end as instance_id from lineitem)
select l_orderkey, l_linenumber, p_name as database_name, s_name as instance_name, p_size > 5 as database_active, l_quantity + l_tax as size_mb{} from f join part on p_partkey = l_partkey and p_partkey % 20 + 1 = instance_id join supplier on s_suppkey = instance_id
"""


def _database_facts(spark: SparkSession, d: str) -> DataFrame:
    i = F.when(F.col("l_linenumber") == 7, 0).otherwise(F.col("l_partkey") % 20 + 1)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("catalog_database_id"), i.alias("instance_id"), F.col("l_quantity").alias("data_size_mb"), F.col("l_tax").alias("log_size_mb"), F.col("l_linenumber").alias("recovery_model"), (F.col("l_linenumber") - 1).alias("page_verify_option"))


@query(
    _OF_DATABASE.format(
        ", case l_linenumber when 1 then 'FULL' when 2 then 'BULK_LOGGED' when 3 then 'SIMPLE' else 'Unknown' end as recovery_model_desc, case l_linenumber - 1 when 0 then 'NONE' when 1 then 'TORN_PAGE_DETECTION' when 2 then 'CHECKSUM' else 'Unknown' end as page_verify_option_desc"
    )
)
def database_details(spark: SparkSession, d: str) -> DataFrame:
    x = V.database_details(V.of_database(_database_facts(spark, d), _members(spark, d), _databases(spark, d)))
    return x.select("l_orderkey", "l_linenumber", "database_name", "instance_name", "database_active", "size_mb", "recovery_model_desc", "page_verify_option_desc")


@query(_OF_DATABASE.format(""))
def database_usage_history(spark: SparkSession, d: str) -> DataFrame:
    return V.of_database(_database_facts(spark, d), _members(spark, d), _databases(spark, d)).select("l_orderkey", "l_linenumber", "database_name", "instance_name", "database_active", "size_mb")


_OF_INSTANCE = "s_suppkey = {0} and s_suppkey % 5 = case when {1} % 10 = 0 then -1 else {0} % 5 end"


def _facts(spark: SparkSession, d: str, name: str, instance: str, number: str, *columns: str) -> DataFrame:
    """Rows of a table as facts of instances; each tenth names a project that the instance is not in."""
    project = F.when(F.col(number) % 10 == 0, -1).otherwise(F.col(instance) % 5)
    return table(spark, d, name).select(F.col(instance).alias("instance_id"), project.alias("project_id"), number, *columns)


@query("select event_id, s_name as instance_name, s_acctbal > 2000 as instance_active, props as message from events join supplier on " + _OF_INSTANCE.format("user_id", "event_id"))
def collection_errors(spark: SparkSession, d: str) -> DataFrame:
    return V.of_instance(_facts(spark, d, "events", "user_id", "event_id", "props"), _members(spark, d)).select("event_id", "instance_name", "instance_active", F.col("props").alias("message"))


@query("select l_orderkey, l_linenumber, s_name as instance_name, l_extendedprice as total_size_mb, l_discount as percent_available from lineitem join supplier on " + _OF_INSTANCE.format("l_suppkey", "l_orderkey"))
def disk_space(spark: SparkSession, d: str) -> DataFrame:
    x = V.of_instance(_facts(spark, d, "lineitem", "l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice", "l_discount"), _members(spark, d))
    return x.select("l_orderkey", "l_linenumber", "instance_name", F.col("l_extendedprice").alias("total_size_mb"), F.col("l_discount").alias("percent_available"))


@query("select event_id, s_name as instance_name, ts as log_date, event_type as text from events join supplier on " + _OF_INSTANCE.format("user_id", "event_id"))
def errorlog(spark: SparkSession, d: str) -> DataFrame:
    return V.of_instance(_facts(spark, d, "events", "user_id", "event_id", "ts", "event_type"), _members(spark, d)).select("event_id", "instance_name", F.col("ts").alias("log_date"), F.col("event_type").alias("text"))


@query("select o_orderkey, s_name as instance_name, o_orderstatus as last_execution_status, o_orderdate as last_execution from orders join supplier on " + _OF_INSTANCE.format("o_custkey", "o_orderkey"))
def agent_jobs_history(spark: SparkSession, d: str) -> DataFrame:
    x = V.of_instance(_facts(spark, d, "orders", "o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate"), _members(spark, d))
    return x.select("o_orderkey", "instance_name", F.col("o_orderstatus").alias("last_execution_status"), F.col("o_orderdate").alias("last_execution"))


@query(
    "select event_id, s_name as instance_name, case event_id % 5 when 1 then 'Application' when 2 then 'System' when 3 then 'Setup' end as log_type_desc, case event_id % 6 when 1 then 'Critical' when 2 then 'Error' when 3 then 'Warning' when 4 then 'Information' end as level_desc from events join supplier on s_suppkey % 3 = event_id % 3 and "
    + _OF_INSTANCE.format("user_id", "event_id")
)
def os_events(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    x = _facts(spark, d, "events", "user_id", "event_id").withColumns({"machine_id": k % 3, "log_type_id": k % 5, "level_id": k % 6})
    return V.os_events(x, _members(spark, d)).select("event_id", "instance_name", "log_type_desc", "level_desc")


@query("""
select p_partkey as id, r_name as task_name, n_name as project_code, p_size > 25 as active from part join region on r_regionkey = p_partkey % 6 left join nation on n_nationkey = case when p_partkey % 4 <> 0 then p_partkey % 25 end
""")
def task_schedule(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    s = table(spark, d, "part").select(k.alias("id"), (k % 6).alias("task_id"), F.when(k % 4 != 0, k % 25).alias("project_id"), (F.col("p_size") > 25).alias("active"))
    t = table(spark, d, "region").select(F.col("r_regionkey").alias("id"), F.lit("d").alias("descriptor"), F.col("r_name").alias("task_name"))
    p = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("code"))
    return V.task_schedule(s, t, p).select("id", "task_name", "project_code", "active")


@query("select p_partkey as id, p_name as object_name, r_name as task_name, r_regionkey * 2 as flg_actions from part join region on r_regionkey = p_partkey % 6")
def object_skip_list(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 6).alias("task_id"), F.col("p_name").alias("object_name"))
    t = table(spark, d, "region").select(F.col("r_regionkey").alias("id"), F.lit("d").alias("descriptor"), F.col("r_name").alias("task_name"), (F.col("r_regionkey") * 2).alias("flg_actions"))
    return V.object_skip_list(s, t).select("id", "object_name", "task_name", "flg_actions")


@query("""
select p_partkey, case when p_size % 2 = 0 then replace('/data/' || p_brand || '\\log', '\\', '/') else replace('/data/' || p_brand || '\\log', '/', '\\') end as path, cast(p_size % 20 as integer) as major, 'dbo' as schema_name, p_brand as object_name,
  p_name as message, cast(p_retailprice * 1000 as bigint) as took from part
""".replace("\\\\", "\\"))
def text_parts(spark: SparkSession, d: str) -> DataFrame:
    from fleetlens.functions import times

    p, size = table(spark, d, "part"), F.col("p_size")
    schema, name = texts.two_part_name(F.concat(F.lit("[dbo].["), "p_brand", F.lit("]")))
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    end = F.timestamp_millis(F.unix_millis(start) + F.expr("cast(p_retailprice * 1000 as bigint)"))
    return p.select(
        "p_partkey", texts.platform_path(F.concat(F.lit("/data/"), "p_brand", F.lit("\\log")), F.when(size % 2 == 0, "Linux").otherwise("Windows")).alias("path"), texts.major_version(F.concat((size % 20).cast("string"), F.lit(".0.1"))).alias("major"),
        schema.alias("schema_name"), name.alias("object_name"), texts.undashed(F.concat(F.lit("--"), "p_name")).alias("message"), times.millis_between(start, end).alias("took"),
    )


@query("select event_id, value, s_name as instance_name, case event_id % 9 when 0 then 'info' when 1 then 'alert' when 2 then 'job-history' when 3 then 'report-html' when 4 then 'action' when 5 then 'backup-job-history' when 6 then 'alert-custom' else 'Unknown' end as event_type_desc from events left join supplier on s_suppkey = user_id")
def event_view(spark: SparkSession, d: str) -> DataFrame:
    payload = F.concat(F.lit("<detail><value>"), F.col("value").cast("string"), F.lit("</value></detail>"))
    log = table(spark, d, "events").select("event_id", F.col("user_id").alias("instance_id"), F.lit(1).alias("project_id"), (F.col("event_id") % 9).alias("event_type"), payload.alias("message"))
    i = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.lit(1).alias("project_id"), F.col("s_name").alias("name"))
    return V.events(log, i, "message", "value double").select("event_id", "value", "instance_name", "event_type_desc")


@query("select o_orderkey, case when s_acctbal > 3000 then o_orderstatus else 'INSTANCE OFFLINE' end as synchronization_state_desc from orders join supplier on s_suppkey = o_custkey % 100")
def replica_states(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 100).alias("s_suppkey"), F.col("o_orderstatus").alias("synchronization_state_desc"))
    m = table(spark, d, "supplier").select("s_suppkey", (F.col("s_acctbal") > 3000).alias("instance_active"))
    return V.replica_details(r, m, "s_suppkey").select("o_orderkey", "synchronization_state_desc")


@query("select c_custkey, coalesce(n_name, 'DEFAULT') as owner from customer left join nation on n_nationkey = c_nationkey and n_regionkey = 1")
def owner_default(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("owner"))
    return V.owner_or_default(table(spark, d, "customer"), o, ["c_nationkey"], "owner", "DEFAULT").select("c_custkey", "owner")


@query("select s_nationkey, string_agg(distinct s_name, ',' order by s_name) as nodes from supplier group by 1")
def node_list(spark: SparkSession, d: str) -> DataFrame:
    return V.node_list(table(spark, d, "supplier"), ["s_nationkey"], "s_name")


@query("select o_orderkey, o_orderstatus || case when o_orderkey % 5 = 0 then ', STANDBY' when o_orderkey % 3 = 0 then ', READ ONLY' else '' end as state from orders")
def state_class(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", V.state_class(F.col("o_orderstatus"), k % 3 == 0, k % 5 == 0).alias("state"))


@query("""
with x as (select o_custkey, o_orderkey, o_orderstatus = 'F' as leftover from orders)
select o_orderkey, row_number() over (partition by o_custkey order by leftover desc, o_orderkey) as priority from x
""")
def leftovers_first(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    return V.leftovers_first(o, o.where("o_orderstatus = 'F'"), ["o_custkey", "o_orderkey"], [F.col("o_orderkey")]).select("o_orderkey", "priority")


@query("select doc_id, case when length(text) > 40 then replace(replace(substr(text, 1, 40) || '[...]', '<', '&lt;'), '>', '&gt;') else replace(replace(text, '<', '&lt;'), '>', '&gt;') end as short, translate(lang || ': ' || source, ' `:-,()/\\%#', '') as anchor from documents")
def text_helpers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", texts.shorten("text", 40).alias("short"), texts.anchor(F.concat("lang", F.lit(": "), "source")).alias("anchor"))
