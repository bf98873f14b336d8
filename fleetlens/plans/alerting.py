"""Queries of alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.operators import alerts as A
from fleetlens.operators import frames
from fleetlens.operators.filters import skip_rules
from fleetlens.plans.registry import query, rows, table


@query("select event_id, value, case when value >= 200 then 'critical' when value >= 120 then 'warning' end as severity from events where value >= 120")
def severity_bands(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", "value", A.severity(F.col("value"), 120.0, 200.0).alias("severity")).where("severity is not null")


@query("""
with a as (
  select event_id, 'running' as alert_name, value, 100 as w, 200 as c from events where event_type in ('view', 'click')
  union all select event_id, 'uncommitted', value, 90, 180 from events where event_type = 'purchase'
  union all select event_id, 'tempdb', cast(json_extract_string(props, '$.k') as double), 80, 95 from events)
select event_id, alert_name, value, case when value >= c then 'critical' else 'warning' end as severity from a where value >= w
""")
def banded_alerts(spark: SparkSession, d: str) -> DataFrame:
    kind, v = F.col("event_type"), F.col("value")
    metrics = [
        ("running", v, kind.isin("view", "click"), 100.0, 200.0),
        ("uncommitted", v, kind == "purchase", 90.0, 180.0),
        ("tempdb", F.get_json_object("props", "$.k").cast("double"), F.lit(True), 80.0, 95.0),
    ]
    return _banded(table(spark, d, "events"), metrics)


def _banded(events: DataFrame, metrics: list) -> DataFrame:
    x = A.banded(events.select("event_id", "event_type", "props", F.col("value").alias("raw")), [(n, F.col("raw") if i < 2 else v, p, w, c) for i, (n, v, p, w, c) in enumerate(metrics)])
    return x.select("event_id", "alert_name", "value", "severity")


@query("""
with s as (select s_suppkey, case when s_suppkey % 4 = 0 then null else s_acctbal / 100 end as pct, s_acctbal as mb from supplier)
select s_suppkey, case when pct is not null then case when pct <= 5 then 'critical' when pct < 10 then 'warning' end else case when mb <= 1024 then 'critical' when mb < 3000 then 'warning' end end as severity from s
where case when pct is not null then pct < 10 else mb < 3000 end
""")
def free_space_alert(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 4 != 0, F.col("s_acctbal") / 100).alias("pct"), F.col("s_acctbal").alias("mb"))
    return A.free_space(s, "pct", "mb", (10.0, 5.0), (3000.0, 1024.0)).select("s_suppkey", "severity")


@query("""
with t(n, w, c) as (values ('error', 100.0, null), ('click', null, 150.0))
select event_id, cast(coalesce(w, 60) as double) as warning_limit, cast(coalesce(c, 120) as double) as critical_limit from events left join t on n = event_type
""")
def alert_limits(spark: SparkSession, d: str) -> DataFrame:
    t = rows(spark, "alert_name, warning_limit, is_warning_limit_enabled, critical_limit, is_critical_limit_enabled", "('error', 100.0D, true, 5.0D, false), ('click', 1.0D, false, 150.0D, true)")
    return A.limits(table(spark, d, "events"), t, "event_type", 60.0, 120.0).select("event_id", "warning_limit", "critical_limit")


@query("select user_id, string_agg(distinct event_type, ', ' order by event_type) as databases from events group by 1")
def session_lists(spark: SparkSession, d: str) -> DataFrame:
    return A.session_lists(table(spark, d, "events"), ["user_id"], {"databases": "event_type"})


_WAITS = "select event_id % 50 as host, user_id as session, cast(json_extract_string(props, '$.k') as bigint) as blocker from events"


@query(f"""
with w as (select * from ({_WAITS}) where blocker <> session),
b as (select host, blocker as session, count(*) as waiters from w group by 1, 2 union all select host, session, 0 from w)
select host, session, max(waiters) as waiters from b group by 1, 2
""")
def blocking_degree(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "events").select((F.col("event_id") % 50).alias("host"), F.col("user_id").alias("session"), F.get_json_object("props", "$.k").cast("long").alias("blocker"))
    return frames.blocking_degree(w, "session", "blocker", ["host"])


@query("""
with s as (select event_id as session, user_id % 5 as host, value, case when cast(json_extract_string(props, '$.k') as bigint) < 20 then cast(json_extract_string(props, '$.k') as bigint) end as blocker from events),
b as (select host, blocker, count(*) as n from s where blocker is not null group by 1, 2)
select s.session, s.host, coalesce(n, 0) as sessions_blocked, s.blocker is not null as is_session_blocked from s left join b on b.host = s.host and b.blocker = s.session
where value >= 150 or coalesce(n, 0) >= 3 or s.blocker is not null
""")
def waiting_snapshot(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    s = table(spark, d, "events").select(F.col("event_id").alias("session"), (F.col("user_id") % 5).alias("host"), "value", F.when(k < 20, k).alias("blocker"))
    return A.waiting_snapshot(s, ["host"], "session", "blocker", "value", 150.0, 3).select("session", "host", "sessions_blocked", "is_session_blocked")


@query("""
with x as (select l_suppkey, l_returnflag, case when l_orderkey % 97 = 0 then null else l_quantity end as latency from lineitem),
g as (select l_suppkey, l_returnflag, case when count(*) filter (latency is null) = 0 then max(latency) end as overall_latency from x group by 1, 2)
select *, case when overall_latency is null or overall_latency >= 50 then 'critical' when overall_latency >= 48 then 'warning' end as severity from g where overall_latency is null or overall_latency >= 48
""")
def latency_merge(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "lineitem").select("l_suppkey", "l_returnflag", F.when(F.col("l_orderkey") % 97 != 0, F.col("l_quantity")).alias("latency"))
    return A.latency_alerts(x, ["l_suppkey", "l_returnflag"], "latency", 48.0, 50.0).select("l_suppkey", "l_returnflag", "overall_latency", "severity")


@query("""
with r as (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as n from events)
select user_id, event_id, ts from r where n = 1 and event_type = 'error' and ts > timestamp '2024-01-20' and user_id % 10 <> 3
""")
def new_failures(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "event_id", "ts", "event_type")
    known = e.where("user_id % 10 = 3").select("user_id", "ts")
    return A.new_failures(e, known, ["user_id"], "ts", "event_id", F.col("event_type") == "error", "2024-01-20 00:00:00").select("user_id", "event_id", "ts")


@query("""
with x as (select event_type, string_agg(distinct r, ';' order by r) as more from (values ('error', 'b@x.org'), ('error', 'a@x.org'), ('click', 'c@x.org')) t(event_type, r) group by 1)
select event_id, 'ops@x.org' || coalesce(';' || more, '') as recipients from events left join x using (event_type)
""")
def recipients(spark: SparkSession, d: str) -> DataFrame:
    extra = rows(spark, "event_type, recipients, active", "('error', 'b@x.org', true), ('error', 'a@x.org', true), ('click', 'c@x.org', true), ('view', 'd@x.org', false)")
    return A.recipients(table(spark, d, "events"), extra, ["event_type"], "ops@x.org").select("event_id", "recipients")


def _alerts(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    kind = F.when(F.col("event_type") == "error", 1).when(F.col("event_type") == "purchase", 6).otherwise(0)
    return e.select((F.col("user_id") % 8).cast("string").alias("instance"), "event_id", "ts", A.repeat_key("user_id", "event_type").alias("alert_key"), kind.alias("event_type"), (F.col("event_type") == "view").alias("ignored"))


def decided(cap: int, minutes: int, repeat: int) -> str:
    """SQL of the decisions, an event of each instance at a time; log is what was sent and still counts."""
    held = f"e.ignored or (e.event_type in (1, 6) and (len(list_filter(r.log, lambda x: e.minute - x.m <= {minutes})) >= {cap} or len(list_filter(r.log, lambda x: x.name = e.name and e.minute - x.m <= {repeat})) > 0))"
    sent = lambda log: f"case when {{}} then {log} else list_append({log}, {{{{'m': e.minute, 'name': e.name}}}}) end"
    return f"""
with recursive a as (
  select cast(user_id % 8 as varchar) as instance, event_id, ts, user_id || '|' || event_type as alert_key, case event_type when 'error' then 1 when 'purchase' then 6 else 0 end as event_type, event_type = 'view' as ignored from events),
e as (select *, event_type || '|' || alert_key as name, cast(floor(epoch(ts) / 60) as bigint) as minute, row_number() over (partition by instance order by ts, event_id) as k from a),
r as (
  select instance, k, event_id, ignored as held, {sent("cast([] as struct(m bigint, name varchar)[])").format("ignored")} as log from e where k = 1
  union all
  select e.instance, e.k, e.event_id, {held}, {sent(f"list_filter(r.log, lambda x: e.minute - x.m <= {max(minutes, repeat)})").format(held)} from r join e on e.instance = r.instance and e.k = r.k + 1)
select instance, event_id, ts, alert_key, event_type, not held as is_sent, held as flood_control from r join e using (instance, k, event_id)
"""


@query(decided(cap=50, minutes=5, repeat=600))
def suppress_repeats(spark: SparkSession, d: str) -> DataFrame:
    return A.decide_alerts(_alerts(spark, d), cap=50, repeat_minutes=600)


@query(decided(cap=3, minutes=120, repeat=60))
def flood_control(spark: SparkSession, d: str) -> DataFrame:
    return A.decide_alerts(_alerts(spark, d), cap=3, minutes=120, repeat_minutes=60)


@query("select user_id, count(*) as n_events, count(*) filter (event_type = 'error') as n_failed, min(ts) as first_time, max(ts) as last_time from events where ts >= timestamp '2024-01-25' group by 1")
def job_digest(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("job_start", F.expr("timestamp_ntz'2024-01-25 00:00:00'"))
    return A.digest(e, ["user_id"], "job_start", "ts", F.col("event_type") == "error")


@query("select event_id, '[' || event_type || '] on ' || user_id || case when value > 100 then ': ' || 'big' else '' end as subject from events where event_type in ('error')")
def alert_subjects(spark: SparkSession, d: str) -> DataFrame:
    e = A.job_notifications(table(spark, d, "events"), "event_type", ("error",))
    return e.select("event_id", A.subject(F.col("user_id").cast("string"), F.col("event_type"), F.when(F.col("value") > 100, "big")).alias("subject"))


@query("select l_suppkey, l_returnflag, count(distinct l_partkey) as articles from lineitem group by 1, 2")
def replication_inventory(spark: SparkSession, d: str) -> DataFrame:
    return A.replication_inventory(table(spark, d, "lineitem"), ["l_suppkey", "l_returnflag"], "l_partkey")


@query("select o_orderkey, case when o_orderkey % 10 = 0 then 'critical' else 'warning' end as severity from orders where o_orderkey % 10 = 0 or o_orderstatus <> 'F'")
def inactive_subscriptions(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 10 != 0, F.col("o_orderstatus")).alias("state"))
    return A.inactive_subscriptions(x, "state", ("F",)).select("o_orderkey", "severity")


_CAPTURED = """
with k as (select *, user_id % 5 as host, cast(json_extract_string(props, '$.k') as bigint) as k from events),
ses as (select host, event_id as session_id, cast(floor(value) as bigint) as idle from k),
req as (select host, event_id as session_id, 1 as request_id, cast(floor(value) as bigint) * 3 as sec from k where event_type in ('click', 'view')),
tra as (select host, event_id as session_id, max(cast(floor(value * i) as bigint)) as sec from k, (values (1), (2)) t(i) where event_type = 'purchase' group by all having max(cast(floor(value * i) as bigint)) >= 150),
tmp as (select host, event_id as session_id, 1 as request_id, floor(sum((k * 128 - 64 * i) * 8) / 1024) as mb from k, (values (1), (2)) t(i) where event_type = 'click' group by all having floor(sum((k * 128 - 64 * i) * 8) / 1024) >= 180),
w as (select host, event_id as session_id, case when k < 90 then k * 7 end as blocker, cast(floor(value) as bigint) as sec from k where event_type in ('error', 'view') and floor(value) >= 60 and (case when k < 90 then k * 7 end) is distinct from event_id),
bk as (select host, blocker as session_id, count(*) as n from w where blocker is not null group by all)
"""


@query(
    _CAPTURED
    + """select ses.host, ses.session_id, req.request_id is null as request_completed, greatest(0, coalesce(req.sec, idle)) as elapsed_seconds, tra.sec as transaction_seconds, cast(tmp.mb as bigint) as tempdb_space_used_mb, coalesce(bk.n, 0) as sessions_blocked, coalesce(w.blocker is not null, false) as is_session_blocked
from ses left join req using (host, session_id) left join tra using (host, session_id) left join tmp on tmp.host = ses.host and tmp.session_id = ses.session_id and tmp.request_id = req.request_id left join bk on bk.host = ses.host and bk.session_id = ses.session_id left join w on w.host = ses.host and w.session_id = ses.session_id
where (req.request_id is not null and greatest(0, coalesce(req.sec, idle)) >= 300) or tra.sec is not null or w.sec is not null or tmp.mb is not null"""
)
def transaction_snapshot(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    e = table(spark, d, "events").select((F.col("user_id") % 5).alias("host"), F.col("event_id").alias("session_id"), "event_type", "value", k.alias("k"))
    sec, twice = F.floor("value").cast("long"), F.explode(F.array(F.lit(1), F.lit(2))).alias("i")
    requests = e.where(F.col("event_type").isin("click", "view")).select("host", "session_id", F.lit(1).alias("request_id"), (sec * 3).alias("request_seconds"))
    transactions = e.where("event_type = 'purchase'").select("host", "session_id", "value", twice).select("host", "session_id", F.floor(F.col("value") * F.col("i")).cast("long").alias("transaction_seconds"))
    space = e.where("event_type = 'click'").select("host", "session_id", F.lit(1).alias("request_id"), (F.col("k") * 128).alias("alloc_pages"), twice).withColumn("dealloc_pages", F.col("i") * 64)
    waits = e.where(F.col("event_type").isin("error", "view")).select("host", "session_id", F.when(F.col("k") < 90, F.col("k") * 7).alias("blocking_session_id"), sec.alias("wait_seconds"))
    x = A.transaction_snapshot(e.select("host", "session_id", sec.alias("idle_seconds")), requests, transactions, space, waits, ["host"], {"request": 300, "transaction": 150, "wait": 60, "temp_mb": 180})
    return x.select("host", "session_id", "request_completed", "elapsed_seconds", "transaction_seconds", F.col("tempdb_space_used_mb").cast("long").alias("tempdb_space_used_mb"), "sessions_blocked", "is_session_blocked")


@query("""
with s as (select distinct l_suppkey as pub, l_partkey as sub from lineitem),
j as (select s_suppkey as pub, bool_or(i = 1 and s_suppkey % 4 <> 0) as one, bool_or(i = 2 and s_suppkey % 3 <> 0) as two from supplier, (values (1), (2)) t(i) group by 1),
m as (select l_suppkey as pub, l_partkey as sub, case when count(*) filter (l_linenumber = 6) = 0 then max(l_quantity) end as latency from lineitem group by all)
select s.pub, s.sub, case when two then 2 when one then 1 else 0 end as state, case when two then latency end as overall_latency from s left join j using (pub) left join m using (pub, sub)
where not (s.pub = 2 and s.sub % 2 = 0)
""")
def latency_state(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("pub"), F.col("l_partkey").alias("sub"), F.when(F.col("l_linenumber") != 6, F.col("l_quantity")).alias("latency"))
    jobs = table(spark, d, "supplier").select(F.col("s_suppkey").alias("pub"), F.explode(F.array(F.lit("analysis"), F.lit("reading"))).alias("step"))
    jobs = jobs.withColumn("status", F.when(F.col("pub") % F.when(F.col("step") == "analysis", 4).otherwise(3) != 0, 1).otherwise(0))
    out = A.latency_state(x.select("pub", "sub").distinct(), jobs, x, ["pub"], ["pub", "sub"], "latency").select("pub", "sub", "state", "overall_latency")
    skip = rows(spark, "rule_id, skip_value, skip_value2, active", "(16, '2', 'even', true), (16, '3', cast(null as string), false)")
    named = out.withColumns({"_pub": F.col("pub").cast("string"), "_sub": F.when(F.col("sub") % 2 == 0, "even").otherwise("odd")})
    return skip_rules(named, skip, 16, ["_pub"], "_sub").drop("_pub", "_sub")


@query("""
select event_id, (case when event_type = 'error' then 1 when event_type = 'purchase' then 6 else 0 end = 1 and event_id % 7 in (1, 3)) or (event_type = 'purchase' and user_id % 3 = 1 and user_id % 2 = 0) as ignored from events
""")
def ignored_alerts(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    kind = F.when(F.col("event_type") == "error", 1).when(F.col("event_type") == "purchase", 6).otherwise(0)
    hit = A.ignored(kind, F.col("event_id") % 7, F.when(F.col("user_id") % 3 == 1, "job queue"), F.when(F.col("user_id") % 2 == 0, "execute"), (1, 3), (("job queue", "execute"),))
    return e.select("event_id", hit.alias("ignored"))


@query("""
with e as (select *, event_id % 8 as t from events)
select event_id, case when user_id % 2 = 0 then '[P' || user_id || '] ' else '' end || case t when 0 then 'info' when 1 then 'alert' when 2 then 'job status' when 3 then 'report' when 4 then 'action' when 5 then 'job status' when 6 then 'alert' else '' end
  || ' on [srv' || user_id || ']: ' || case when event_id % 3 <> 0 then '[db] - ' else '' end || case when t = 1 then '[error] - ' when t in (2, 5) then case when value > 50 then '[failed] - ' else '[completed] - ' end else '' end || event_type as subject,
  '<ul><li>type: ' || event_type || case when event_id % 3 <> 0 then '<li>db: a&amp;b' else '' end || '</ul>' as body from e
""")
def alert_messages(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    user, db, kind = F.col("user_id").cast("string"), F.col("event_id") % 3 != 0, F.col("event_id") % 8
    subject = A.full_subject(F.when(F.col("user_id") % 2 == 0, F.concat(F.lit("P"), user)), kind, F.concat(F.lit("srv"), user), F.when(db, "db"), F.col("value") > 50, F.col("event_type"), F.lit(None).cast("string"))
    pair = lambda n, c: F.struct(F.lit(n).alias("field"), c.alias("value"))
    return e.select("event_id", subject.alias("subject"), A.body(F.array(pair("type", F.col("event_type")), pair("db", F.when(db, "a&b")))).alias("body"))


@query("""
with a as (select event_id, case event_type when 'error' then 'Replication Latency' when 'click' then 'Blocking Transaction Elapsed Time (sec)' else 'other' end as name from events)
select event_id, cast(case name when 'Replication Latency' then 15.0 when 'other' then null else 600.0 end as double) as warning, cast(case name when 'Replication Latency' then 20.0 when 'other' then null else 900.0 end as double) as critical from a
""")
def default_limits(spark: SparkSession, d: str) -> DataFrame:
    name = F.when(F.col("event_type") == "error", "Replication Latency").when(F.col("event_type") == "click", "Blocking Transaction Elapsed Time (sec)").otherwise("other")
    return table(spark, d, "events").select("event_id", A.default_limits(name, "warning").alias("warning"), A.default_limits(name, "critical").alias("critical"))


@query("""
with r as (select o_custkey, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) as last_status, count(*) as n_runs from orders group by 1)
select c_custkey, last_status, coalesce(n_runs, 0) as n_runs from r right join customer on o_custkey = c_custkey
""")
def job_status_all(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_custkey")
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderstatus", "o_orderdate", "o_orderkey")
    return A.status_of_all(o, c, ["c_custkey"], "o_orderstatus", ["o_orderdate", "o_orderkey"])
