"""Queries of maintenance decisions and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.functions import measures, times
from fleetlens.operators import maintenance as M
from fleetlens.plans.registry import place, query, rows, table


def _parts(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return p.select(
        "p_partkey", (F.col("p_size") * 40).cast("long").alias("pages"), (F.col("p_partkey") % 97).cast("double").alias("frag"), F.when(F.col("p_partkey") % 5 != 0, (F.col("p_partkey") % 53).cast("double")).alias("dev"),
        (F.col("p_partkey") % 41).cast("double").alias("deleted"), (F.col("p_partkey") % 8 == 0).alias("columnstore"), (F.col("p_size") % 90).alias("fill"),
    )


_PARTS = """with p as (select p_partkey, p_size * 40 as pages, cast(p_partkey % 97 as double) as frag, case when p_partkey % 5 <> 0 then cast(p_partkey % 53 as double) end as dev,
  cast(p_partkey % 41 as double) as deleted, p_partkey % 8 = 0 as columnstore, p_size % 90 as fill from part)
"""


@query(
    _PARTS
    + """select p_partkey, case when pages < 200 then 'none' when columnstore then case when deleted >= 30 then 'rebuild' when deleted >= 5 then 'reorganize' else 'none' end
  when greatest(frag, coalesce(dev, 0)) < 5 then 'none' when greatest(frag, coalesce(dev, 0)) < 30 or pages > 1800 then 'reorganize' else 'rebuild' end as action from p"""
)
def index_action(spark: SparkSession, d: str) -> DataFrame:
    a = M.index_action(F.col("pages"), F.col("frag"), F.col("dev"), F.col("deleted"), F.col("columnstore"), 5.0, 30.0, 200, 1800)
    return _parts(spark, d).select("p_partkey", a.alias("action"))


@query(_PARTS + "select p_partkey from p where frag >= 60 or coalesce(dev, 0) >= 60 or deleted >= 35")
def heap_action(spark: SparkSession, d: str) -> DataFrame:
    return _parts(spark, d).where(M.heap_action(F.col("frag"), F.coalesce("dev", F.lit(0.0)), F.col("deleted"), 60.0, 35.0) == "rebuild").select("p_partkey")


@query("""
with g as (
  select l_partkey, count(*) as segments_count, count(*) filter (cast(l_quantity as bigint) <= l_linenumber * 6) as deleted_segments_count, sum(cast(l_quantity as bigint)) as r, sum(cast(l_linenumber * 6 as bigint)) as x from lineitem group by 1)
select l_partkey, segments_count, deleted_segments_count, round(x * 100.0 / r, 2) as deleted_rows_percentage, round(deleted_segments_count * 100.0 / segments_count, 2) as deleted_segments_percentage from g
""")
def segment_health(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "lineitem").select("l_partkey", F.col("l_quantity").cast("long").alias("n"), (F.col("l_linenumber") * 6).cast("long").alias("gone"))
    return M.segment_health(x, ["l_partkey"], "n", "gone").select("l_partkey", "segments_count", "deleted_segments_count", F.col("deleted_rows_percentage").cast("double").alias("deleted_rows_percentage"), F.col("deleted_segments_percentage").cast("double").alias("deleted_segments_percentage"))


@query("""
with x as (select p_partkey, p_partkey % 40 as age, p_size * 1000 as n, p_partkey * 7 as changes from part)
select p_partkey from x where (age >= 30 and changes <> 0) or changes * 100.0 / n >= 80 or sqrt(1000.0 * n) <= changes
""")
def stats_stale(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, d, "part").where(measures.stale(k % 40, F.col("p_size") * 1000, k * 7, 30, 80.0)).select("p_partkey")


@query("select p_partkey, floor(8060.0 / (p_size + 20)) as per_page, round(abs(floor(8060.0 / (p_size + 20)) * (p_size + 20) / 8060.0 * 90 - 70), 4) as deviation from part")
def density_deviation(spark: SparkSession, d: str) -> DataFrame:
    r = F.col("p_size") + 20
    return table(spark, d, "part").select("p_partkey", F.floor(F.lit(8060.0) / r).cast("double").alias("per_page"), F.round(measures.density_deviation(r, F.lit(90), F.lit(70)), 4).alias("deviation"))


@query("select l_orderkey, l_linenumber from lineitem where l_suppkey in (select l_suppkey from lineitem group by 1 having sum(cast(l_quantity as bigint)) >= 15500)")
def size_floor(spark: SparkSession, d: str) -> DataFrame:
    return M.size_floor(table(spark, d, "lineitem").withColumn("q", F.col("l_quantity").cast("long")), ["l_suppkey"], "q", 15500).select("l_orderkey", "l_linenumber")


@query("select l_orderkey, l_linenumber from lineitem where l_partkey in (select p_partkey from part where p_size = 1)")
def dependents(spark: SparkSession, d: str) -> DataFrame:
    pending = table(spark, d, "part").where("p_size = 1").select(F.col("p_partkey").alias("l_partkey"))
    return M.dependents(table(spark, d, "lineitem"), pending, ["l_partkey"]).select("l_orderkey", "l_linenumber")


@query(_PARTS + "select p_partkey, case when (case when fill = 0 then 100 else fill end) - 5 >= 40 then (case when fill = 0 then 100 else fill end) - 5 end as advice from p")
def fill_advice(spark: SparkSession, d: str) -> DataFrame:
    return _parts(spark, d).select("p_partkey", M.fill_advice(F.col("fill"), 5, 40).alias("advice"))


@query("select l_suppkey, case when sum(cast(l_quantity as bigint)) filter (l_returnflag = 'A') * 100.0 / sum(cast(l_quantity as bigint)) >= 34 then 'full' else 'diff' end as backup_type from lineitem group by 1")
def backup_switch(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("l_quantity").cast("long")
    x = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.sum(F.when(F.col("l_returnflag") == "A", q)).alias("changed"), F.sum(q).alias("total"))
    return x.select("l_suppkey", M.backup_type(F.col("changed"), F.col("total"), 34.0).alias("backup_type"))


_SETS = """with s as (
  select o_custkey, o_orderkey as set_id, case o_orderstatus when 'F' then 'full' when 'O' then 'diff' else 'log' end as kind, o_orderdate as start_time, o_orderkey * 10 as first_lsn, (o_orderkey - o_orderkey % 50) * 10 as base_lsn from orders)
"""


def _sets(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    kind = F.when(F.col("o_orderstatus") == "F", "full").when(F.col("o_orderstatus") == "O", "diff").otherwise("log")
    return table(spark, d, "orders").select("o_custkey", k.alias("set_id"), kind.alias("kind"), F.col("o_orderdate").alias("start_time"), (k * 10).alias("first_lsn"), ((k - k % 50) * 10).alias("base_lsn"))


@query(
    _SETS
    + """, f as (select o_custkey, max_by(set_id, (start_time, set_id)) as f_id, max(start_time) as f_time from s where kind = 'full' and start_time <= timestamp '2000-01-01' - interval 100 day group by 1),
x as (select s.o_custkey, max(set_id) as x_id from s join f on f.o_custkey = s.o_custkey where kind = 'diff' and start_time <= timestamp '2000-01-01' - interval 100 day and set_id > f_id group by 1)
select s.o_custkey, s.set_id, kind from s join f on f.o_custkey = s.o_custkey left join x on x.o_custkey = s.o_custkey
where start_time < f_time or (set_id < f_id and kind <> 'full' and base_lsn <> f_id * 10) or (x_id is not null and set_id < x_id and kind <> 'full')"""
)
def retention_by_days(spark: SparkSession, d: str) -> DataFrame:
    return M.deletable(_sets(spark, d), ["o_custkey"], 100, "days", "2000-01-01 00:00:00").select("o_custkey", "set_id", "kind")


@query(
    _SETS
    + """, n as (select *, row_number() over (partition by o_custkey order by start_time desc, set_id desc) as r from s where kind <> 'log'),
a as (select o_custkey, start_time as a_time, set_id as a_id from n where r = 4),
f as (select s.o_custkey, max_by(set_id, (start_time, set_id)) as f_id, max(start_time) as f_time from s join a on a.o_custkey = s.o_custkey where kind = 'full' and (start_time, set_id) <= (a_time, a_id) group by 1)
select s.o_custkey, s.set_id, kind from s join f on f.o_custkey = s.o_custkey where start_time < f_time or (set_id < f_id and kind <> 'full' and base_lsn <> f_id * 10)"""
)
def retention_by_count(spark: SparkSession, d: str) -> DataFrame:
    return M.deletable(_sets(spark, d), ["o_custkey"], 4, "count").select("o_custkey", "set_id", "kind")


@query(_SETS + "select set_id from s where kind <> 'full' and not exists (select 1 from s f where f.kind = 'full' and f.o_custkey = s.o_custkey and s.base_lsn between f.first_lsn - 20000 and f.first_lsn)")
def missing_base(spark: SparkSession, d: str) -> DataFrame:
    s = _sets(spark, d)
    fulls = s.where("kind = 'full'").withColumn("low", F.col("first_lsn") - 20000)
    return M.missing_base(s.where("kind <> 'full'"), fulls, "o_custkey", "base_lsn", "low", "first_lsn").select("set_id")


@query("""
with x as (select o_custkey, o_orderkey, cast(o_orderkey as hugeint) * 100000 + 7 as first, cast(o_orderkey + o_orderkey % 3 as hugeint) * 100000 + 7 as last from orders),
w as (select *, lag(last) over (partition by o_custkey order by o_orderkey) as before from x)
select o_orderkey, case when before is null or first = before then 'ok' when first > before then 'gap' else 'overlap' end as state from w
""")
def chain_gaps(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    triple = lambda n: M.lsn_number(F.concat(F.lit("0:"), F.lower(F.hex(n)), F.lit(":7")))
    x = table(spark, d, "orders").select("o_custkey", "o_orderkey", triple(k).alias("first"), triple(k + k % 3).alias("last"))
    return M.chain_gaps(x, ["o_custkey"], "o_orderkey", "first", "last").select("o_orderkey", "state")


@query("""
with a as (select p_brand, (p_partkey % 300) || '.' || p_size || '.0.' || case when p_partkey % 13 = 0 then 'x' else (p_partkey % 256)::varchar end as ip, p_partkey from part)
select p_brand, count(*) filter (p_partkey % 300 <= 255 and p_partkey % 13 <> 0) as valid, count(*) filter (not (p_partkey % 300 <= 255 and p_partkey % 13 <> 0)) as invalid from a group by 1
""")
def ip_profile(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    ip = F.concat_ws(".", (k % 300).cast("string"), F.col("p_size").cast("string"), F.lit("0"), F.when(k % 13 == 0, "x").otherwise((k % 256).cast("string")))
    return M.address_profile(table(spark, d, "part").select("p_brand", ip.alias("ip")), ["p_brand"], "ip")


_SCHEDULE = "(cast(null as bigint), 1, 'Daily', true), (null, 2, 'Monday', true), (null, 3, 'Friday', true), (3, 3, 'Daily', true), (4, 1, 'Daily', false), (5, 2, 'Sunday', true)"


@query(f"""
with s(project_id, task_id, day, active) as (values {_SCHEDULE}), due as (select *, active and day in ('Daily', 'Friday') as d from s)
select n_nationkey as project_id, x.task_id from nation cross join (select task_id, d from due where project_id is null) x left join due o on o.project_id = n_nationkey and o.task_id = x.task_id where coalesce(o.d, x.d)
""")
def due_tasks(spark: SparkSession, d: str) -> DataFrame:
    s = rows(spark, "project_id, task_id, scheduled_weekday, active", _SCHEDULE)
    return M.due_tasks(s, table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("project_id")), "2024-03-01")


@query("""
select c_custkey, t.task_id from customer cross join (values (1), (2), (8)) t(task_id) where not (t.task_id = 2 and c_mktsegment = 'BUILDING') and not exists (select 1 from orders where o_custkey = c_custkey and o_orderkey % 8 = t.task_id)
""")
def work_list(spark: SparkSession, d: str) -> DataFrame:
    members = table(spark, d, "customer")
    tasks = rows(spark, "task_id", "(1), (2), (8)")
    skip = members.where("c_mktsegment = 'BUILDING'").select("c_custkey", F.lit(2).alias("task_id"))
    queued = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), (F.col("o_orderkey") % 8).cast("int").alias("task_id"))
    return M.work_list(members.select("c_custkey"), tasks, skip, queued, ["c_custkey", "task_id"])


@query("""
with m as (select c_custkey, c_nationkey, max(o_orderdate) as last_check from customer left join orders on o_custkey = c_custkey where c_mktsegment <> 'BUILDING' group by all)
select c_custkey, last_check from m where (last_check is null or date_diff('day', last_check, date '2001-08-01') >= 60) and c_custkey not in (select s_suppkey from supplier where s_acctbal < 3000) and c_nationkey < 20
""")
def overdue(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("last_check"))
    m = table(spark, d, "customer").where("c_mktsegment <> 'BUILDING'").join(o, "c_custkey", "left").withColumn("production", F.col("c_nationkey") < 20)
    unreadable = table(spark, d, "supplier").where("s_acctbal < 3000").select(F.col("s_suppkey").alias("c_custkey"))
    return M.overdue_checks(m, "c_custkey", "last_check", "2001-08-01", 60, unreadable, "production").select("c_custkey", "last_check")


@query("select c_custkey, cast(avg(cast(o_totalprice as decimal(18,2))) as decimal(18,4))::double as mean_runtime from customer left join orders on o_custkey = c_custkey and o_orderstatus = 'F' group by 1")
def mean_runtime(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("c_custkey")).agg((F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double") / F.count("*")).alias("m"))
    return table(spark, d, "customer").select("c_custkey").join(o, "c_custkey", "left").select("c_custkey", F.col("m").cast("decimal(18,4)").cast("double").alias("mean_runtime"))


@query("""
with q as (select user_id, ts, cast(event_id % 6 as int) - 1 as status from events)
select user_id, count(*) filter (status = -1) as pending, count(*) filter (status = 4) as running, count(*) filter (status = 0) as failed, count(*) filter (status in (1, 2, 3)) as finished,
  count(*) filter (status = -1 and ts < timestamp '2024-01-30' - interval 48 hour) as expired from q group by 1
""")
def queue_stats(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "events").withColumn("status", (F.col("event_id") % 6 - 1).cast("int"))
    return M.queue_stats(q, "ts", "2024-01-30 00:00:00", 48, ["user_id"])


@query("select date_trunc('minute', ts) as minute, count(*) as starts, count(*) filter (value > 100) as heavy from events group by 1")
def starts_per_minute(spark: SparkSession, d: str) -> DataFrame:
    return M.starts_per_minute(table(spark, d, "events"), "ts", F.col("value") > 100)


@query("""
select s_suppkey, case when s_suppkey % 7 = 0 then 'not synchronised' when s_suppkey % 2 = 1 and s_nationkey % 2 = 0 then 'secondary not preferred' end as reason,
  not (s_suppkey % 7 = 0 or (s_suppkey % 2 = 1 and s_nationkey % 2 = 0)) as run from supplier
""")
def replica_eligibility(spark: SparkSession, d: str) -> DataFrame:
    rules = rows(spark, "role, preference, reason", "('SECONDARY', 'primary', 'secondary not preferred'), ('PRIMARY', 'primary', cast(null as string))")
    s = table(spark, d, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 2 == 1, "SECONDARY").otherwise("PRIMARY").alias("role"), F.when(F.col("s_nationkey") % 2 == 0, "primary").otherwise("any").alias("preference"), (F.col("s_suppkey") % 7 != 0).alias("synchronised"))
    return M.replica_eligibility(s, rules, ["role", "preference"]).select("s_suppkey", "reason", "run")


@query("""
with recursive o as (
  select c_nationkey, o_orderkey as item_id, o_orderstatus = 'F' as production, o_orderdate as last_check, case when o_orderkey % 9 <> 0 then o_totalprice / 10000 end as runtime, o_totalprice as size from orders join customer on c_custkey = o_custkey),
k as (select *, row_number() over (partition by c_nationkey order by production desc, last_check nulls first, runtime desc, item_id) as n from o where runtime is not null),
r as (
  select c_nationkey, n, item_id, runtime <= 60 as fits, cast(240 - case when runtime <= 60 then runtime else 0 end as double) as remains from k where n = 1
  union all
  select k.c_nationkey, k.n, k.item_id, r.remains > 0 and k.runtime <= r.remains and k.runtime <= 60, r.remains - case when r.remains > 0 and k.runtime <= r.remains and k.runtime <= 60 then k.runtime else 0 end from r join k on k.c_nationkey = r.c_nationkey and k.n = r.n + 1),
x as (select o.*, coalesce(r.fits, false) as in_budget, r.n from o left join r on r.c_nationkey = o.c_nationkey and r.item_id = o.item_id)
select c_nationkey, item_id, in_budget, case when in_budget then row_number() over (partition by c_nationkey, in_budget order by n)
  else row_number() over (partition by c_nationkey, in_budget order by production desc, coalesce(runtime, size) desc, item_id) + count(*) filter (in_budget) over (partition by c_nationkey) end as priority from x
""")
def budget_packing(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    q = o.select("c_nationkey", F.col("o_orderkey").alias("item_id"), (F.col("o_orderstatus") == "F").alias("production"), F.col("o_orderdate").alias("last_check"), F.when(F.col("o_orderkey") % 9 != 0, F.col("o_totalprice") / 10000).alias("runtime"), F.col("o_totalprice").alias("size"))
    return M.pack(q, ["c_nationkey"], 60.0, 4).select("c_nationkey", "item_id", "in_budget", "priority")


@query("select p_partkey from part where p_brand not in ('Brand#3', 'Brand#4') and p_partkey not in (select l_partkey from lineitem where l_linenumber = 1)")
def missing_stats(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("type"))
    s = table(spark, d, "lineitem").select(F.col("l_partkey").alias("p_partkey"), F.col("l_linenumber").alias("position"))
    return M.missing_statistics(c, s, ["p_partkey"], ["Brand#3", "Brand#4"]).select("p_partkey")


@query("""
select l_suppkey, sum(l_linenumber) as ghosts from lineitem where (l_orderkey, l_linenumber) not in (select (l_orderkey, l_linenumber) from lineitem where l_returnflag = 'A') group by 1 having sum(l_linenumber) >= 1500
""")
def residual_total(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag", F.col("l_linenumber").cast("long").alias("n"))
    return M.ghost_totals(x, x.where("l_returnflag = 'A'"), ["l_orderkey", "l_linenumber"], ["l_suppkey"], "n", 1500)


@query("""
with x as (select l_partkey, l_linenumber, l_orderkey % 40 as age, cast(l_quantity as bigint) * 10 as n, l_orderkey % 97 as changes from lineitem where l_linenumber <> 5),
s as (select l_partkey, l_linenumber from x where n > 0 and ((age >= 30 and changes <> 0) or changes * 100.0 / n >= 80 or sqrt(1000.0 * n) <= changes))
select l_partkey, string_agg(distinct l_linenumber::varchar, ',' order by l_linenumber::varchar) as partitions, count(*) as n_stale from s group by 1
""")
def stale_partitions(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "lineitem").where("l_linenumber <> 5")
    return M.stale_partitions(x, ["l_partkey"], "l_linenumber", F.col("l_orderkey") % 40, F.col("l_quantity").cast("long") * 10, F.col("l_orderkey") % 97, 30, 80.0)


@query("""
with q as (select event_id, user_id % 20 as host, event_type = 'view' as pending, value > 60 as heavy, '/m' || event_id % 6 || ',/n' || user_id % 4 as vols from events),
p as (select * from q where pending), r as (select * from q where not pending),
n as (select host, count(*) as n from r group by 1),
pv as (select distinct host, event_id, unnest(string_split(vols, ',')) as v from p), rv as (select distinct host, event_id, unnest(string_split(vols, ',')) as v from r where heavy),
s as (select pv.event_id, count(distinct rv.event_id) as n from pv join rv on pv.host = rv.host and pv.v = rv.v group by 1)
select p.event_id, coalesce(n.n, 0) as n_running, coalesce(s.n, 0) as n_same_volume from p left join n on n.host = p.host left join s on s.event_id = p.event_id
""")
def shared_volume_load(spark: SparkSession, d: str) -> DataFrame:
    k, u = F.col("event_id"), F.col("user_id")
    volumes = F.concat(F.lit("/m"), (k % 6).cast("string"), F.lit(",/n"), (u % 4).cast("string"))
    q = table(spark, d, "events").select("event_id", (u % 20).alias("host"), (F.col("event_type") == "view").alias("pending"), (F.col("value") > 60).alias("heavy"), volumes.alias("vols"))
    return M.shared_volume_load(q.where("pending"), q.where("not pending"), "host", "event_id", "vols", "heavy")


@query("""
select distinct p_partkey, 'type ' || lower(p_type) as reason from part where lower(p_type) in ('promo', 'small')
union all select distinct p_partkey, 'function ' || f from part, (values ('ring'), ('widget')) t(f) where contains(lower(p_name), f)
""")
def schema_audit(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return M.schema_audit(p.select("p_partkey", F.col("p_type").alias("type")), p.select("p_partkey", F.col("p_name").alias("text")), ["p_partkey"], ["promo", "small"], ["ring", "widget"])


@query("""
with x as (select event_id, cast(round(value * 1000) as bigint) * 997 as ms, cast(floor(value) as bigint) * 37 as s, cast(event_id % 500 as bigint) * 10000 + (event_id % 60) * 100 + event_id % 60 as packed from events)
select event_id, case when ms >= 86400000 then (ms // 86400000) || 'd ' else '' end || lpad((ms // 3600000 % 24)::varchar, 2, '0') || ':' || lpad((ms // 60000 % 60)::varchar, 2, '0') || ':' || lpad((ms // 1000 % 60)::varchar, 2, '0') || '.' || lpad((ms % 1000)::varchar, 3, '0') as took,
  lpad((s // 3600)::varchar, cast(greatest(2, length((s // 3600)::varchar)) as int), '0') || 'h ' || lpad((s // 60 % 60)::varchar, 2, '0') || 'm ' || lpad((s % 60)::varchar, 2, '0') || 's' as clock,
  packed // 10000 * 3600 + packed // 100 % 100 * 60 + packed % 100 as seconds from x
""")
def duration_texts(spark: SparkSession, d: str) -> DataFrame:
    v, k = F.col("value"), F.col("event_id")
    e = table(spark, d, "events")
    return e.select("event_id", times.duration_text(F.round(v * 1000).cast("long") * 997).alias("took"), times.hms_text(F.floor(v).cast("long") * 37).alias("clock"), times.packed_seconds(k % 500 * 10000 + k % 60 * 100 + k % 60).alias("seconds"))


@query("with x as (select o_custkey % 25 as project, min(o_orderkey) as first_priority from orders where o_orderstatus = 'O' group by 1) select project, first_priority, row_number() over (order by first_priority, project) as project_order from x")
def project_order(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "orders").where("o_orderstatus = 'O'").select((F.col("o_custkey") % 25).alias("project"), "o_orderkey")
    return M.project_order(x, "project", "o_orderkey", place(spark))


def _queue(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    q = table(spark, d, "events").select("user_id", "event_id", (F.col("event_id") % 6 - 1).cast("int").alias("status"))
    inactive = table(spark, d, "supplier").where("s_acctbal < 1000").select(F.col("s_suppkey").alias("user_id"))
    return M.archive_finished(q.where("event_id >= 100"), q.where("event_id < 100"), inactive, "user_id")


@query("select user_id, event_id from events where event_id >= 100 and event_id % 6 - 1 in (-1, 4) and user_id not in (select s_suppkey from supplier where s_acctbal < 1000)")
def queue_after_archive(spark: SparkSession, d: str) -> DataFrame:
    return _queue(spark, d)[0].select("user_id", "event_id")


@query("select user_id, event_id from events where event_id < 100 or event_id % 6 - 1 not in (-1, 4)")
def history_after_archive(spark: SparkSession, d: str) -> DataFrame:
    return _queue(spark, d)[1].select("user_id", "event_id")
