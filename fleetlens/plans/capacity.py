"""Queries of capacity and growth."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.operators import capacity as C
from fleetlens.operators import filters, frames
from fleetlens.plans.registry import query, rows, table

_GROWTH = """
with r as (
  select o_custkey, o_totalprice,
    row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as a,
    row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as b
  from orders where o_totalprice is not null),
g as (
  select o_custkey, max(case when a = 1 then o_totalprice end) as old_size, max(case when b = 1 then o_totalprice end) as current_size
  from r group by o_custkey),
growth as (
  select *, cast(cast(current_size as decimal(18,2)) - cast(old_size as decimal(18,2)) as double) as growth_size,
    case when old_size <> 0 then round((current_size - old_size) * 100.0 / old_size, 2) end as growth_percent from g)
"""


def _growth(spark: SparkSession, d: str) -> DataFrame:
    return C.growth(table(spark, d, "orders"), ["o_custkey"], "o_orderdate", "o_totalprice", "o_orderkey")


@query(_GROWTH + "select o_custkey, old_size, current_size, growth_size, growth_percent from growth")
def growth_first_last(spark: SparkSession, d: str) -> DataFrame:
    return _growth(spark, d)


@query(
    _GROWTH
    + """select g.o_custkey, c.c_name, g.growth_size, g.growth_percent from growth g join customer c on c.c_custkey = g.o_custkey
where (growth_percent > 50 or growth_size > 200000) and not exists (
  select 1 from (values ('Customer#000000007', null), ('Customer#000000011', 'BUILDING')) s(k1, k2)
  where lower(s.k1) = lower(c.c_name) and (s.k2 is null or lower(s.k2) = lower(c.c_mktsegment)))"""
)
def growth_issues(spark: SparkSession, d: str) -> DataFrame:
    rules = rows(spark, "rule_id, skip_value, skip_value2, active", "(512, 'Customer#000000007', cast(null as string), true), (512, 'Customer#000000011', 'BUILDING', true), (512, 'Customer#000000013', null, false)")
    x = _growth(spark, d).where("growth_percent > 50 or growth_size > 200000")
    x = x.join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return filters.skip_rules(x, rules, 512, ["c_name"], "c_mktsegment").select("o_custkey", "c_name", "growth_size", "growth_percent")


@query("""
with e as (
  select user_id, event_type, event_id, ts, lag(ts) over w as before, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) as n
  from events window w as (partition by user_id, event_type order by ts, event_id))
select user_id, event_type, event_id, cast(ceil(date_diff('hour', before, ts) / 24.0) as bigint) as interval_days
from e where n = 1 and before is not null and ceil(date_diff('hour', before, ts) / 24.0) <= 2
""")
def frequent_repeat(spark: SparkSession, d: str) -> DataFrame:
    return C.frequent_maintenance(table(spark, d, "events").select("user_id", "event_type", "event_id", "ts"), ["user_id", "event_type"], "ts", "event_id", 2).select("user_id", "event_type", "event_id", F.col("interval_days").cast("long").alias("interval_days"))


@query("""
with info as (select user_id, event_id, ts from events where event_type = 'view'), act as (select user_id, ts as action_time from events where event_type = 'click'),
p as (
  select i.user_id, i.event_id, i.ts, a.action_time, row_number() over (partition by i.event_id order by abs(epoch_us(a.action_time) - epoch_us(i.ts)), a.action_time) as n
  from info i join act a on a.user_id = i.user_id where abs(epoch_us(a.action_time) - epoch_us(i.ts)) <= 3600000000)
select user_id, event_id, action_time from p where n = 1
""")
def paired_events(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "event_id", "ts", "event_type")
    info, act = (e.where(F.col("event_type") == k).drop("event_type") for k in ("view", "click"))
    return C.paired_actions(info, act.select("user_id", "ts"), ["user_id"], "ts", 3600).select("user_id", "event_id", "action_time")


@query("""
with det as (select s.s_nationkey as nation, count(*) as n_members, cast(sum(cast(s_acctbal as decimal(18,2))) as double) as size_total from supplier s group by 1),
b as (
  select s.s_nationkey as nation, count(distinct l_orderkey) as n_files,
    cast(sum(cast(l_extendedprice as decimal(18,2))) filter (l_returnflag = 'A') as double) as full_bytes, count(l_orderkey) filter (l_returnflag = 'A') as full_files,
    cast(sum(cast(l_extendedprice as decimal(18,2))) filter (l_returnflag = 'N') as double) as diff_bytes, count(l_orderkey) filter (l_returnflag = 'N') as diff_files,
    cast(sum(cast(l_extendedprice as decimal(18,2))) filter (l_returnflag = 'R') as double) as log_bytes, count(l_orderkey) filter (l_returnflag = 'R') as log_files
  from lineitem join supplier s on s_suppkey = l_suppkey group by 1)
select det.nation, n_members, size_total, coalesce(n_files, 0) as n_files, coalesce(full_bytes, 0) as full_bytes, coalesce(full_files, 0) as full_files, coalesce(diff_bytes, 0) as diff_bytes,
  coalesce(diff_files, 0) as diff_files, coalesce(log_bytes, 0) as log_bytes, coalesce(log_files, 0) as log_files
from det left join b on det.nation is not distinct from b.nation
""")
def backup_capacity(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").withColumn("nation", F.col("s_nationkey"))
    b = table(spark, d, "lineitem").join(s.select("s_suppkey", "nation"), F.col("l_suppkey") == F.col("s_suppkey"))
    x = C.backup_capacity(s, b, ["nation"], frames.exact("s_acctbal"), "l_orderkey", "l_returnflag", frames.exact("l_extendedprice"), {"A": "full", "N": "diff", "R": "log"})
    return x.select(*(F.col(c).cast("double").alias(c) if c.endswith(("bytes", "total")) else F.col(c) for c in x.columns))


@query("""
with m as (select s_suppkey, s_nationkey, case when s_suppkey % 5 = 0 then 'PRIMARY' else 'SECONDARY' end as role, case when s_suppkey % 3 = 1 then null else s_acctbal end as size from supplier),
p as (select s_nationkey, max(size) as psize from m where role = 'PRIMARY' group by 1)
select m.s_suppkey, m.s_nationkey, role, coalesce(size, psize) as size from m left join p on p.s_nationkey = m.s_nationkey
""")
def replica_fallback(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "supplier").select("s_suppkey", "s_nationkey", F.when(F.col("s_suppkey") % 5 == 0, "PRIMARY").otherwise("SECONDARY").alias("role"), F.when(F.col("s_suppkey") % 3 != 1, F.col("s_acctbal")).alias("size"))
    return C.replica_fallback(m, ["s_nationkey"], "role", "PRIMARY", "size")


@query("""
with x as (
  select l_suppkey, l_linestatus = 'F' as is_log, cast(l_extendedprice as decimal(18,2)) as s, cast(l_extendedprice * (1 - l_discount) as decimal(18,2)) as u, l_returnflag from lineitem),
g as (
  select l_suppkey, coalesce(sum(s) filter (not is_log), 0) as ds, coalesce(sum(s) filter (is_log), 0) as ls, coalesce(sum(u) filter (not is_log), 0) as du, coalesce(sum(u) filter (is_log), 0) as lu,
    string_agg(distinct l_returnflag, ', ' order by l_returnflag) as mount_points from x group by 1)
select l_suppkey, cast(ds as double) as data_size, cast(ls as double) as log_size, case when ds <> 0 then round(cast(du as double) * 100 / cast(ds as double), 2) else 0 end as data_used_percent,
  case when ls <> 0 then round(cast(lu as double) * 100 / cast(ls as double), 2) else 0 end as log_used_percent, mount_points from g
""")
def space_by_owner(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "lineitem").withColumn("used", F.col("l_extendedprice") * (1 - F.col("l_discount")))
    return C.space_by_owner(x, ["l_suppkey"], F.col("l_linestatus") == "F", "l_extendedprice", "used", "l_returnflag")


@query("""
with p(prefix) as (values ('https://'), ('http://'), ('https://m.'), ('https://www.'), ('https://blog.')),
u as (select page_id, regexp_replace(url, '^([^.]*)[.]', '\\1./') as path from pages)
select u.page_id, (select max_by(replace(prefix, '.', './'), length(prefix)) from p where starts_with(u.path, replace(prefix, '.', './'))) as owner_prefix from u
""")
def prefix_attribution(spark: SparkSession, d: str) -> DataFrame:
    p = rows(spark, "prefix", "('https://'), ('http://'), ('https://m./'), ('https://www./'), ('https://blog./')")
    u = table(spark, d, "pages").select("page_id", F.regexp_replace("url", r"^([^.]*)\.", "$1./").alias("path"))
    return C.prefix_attribution(u, "path", p, "prefix").select("page_id", "owner_prefix")


@query("select c_custkey, max(case when o_orderstatus = 'F' then o_orderdate end) as last_time from customer left join orders on o_custkey = c_custkey group by 1")
def last_event_or_null(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"), "o_orderdate")
    return C.last_event_or_null(table(spark, d, "customer").select("c_custkey"), o, ["c_custkey"], "o_orderdate", "last_time")


@query("""
with c as (select case when c_nationkey < 18 then c_nationkey end as nation, count(*) as n_customers from customer group by 1), s as (select case when s_nationkey > 6 then s_nationkey end as nation, count(*) as n_suppliers from supplier group by 1)
select coalesce(c.nation, s.nation) as nation, n_customers, coalesce(n_suppliers, 0) as n_suppliers from c full join s on c.nation = s.nation
""")
def merge_partials(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").groupBy(F.when(F.col("c_nationkey") < 18, F.col("c_nationkey")).alias("nation")).agg(F.count("*").alias("n_customers"))
    s = table(spark, d, "supplier").groupBy(F.when(F.col("s_nationkey") > 6, F.col("s_nationkey")).alias("nation")).agg(F.count("*").alias("n_suppliers"))
    return C.merge_partials(c, s, ["nation"], {"n_suppliers": 0})


@query("""
with m as (select s_suppkey, s_nationkey from supplier), has as (select s_suppkey, s_acctbal from supplier where s_suppkey % 4 = 0),
donor as (select s_nationkey, min(m.s_suppkey) as donor from m join has using (s_suppkey) group by 1)
select s_suppkey, s_acctbal, false as inherited from has
union all select m.s_suppkey, h.s_acctbal, true from m join donor d using (s_nationkey) join has h on h.s_suppkey = d.donor where m.s_suppkey % 4 <> 0
""")
def pool_inherit(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier")
    return C.pool_inherit(s.select("s_suppkey", "s_nationkey"), s.where("s_suppkey % 4 = 0").select("s_suppkey", "s_acctbal"), "s_suppkey", "s_nationkey")


@query("""
with r as (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as n from events)
select user_id, ts, round(value * (100 - cast(json_extract_string(props, '$.k') as double)) / 100, 4) as free from r where n = 1
""")
def latest_sample(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("used", F.get_json_object("props", "$.k").cast("double"))
    return C.latest_sample(e, ["user_id"], "ts", "event_id", "value", "used")


@query("""
with g as (
  select l_suppkey, l_returnflag, sum(cast(l_quantity as bigint) * 8) as growth_kb from lineitem where l_shipdate > timestamp '1998-01-01' group by all)
select g.l_suppkey, l_returnflag, growth_kb, s_name from g join supplier s on s.s_suppkey = g.l_suppkey where growth_kb > 0
""")
def growth_events(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "lineitem").withColumn("pages", F.col("l_quantity").cast("long"))
    files = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
    return C.growth_events(x, files, ["l_suppkey"], ["l_returnflag"], "pages", "l_shipdate", "1998-01-01")


@query("""
with m as (select s_suppkey, s_nationkey, case when s_suppkey % 3 = 0 then null else s_suppkey * 10 end as data, case when s_suppkey % 5 = 0 then null else s_suppkey end as log from supplier),
f as (select l_suppkey, sum(cast(l_quantity as bigint)) as q from lineitem where l_linenumber < 4 group by 1)
select s_nationkey, sum(coalesce(data + log, q)) as size_total, count(*) filter (data + log is null) as n_fallback from m left join f on l_suppkey = s_suppkey group by 1
""")
def size_with_fallback(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    m = table(spark, d, "supplier").select("s_suppkey", "s_nationkey", F.when(k % 3 != 0, k * 10).alias("data"), F.when(k % 5 != 0, k).alias("log"))
    f = table(spark, d, "lineitem").where("l_linenumber < 4").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.sum(F.col("l_quantity").cast("long")).alias("q"))
    return C.size_with_fallback(m, f, ["s_suppkey"], ["s_nationkey"], ["data", "log"], "q")
