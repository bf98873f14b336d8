"""Queries of filters, windows and runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.operators import filters as X
from fleetlens.operators import frames, health
from fleetlens.plans.registry import query, rows, table

_RULES = "('Supplier#000000003', null), ('supplier#000000010', 'NATION_4'), ('NATION_7', null)"


@query(f"""
select s_suppkey, s_name, n_name from supplier join nation on n_nationkey = s_nationkey where not exists (
  select 1 from (values {_RULES}) r(k1, k2) where lower(k1) in (lower(s_name), lower(n_name)) and (k2 is null or lower(k2) = lower(n_name)))
""")
def skip_rules(spark: SparkSession, d: str) -> DataFrame:
    r = rows(spark, "k1, k2", _RULES).select(F.lit(16).alias("rule_id"), F.col("k1").alias("skip_value"), F.col("k2").cast("string").alias("skip_value2"), F.lit(True).alias("active"))
    x = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("n_nationkey") == F.col("s_nationkey"))
    return X.skip_rules(x, r, 16, ["s_name", "n_name"], "n_name").select("s_suppkey", "s_name", "n_name")


@query("""
select event_id, user_id, event_type from events where not exists (
  select 1 from (values ('%', 'sign%'), ('7', null), ('9', 'error'), ('12', '%ck')) r(k1, k2)
  where (k1 = '%' or k1 = cast(user_id as varchar)) and (k2 is null or event_type like k2))
""")
def skip_rules_wild(spark: SparkSession, d: str) -> DataFrame:
    r = rows(spark, "skip_value, skip_value2", "('%', 'sign%'), ('7', cast(null as string)), ('9', 'error'), ('12', '%ck')").withColumn("active", F.lit(True))
    x = table(spark, d, "events").select("event_id", "user_id", "event_type").withColumn("_user", F.col("user_id").cast("string"))
    return X.skip_rules_wild(x, r, ["_user"], ["event_type"]).drop("_user")


@query("""
select o_orderkey from orders where lower('[' || o_orderstatus || '].[' || o_orderpriority || '](' || cast(o_custkey as varchar) || ')') not in
  (select lower(v) from (values ('[F].[1-URGENT](7)'), ('[o].[2-high](11)')) t(v))
""")
def skip_rules_label(spark: SparkSession, d: str) -> DataFrame:
    r = rows(spark, "skip_value, active", "('[F].[1-URGENT](7)', true), ('[o].[2-high](11)', true)")
    x = table(spark, d, "orders").withColumn("_c", F.col("o_custkey").cast("string"))
    return X.skip_rules_label(x, r, "o_orderstatus", "o_orderpriority", "_c").select("o_orderkey")


_PATTERNS = ["%All rights reserved.%", "Licensed under%", "%GNU General Public License, version _.%"]


@query("select doc_id, source from documents where not (" + " or ".join(f"text ilike '{p}'" for p in _PATTERNS) + ")")
def pattern_suppression(spark: SparkSession, d: str) -> DataFrame:
    return X.pattern_suppression(table(spark, d, "documents"), "text", _PATTERNS).select("doc_id", "source")


@query("""
with o as (select o_orderkey, 'customer#' || lpad(o_custkey::varchar, 9, '0') || ' ordered at ' || o_orderpriority as message from orders),
p as (select '%#' || lpad((s_suppkey * 7)::varchar, 9, '0') || '%at ' || (s_suppkey % 5 + 1) || '-%' as pattern from supplier)
select o_orderkey from o where not exists (select 1 from p where message ilike pattern)
""")
def pattern_index(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0"), F.lit(" ordered at "), "o_orderpriority").alias("message"))
    k = F.col("s_suppkey")
    p = table(spark, d, "supplier").select(F.concat(F.lit("%#"), F.lpad((k * 7).cast("string"), 9, "0"), F.lit("%at "), (k % 5 + 1).cast("string"), F.lit("-%")).alias("pattern"))
    return X.suppress_patterns(o, "message", p).select("o_orderkey")


@query("""
with r as (select '%#' || lpad((c_custkey * 7)::varchar, 9, '0') as pattern from customer)
select c_custkey, c_mktsegment from customer where not exists (select 1 from r where lower(c_name) like pattern or lower(c_mktsegment) like pattern)
""")
def skip_rules_many(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    r = c.select(F.lit("%").alias("skip_value"), F.concat(F.lit("%#"), F.lpad((F.col("c_custkey") * 7).cast("string"), 9, "0")).alias("skip_value2"), F.lit(True).alias("active"))
    return X.skip_rules_wild(c, r, [], ["c_name", "c_mktsegment"]).select("c_custkey", "c_mktsegment")


@query("select p_partkey, cast(i as bigint) as position, trim(split_part(p_name, ' ', i)) as value from part, unnest(range(1, len(string_split(p_name, ' ')) + 1)) u(i) where trim(split_part(p_name, ' ', cast(i as int))) <> ''")
def list_filter(spark: SparkSession, d: str) -> DataFrame:
    return X.list_rows(table(spark, d, "part").select("p_partkey", "p_name"), "p_name", " ").select("p_partkey", F.col("position").cast("long").alias("position"), "value")


@query("select p_partkey, p_brand from part where p_brand is null or lower(p_brand) not in ('brand#1', 'brand#2', 'brand#25')")
def exclude_names(spark: SparkSession, d: str) -> DataFrame:
    return X.exclude_names(table(spark, d, "part").select("p_partkey", "p_brand"), "p_brand", ["Brand#1", "BRAND#2", "Brand#25"])


@query("select o_orderkey, o_orderstatus from orders where o_orderstatus not in ('F', 'O')")
def admitted_state(spark: SparkSession, d: str) -> DataFrame:
    return health.not_admitted(table(spark, d, "orders"), "o_orderstatus", "F, O").select("o_orderkey", "o_orderstatus")


@query("select c_custkey from customer where c_name ilike 'CUSTOMER#%_7'")
def member_filter(spark: SparkSession, d: str) -> DataFrame:
    return X.member_filter(table(spark, d, "customer"), "c_name", "CUSTOMER#%_7").select("c_custkey")


@query("select l_orderkey, l_linenumber, l_extendedprice from lineitem order by l_extendedprice desc, l_orderkey, l_linenumber limit 25")
def largest_rows(spark: SparkSession, d: str) -> DataFrame:
    return frames.largest(table(spark, d, "lineitem"), "l_extendedprice", ["l_orderkey", "l_linenumber"], 25).select("l_orderkey", "l_linenumber", "l_extendedprice")


@query("""
with r(brand, flags) as (values ('Brand#1', 1), ('Brand#2', 6), (null, 24))
select p_partkey, p_brand, p_size % 32 as flags from part p where not exists (select 1 from r where (5 & r.flags) = r.flags and (r.brand is null or r.brand = p.p_brand))
""")
def flag_subset(spark: SparkSession, d: str) -> DataFrame:
    r = rows(spark, "p_brand, flags, active", "('Brand#1', 1, true), ('Brand#2', 6, true), (null, 24, true)")
    x = table(spark, d, "part").select("p_partkey", "p_brand", (F.col("p_size") % 32).alias("flags"))
    return X.flag_subset_skip(x, r, ["p_brand"], 5)


@query("""
with e as (select event_id, ts, case when event_id % 3 = 0 then null else ts end as utc from events)
select event_id from e where (utc is not null and utc >= timestamp '2024-01-30 12:00:00' - interval 24 hour) or (utc is null and ts >= timestamp '2024-01-30 14:00:00' - interval 24 hour)
""")
def recent_window(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("utc", F.when(F.col("event_id") % 3 != 0, F.col("ts")))
    return X.recent(e, "utc", "ts", 24, "2024-01-30 12:00:00", "2024-01-30 14:00:00").select("event_id")


@query("""
select p_partkey from part where p_partkey not in (select l_partkey from lineitem where l_returnflag = 'R' and l_quantity > 40 group by 1 having sum(l_quantity) <> 0) and p_partkey not in (select p_partkey from part where p_size > 45)
""")
def unused_members(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", "p_size")
    use = table(spark, d, "lineitem").where("l_returnflag = 'R' and l_quantity > 40").select(F.col("l_partkey").alias("p_partkey"), "l_quantity")
    return X.unused(p, use, "p_partkey", "l_quantity", p.where("p_size > 45")).select("p_partkey")


@query("select c_custkey from customer where c_nationkey not in (select s_nationkey from supplier group by 1 having min(case when s_acctbal < 5000 then 1 else 0 end) = 1)")
def offline_members(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "supplier").select(F.col("s_nationkey").alias("c_nationkey"), (F.col("s_acctbal") < 5000).alias("offline"))
    return X.without_offline_groups(table(spark, d, "customer"), files, "c_nationkey", "offline").select("c_custkey")


_PARTS = "select o_custkey, case when o_orderstatus = 'F' then null else o_orderstatus end as part, count(*) as n from orders group by all"


@query(f"with x as ({_PARTS}) select * from x where part is not null or o_custkey not in (select o_custkey from x where part is not null)")
def detail_over_summary(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "orders").groupBy("o_custkey", F.when(F.col("o_orderstatus") != "F", F.col("o_orderstatus")).alias("part")).agg(F.count("*").alias("n"))
    return X.detail_over_summary(x, ["o_custkey"], "part")


@query("select min(s_suppkey) as s_suppkey, s_nationkey from supplier group by s_nationkey")
def one_per_host(spark: SparkSession, d: str) -> DataFrame:
    return X.one_per_host(table(spark, d, "supplier").select("s_suppkey", "s_nationkey"), ["s_nationkey"], "s_suppkey")


@query("""
with m as (select c_custkey, c_mktsegment, c_nationkey, c_acctbal > 9000 as active from customer)
select * from m where active or exists (select 1 from m t where t.active and t.c_mktsegment = m.c_mktsegment and t.c_nationkey <> m.c_nationkey)
""")
def passive_twins(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_nationkey", (F.col("c_acctbal") > 9000).alias("active"))
    return X.with_passive_twins(m, "c_mktsegment", "c_nationkey", "active")


@query("""
select user_id, event_id, row_no from (select user_id, event_id, row_number() over (partition by user_id order by value desc, event_id) as row_no from events) where row_no <= 5
""")
def top_n_per_owner(spark: SparkSession, d: str) -> DataFrame:
    return frames.top_per_owner(table(spark, d, "events"), ["user_id"], [F.col("value").desc(), F.col("event_id")], 5).select("user_id", "event_id", "row_no")


@query("select event_id, row_number() over (partition by event_type order by ts, event_id) as row_no, count(*) over (partition by event_type) as row_count from events")
def position_and_total(spark: SparkSession, d: str) -> DataFrame:
    return frames.position_and_total(table(spark, d, "events"), ["event_type"], [F.col("ts"), F.col("event_id")]).select("event_id", "row_no", "row_count")


@query("""
with a as (
  select *, sum(case when event_type = 'purchase' then 1 else 0 end) over (partition by user_id order by ts desc, event_id desc rows unbounded preceding) as after from events)
select event_id, user_id, case when after = 0 then 'current' else 'finished' end as run_state from a where event_type <> 'purchase' and after <= 1
""")
def run_slicing(spark: SparkSession, d: str) -> DataFrame:
    return frames.run_slices(table(spark, d, "events"), ["user_id"], F.col("event_type") == "purchase", ["ts", "event_id"]).select("event_id", "user_id", "run_state")


@query("select event_type, user_id, max(ts) as last_time, count(*) as occurrences from events group by all")
def last_occurrence(spark: SparkSession, d: str) -> DataFrame:
    return frames.last_occurrence(table(spark, d, "events"), ["event_type"], "user_id", "ts")


@query("select table_name, n_rows from (select 'customer' as table_name, count(*) as n_rows from customer union all select 'lineitem', count(*) from lineitem union all select 'orders', count(*) from orders)")
def table_row_counts(spark: SparkSession, d: str) -> DataFrame:
    return frames.row_counts({n: table(spark, d, n) for n in ("customer", "lineitem", "orders")})


@query("""
select l_suppkey, cast(coalesce(sum(cast(l_quantity as decimal(18,2))) filter (l_returnflag = 'A'), 0) as double) as a, cast(coalesce(sum(cast(l_quantity as decimal(18,2))) filter (l_returnflag = 'N'), 0) as double) as n,
  cast(coalesce(sum(cast(l_quantity as decimal(18,2))) filter (l_returnflag = 'X'), 0) as double) as x from lineitem group by 1
""")
def pivot_by_kind(spark: SparkSession, d: str) -> DataFrame:
    x = frames.pivot_sums(table(spark, d, "lineitem"), ["l_suppkey"], "l_returnflag", frames.exact("l_quantity"), {"A": "a", "N": "n", "X": "x"})
    return x.select("l_suppkey", *(F.col(c).cast("double").alias(c) for c in ("a", "n", "x")))


@query("select o_orderkey, count(*) over (partition by o_custkey) as group_count from orders")
def group_count(spark: SparkSession, d: str) -> DataFrame:
    return frames.with_group_count(table(spark, d, "orders"), ["o_custkey"]).select("o_orderkey", "group_count")


@query("with x as (select s_nationkey, l_suppkey, sum(cast(l_quantity as bigint)) as s from lineitem join supplier on s_suppkey = l_suppkey group by all) select s_nationkey, count(*) as n_groups, cast(sum(s) as bigint) as total, max(s) as largest from x group by 1")
def rollup_twice(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("s_suppkey") == F.col("l_suppkey"))
    return frames.rollup_twice(x, ["s_nationkey", "l_suppkey"], ["s_nationkey"], F.col("l_quantity").cast("long"))


@query("select user_id, arg_max(event_type, (ts, event_id)) as last_type from events group by 1")
def arg_max(spark: SparkSession, d: str) -> DataFrame:
    return frames.arg_max(table(spark, d, "events"), ["user_id"], "event_type", ["ts", "event_id"], "last_type")


@query("with x as (select l_orderkey, l_returnflag, case when l_linenumber = 3 then null else l_linenumber end as n from lineitem) select l_orderkey, case when count(*) filter (n is null) = 0 then max(n) end as longest from x group by 1")
def max_or_open(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "lineitem").select("l_orderkey", F.when(F.col("l_linenumber") != 3, F.col("l_linenumber")).alias("n"))
    return frames.max_or_open(x, ["l_orderkey"], "n", "longest")
