"""Queries of ingestion and table upkeep."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetlens.operators import ingest as I
from fleetlens.plans.registry import place, query, table
from fleetlens.sources import tables as S

_DAY = "timestamp '1999-01-01'"


def _split(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    return o.where("o_orderdate < timestamp_ntz'1999-01-01'"), o


@query(f"""
with s as (select o_custkey, max(o_orderdate) as high from orders where o_orderdate < {_DAY} group by 1)
select o_orderkey from orders left join s using (o_custkey) where o_orderdate > coalesce(high, timestamp '1900-01-01')
""")
def watermark_pull(spark: SparkSession, d: str) -> DataFrame:
    stored, new = _split(spark, d)
    return I.incremental(new, stored, ["o_custkey"], "o_orderdate", "1900-01-01").select("o_orderkey")


@query("with s as (select o_custkey, max(o_orderkey) as high from orders where o_orderkey % 3 = 0 group by 1) select o_orderkey from orders left join s using (o_custkey) where o_orderkey > coalesce(high, 0)")
def id_pull(spark: SparkSession, d: str) -> DataFrame:
    _, new = _split(spark, d)
    return I.incremental(new, new.where("o_orderkey % 3 = 0"), ["o_custkey"], "o_orderkey", 0).select("o_orderkey")


@query(f"select o_orderkey from orders where o_orderkey not in (select o_orderkey from orders where o_orderdate < {_DAY})")
def new_history_events(spark: SparkSession, d: str) -> DataFrame:
    stored, new = _split(spark, d)
    return I.only_new(stored, new, ["o_orderkey"]).select("o_orderkey")


@query(f"select o_orderkey, o_orderstatus from orders where o_orderdate < {_DAY} union all select o_orderkey, o_orderstatus from orders where o_orderdate >= {_DAY} and o_orderstatus = 'F'")
def archive_snapshot(spark: SparkSession, d: str) -> DataFrame:
    stored, new = _split(spark, d)
    return I.archive_snapshot(new.where("o_orderdate >= timestamp_ntz'1999-01-01'"), stored, "o_orderstatus = 'F'").select("o_orderkey", "o_orderstatus")


@query("with n as (select s_nationkey, s_suppkey, s_acctbal + 1 as bal from supplier where s_nationkey % 4 = 0) select s_nationkey, s_suppkey, s_acctbal as bal from supplier where s_nationkey not in (select s_nationkey from n) union all select * from n")
def replace_slice(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "supplier").select("s_nationkey", "s_suppkey", F.col("s_acctbal").alias("bal"))
    return I.replace_slice(t, t.where("s_nationkey % 4 = 0").withColumn("bal", F.col("bal") + 1), ["s_nationkey"])


@query("select s_suppkey from supplier where s_nationkey not in (select s_nationkey from supplier where s_acctbal > 9000)")
def replace_group(spark: SparkSession, d: str) -> DataFrame:
    return I.replace_group(table(spark, d, "supplier"), "s_acctbal > 9000", ["s_nationkey"]).select("s_suppkey")


@query("""
with src as (select s_suppkey * 20 as c_custkey, 'x' || s_name as c_name, s_acctbal * 2 as c_acctbal from supplier)
select coalesce(d.c_custkey, s.c_custkey) as c_custkey, coalesce(d.c_name, s.c_name) as c_name, case when s.c_custkey is not null then s.c_acctbal else d.c_acctbal end as c_acctbal from customer d full join src s on d.c_custkey = s.c_custkey
""")
def upsert(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    src = table(spark, d, "supplier").select((F.col("s_suppkey") * 20).alias("c_custkey"), F.concat(F.lit("x"), "s_name").alias("c_name"), (F.col("s_acctbal") * 2).alias("c_acctbal"))
    return I.upsert(c, src, ["c_custkey"], ["c_acctbal"])


def _stored_orders(spark: SparkSession, d: str) -> str:
    """Orders, stored in partitions by month."""
    path = place(spark)
    table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", F.date_format("o_orderdate", "yyyy-MM-01").alias("month")).write.partitionBy("month").parquet(path)
    return path


@query("""
with src as (select l_orderkey as k, sum(l_linenumber) as n from lineitem group by 1), late as (select max(o_orderdate) - interval 60 days as d from orders)
select o_orderkey, case when k is null or o_orderdate < (select date_trunc('month', d) from late) then o_orderstatus else 'X' end as o_orderstatus, o_totalprice, strftime(o_orderdate, '%Y-%m-01') as month from orders left join src on k = o_orderkey
""")
def upsert_stored(spark: SparkSession, d: str) -> DataFrame:
    path = _stored_orders(spark, d)
    o = table(spark, d, "orders")
    recent = o.agg(F.date_trunc("month", F.max("o_orderdate") - F.expr("interval 60 days")).alias("since"))
    src = o.join(F.broadcast(recent), F.col("o_orderdate") >= F.col("since")).join(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")).distinct(), "o_orderkey")  # one row
    src = src.select("o_orderkey", F.lit("X").alias("o_orderstatus"), F.date_format("o_orderdate", "yyyy-MM-01").alias("month"))
    I.upsert_stored(spark, path, src, ["o_orderkey"], ["o_orderstatus"], "month", place(spark))
    return spark.read.schema("o_orderkey long, o_orderstatus string, o_totalprice double, month string").parquet(path)


@query("""
with n as (select o_orderkey, 'N' as o_orderstatus, o_totalprice * 2 as o_totalprice, strftime(o_orderdate, '%Y-%m-01') as month from orders where o_orderpriority = '1-URGENT' and o_orderdate >= (select max(o_orderdate) - interval 200 days from orders))
select o_orderkey, o_orderstatus, o_totalprice, strftime(o_orderdate, '%Y-%m-01') as month from orders where strftime(o_orderdate, '%Y-%m-01') not in (select month from n) union all select * from n
""")
def replace_stored(spark: SparkSession, d: str) -> DataFrame:
    path = _stored_orders(spark, d)
    o = table(spark, d, "orders")
    recent = o.agg((F.max("o_orderdate") - F.expr("interval 200 days")).alias("since"))
    new = o.join(F.broadcast(recent), F.col("o_orderdate") >= F.col("since")).where("o_orderpriority = '1-URGENT'")  # one row
    new = new.select("o_orderkey", F.lit("N").alias("o_orderstatus"), (F.col("o_totalprice") * 2).alias("o_totalprice"), F.date_format("o_orderdate", "yyyy-MM-01").alias("month"))
    I.replace_stored(spark, path, new, "month", place(spark))
    return spark.read.schema("o_orderkey long, o_orderstatus string, o_totalprice double, month string").parquet(path)


@query("select o_orderkey, o_orderstatus, o_totalprice, strftime(o_orderdate, '%Y-%m-01') as month from orders where strftime(o_orderdate, '%Y-%m-01') >= '1998-01-01'")
def purge_stored(spark: SparkSession, d: str) -> DataFrame:
    path = _stored_orders(spark, d)
    I.purge_stored(spark, path, "month", 365, "1999-01-01")
    return spark.read.schema("o_orderkey long, o_orderstatus string, o_totalprice double, month string").parquet(path)


@query("select c_custkey, case when c_nationkey < 10 then c_custkey in (select o_custkey from orders where o_orderstatus = 'F') else c_acctbal > 0 end as active from customer")
def sync_active(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey", (F.col("c_acctbal") > 0).alias("active"))
    seen = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return I.sync_active(c, seen, ["c_custkey"], "c_nationkey < 10").select("c_custkey", "active")


@query("""
select distinct user_id as id, 'new' as status from events where user_id not in (select s_suppkey from supplier)
union all select s_suppkey, 'gone' from supplier where s_suppkey not in (select user_id from events where user_id % 2 = 0) and s_suppkey not in (select user_id from events where user_id % 2 = 1)
""")
def drift(spark: SparkSession, d: str) -> DataFrame:
    return I.drift(table(spark, d, "supplier").select(F.col("s_suppkey").alias("id")), table(spark, d, "events").select(F.col("user_id").alias("id")), ["id"])


@query("select n_nationkey, n_name from nation where n_nationkey < 20 union all select n_nationkey, 'seed' from nation where n_nationkey >= 20")
def seed_defaults(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    return I.seed(n.where("n_nationkey < 20"), n.withColumn("n_name", F.lit("seed")), ["n_nationkey"])


@query("select 'events' as table_name, count(*) as n_rows from events where ts >= timestamp '2024-01-31' - interval 15 day union all select 'lineitem', count(*) from lineitem union all select 'orders', count(*) from orders where o_orderdate >= timestamp '2024-01-31' - interval 9000 day")
def purge(spark: SparkSession, d: str) -> DataFrame:
    from fleetlens.operators.frames import row_counts

    t = {n: table(spark, d, n) for n in ("events", "lineitem", "orders")}
    return row_counts(I.purge(t, {"events": ("ts", 15), "orders": ("o_orderdate", 9000), "lineitem": ("l_shipdate", 0)}, "2024-01-31 00:00:00"))


@query("select 'customer' as table_name, count(*) as n_rows from customer where c_nationkey <> 4 union all select 'nation', count(*) from nation where n_nationkey <> 4 union all select 'supplier', count(*) from supplier where s_nationkey <> 4")
def cascade(spark: SparkSession, d: str) -> DataFrame:
    from fleetlens.operators.frames import row_counts

    t = {n: table(spark, d, n) for n in ("nation", "customer", "supplier")}
    return row_counts(I.cascade_remove(t, {"nation": "n_nationkey", "customer": "c_nationkey", "supplier": "s_nationkey"}, 4))


@query("select cast(d as date) as day from generate_series(timestamp '2023-12-25', timestamp '2024-02-05', interval 1 day) t(d) where cast(d as date) not in (select cast(ts as date) from events)")
def daily_calendar(spark: SparkSession, d: str) -> DataFrame:
    return S.missing_days(table(spark, d, "events"), "ts", "2023-12-25", "2024-02-05")


@query("select event_id, cast(json_extract_string(props, '$.k') as integer) as k from events")
def payload_shred(spark: SparkSession, d: str) -> DataFrame:
    return S.shred_json(table(spark, d, "events").select("event_id", "props"), "props", "k int").select("event_id", "k")


@query("select event_id, event_type, cast(value as decimal(18,2))::double as value from events")
def xml_shred(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "events").select("event_id", S.to_payload(["event_type", "value"]).alias("message"))
    return S.shred(x, "message", "event_type string, value double").select("event_id", "event_type", "value")


@query("select event_id, event_type as \"Level\", cast(user_id as varchar) as \"Id\" from events")
def property_pivot(spark: SparkSession, d: str) -> DataFrame:
    p = lambda n, c: F.concat(F.lit(f'<Property Name="{n}">'), F.col(c).cast("string"), F.lit("</Property>"))
    x = table(spark, d, "events").select("event_id", F.concat(F.lit("<Object>"), p("Id", "user_id"), p("Level", "event_type"), p("Other", "value"), F.lit("</Object>")).alias("bag"))
    return S.pivot_properties(x, ["event_id"], "bag", ["Level", "Id"])


@query("select p_partkey, p_brand, p_size, p_retailprice from part where p_partkey % 11 <> 0")
def line_parse(spark: SparkSession, d: str) -> DataFrame:
    size = F.when(F.col("p_partkey") % 11 == 0, "n/a").otherwise(F.col("p_size").cast("string"))
    line = F.concat_ws("|", F.col("p_partkey").cast("string"), "p_brand", size, F.col("p_retailprice").cast("string"))
    ok, _ = S.parse_lines(table(spark, d, "part").select(line.alias("line")), "line", [("p_partkey", "long"), ("p_brand", "string"), ("p_size", "int"), ("p_retailprice", "double")])
    return ok.drop("line")


@query("select cast(p_partkey as varchar) || '|' || p_brand as line from part where p_partkey % 11 = 0")
def line_dead_letters(spark: SparkSession, d: str) -> DataFrame:
    line = F.when(F.col("p_partkey") % 11 == 0, F.concat_ws("|", F.col("p_partkey").cast("string"), "p_brand")).otherwise(F.concat_ws("|", F.col("p_partkey").cast("string"), "p_brand", F.col("p_size").cast("string")))
    _, bad = S.parse_lines(table(spark, d, "part").select(line.alias("line")), "line", [("p_partkey", "long"), ("p_brand", "string"), ("p_size", "int")])
    return bad


@query("select 'east' as source_name, count(*) as n, count(c_acctbal) as n_balance from customer where c_nationkey < 12 union all select 'west', count(*), 0 from customer where c_nationkey >= 12")
def fan_in(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    ok, _ = S.fan_in({
        "east": lambda: c.where("c_nationkey < 12").select("c_custkey", "c_acctbal"),
        "west": lambda: c.where("c_nationkey >= 12").select("c_custkey"),
        "gone": lambda: c.select("no_such_column"),
    })
    return ok.groupBy("source_name").agg(F.count("*").alias("n"), F.count("c_acctbal").alias("n_balance"))


@query("""
select case when l_returnflag = 'R' then 'source R' else 'source ' || l_returnflag end as source_name, count(*) as n, false as failed from lineitem where l_returnflag <> 'R' group by 1
union all select 'source R', null, true union all select 'source Z', null, true
""")
def failing_sources(spark: SparkSession, d: str) -> DataFrame:
    """One source fails while its rows are read, one when it is opened."""
    x = table(spark, d, "lineitem").select("l_orderkey", "l_returnflag")
    broken = x.where("l_returnflag = 'R'").withColumn("l_orderkey", F.when(F.col("l_orderkey") % 7 == 3, F.raise_error(F.lit("a page is broken")).cast("long")).otherwise(F.col("l_orderkey")))
    ok, errors = S.collect_sources(spark, {"source A": lambda: x.where("l_returnflag = 'A'"), "source R": lambda: broken, "source N": lambda: x.where("l_returnflag = 'N'"), "source Z": lambda: spark.read.parquet(f"{d}/no-such-table")}, place(spark), "lines")
    n = ok.groupBy("source_name").agg(F.count("*").alias("n")).withColumn("failed", F.lit(False))
    return n.unionByName(errors.select("source_name", F.lit(None).cast("long").alias("n"), F.lit(True).alias("failed")))


@query("select event_id, ts - interval 3 hour as utc from events")
def local_to_utc(spark: SparkSession, d: str) -> DataFrame:
    from fleetlens.functions.times import to_utc

    return table(spark, d, "events").select("event_id", to_utc("ts", 3).alias("utc"))


@query("select event_id, i as step_id, event_type || '-' || i as step_name from events, (values (1), (2)) t(i)")
def job_steps(spark: SparkSession, d: str) -> DataFrame:
    step = lambda i: F.concat(F.lit(f"<step><step_id>{i}</step_id><step_name>"), "event_type", F.lit(f"-{i}</step_name></step>"))
    x = table(spark, d, "events").select("event_id", F.concat(F.lit("<history>"), step(1), step(2), F.lit("</history>")).alias("message"))
    return S.step_rows(x, ["event_id"], "message", "step", "step_id: int, step_name: string")


@query("select event_id, cast(i as bigint) as object_id, event_type || '-' || i as step_name from events, (values (1), (2), (3)) t(i)")
def object_positions(spark: SparkSession, d: str) -> DataFrame:
    step = lambda i: F.concat(F.lit("<step><step_name>"), "event_type", F.lit(f"-{i}</step_name></step>"))
    x = table(spark, d, "events").select("event_id", F.concat(F.lit("<history>"), step(1), step(2), step(3), F.lit("</history>")).alias("message"))
    return S.step_rows(x, ["event_id"], "message", "step", "step_name: string", number="object_id")


@query("select p_partkey, p_size, p_brand from part")
def fixed_lines(spark: SparkSession, d: str) -> DataFrame:
    line = F.concat(F.lpad(F.col("p_partkey").cast("string"), 12, " "), F.lpad(F.col("p_size").cast("string"), 6, " "), F.rpad("p_brand", 10, " "))
    x = S.parse_fixed(table(spark, d, "part").select(line.alias("line")), "line", [("p_partkey", 1, 12, "long"), ("p_size", 13, 6, "int"), ("p_brand", 19, 10, "string")])
    return x.drop("line")


@query("select cast(ts as date) as day, count(*) as n, sum(case when event_type = 'error' then 0 else 1 end) as n_kept from events group by 1")
def daily_partitions(spark: SparkSession, d: str) -> DataFrame:
    """Days are written, then all with an error are written again without errors: only these change."""
    e, at = table(spark, d, "events").select("event_id", "ts", "event_type"), place(spark)
    S.write_daily(e.withColumn("pass", F.lit(1)), "ts", f"{at}/days")
    again = e.withColumn("bad", F.max((F.col("event_type") == "error").cast("int")).over(Window.partitionBy(F.to_date("ts")))).where("bad = 1").drop("bad")
    S.write_daily(again.withColumn("pass", F.lit(2)), "ts", f"{at}/days")
    back = spark.read.parquet(f"{at}/days")
    return back.groupBy("day").agg(F.count("*").alias("n"), F.sum(F.when(F.col("event_type") == "error", 0).otherwise(1)).alias("n_kept"))
