"""Operators on small frames: nulls, boundaries, ties and empty inputs."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from fleetlens.functions import measures, texts, times
from fleetlens.operators import alerts, capacity, filters, frames, health, ingest, maintenance
from fleetlens.sources import tables


def ts(text: str) -> datetime:
    return datetime.fromisoformat(text)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_boundaries_count_not_durations(spark):
    a, b = F.lit(ts("2024-01-01 00:59:59")), F.lit(ts("2024-01-01 01:00:01"))
    assert one(spark, times.boundary_diff("hour", a, b)) == 1
    assert one(spark, times.boundary_diff("day", a, b)) == 0
    assert one(spark, times.millis_between(a, b)) == 2000


def test_texts(spark):
    assert one(spark, times.duration_text(F.lit(None).cast("long"))) == "00:00:00.000"
    assert one(spark, times.duration_text(F.lit(90_061_007))) == "1d 01:01:01.007"
    assert one(spark, times.packed_seconds(F.lit(1_203_004))) == 120 * 3600 + 30 * 60 + 4
    assert one(spark, texts.between(F.lit("login 'sa'. Reason: bad [x]"), "Reason: ", " [")) == "bad"
    assert one(spark, texts.between(F.lit("nothing"), "Reason: ", " [")) is None
    assert one(spark, texts.shorten(F.lit("a<b>c"), 3)) == "a&lt;b[...]"
    assert one(spark, texts.weekdays(F.lit(65))) == "Sunday, Saturday"
    assert one(spark, measures.growth_percent(F.lit(0.0), F.lit(5.0))) is None
    assert one(spark, maintenance.lsn_number(F.lit("0000002a:000000ff:0001"))) == 42 * 10**15 + 255 * 10**5 + 1


def test_skip_rules(spark):
    df = spark.createDataFrame([("m1", "i1", "a"), ("m1", "i2", "b"), ("m2", "i3", None)], "machine string, instance string, db string")
    rules = spark.createDataFrame([(1, "M1", "A", True), (1, None, None, True), (1, "i2", None, False), (2, "i2", None, True)], "rule_id int, skip_value string, skip_value2 string, active boolean")
    kept = filters.skip_rules(df, rules, 1, ["machine", "instance"], "db")
    assert [r.instance for r in kept.orderBy("instance").collect()] == ["i2", "i3"]
    assert filters.skip_rules(df, rules.where("false"), 1, ["machine"], "db").count() == 3


def test_patterns_and_lists(spark):
    df = spark.createDataFrame([("Backup DATABASE done",), ("x_y",), ("xzy.",), (None,)], "text string")
    assert rows(filters.pattern_suppression(df, "text", ["%database%", "x_y"])) == [("xzy.",), (None,)]
    lists = spark.createDataFrame([("a, b,,c",), ("",), (None,)], "v string")
    assert rows(filters.list_rows(lists, "v").select("position", "value")) == [(1, "a"), (2, "b"), (4, "c")]
    assert rows(filters.exclude_names(df, "text", ["X_Y"]).select(F.col("text").isNull())) == [(False,), (False,), (True,)]


def test_growth_ties_and_zero(spark):
    h = spark.createDataFrame(
        [("a", ts("2024-01-01"), 1, 0.0), ("a", ts("2024-01-02"), 2, 5.0), ("b", ts("2024-01-01"), 3, 4.0), ("c", ts("2024-01-01"), 5, 9.0), ("c", ts("2024-01-01"), 4, 6.0), ("d", ts("2024-01-01"), 6, None)],
        "db string, ts timestamp_ntz, id int, size double",
    )
    got = rows(capacity.growth(h, ["db"], "ts", "size", "id"))
    assert got == [("a", 0.0, 5.0, 5.0, None), ("b", 4.0, 4.0, 0.0, 0.0), ("c", 6.0, 9.0, 3.0, 50.0)]


def test_frequent_maintenance_gap(spark):
    e = spark.createDataFrame([("i", ts("2024-01-01 00:00"), 1), ("i", ts("2024-01-02 23:59"), 2), ("j", ts("2024-01-01 00:00"), 3), ("j", ts("2024-01-03 01:01"), 4), ("k", ts("2024-01-01 00:00"), 5)], "o string, ts timestamp_ntz, id int")
    assert [(r.o, r.interval_days) for r in capacity.frequent_maintenance(e, ["o"], "ts", "id", 2).orderBy("o").collect()] == [("i", 2)]


def test_severity_boundaries(spark):
    df = spark.createDataFrame([(9.9,), (10.0,), (20.0,), (None,)], "v double")
    assert [r[0] for r in df.select(alerts.severity(F.col("v"), 10.0, 20.0)).collect()] == [None, "warning", "critical", None]
    low = [r[0] for r in df.select(alerts.severity_low(F.col("v"), 20.0, 10.0)).collect()]
    assert low == ["critical", "critical", None, None]
    assert [r[0] for r in df.select(alerts.severity_low(F.col("v"), 20.0, 10.0, strict=True)).collect()] == ["critical", None, None, None]


def _decide(spark, events, **options):
    df = spark.createDataFrame(events, "instance string, event_id long, ts timestamp_ntz, alert_key string, event_type int, ignored boolean")
    return {r.event_id: (r.is_sent, r.flood_control) for r in alerts.decide_alerts(df, **options).collect()}


def test_flood_control_caps_and_counts_all_types(spark):
    events = [("a", i, ts(f"2024-01-01 00:0{i // 20}:{i % 20:02d}"), f"k{i}", 1, False) for i in range(60)] + [("b", 100, ts("2024-01-01"), "k", 3, False)]
    got = _decide(spark, events)
    assert sum(s for s, _ in got.values()) == 51
    assert got[49] == (True, False) and got[50] == (False, True) and got[100] == (True, False)


def test_repeats_within_the_hour(spark):
    t = ["2024-01-01 00:00", "2024-01-01 00:59", "2024-01-01 01:00", "2024-01-01 01:01", "2024-01-01 01:02"]
    got = _decide(spark, [("a", i, ts(x), "k", 1, False) for i, x in enumerate(t)])
    assert [got[i][0] for i in range(5)] == [True, False, False, True, False]
    assert _decide(spark, [("a", 1, ts(t[0]), "k", 1, True)])[1] == (False, True)
    assert _decide(spark, []) == {}


def test_run_slices(spark):
    e = spark.createDataFrame([("j", i, m) for i, m in enumerate([False, True, False, False, True, False])], "job string, id int, done boolean")
    got = {r.id: r.run_state for r in frames.run_slices(e, ["job"], F.col("done"), ["id"]).collect()}
    assert got == {2: "finished", 3: "finished", 5: "current"}


def test_max_or_open(spark):
    df = spark.createDataFrame([("a", 1), ("a", None), ("b", 2)], "k string, v int")
    assert rows(frames.max_or_open(df, ["k"], "v", "m")) == [("a", None), ("b", 2)]


def test_outdated_with_healthy_replica(spark):
    m = spark.createDataFrame([("x", "g1", "2023-01-01", True), ("y", "g1", "2024-01-09", True), ("z", None, None, True), ("tempdb", None, None, True), ("v", "g2", "2023-01-01", True), ("w", "g2", "2024-01-09", False)], "name string, grp string, d string, ok boolean").withColumn("last", F.col("d").cast("timestamp_ntz"))
    assert sorted(r.name for r in health.outdated(m, "name", "last", "2024-01-10", 7, 7, ["grp"], F.col("ok")).collect()) == ["v", "z"]


def test_upsert_and_drift(spark):
    d = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "id int, n string, v int")
    s = spark.createDataFrame([(2, "B", None), (3, "c", 9)], "id int, n string, v int")
    assert rows(ingest.upsert(d, s, ["id"], ["v"])) == [(1, "a", 1), (2, "b", None), (3, "c", 9)]
    assert rows(ingest.drift(d, s, ["id"])) == [(1, "gone"), (3, "new")]
    assert ingest.incremental(s, d.where("false"), ["n"], "id", 2).count() == 1
    kept = ingest.purge({"t": d.withColumn("at", F.lit(ts("2024-01-01")).cast("timestamp_ntz"))}, {"t": ("at", 3)}, "2024-02-01 00:00:00")
    assert kept["t"].count() == 0
    assert ingest.purge({"t": d}, {"t": ("at", 0)}, "2024-02-01 00:00:00")["t"].count() == 2


def test_replace_keeps_other_slices(spark):
    t = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "k string, v int")
    assert rows(ingest.replace_slice(t, t.where("v = 1").withColumn("v", F.lit(7)), ["k"])) == [("a", 7), ("b", 3)]
    assert rows(ingest.replace_group(t, "v = 2", ["k"])) == [("b", 3)]


def test_deletable(spark):
    s = [(1, "full", "2024-01-01", 10, 0), (2, "diff", "2024-01-02", 20, 10), (3, "full", "2024-01-10", 30, 0), (4, "log", "2024-01-10", 40, 10), (5, "diff", "2024-01-12", 50, 30), (6, "full", "2024-01-20", 60, 0)]
    df = spark.createDataFrame([("d", a, b, ts(c), e, f) for a, b, c, e, f in s], "db string, set_id long, kind string, start_time timestamp_ntz, first_lsn long, base_lsn long")
    gone = lambda *a: sorted(r.set_id for r in maintenance.deletable(df, ["db"], *a).collect())
    assert gone(5, "days", "2024-01-18 00:00:00") == [1, 2, 4]
    assert gone(60, "days", "2024-01-18 00:00:00") == []
    assert gone(1, "count") == [1, 2, 3, 4, 5]
    assert gone(9, "count") == []


def test_packing_never_exceeds_the_budget(spark):
    q = spark.createDataFrame([("g", 1, True, 9.0), ("g", 2, True, 6.0), ("g", 3, True, 5.0), ("g", 4, False, None), ("g", 5, False, 3.0), ("h", 6, True, 99.0)], "g string, item_id long, production boolean, runtime double")
    q = q.withColumn("last_check", F.lit(ts("2024-01-01")).cast("timestamp_ntz")).withColumn("size", F.lit(1.0))
    got = {r.item_id: (r.in_budget, r.priority) for r in maintenance.pack(q, ["g"], 8.0, 2).collect()}
    assert got[1] == (False, 4) and got[2] == (True, 1) and got[3] == (True, 2) and got[5] == (True, 3) and got[4][0] is False and got[6] == (False, 1)


def test_prefixes(spark):
    i = spark.createDataFrame([("/a/b/c",), ("/ax",), ("",), (None,)], "p string")
    m = spark.createDataFrame([("/",), ("/a/",), ("/a/b/",)], "m string")
    assert rows(capacity.prefix_attribution(i, "p", m, "m")) == [("", None), ("/a/b/c", "/a/b/"), ("/ax", "/"), (None, None)]


def test_lines_and_payloads(spark):
    df = spark.createDataFrame([("c|10|5",), ("bad|x|1",), ("short",)], "line string")
    ok, bad = tables.parse_lines(df, "line", [("drive", "string"), ("size", "int"), ("free", "int")])
    assert rows(ok.select("drive", "size", "free")) == [("c", 10, 5)]
    assert bad.count() == 2
    x = spark.createDataFrame([("a&b<c", None)], "n string, v int").select(tables.to_payload(["n", "v"]).alias("m"))
    assert rows(tables.shred(x, "m", "n string, v int").select("n", "v")) == [("a&b<c", None)]
    out, errors = tables.fan_in({"a": lambda: df, "b": lambda: df.select("nope")})
    assert out.count() == 3 and [e[0] for e in errors] == ["b"]


@pytest.mark.parametrize("address, ok", [("1.2.3.4", True), ("1.2.3", False), ("1.2.3.256", False), ("a.b.c.d", False), (None, False), ("", False)])
def test_addresses(spark, address, ok):
    df = spark.createDataFrame([("g", address)], "g string, ip string")
    assert rows(maintenance.address_profile(df, ["g"], "ip")) == [("g", int(ok), int(not ok))]


def test_wild_rules_patterns_and_flags(spark):
    df = spark.createDataFrame([("m1", "sign up"), ("m2", "error"), ("m3", "click"), (None, None)], "m string, t string")
    rule = lambda *r: spark.createDataFrame([(*x, True) for x in r], "skip_value string, skip_value2 string, active boolean")
    left = lambda r: sorted(str(x.m) for x in filters.skip_rules_wild(df, r, ["m"], ["t"]).collect())
    assert left(rule(("%", "sign%"), ("M2", None), ("m3", "x%"))) == ["None", "m3"]
    assert left(rule(("%", None))) == [] and left(rule(("zz", None))) == ["None", "m1", "m2", "m3"]
    texts_ = spark.createDataFrame([("ABC.def",), ("xabc",), ("abc",), ("a_c",), ("a%c",), (None,)], "text string")
    kept = lambda *p: sorted(str(r.text) for r in filters.pattern_suppression(texts_, "text", list(p)).collect())
    assert kept("abc%") == ["None", "a%c", "a_c", "xabc"] and kept("%abc") == ["ABC.def", "None", "a%c", "a_c"] and kept("abc") == ["ABC.def", "None", "a%c", "a_c", "xabc"]
    assert kept("%b%f") == ["None", "a%c", "a_c", "abc", "xabc"] and kept("a_c") == ["ABC.def", "None", "xabc"] and kept("%") == ["None"]
    rules = spark.createDataFrame([("m1", None, 1, True), (None, "error", 2, True), (None, None, 8, True)], "m string, t string, flags int, active boolean")
    assert sorted(str(r.m) for r in filters.flag_subset_skip(df, rules, ["m", "t"], 3).collect()) == ["None", "m3"]
    assert filters.flag_subset_skip(df, rules, ["m", "t"], 8).count() == 0


def test_paired_actions_take_the_nearest_for_equal_rows_too(spark):
    info = spark.createDataFrame([("k", ts("2024-01-01 00:00:59")), ("k", ts("2024-01-01 00:00:59")), ("k", ts("2024-01-01 02:00:00")), ("j", ts("2024-01-01 00:00:59"))], "key string, ts timestamp_ntz")
    acts = spark.createDataFrame([("k", ts("2024-01-01 00:01:30")), ("k", ts("2024-01-01 00:00:10")), ("k", ts("2024-01-01 01:58:59"))], "key string, ts timestamp_ntz")
    got = capacity.paired_actions(info, acts, ["key"], "ts", 60)
    assert rows(got) == [("k", ts("2024-01-01 00:00:59"), ts("2024-01-01 00:01:30"))] * 2
    assert capacity.paired_actions(info, acts, ["key"], "ts").count() == 9


def test_decider_state_stays_small():
    d = alerts.Decider(cap=5, minutes=5, repeat_minutes=10)
    sent = [d.decide(60 * (i // 1000), f"k{i}", 0, False)[0] for i in range(50_000)]
    assert all(sent) and len(d.sent) <= 6 and len(d.last) <= 11_000
    assert d.decide(60 * 49, "new", 1, False) == (False, True) and d.decide(60 * 60, "new", 1, False) == (True, False) and d.decide(60 * 65, "new", 1, False) == (False, True)


def test_dead_letters_and_fixed_lines(spark):
    df = spark.createDataFrame([("1|a",), ("x|b",), ("1|a|c",), (None,), ("x|b",)], "line string")
    ok, bad = tables.parse_lines(df, "line", [("n", "int"), ("s", "string")])
    assert rows(ok.select("n", "s")) == [(1, "a")] and rows(bad) == sorted([("x|b",), ("x|b",), ("1|a|c",), (None,)], key=str)
    assert "Exchange" not in bad._jdf.queryExecution().executedPlan().toString()


def test_tables_are_loaded(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "region.parquet"))
    t = tables.load(spark, str(tmp_path), ("region",))
    assert t["region"].count() == 5
    run = tables.save_report({"a": t["region"], "b": t["region"].where("id > 2")}, str(tmp_path / "report"), "p", 3).first()
    assert run.issues == {"a": 5, "b": 2} and run.project == "p" and run.build_duration_ms >= 0


def test_jdbc_tables_are_read_in_parts(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    try:
        spark.range(20).write.format("jdbc").options(url=url, dbtable="T", driver="org.apache.derby.iapi.jdbc.AutoloadedDriver").save()
    except Exception as e:
        pytest.skip(f"no database in this Spark: {str(e)[:80]}")
    df = tables.load_jdbc(spark, url, "T", '"id"', (0, 20), 4, driver="org.apache.derby.iapi.jdbc.AutoloadedDriver")
    assert df.count() == 20 and df.rdd.getNumPartitions() == 4


def test_transactions_reach_a_threshold(spark):
    df = lambda schema, *r: spark.createDataFrame(list(r), "host string, session_id int, " + schema)
    sessions = df("idle_seconds int", ("h", 1, 5), ("h", 2, 5), ("h", 3, -5), ("h", 4, 5))
    requests = df("request_id int, request_seconds int", ("h", 1, 7, 100), ("h", 3, 8, 1))
    transactions = df("transaction_seconds int", ("h", 2, 90), ("h", 2, 10), ("h", 4, 10))
    space = df("request_id int, alloc_pages int, dealloc_pages int", ("h", 3, 8, 200_000, 0))
    waits = df("blocking_session_id int, wait_seconds int", ("h", 4, 2, 3), ("h", 2, 2, 99))
    got = {r.session_id: r for r in alerts.transaction_snapshot(sessions, requests, transactions, space, waits, ["host"], {"request": 60, "transaction": 60, "wait": 60, "temp_mb": 1000}).collect()}
    assert set(got) == {1, 2, 3} and got[2].transaction_seconds == 90 and got[3].tempdb_space_used_mb == 1562 and got[2].request_completed


def test_replicas_and_never_checked_members(spark):
    m = spark.createDataFrame([("a", None, True), ("b", ts("2024-01-01"), True), ("c", ts("2024-03-01"), True), ("d", None, True), ("e", None, False)], "k string, t timestamp_ntz, production boolean")
    hidden = spark.createDataFrame([("d",)], "k string")
    assert [r.k for r in maintenance.overdue_checks(m, "k", "t", "2024-03-10", 30, hidden, "production").orderBy("k").collect()] == ["a", "b"]
