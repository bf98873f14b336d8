"""Operators whose work is split within a key or bounded, against plain Python; and the plans that make them so."""

import os
import re
from datetime import date, datetime, timedelta
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetlens.operators import alerts, capacity, filters, frames, ingest, maintenance
from fleetlens.sources import tables

T0 = datetime(2024, 1, 1)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# alerts


def alert_log(rng, n, pause):
    """(instance, event_id, ts, alert_key, event_type, ignored): bursts with pauses, ties in time, a null instance."""
    out, at = [], T0
    for i in range(n):
        at += timedelta(seconds=int(rng.choice([0, 5, 40, 200, pause], p=[0.2, 0.4, 0.2, 0.15, 0.05])))
        out.append((("a", "b", None)[int(rng.integers(0, 3))], i, at, f"k{rng.integers(0, 5)}", int(rng.choice([0, 1, 6])), bool(rng.random() < 0.2)))
    return out


@pytest.mark.parametrize(("cap", "minutes", "repeat"), [(3, 5, 10), (50, 5, 60), (2, 30, 1)])
def test_segments_decide_as_the_whole_log(spark, cap, minutes, repeat):
    log = alert_log(np.random.default_rng(cap), 1500, 5000)
    want, state = {}, {}
    for instance, i, ts, key, kind, ignored in sorted(log, key=lambda r: (r[2], r[1])):
        d = state.setdefault(instance, alerts.Decider(cap, minutes, repeat))
        want[i] = d.decide(int((ts - datetime(1970, 1, 1)).total_seconds()), key, kind, ignored)
    df = spark.createDataFrame(log, "instance string, event_id long, ts timestamp_ntz, alert_key string, event_type int, ignored boolean").repartition(5)
    got = {r.event_id: (r.is_sent, r.flood_control) for r in alerts.decide_alerts(df, cap, minutes, repeat).collect()}
    assert got == want
    early, late = df.where("event_id < 700"), df.where("event_id >= 700")
    first = alerts.decide_alerts(early, cap, minutes, repeat)
    second = alerts.decide_alerts(late, cap, minutes, repeat, first.where("is_sent"))
    assert {r.event_id: (r.is_sent, r.flood_control) for r in first.unionByName(second).collect()} == want


def test_an_instance_is_decided_by_many_tasks(spark):
    df = spark.range(4000).select(F.lit("hot").alias("instance"), (F.floor(F.col("id") / 10) * 7200 + F.col("id") % 10).alias("second"))
    df = df.withColumn("minute", F.floor(F.col("second") / 60))
    cut = alerts.quiet_segments(df, "instance", "minute", 60)
    assert cut.select("segment").distinct().count() == 400
    assert cut.repartition(8, "_instance", "segment").select(F.spark_partition_id()).distinct().count() == 8


# intervals


@pytest.mark.parametrize("kind", ["long", "decimal(25,0)", "timestamp_ntz"])
def test_points_in_intervals(spark, kind):
    rng = np.random.default_rng(5)
    make = {"long": int, "decimal(25,0)": lambda x: Decimal(int(x)) * 10**18 + 7, "timestamp_ntz": lambda x: T0 + timedelta(microseconds=int(x) * 10**6)}[kind]
    points = [(k, None if x % 31 == 0 else make(x)) for k, x in zip(rng.integers(0, 3, 400).tolist(), rng.integers(-900, 900, 400).tolist(), strict=True)] + [(None, make(5))]
    spans = [(int(rng.integers(0, 3)), a, a + int(rng.choice([-5, 0, 1, 2, 7, 300]))) for a in rng.integers(-900, 900, 60).tolist()] + [(None, -900, 900), (1, None, 5)]
    spans = [(k, None if a is None else make(a), make(b)) for k, a, b in spans]
    p, s = spark.createDataFrame(points, f"k int, at {kind}"), spark.createDataFrame(spans, f"k int, low {kind}, high {kind}")
    want = {(k, x) for k, x in points if k is not None and x is not None and any(k == j and a is not None and a <= x <= b for j, a, b in spans)}
    assert {tuple(r) for r in maintenance.covered(p, s, "k", "at", "low", "high").collect()} == want
    assert rows(maintenance.missing_base(p, s, "k", "at", "low", "high")) == sorted((x for x in points if x not in want), key=str)
    assert maintenance.covered(p, s.where("false"), "k", "at", "low", "high").count() == 0


def test_an_interval_meets_points_about_it_only(spark):
    """One member with all rows: what the join makes grows with the rows, not with their square."""
    n = 3000
    s = spark.range(n).select(F.lit(1).alias("k"), (F.col("id") * 10).alias("low"), (F.col("id") * 10 + F.col("id") % 8).alias("high"))
    p = spark.range(n).select(F.lit(1).alias("k"), (F.col("id") * 10 + 5).alias("at"))
    assert maintenance.covered(p, s, "k", "at", "low", "high").count() == sum(i % 8 >= 5 for i in range(n))


# top two, runs, ranks


def test_the_newest_two_and_runs_keep_two_rows_of_a_key_in_a_task(spark):
    data = [(k, i, (i * 7) % 5 == 0 if k != "none" else False) for k in ("a", None, "none", "x") for i in range(30)]
    df = spark.createDataFrame(data, "k string, id long, done boolean").repartition(4).withColumn("ts", F.timestamp_seconds(F.col("id") * 4000).cast("timestamp_ntz"))
    two = frames.newest_two(df, ["k"], "ts", "id")
    assert {(r.k, r.id, r._before) for r in two.collect()} == {(k, 29, datetime(1970, 1, 1) + timedelta(seconds=28 * 4000)) for k in ("a", None, "none", "x")}
    runs = frames.run_slices(df, ["k"], F.col("done"), ["ts", "id"])
    want = []
    for k in ("a", None, "none", "x"):
        marks = sorted((i for j, i, d in data if j == k and d), reverse=True) + [-1, -1]
        want += [(k, i, "current" if i > marks[0] else "finished") for j, i, d in data if j == k and not d and i > (marks[1] if marks[0] >= 0 else -1)]
    assert rows(runs.select("k", "id", "run_state")) == sorted(want, key=str)
    often = capacity.frequent_maintenance(df, ["k"], "ts", "id", 1)
    for x in (two, runs, often):
        assert re.search(r"WindowGroupLimit.*Partial", plan(x)), plan(x)
    assert {(r.k, r.interval_days) for r in often.collect()} == {(k, 1) for k in ("a", None, "none", "x")}


def test_places_over_all_rows(spark, tmp_path):
    df = spark.range(500).select((F.col("id") * 37 % 101).alias("v"), F.col("id").alias("tie"), F.lit("x").alias("_range2")).repartition(7)
    got = frames.ranked(df, [F.col("v").desc(), F.col("tie").asc()], "place", str(tmp_path / "r"))
    want = sorted(((i * 37 % 101, i) for i in range(500)), key=lambda r: (-r[0], r[1]))
    assert [(r.v, r.tie) for r in sorted(got.collect(), key=lambda r: r.place)] == want and sorted(r.place for r in got.collect()) == list(range(1, 501))
    assert frames.ranked(df.where("false"), [F.col("v").asc()], "place", str(tmp_path / "e")).count() == 0


# retention, volumes


@pytest.mark.parametrize("keep", [1, 3, 50])
def test_retention_without_windows_over_sets(spark, keep):
    rng = np.random.default_rng(keep)
    kinds = rng.choice(["full", "diff", "log"], 300, p=[0.2, 0.3, 0.5]).tolist()
    sets = [((1, 2, None)[i % 3], i, kinds[i], T0 + timedelta(hours=int(rng.integers(0, 900))), i, int(rng.integers(0, 300))) for i in range(300)]
    df = spark.createDataFrame(sets, "m int, set_id long, kind string, start_time timestamp_ntz, first_lsn long, base_lsn long")

    def gone(mode):
        out = []
        for m in (1, 2, None):
            own = [s for s in sets if s[0] == m]
            fulls, x = [s for s in own if s[2] == "full"], None
            if mode == "days":
                old = lambda s: s[3] <= datetime(2024, 2, 1) - timedelta(days=keep)
                f = max((s for s in fulls if old(s)), key=lambda s: (s[3], s[1]), default=None)
                x = max((s[1] for s in own if f and s[2] == "diff" and old(s) and s[1] > f[1]), default=None)
            else:
                both = sorted((s for s in own if s[2] != "log"), key=lambda s: (s[3], s[1]), reverse=True)
                a = both[keep - 1] if len(both) >= keep else None
                f = max((s for s in fulls if a and (s[3], s[1]) <= (a[3], a[1])), key=lambda s: (s[3], s[1]), default=None)
            out += [s for s in own if f and (s[3] < f[3] or (s[2] != "full" and s[1] < f[1] and s[5] != f[4]) or (x is not None and s[2] != "full" and s[1] < x))]
        return sorted((tuple(s) for s in out), key=str)

    for mode in ("days", "count"):
        assert rows(maintenance.deletable(df, ["m"], keep, mode, "2024-02-01")) == gone(mode)


def test_volumes_meet_as_classes(spark):
    data = [(i, "h" if i % 3 else None, ("/a,/b", "/b, /c", "/d", None)[i % 4], i % 2 == 0) for i in range(60)] + [(7, "h", "/a", True)]
    df = spark.createDataFrame(data, "id long, host string, vols string, heavy boolean")
    pending, running = df.where("id % 5 = 0"), df.where("id % 5 <> 0")
    cut = lambda v: {x.strip() for x in v.split(",")} if v else set()
    want = []
    for i, h, v, _ in (r for r in data if r[0] % 5 == 0):
        others = [r for r in data if r[0] % 5 and r[1] == h and h is not None]
        want.append((i, len(others), len({r[0] for r in others if r[3] and cut(r[2]) & cut(v)})))
    assert rows(maintenance.shared_volume_load(pending, running, "host", "id", "vols", "heavy")) == sorted(want, key=str)


# patterns


def like(text, pattern):
    regex, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 1
            regex += re.escape(pattern[i])
        else:
            regex += ".*" if c == "%" else "." if c == "_" else re.escape(c)
        i += 1
    return re.fullmatch(regex, text, re.S) is not None


def test_patterns_are_looked_up_in_an_index(spark):
    rng = np.random.default_rng(3)
    word = lambda n: "".join(rng.choice(list("abcé日%_\\ "), n))
    texts = sorted({word(int(rng.integers(0, 14))) for _ in range(300)} | {"", "a", "abcabcabc", "x\ny"})
    patterns = ["%abca%", "_b%", "a", "", "%é_", "100\\%", "%\\_b%", "b%c%a", "____", "%日%", "a\\\\%", "%zz%"]
    for p in patterns + ["%", "_%"]:
        got = filters.matched_texts(spark.createDataFrame([(t,) for t in [*texts, None]], "text string"), spark.createDataFrame([(p,), (None,)], "pattern string"))
        assert {r.text for r in got.collect()} == {t for t in texts if like(t, p)}, p
    got = filters.matched_texts(spark.createDataFrame([(t,) for t in texts], "text string"), spark.createDataFrame([(p,) for p in patterns], "pattern string"))
    assert {r.text for r in got.collect()} == {t for t in texts if any(like(t, p) for p in patterns)}


def test_thousands_of_rules_for_all_members(spark):
    df = spark.range(8000).select(F.col("id"), F.when(F.col("id") >= 0, F.concat(F.lit("Job "), F.col("id"), F.lit(" failed"))).alias("text"), F.when(F.col("id") % 2 == 0, F.lit("db one")).alias("other"))
    rules = [("%", f"%job {3 * i} fail%", True) for i in range(5000)] + [("%", "db two%", True), ("%", "% 11 failed", True), ("%", "%", False), ("8", None, True)]
    r = spark.createDataFrame(rules, "skip_value string, skip_value2 string, active boolean")
    left = {x.id for x in filters.skip_rules_wild(df.withColumn("key", F.col("id").cast("string")), r, ["key"], ["text", "other"]).collect()}
    assert left == {i for i in range(8000) if i % 3 and i not in (8, 11)}
    assert filters.skip_rules_wild(df, r.unionByName(spark.createDataFrame([("%", None, True)], r.schema)), ["text"], ["text"]).count() == 0
    kept = filters.suppress_patterns(df.unionByName(spark.sql("select -1L as id, cast(null as string) as text, cast(null as string) as other")), "text", r.where("active and skip_value2 is not null").withColumnRenamed("skip_value2", "pattern"))
    assert kept.count() == sum(1 for i in range(8000) if i % 3 and i != 11) + 1


def test_strings_of_texts_and_patterns_are_not_broadcast(spark, tmp_path):
    """Spark takes exploded strings for as small as the file that they come from; the index is not to pass the driver."""
    spark.range(3000).select(F.concat(F.lit("customer#"), F.lpad(F.col("id").cast("string"), 9, "0")).alias("text"), F.concat(F.lit("%#"), F.lpad((F.col("id") * 7).cast("string"), 9, "0")).alias("pattern")).write.parquet(str(tmp_path / "t"))
    df = spark.read.schema("text string, pattern string").parquet(str(tmp_path / "t"))
    got = filters.matched_texts(df, df)
    assert {r.text for r in got.collect()} == {f"customer#{i:09}" for i in range(0, 3000, 7)}
    assert not re.search(r"BroadcastHashJoin \[[^]]*(_held|_gram)", plan(got)), plan(got)


def test_patterns_are_filed_under_long_strings(spark):
    """Thousands of patterns of digits share all strings of four digits; of eight, a pattern has one that few others have."""
    df = spark.range(5000).select(F.lpad((F.col("id") * 7 + 1000000).cast("string"), 9, "0").alias("p"))
    own = df.select("p", F.explode(filters._grams(F.col("p"), max(n for n in filters.GRAMS if n <= 9))).alias("g"))
    least = own.join(own.groupBy("g").count(), "g").groupBy("p").agg(F.min("count").alias("n"))
    assert least.agg(F.max("n")).first()[0] <= 2


def test_prefixes_end_at_any_separator(spark):
    items = spark.createDataFrame([("/a/b/c",), ("/a/bc",), ("c:\\d\\e",), ("",), (None,), ("/",), ("none",)], "path string")
    prefixes = spark.createDataFrame([("/a/",), ("/a/b/",), ("c:\\",), ("/",), ("none",)], "prefix string")
    got = {r.path: r.owner_prefix for r in capacity.prefix_attribution(items, "path", prefixes, "prefix", "/\\").collect()}
    assert got == {"/a/b/c": "/a/b/", "/a/bc": "/a/", "c:\\d\\e": "c:\\", "": None, None: None, "/": "/", "none": None}


# sources and stored tables


def test_a_source_that_fails_while_it_is_read_leaves_one_error_row(spark, tmp_path):
    df = spark.range(100)
    broken = df.withColumn("id", F.when(F.col("id") == 77, F.raise_error(F.lit("broken page")).cast("long")).otherwise(F.col("id")))
    (tmp_path / "bad.parquet").write_bytes(b"not parquet")
    sources = {"one": lambda: df, "two": lambda: broken, "three": lambda: df.withColumn("more", F.lit(1)), "file": lambda: spark.read.schema("id long").parquet(str(tmp_path / "bad.parquet")), "gone": lambda: df.select("nothing")}
    ok, errors = tables.collect_sources(spark, sources, str(tmp_path / "out"), "growth")
    assert rows(ok.groupBy("source_name").agg(F.count("*"), F.count("more"))) == [("one", 100, 0), ("three", 100, 100)]
    assert [(r.source_name, r.descriptor) for r in errors.collect()] == [("two", "growth"), ("file", "growth"), ("gone", "growth")] and all(r.message for r in errors.collect())
    none, failed = tables.collect_sources(spark, {"gone": lambda: df.select("nothing")}, str(tmp_path / "none"), "x")
    assert none is None and failed.count() == 1


def test_live_tables_are_pulled_from_their_last_mark(spark, tmp_path):
    url, driver = f"jdbc:derby:{tmp_path}/live;create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    write = lambda df: df.write.format("jdbc").options(url=url, dbtable="T", driver=driver).mode("append").save()
    write(spark.range(-5, 40))
    first = tables.pull_jdbc(spark, url, "T", '"id"', None, 4, driver=driver)
    assert first.count() == 45 and first.rdd.getNumPartitions() == 4
    write(spark.range(40, 60))
    new = tables.pull_jdbc(spark, url, "T", '"id"', 39, 4, driver=driver)
    assert sorted(r.id for r in new.collect()) == list(range(40, 60)) and new.rdd.getNumPartitions() == 4
    assert tables.pull_jdbc(spark, url, "T", '"id"', 59, driver=driver).count() == 0


def files(path):
    return {os.path.join(os.path.basename(d), n) for d, _, names in os.walk(path) for n in names if n.endswith(".parquet")}


@pytest.fixture
def stored(spark, tmp_path):
    path = str(tmp_path / "table")
    data = [(i, i * 1.0, f"2024-01-{i % 10 + 1:02d}") for i in range(100)]
    spark.createDataFrame(data, "id long, v double, day string").repartition(1).write.partitionBy("day").parquet(path)
    return path


def read(spark, path):
    return spark.read.schema("id long, v double, day string").parquet(path)


def test_upsert_rewrites_touched_days_only(spark, stored, tmp_path):
    before = files(stored)
    src = spark.createDataFrame([(3, -1.0, "2024-01-04"), (1000, 5.0, "2024-01-04"), (1001, 6.0, "2024-02-01")], "id long, v double, day string")
    ingest.upsert_stored(spark, stored, src, ["id"], ["v"], "day", str(tmp_path / "staging"))
    got = {r.id: (r.v, r.day) for r in read(spark, stored).collect()}
    assert got == {i: (i * 1.0, f"2024-01-{i % 10 + 1:02d}") for i in range(100)} | {3: (-1.0, "2024-01-04"), 1000: (5.0, "2024-01-04"), 1001: (6.0, "2024-02-01")}
    after = files(stored)
    assert {f for f in before if "2024-01-04" not in f} <= after and not {f for f in before if "2024-01-04" in f} & after


def test_days_are_replaced_as_a_whole(spark, stored, tmp_path):
    before = files(stored)
    new = spark.createDataFrame([("2024-01-04", 7, 7.0), ("2024-03-01", 8, 8.0)], "day string, id long, v double")
    ingest.replace_stored(spark, stored, new, "day", str(tmp_path / "staging"))
    assert sorted((r.id, r.v, r.day) for r in read(spark, stored).collect()) == sorted([(i, i * 1.0, f"2024-01-{i % 10 + 1:02d}") for i in range(100) if i % 10 != 3] + [(7, 7.0, "2024-01-04"), (8, 8.0, "2024-03-01")])
    assert {f for f in before if "2024-01-04" not in f} <= files(stored)


def test_a_failed_upsert_leaves_the_old_table(spark, stored, tmp_path):
    before = files(stored)
    bad = spark.createDataFrame([(3, -1.0, "2024-01-04"), (4, 1.0, "2024-01-05")], "id long, v double, day string")
    bad = bad.withColumn("v", F.when(F.col("id") == 4, F.raise_error(F.lit("no"))).otherwise(F.col("v")).cast("double"))
    with pytest.raises(Exception, match="no"):
        ingest.upsert_stored(spark, stored, bad, ["id"], ["v"], "day", str(tmp_path / "staging"))
    assert files(stored) == before and read(spark, stored).count() == 100


def test_inserts_and_purges_of_stored_days(spark, stored):
    before = files(stored)
    new = spark.createDataFrame([(3, 9.0, "2024-01-04"), (3, 9.0, "2024-01-05"), (500, 9.0, "2024-01-04"), (500, 9.0, "2024-01-04")], "id long, v double, day string")
    ingest.insert_stored(spark, stored, new, ["id"], "day")
    assert read(spark, stored).count() == 102 and before <= files(stored)
    assert ingest.purge_stored(spark, stored, "day", None, "2024-01-09") == []
    assert ingest.purge_stored(spark, stored, "day", 5, "2024-01-09") == [f"day={date(2024, 1, i)}" for i in (1, 2, 3)]
    assert min(r.day for r in read(spark, stored).collect()) == "2024-01-04" and {f for f in before if f[4:14] >= "2024-01-04"} <= files(stored)
