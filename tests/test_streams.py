"""Streams over several batches against the batch forms; state that goes."""

import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from fleetlens.operators import alerts
from fleetlens.streaming import state, streams

T0 = datetime(2024, 1, 1)
SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string"


@pytest.fixture
def files(spark, tmp_path):
    """Four files of events, in order of time, read one a trigger."""
    data = [(i, T0 + timedelta(minutes=7 * i), i % 3, ("purchase", "error", "view")[i * i % 7 % 3]) for i in range(80)]
    for n in range(4):
        spark.createDataFrame(data[20 * n : 20 * n + 20], SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / f"{n}"))
    for n in range(4):
        for p in (tmp_path / "in" / f"{n}").glob("*.parquet"):
            (tmp_path / "flat").mkdir(exist_ok=True)
            p.rename(tmp_path / "flat" / f"{n}.parquet")
    df = spark.createDataFrame(data, SCHEMA)
    return df, streams.event_stream(spark, str(tmp_path / "flat"), df.schema, files_a_trigger=1), str(tmp_path / "out")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_windows_close_in_append_mode(spark, files):
    df, stream, out = files
    last = spark.sql("select timestamp'2100-01-01' as ts, 0L as event_id, 0L as user_id, 'end' as event_type")
    got = streams.drain_closed(stream, lambda e: streams.windowed_counts(e, ["event_type"], "ts", "1 hour", late="10 minutes"), last, out)
    want = df.groupBy(F.date_trunc("hour", "ts").alias("w"), "event_type").agg(F.count("*").alias("n"))
    assert rows(got) == rows(want.select(F.col("w").cast("timestamp"), "event_type", "n"))


def test_gaps_over_batches_and_their_expiry(spark, files):
    df, stream, out = files
    got = {r.event_id: r.gap_seconds for r in streams.occurrence_gaps(stream, f"{out}/a", f"{out}/s", "user_id").collect()}
    assert got == {i: None if i < 3 else 3 * 7 * 60 for i in range(80)}
    short = {r.event_id: r.gap_seconds for r in streams.occurrence_gaps(stream, f"{out}/b", f"{out}/t", "user_id", keep="5 minutes").collect()}
    assert [i for i in range(80) if short[i] is None] == [0, 1, 2, 20, 21, 40, 41, 60, 61]  # only the newest key outlives a batch


def test_marker_runs_over_batches(spark, files):
    df, stream, out = files
    got = rows(streams.marker_runs(stream, f"{out}/a", f"{out}/s", "user_id", F.col("event_type") == "purchase"))
    want = []
    for u in range(3):
        steps = n = 0
        for r in df.where(F.col("user_id") == u).orderBy("ts").collect():
            if r.event_type == "purchase":
                n += 1
                want.append((str(u), n, r.event_id, steps))
                steps = 0
            else:
                steps += 1
    assert got == sorted(want)


def test_alerts_over_batches_decide_as_one_batch(spark, files):
    df, stream, out = files
    kind = F.when(F.col("event_type") == "error", 1).when(F.col("event_type") == "purchase", 6).otherwise(0)
    shape = lambda x: x.select((F.col("user_id") % 2).cast("string").alias("instance"), "event_id", "ts", F.col("event_type").alias("alert_key"), kind.alias("event_type"), F.lit(False).alias("ignored"))
    got = streams.alert_stream(shape(stream), f"{out}/a", f"{out}/s", cap=3, minutes=60, repeat_minutes=30)
    want = alerts.decide_alerts(shape(df), cap=3, minutes=60, repeat_minutes=30)
    assert rows(got.select("event_id", "is_sent", "flood_control")) == rows(want.select("event_id", "is_sent", "flood_control"))


def test_ingest_twice_adds_nothing(spark, files):
    _, stream, out = files
    streams.ingest(stream, f"{out}/a", ["event_id"], f"{out}/s")
    streams.ingest(stream, f"{out}/a", ["event_id"], f"{out}/other", "ts")
    assert spark.read.parquet(f"{out}/a").count() == 80


def write_flat(spark, path, data, name):
    """One file of events that a stream reads in the order of their names' times."""
    spark.createDataFrame(data, SCHEMA).coalesce(1).write.parquet(f"{path}/tmp-{name}")
    (path / "flat").mkdir(exist_ok=True)
    for p in (path / f"tmp-{name}").glob("*.parquet"):
        p.rename(path / "flat" / f"{name}.parquet")


END = (-1, datetime(2100, 1, 1), None, "end")


def brute_gaps(data, keep=None):
    last, out = {}, []
    for i, ts, key, _ in sorted(data, key=lambda r: (r[1], r[0])):
        before = last.get(key)
        silent = before is not None and keep is not None and ts - before > keep
        out.append((None if key is None else str(key), i, None if before is None or silent else int((ts - before).total_seconds())))
        last[key] = ts
    return sorted(out, key=str)


def brute_runs(data, keep=None):
    state, out = {}, []
    for i, ts, key, kind in sorted(data, key=lambda r: (r[1], r[0])):
        last, steps, number = state.get(key, (None, 0, 0))
        if last is not None and keep is not None and ts - last > keep:
            steps = number = 0
        if kind == "purchase":
            number += 1
            out.append((None if key is None else str(key), number, i, steps))
            steps = 0
        else:
            steps += 1
        state[key] = (ts, steps, number)
    return sorted(out, key=str)


def keyed(n=90):
    """Events of three keys, one null, in three batches, some later than newer ones of the batch before."""
    data = [(i, T0 + timedelta(minutes=7 * i, seconds=i % 3), (None, 1, 2)[i % 3], ("purchase", "error", "view")[i * i % 7 % 3]) for i in range(n)]
    parts = [data[:30], data[30:60], data[60:]]
    parts[0][-2], parts[1][0] = parts[1][0], parts[0][-2]  # one comes a batch late, within the watermark
    return data, parts


@pytest.mark.parametrize("keep", [None, "30 minutes", "10 minutes"])
def test_state_by_key_over_batches_with_null_keys(spark, tmp_path, keep):
    data, parts = keyed()
    silent = None if keep is None else timedelta(minutes=int(keep.split()[0]))
    for n, part in enumerate([*parts, [END]]):
        write_flat(spark, tmp_path, part, n)
    events = streams.event_stream(spark, str(tmp_path / "flat"), spark.createDataFrame([], SCHEMA).schema, files_a_trigger=1)
    got = streams.drain(streams.gap_stream(events, "user_id", keep=keep), str(tmp_path / "g"), str(tmp_path / "gs"))
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_gaps(data, silent)
    got = streams.drain(streams.run_stream(events, "user_id", F.col("event_type") == "purchase", keep=keep), str(tmp_path / "r"), str(tmp_path / "rs"))
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_runs(data, silent)


def test_a_stream_goes_on_after_a_restart(spark, tmp_path):
    data, parts = keyed()
    got = []
    for n, part in enumerate([*parts, [END]]):
        write_flat(spark, tmp_path, part, n)
        events = streams.event_stream(spark, str(tmp_path / "flat"), spark.createDataFrame([], SCHEMA).schema)
        gaps = streams.drain(streams.gap_stream(events, "user_id", late="2 hours"), str(tmp_path / "g"), str(tmp_path / "s"))
        got.append(gaps.count())
    assert sorted((tuple(r) for r in gaps.collect()), key=str) == brute_gaps(data) and got == sorted(got) and got[1] > 0


def test_state_does_not_grow_with_keys_that_are_gone(spark, tmp_path):
    """A key lives for an hour; each batch has new ones, and the store holds those of the last batches only."""
    for n in range(6):
        write_flat(spark, tmp_path, [(100 * n + i, T0 + timedelta(hours=5 * n, minutes=i % 50), 1000 * n + i, "view") for i in range(100)], n)
    events = streams.event_stream(spark, str(tmp_path / "flat"), spark.createDataFrame([], SCHEMA).schema, files_a_trigger=1)
    out = streams.gap_stream(events, "user_id", late="10 minutes", keep="1 hour")
    with state.rocksdb(spark):
        job = out.writeStream.format("parquet").option("path", str(tmp_path / "g")).option("checkpointLocation", str(tmp_path / "s")).trigger(availableNow=True).start()
        job.awaitTermination()
    held = [o["numRowsTotal"] for p in job.recentProgress for o in p["stateOperators"]]
    assert len(held) >= 6 and held[-1] <= 6 * 100 and max(held) <= 10 * 100  # a few rows a live key, with its timer's


def test_keys_share_buckets_of_state(spark, tmp_path):
    """The store is called by buckets, not by keys; ids beyond 2**53 stay whole beside a null one."""
    data = [(2**60 + i, T0 + timedelta(seconds=i), i % 6000, "view") for i in range(9000)] + [(None, T0 + timedelta(seconds=9000), 5, "view")]
    for n, part in enumerate([data, [END]]):
        write_flat(spark, tmp_path, part, n)
    events = streams.event_stream(spark, str(tmp_path / "flat"), spark.createDataFrame([], SCHEMA).schema, files_a_trigger=1)
    with state.rocksdb(spark):
        job = streams.gap_stream(events, "user_id").writeStream.format("parquet").option("path", str(tmp_path / "g")).option("checkpointLocation", str(tmp_path / "s")).trigger(availableNow=True).start()
        job.awaitTermination()
    got = sorted((r.key, r.gap_seconds, r.event_id is None, r.event_id or 0) for r in spark.read.parquet(str(tmp_path / "g")).collect() if r.gap_seconds is not None)
    assert got == sorted([(str(i - 6000), 6000, False, 2**60 + i) for i in range(6000, 9000)] + [("5", 2995, True, 0)])
    assert max(o["numRowsTotal"] for p in job.recentProgress for o in p["stateOperators"]) < 6000


def test_keys_return_after_their_time_to_live(spark, tmp_path):
    def run(part, n):
        write_flat(spark, tmp_path, part, n)
        events = streams.event_stream(spark, str(tmp_path / "flat"), spark.createDataFrame([], SCHEMA).schema)
        return sorted(((r.key, r.first_time) for r in streams.drain(state.returned(events, "user_id", "ts", "20 seconds"), str(tmp_path / "g"), str(tmp_path / "s"), idle_batches=False).collect()), key=str)

    at = lambda m: T0 + timedelta(minutes=m)
    first = run([(1, at(3), 1, "x"), (2, at(1), 1, "x"), (3, at(2), None, "x")], 0)
    assert first == sorted([("1", at(1)), (None, at(2))], key=str)
    assert run([(4, at(5), 1, "x"), (5, at(6), 2, "x")], 1) == sorted([*first, ("2", at(6))], key=str)
    time.sleep(21)
    assert run([(6, at(8), 1, "x")], 2) == sorted([*first, ("2", at(6)), ("1", at(8))], key=str)


def test_runs_by_batch_keep_the_state_of_null_keys(spark, tmp_path):
    data, _ = keyed()
    for n in range(3):
        write_flat(spark, tmp_path, data[30 * n : 30 * n + 30], n)
    events = streams.event_stream(spark, str(tmp_path / "flat"), spark.createDataFrame([], SCHEMA).schema, files_a_trigger=1)
    got = streams.marker_runs(events, str(tmp_path / "r"), str(tmp_path / "rs"), "user_id", F.col("event_type") == "purchase")
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_runs(data)


def test_ingest_knows_null_keys_again_and_carried_state_does_not_pile_up(spark, tmp_path):
    data, _ = keyed(40)
    for n in range(4):
        write_flat(spark, tmp_path, [(None if i % 5 == 0 else i, ts, key, kind) for i, ts, key, kind in data[10 * n : 10 * n + 10]], n)
    events = streams.event_stream(spark, str(tmp_path / "flat"), spark.createDataFrame([], SCHEMA).schema, files_a_trigger=1)
    for checkpoint in ("one", "two"):
        streams.ingest(events, str(tmp_path / "rows"), ["event_id"], str(tmp_path / checkpoint))
    assert spark.read.parquet(str(tmp_path / "rows")).count() == 33
    streams.occurrence_gaps(events, str(tmp_path / "g"), str(tmp_path / "gs"), "user_id")
    assert sorted(p.name for p in (tmp_path / "gs-carried").iterdir()) == ["2", "3"]
