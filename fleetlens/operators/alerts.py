"""Alerts: thresholds, severity bands, routing, repeat suppression and flood control."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.functions import texts

#: Fixed values: (category, alert, operator, warning, critical) defaults.
THRESHOLDS = (
    ("disk-space", "Logical Disk: Free Disk Space (%)", "<", 10.0, 5.0),
    ("disk-space", "Logical Disk: Free Disk Space (MB)", "<", 3000.0, 1024.0),
    ("replication", "Replication Latency", ">", 15.0, 20.0),
    ("performance", "Running Transaction Elapsed Time (sec)", ">", 3600.0, 7200.0),
    ("performance", "Uncommitted Transaction Elapsed Time (sec)", ">", 900.0, 1800.0),
    ("performance", "Blocking Transaction Elapsed Time (sec)", ">", 600.0, 900.0),
    ("performance", "Active Request Elapsed Time (sec)", ">", 600.0, 900.0),
    ("performance", "tempdb: space used by a single session", ">", 8192.0, 16384.0),
)


def limits(alerts: DataFrame, thresholds: DataFrame, name: str, warning: float, critical: float) -> DataFrame:
    """alerts with warning_limit and critical_limit of their enabled threshold, or the defaults."""
    t = thresholds.select(
        F.col("alert_name").alias("_name"), F.when(F.col("is_warning_limit_enabled"), F.col("warning_limit")).alias("_w"), F.when(F.col("is_critical_limit_enabled"), F.col("critical_limit")).alias("_c")
    )
    x = alerts.join(t, alerts[name] == t["_name"], "left")
    return x.withColumn("warning_limit", F.coalesce("_w", F.lit(warning))).withColumn("critical_limit", F.coalesce("_c", F.lit(critical))).drop("_name", "_w", "_c")


def default_limits(name: Column, limit: str) -> Column:
    """The warning or critical default of THRESHOLDS for an alert's name, else null."""
    at = {"warning": 3, "critical": 4}[limit]
    out = F.lit(None).cast("double")
    for t in THRESHOLDS:
        out = F.when(name == t[1], t[at]).otherwise(out)
    return out


def severity(value: Column, warning: Column | float, critical: Column | float) -> Column:
    """warning for warning <= value < critical, critical for more, else null."""
    return F.when(value >= critical, "critical").when(value >= warning, "warning")


def severity_low(value: Column, warning: Column | float, critical: Column | float, strict: bool = False) -> Column:
    """For values that are bad when small. strict leaves a value that equals the critical limit without a band."""
    low = value < critical if strict else value <= critical
    return F.when(low, "critical").when((value > critical) & (value < warning), "warning")


def banded(df: DataFrame, metrics: list[tuple[str, Column, Column, float, float]]) -> DataFrame:
    """One row for each row and alert (name, value, predicate, warning, critical) that is in a band; df is read once."""
    each = [F.struct(F.lit(n).alias("alert_name"), F.when(p, v.cast("double")).alias("value"), F.when(p, severity(v, w, c)).alias("severity")) for n, v, p, w, c in metrics]
    return df.select("*", F.explode(F.array(*each)).alias("_a")).select(*df.columns, "_a.*").where("severity is not null")


def free_space(disks: DataFrame, percent: str, free_mb: str, percent_limits: tuple[float, float], mb_limits: tuple[float, float], strict: bool = False) -> DataFrame:
    """Disks in a band by percent, or by MB where percent is null."""
    by = F.when(F.col(percent).isNotNull(), severity_low(F.col(percent), *percent_limits, strict)).otherwise(severity_low(F.col(free_mb), *mb_limits, strict))
    return disks.withColumn("severity", by).where("severity is not null")


def latency_alerts(rows: DataFrame, keys: list[str], latency: str, warning: float, critical: float) -> DataFrame:
    """Largest latency of each subscription; an unknown one counts as critical and stays null."""
    x = rows.groupBy(*keys).agg(F.max(latency).alias("max_latency"), F.bool_or(F.col(latency).isNull()).alias("_open"))
    x = x.withColumn("overall_latency", F.when(~F.col("_open"), F.col("max_latency")))
    return x.withColumn("severity", F.when(F.col("overall_latency").isNull(), "critical").otherwise(severity(F.col("overall_latency"), warning, critical))).drop("_open", "max_latency").where("severity is not null")


def new_failures(runs: DataFrame, recorded: DataFrame, keys: list[str], time: str, tie: str, failed: Column, since: str) -> DataFrame:
    """Jobs whose last outcome is a failure later than since and not recorded yet."""
    others = [c for c in runs.columns if c not in keys]
    last = runs.groupBy(*keys).agg(F.max(F.struct(time, tie, F.struct(*others).alias("_row"))).alias("_n")).select(*keys, "_n._row.*").select(*runs.columns)
    x = last.where(failed).where(F.col(time) > F.expr(f"timestamp_ntz'{since}'"))
    return x.join(recorded.select(*keys, time), [*keys, time], "left_anti")


def recipients(events: DataFrame, extra: DataFrame, keys: list[str], default: str) -> DataFrame:
    """events with recipients: the default list and the additional ones of (instance, event, object) in order; a null object fits all."""
    x = extra.where("active").groupBy(*keys).agg(F.array_join(F.sort_array(F.collect_set("recipients")), ";").alias("_more"))
    return events.join(x, keys, "left").withColumn("recipients", F.concat(F.lit(default), F.coalesce(F.concat(F.lit(";"), "_more"), F.lit("")))).drop("_more")


def session_lists(rows: DataFrame, keys: list[str], lists: dict[str, str]) -> DataFrame:
    """Distinct values of each session in order, joined: name of the list to its column."""
    return rows.groupBy(*keys).agg(*(F.array_join(F.sort_array(F.collect_set(c)), ", ").alias(n) for n, c in lists.items()))


def waiting_snapshot(sessions: DataFrame, keys: list[str], session: str, blocker: str, elapsed: str, least_elapsed: float, least_blocked: int) -> DataFrame:
    """Sessions that run long or block others, with how many they block and whether they are blocked."""
    blocked = sessions.where(F.col(blocker).isNotNull()).groupBy(*keys, F.col(blocker).alias(session)).agg(F.count("*").alias("sessions_blocked"))
    x = sessions.join(blocked, [*keys, session], "left").withColumn("sessions_blocked", F.coalesce("sessions_blocked", F.lit(0)))
    x = x.withColumn("is_session_blocked", F.col(blocker).isNotNull())
    return x.where((F.col(elapsed) >= least_elapsed) | (F.col("sessions_blocked") >= least_blocked) | F.col("is_session_blocked"))


def transaction_snapshot(sessions: DataFrame, requests: DataFrame, transactions: DataFrame, temp_space: DataFrame, waits: DataFrame, keys: list[str], least: dict[str, float]) -> DataFrame:
    """User sessions that reach a threshold: running request, transaction, wait or temp space (least: request, transaction, wait, temp_mb).

    Captured tables, each with keys (host) and session_id: sessions (idle_seconds), requests (request_id, request_seconds),
    transactions (transaction_seconds, several a session), temp_space (request_id, alloc_pages, dealloc_pages, several a request)
    and waits (blocking_session_id, wait_seconds). Each side is cut to what reaches its threshold and summed before it is joined;
    a session with several requests has a row for each. sessions_blocked counts who waits for the session.
    """
    on = [*keys, "session_id"]
    t = transactions.groupBy(*on).agg(F.max("transaction_seconds").alias("transaction_seconds")).where(F.col("transaction_seconds") >= least["transaction"])
    mb = F.floor(F.sum((F.col("alloc_pages") - F.col("dealloc_pages")) * 8) / 1024)
    s = temp_space.groupBy(*on, "request_id").agg(mb.alias("tempdb_space_used_mb")).where(F.col("tempdb_space_used_mb") >= max(1, least["temp_mb"]))
    w = waits.where(~F.col("session_id").eqNullSafe(F.col("blocking_session_id")) & (F.col("wait_seconds") >= least["wait"]))
    blockers = w.where(F.col("blocking_session_id").isNotNull()).groupBy(*keys, F.col("blocking_session_id").alias("session_id")).agg(F.count("*").alias("sessions_blocked"))
    blocked = w.groupBy(*on).agg(F.max("wait_seconds").alias("wait_seconds"), F.bool_or(F.col("blocking_session_id").isNotNull()).alias("is_session_blocked"))
    x = sessions.join(requests, on, "left").join(t, on, "left").join(s, [*on, "request_id"], "left").join(blockers, on, "left").join(blocked, on, "left")
    x = x.withColumn("request_completed", F.col("request_id").isNull()).withColumn("elapsed_seconds", F.greatest(F.lit(0), F.coalesce("request_seconds", "idle_seconds")))
    x = x.withColumn("is_session_blocked", F.coalesce("is_session_blocked", F.lit(False))).withColumn("sessions_blocked", F.coalesce("sessions_blocked", F.lit(0).cast("long")))
    reached = (~F.col("request_completed") & (F.col("elapsed_seconds") >= least["request"])) | F.col("transaction_seconds").isNotNull() | F.col("wait_seconds").isNotNull() | F.col("tempdb_space_used_mb").isNotNull()
    return x.where(reached)


def latency_state(subscriptions: DataFrame, jobs: DataFrame, measured: DataFrame, publication: list[str], subscription: list[str], latency: str) -> DataFrame:
    """subscriptions with state and latency: 1 once the publication's analysis job succeeded, 2 once its reading did; the largest latency, null if one is unknown.

    jobs: (publication, step analysis or reading, status, 1 is success). Latencies are taken for publications in state 2 only.
    """
    ok = jobs.where("status = 1").groupBy(*publication).agg(F.bool_or(F.col("step") == "analysis").alias("_one"), F.bool_or(F.col("step") == "reading").alias("_two"))
    m = measured.groupBy(*subscription).agg(F.when(~F.bool_or(F.col(latency).isNull()), F.max(latency)).alias("overall_latency"))
    x = subscriptions.join(ok, publication, "left").join(m, subscription, "left")
    state = F.when(F.col("_two"), 2).when(F.col("_one"), 1).otherwise(0)
    return x.withColumn("state", state).withColumn("overall_latency", F.when(F.col("state") == 2, F.col("overall_latency"))).drop("_one", "_two")


def ignored(event_type: Column, error_code: Column, event_name: Column, object_name: Column, error_codes: tuple[int, ...], events: tuple[tuple[str, str], ...]) -> Column:
    """Whether an alert is on the ignore list: an error by its code (type 1), or a custom alert by its name and object (type 6)."""
    by_event = F.lit(False)
    for name, obj in events:
        by_event = by_event | ((event_name == name) & (object_name == obj))
    return F.coalesce(((event_type == 1) & error_code.isin(*error_codes)) | ((event_type == 6) & by_event), F.lit(False))


def repeat_key(*columns: str) -> Column:
    return F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns))


DECIDED = "instance string, event_id long, ts timestamp_ntz, alert_key string, event_type int, is_sent boolean, flood_control boolean"


class Decider:
    """The state of one instance: how much was sent in each of the last minutes, and the last time of each key; both forget."""

    def __init__(self, cap: int, minutes: int, repeat_minutes: int):
        self.cap, self.minutes, self.repeat = cap, minutes, repeat_minutes
        self.sent: deque[list[int]] = deque()  # [minute, number sent]
        self.n_sent = 0
        self.last: dict[str, int] = {}  # in order of time

    def decide(self, second: int, key: str, kind: int, ignored: bool, sent: bool = False) -> tuple[bool, bool]:
        """(sent, held back). Limits count minute boundaries; types other than 1 and 6 pass them, but count. sent: it was decided before."""
        minute = second // 60
        while self.sent and minute - self.sent[0][0] > self.minutes:
            self.n_sent -= self.sent.popleft()[1]
        while self.last and minute - next(iter(self.last.values())) > self.repeat:
            self.last.pop(next(iter(self.last)))
        name = f"{kind}|{key}"
        held = ignored and not sent
        if not held and not sent and kind in (1, 6):
            held = self.n_sent >= self.cap or name in self.last
        if not held:
            if not self.sent or self.sent[-1][0] != minute:
                self.sent.append([minute, 0])
            self.sent[-1][1] += 1
            self.n_sent += 1
            self.last.pop(name, None)
            self.last[name] = minute
        return not held, held


def quiet_segments(events: DataFrame, instance: str, minute: str, quiet: int) -> DataFrame:
    """(_instance, _minute, segment) for each minute with events: segments of an instance are more than `quiet` minutes apart.

    The window is over distinct minutes, which a partial aggregation leaves of the events: half a million a year at most.
    """
    minutes = events.select(F.col(instance).alias("_instance"), F.col(minute).alias("_minute")).distinct()
    w = Window.partitionBy("_instance").orderBy("_minute")
    new = F.coalesce((F.col("_minute") - F.lag("_minute").over(w) > quiet).cast("long"), F.lit(0))
    return minutes.withColumn("_new", new).withColumn("segment", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def decide_alerts(events: DataFrame, cap: int = 50, minutes: int = 5, repeat_minutes: int = 60, sent: DataFrame | None = None) -> DataFrame:
    """DECIDED for events (instance, event_id, ts, alert_key, event_type, ignored): repeat suppression and flood control.

    In order of (ts, event_id) within an instance an event is held back and flagged if it is ignored, if the instance has sent cap
    events in the last minutes, or if the same key and type was sent within repeat_minutes; only what was sent counts. sent has
    earlier events that count as sent and are not given out again.

    Ignored events are held back whatever else happens and leave no trace, so they need no order. The others do, but only as far
    as the limits reach: after a pause longer than both an instance starts without a memory, so the segments between such pauses
    are decided independently, an instance with a third of all events on as many tasks as it has segments. A segment passes
    through one task in sorted batches, each row at constant cost; the state kept is a count for each of the recent minutes and
    one time for each recent key. An instance that never pauses is one segment.
    """
    fields = ["instance", "event_id", "ts", "alert_key", "event_type"]
    rows = events.select(*fields, F.coalesce("ignored", F.lit(False)).alias("ignored"), F.lit(False).alias("before"))
    held = rows.where("ignored").select(*fields, F.lit(False).alias("is_sent"), F.lit(True).alias("flood_control"))
    keep = rows.where("not ignored")
    if sent is not None:
        keep = keep.unionByName(sent.select(*fields, F.lit(False).alias("ignored"), F.lit(True).alias("before")))
    keep = keep.withColumn("second", F.unix_seconds(F.col("ts").cast("timestamp"))).withColumn("minute", F.floor(F.col("second") / 60))
    cuts = quiet_segments(keep, "instance", "minute", max(minutes, repeat_minutes))
    keep = keep.join(cuts, F.col("instance").eqNullSafe(F.col("_instance")) & F.col("minute").eqNullSafe(F.col("_minute"))).drop("_instance", "_minute")
    ordered = keep.repartition("instance", "segment").sortWithinPartitions("instance", "segment", "second", "ts", "event_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, state = None, Decider(cap, minutes, repeat_minutes)
        for b in batches:
            out = []
            for instance, segment, second, key, kind, before in zip(b["instance"], b["segment"], b["second"], b["alert_key"], b["event_type"], b["before"], strict=True):
                if (instance, segment) != name:
                    name, state = (instance, segment), Decider(cap, minutes, repeat_minutes)
                out.append(state.decide(int(second), key, int(kind), False, bool(before)))
            b["is_sent"], b["flood_control"] = [x[0] for x in out], [x[1] for x in out]
            yield b.loc[~b["before"], [*fields, "is_sent", "flood_control"]]

    return ordered.mapInPandas(run, DECIDED).unionByName(held)


def job_notifications(events: DataFrame, status: str, failures: tuple[str, ...]) -> DataFrame:
    """Only failures notify."""
    return events.where(F.col(status).isin(*failures))


def digest(events: DataFrame, key: list[str], start: str, time: str, failed: Column) -> DataFrame:
    """Of each job the events since its start: how many, how many failed, first and last."""
    return events.where(F.col(time) >= F.col(start)).groupBy(*key).agg(F.count("*").alias("n_events"), F.count(F.when(failed, 1)).alias("n_failed"), F.min(time).alias("first_time"), F.max(time).alias("last_time"))


def status_of_all(runs: DataFrame, jobs: DataFrame, keys: list[str], status: str, order: list[str]) -> DataFrame:
    """Every job with its last status and number of runs, also one that never ran."""
    last = runs.groupBy(*keys).agg(F.max_by(status, F.struct(*order)).alias("last_status"), F.count("*").alias("n_runs"))
    return last.join(jobs, keys, "right").na.fill(0, ["n_runs"])


def subject(instance: Column, event: Column, obj: Column) -> Column:
    return F.concat(F.lit("["), event, F.lit("] on "), instance, F.when(obj.isNotNull(), F.concat(F.lit(": "), obj)).otherwise(""))


def full_subject(project: Column, event_type: Column, server: Column, database: Column, failed: Column, name: Column, obj: Column) -> Column:
    """[project] kind on [server]: [database] - [error or outcome] - name - object; what is null is left out."""
    outcome = F.when(event_type == 1, "[error] - ").when(event_type.isin(2, 5), F.when(failed, "[failed] - ").otherwise("[completed] - ")).otherwise("")
    opt = lambda c, *x: F.when(c.isNotNull(), F.concat(*x)).otherwise("")
    return F.concat(
        opt(project, F.lit("["), project, F.lit("] ")), texts.decode(event_type, texts.SUBJECT, ""), F.lit(" on ["), server, F.lit("]: "), opt(database, F.lit("["), database, F.lit("] - ")), outcome, name, opt(obj, F.lit(" - "), obj)
    )


def body(detail: Column) -> Column:
    """An alert's detail (field, value) pairs as an HTML list, in order; pairs without a value are left out."""
    items = F.transform(F.filter(detail, lambda x: x["value"].isNotNull()), lambda x: F.concat(F.lit("<li>"), x["field"], F.lit(": "), F.replace(F.replace(x["value"], F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))))
    return F.concat(F.lit("<ul>"), F.array_join(items, ""), F.lit("</ul>"))


def replication_inventory(articles: DataFrame, subscription: list[str], article: str) -> DataFrame:
    """Distinct articles of each subscription."""
    return articles.groupBy(*subscription).agg(F.count_distinct(article).alias("articles"))


def inactive_subscriptions(subscriptions: DataFrame, status: str, active: tuple) -> DataFrame:
    """Subscriptions that are not active, with a severity: unknown states are critical."""
    return subscriptions.where(~F.coalesce(F.col(status).isin(*active), F.lit(False))).withColumn("severity", F.when(F.col(status).isNull(), "critical").otherwise("warning"))
