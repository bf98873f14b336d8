"""Health rules: each takes tables and limits and gives the rows of one report section."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.measures import reclaimable
from fleetlens.functions.times import day_age
from fleetlens.operators.capacity import frequent_maintenance
from fleetlens.operators.filters import Sections, admitted_state, pattern_suppression, recent
from fleetlens.operators.frames import last_occurrence, position_and_total, top_per_owner

#: Databases of the server itself.
SYSTEM_DATABASES = ("master", "model", "msdb", "distribution", "tempdb")


def offline(members: DataFrame, log: DataFrame, key: str, active: str, message: str, time: str) -> DataFrame:
    """Inactive members with the last time of each message."""
    return last_occurrence(log.join(members.where(~F.col(active)).select(key), key), [key], message, time)


def online(members: DataFrame, sizes: DataFrame, key: str, active: str, size: Column) -> DataFrame:
    totals = sizes.groupBy(key).agg(F.count("*").alias("n_databases"), F.sum(size).alias("size_total"))
    return members.where(active).join(totals, key, "left").na.fill(0, ["n_databases"])


def availability(members: DataFrame, key: str, facts: dict[str, DataFrame]) -> DataFrame:
    """How many rows each fact table has of each member."""
    for name, f in facts.items():
        members = members.join(f.groupBy(key).agg(F.count("*").alias(name)), key, "left")
    return members.na.fill(0, list(facts))


def replica_overview(replicas: DataFrame, group: list[str], role: str, database: str) -> DataFrame:
    return replicas.groupBy(*group, role).agg(F.count_distinct(database).alias("n_databases"))


def error_digest(errors: DataFrame, key: str, message: str, time: str) -> DataFrame:
    """Distinct messages of each member with their last time, and how many distinct ones it has."""
    x = errors.groupBy(key, message).agg(F.max(time).alias("last_time"))
    return x.join(x.groupBy(key).agg(F.count("*").alias("n_messages")), key)


def not_admitted(members: DataFrame, state: str, admitted: str) -> DataFrame:
    return members.where(~admitted_state(state, admitted))


def failed_recent(runs: DataFrame, status: str, failed: tuple, time: str, local: str, hours: int, as_of: str) -> DataFrame:
    return recent(runs.where(F.col(status).isin(*failed)), time, local, hours, as_of)


def long_running(runs: DataFrame, running: Column, seconds: Column, hours: float) -> DataFrame:
    return runs.where(running & (seconds >= hours * 3600))


def failed_logins(log: DataFrame, key: str, login: Column, reason: Column, least: int, most: int) -> DataFrame:
    """Login and reason out of the text, counted; the most frequent of each member."""
    x = log.select(key, login.alias("login_name"), reason.alias("reason")).where("login_name is not null").groupBy(key, "login_name", "reason").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return top_per_owner(x, [key], [F.col("n").desc(), F.col("login_name"), F.col("reason")], most)


def outdated(members: DataFrame, name: str, time: str, as_of: str, user_days: int, system_days: int, group: list[str] | None = None, healthy: Column | None = None) -> DataFrame:
    """Members whose last time is too old or null, unless a healthy member of the same group is fresh.

    Groups are equi-joined; a null group shields nobody. tempdb is never outdated.
    """
    system = F.lower(F.col(name)).isin(*SYSTEM_DATABASES)
    age = day_age(time, as_of)
    old = (F.col(time).isNull() | (age > F.when(system, system_days).otherwise(user_days))) & (F.lower(F.col(name)) != "tempdb")
    x = members.withColumn("age_days", age)
    late = x.where(old)
    if group:
        fresh = x.where(~old & healthy).select(*group).distinct()
        late = late.join(fresh, group, "left_anti")
    return late


def flagged(members: DataFrame, *flags: str) -> DataFrame:
    """Members with any of the flags (auto close, auto shrink, growth limited)."""
    any_ = F.lit(False)
    for f in flags:
        any_ = any_ | F.coalesce(F.col(f), F.lit(False))
    return members.where(any_)


def weak_verify(members: DataFrame, option: str, level: str) -> DataFrame:
    """Page verification that is not CHECKSUM, or NONE on servers before level 90."""
    return members.where(F.when(F.col(level) >= 90, F.col(option) != "CHECKSUM").otherwise(F.col(option) == "NONE"))


def low_disk(disks: DataFrame, hosted: DataFrame, keys: list[str], percent: str, free_mb: str, total_mb: str, least_percent: float, least_mb: float) -> DataFrame:
    """Drives that host databases and have little left, by percent, or by MB where that is null; largest total and least free."""
    x = disks.join(hosted.select(*keys).distinct(), keys, "left_semi").where((F.col(percent) < least_percent) | (F.col(percent).isNull() & (F.col(free_mb) < least_mb)))
    return x.groupBy(*keys).agg(F.max(total_mb).alias("total_mb"), F.min(free_mb).alias("available_mb"), F.min(percent).alias("percent_available"))


def size_outliers(members: DataFrame, size: str, least: float, used: str | None = None) -> DataFrame:
    """Members of at least a size (0: the rule is off), largest first, with what could be reclaimed."""
    if not least:
        return members.limit(0)
    x = members.where(F.col(size) >= least).orderBy(F.col(size).desc())
    return x.withColumn("reclaimable", reclaimable(size, used)) if used else x


def low_usage(members: DataFrame, size: str, used: str, least_size: float, most_used: float, least_reclaimable: float) -> DataFrame:
    x = members.where((F.col(size) >= least_size) & (F.col(used) <= most_used)).withColumn("reclaimable", reclaimable(size, used))
    return x.where(F.col("reclaimable") >= least_reclaimable)


def high_log_usage(members: DataFrame, log_size: str, log_used: str, percent: float, least_free: float) -> DataFrame:
    return members.where((F.col(log_used) >= percent) & (reclaimable(log_size, log_used) >= least_free))


def log_ratio(members: DataFrame, log_size: str, data_size: str, ratio: float) -> DataFrame:
    x = members.where(F.col(data_size) != 0).withColumn("log_data_ratio", F.col(log_size) / F.col(data_size))
    return x.where(F.col("log_data_ratio") > ratio)


def log_issues(log: DataFrame, owner: str, text: str, utc: str, local: str, patterns: list[str], hours: int, as_of: str, most: int, order: list[Column]) -> DataFrame:
    """The log's last hours without suppressed texts: row number and count of each owner, the first most rows (0: all).

    The counts are an aggregation beside the top rows, so that of a large owner no more than most rows of a partition are moved.
    """
    x = pattern_suppression(recent(log, utc, local, hours, as_of), text, patterns)
    if not most:
        return position_and_total(x, [owner], order)
    n = x.groupBy(F.col(owner).alias("_owner")).agg(F.count("*").alias("row_count"))
    return top_per_owner(x, [owner], order, most).join(n, F.col(owner).eqNullSafe(F.col("_owner"))).drop("_owner")


def complete_detail(facts: DataFrame, owner: list[str], order: list[Column]) -> DataFrame:
    return position_and_total(facts, owner, order)


def fragmented_indexes(actions: DataFrame, keys: list[str], time: str, tie: str, action: str, kinds: tuple[str, ...], max_days: int, pages: str, least_pages: int, fill: str, least_fill: int, instance: str) -> tuple[DataFrame, DataFrame]:
    """(indexes, counts by instance): objects that one of several kinds of maintenance came back to within max_days, each kind for itself, of a size and fill factor at least."""
    found = None
    for k in kinds:
        x = frequent_maintenance(actions.where(F.col(action) == k), keys, time, tie, max_days)
        found = x if found is None else found.unionByName(x)
    found = found.where((F.col(pages) >= least_pages) & (F.col(fill) >= least_fill))
    return found, found.groupBy(instance).agg(F.count("*").alias("index_count"))


def jobs_detail(runs: DataFrame, instance: str, columns: list[str], job: str, run: Column, order: list[Column]) -> tuple[DataFrame, DataFrame]:
    """(detail, runs by instance): distinct rows of jobs with their place in the instance's section; and distinct (job, run) of each instance."""
    detail = position_and_total(runs.select(instance, *columns).distinct(), [instance], order)
    return detail, runs.select(instance, job, run.alias("_run")).distinct().groupBy(instance).agg(F.count("*").alias("n_runs"))


def disk_detail(volumes: DataFrame, machine: list[str], volume: str, total: str, free: str) -> DataFrame:
    """Largest total and least free of each volume, then summed by machine."""
    x = volumes.groupBy(*machine, volume).agg(F.max(total).alias("_t"), F.min(free).alias("_f"))
    return x.groupBy(*machine).agg(F.count("*").alias("n_volumes"), F.sum("_t").alias("total"), F.sum("_f").alias("free"))


def report(sections: dict[Sections, tuple[str, Callable[[], DataFrame]]], enabled: Sections) -> dict[str, DataFrame]:
    """The sections that are enabled, by name; others are not even planned."""
    return {name: build() for flag, (name, build) in sections.items() if flag & enabled}


def issue_index(sections: dict[str, DataFrame]) -> DataFrame:
    """How many rows each section has."""
    from fleetlens.operators.frames import row_counts

    return row_counts(sections).select(F.col("table_name").alias("section"), F.col("n_rows").alias("n_issues"))
