"""Capacity, growth and trends."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.measures import growth_percent
from fleetlens.functions.times import boundary_diff
from fleetlens.operators.frames import exact, first_and_last, newest_two


def growth(history: DataFrame, keys: list[str], time: str, size: str, tie: str, since: str | None = None) -> DataFrame:
    """First and last size of each member since a time, the growth and its percent (null from 0); one row gives growth 0."""
    x = history.where(F.col(size).isNotNull())
    if since:
        x = x.where(F.col(time) >= F.expr(f"timestamp_ntz'{since}'"))
    x = first_and_last(x, keys, time, [size], tie)
    old, new = F.col(f"first_{size}"), F.col(f"last_{size}")
    return x.select(*keys, old.alias("old_size"), new.alias("current_size"), (exact(new) - exact(old)).cast("double").alias("growth_size"), growth_percent(old, new).alias("growth_percent"))


def frequent_maintenance(events: DataFrame, keys: list[str], time: str, tie: str, max_days: int) -> DataFrame:
    """Objects whose newest maintenance came within max_days of the one before: the newest row with interval_days."""
    x = newest_two(events, keys, time, tie).withColumn("_gap", boundary_diff("hour", F.col("_before"), F.col(time))).where("_gap is not null")
    return x.withColumn("interval_days", F.ceil(F.col("_gap") / 24.0)).where(F.col("interval_days") <= max_days).drop("_gap", "_before")


def paired_actions(info: DataFrame, actions: DataFrame, keys: list[str], time: str, tolerance_seconds: int | None = None) -> DataFrame:
    """Info rows with the action of the same object; the nearest within the tolerance, or with None every one.

    Within a tolerance time is cut in buckets of that length, and a row meets actions of its bucket and the two beside it only.
    Equal info rows have the same nearest action: they are paired as one, and each comes out.
    """
    a = actions.select(*keys, F.col(time).alias("action_time"))
    if tolerance_seconds is None:
        return info.join(a, keys)
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    bucket = lambda c: F.floor(micros(c) / (tolerance_seconds * 1_000_000))
    x = info.groupBy(*info.columns).agg(F.count("*").alias("_copies")).withColumn("_bucket", F.explode(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda i: bucket(time) + i)))
    far = F.abs(micros("action_time") - micros(time))
    x = x.join(a.distinct().withColumn("_bucket", bucket("action_time")), [*keys, "_bucket"]).where(far <= tolerance_seconds * 1_000_000)
    x = x.groupBy(*info.columns, "_copies").agg(F.min_by("action_time", F.struct(far, F.col("action_time"))).alias("action_time"))
    return x.select(*info.columns, "action_time", F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("_copy")).drop("_copy")


def backup_capacity(details: DataFrame, backups: DataFrame, keys: list[str], size: Column, file: str, kind: str, bytes_: Column, kinds: dict[str, str]) -> DataFrame:
    """Members and their size, with backup files and bytes of each kind; sides are summed on their own and joined null-safe.

    Distinct files are counted beside the sums: these combine before they are shuffled, and only keys and files are moved for the count.
    """
    left = details.groupBy(*keys).agg(F.count("*").alias("n_members"), F.sum(size).alias("size_total"))
    sums = []
    for k, name in kinds.items():
        sums += [F.sum(F.when(F.col(kind) == k, bytes_)).alias(f"{name}_bytes"), F.count(F.when(F.col(kind) == k, F.col(file))).alias(f"{name}_files")]
    totals = backups.groupBy(*keys).agg(*sums)
    files = backups.select(*(F.col(k).alias(f"_{k}") for k in keys), file).distinct().groupBy(*(f"_{k}" for k in keys)).agg(F.count(file).alias("n_files"))
    right = totals.join(files, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]).drop(*(f"_{k}" for k in keys))
    on = [left[k].eqNullSafe(right[k]) for k in keys]
    x = left.join(right, on, "left").select(*(left[k] for k in keys), "n_members", "size_total", *(right[c] for c in right.columns if c not in keys))
    return x.na.fill(0)


def replica_fallback(members: DataFrame, group: list[str], role: str, primary: str, size: str) -> DataFrame:
    """A member without a size takes its group's primary's."""
    p = members.where(F.col(role) == primary).groupBy(*group).agg(F.max(size).alias("_size"))
    return members.join(p, group, "left").withColumn(size, F.coalesce(size, "_size")).drop("_size").select(*members.columns)


def space_by_owner(files: DataFrame, owner: list[str], is_log: Column, size: str, used: str, mount: str) -> DataFrame:
    """Data and log size and used percent (0 for no size) and the mount points of each owner."""
    s, u = exact(size), exact(used)
    parts = ((~is_log, s, "data_size"), (is_log, s, "log_size"), (~is_log, u, "_du"), (is_log, u, "_lu"))
    x = files.groupBy(*owner, mount).agg(*(F.sum(F.when(c, v)).alias(n) for c, v, n in parts))  # mounts are distinct before they are listed
    x = x.groupBy(*owner).agg(*(F.coalesce(F.sum(n), F.lit(0)).alias(n) for _, _, n in parts), F.array_join(F.sort_array(F.collect_list(mount)), ", ").alias("mount_points"))
    pct = lambda a, b: F.when(F.col(b) != 0, F.round(F.col(a).cast("double") * 100 / F.col(b).cast("double"), 2)).otherwise(0.0)
    return x.select(*owner, F.col("data_size").cast("double").alias("data_size"), F.col("log_size").cast("double").alias("log_size"), pct("_du", "data_size").alias("data_used_percent"), pct("_lu", "log_size").alias("log_used_percent"), "mount_points")


def prefix_attribution(items: DataFrame, path: str, prefixes: DataFrame, prefix: str, separators: str = "/") -> DataFrame:
    """Each item with its longest matching prefix (null for none).

    Prefixes end at a separator, so an item's starts are known, one for each separator that it has, and the join is on equal strings, not on containment.
    """
    x = items.select(F.col(path).alias("_path")).distinct()
    sizes = F.transform(F.split("_path", "[" + re.escape(separators) + "]"), lambda p: F.char_length(p))
    add = lambda ends, n: F.concat(ends, F.array(F.coalesce(F.try_element_at(ends, F.lit(-1)), F.lit(0)) + n + 1))
    ends = F.reduce(F.slice(sizes, 1, F.size(sizes) - 1), F.array().cast("array<int>"), add)
    starts = x.where(F.length("_path") > 0).select("_path", F.explode(F.transform(ends, lambda n: F.substring(F.col("_path"), F.lit(1), n))).alias("_start"))
    best = starts.join(prefixes.select(F.col(prefix).alias("_start")).distinct(), "_start").groupBy("_path").agg(F.max_by("_start", F.length("_start")).alias("owner_prefix"))
    return items.join(best, items[path] == best["_path"], "left").drop("_path")


def size_with_fallback(members: DataFrame, measured: DataFrame, key: list[str], group: list[str], parts: list[str], fallback: str) -> DataFrame:
    """Size by group: the sum of a member's parts, or where one of them is null its fallback measure of another table."""
    own = F.col(parts[0])
    for p in parts[1:]:
        own = own + F.col(p)
    x = members.join(measured.select(*key, F.col(fallback).alias("_fallback")), key, "left")
    return x.groupBy(*group).agg(F.sum(F.coalesce(own, "_fallback")).alias("size_total"), F.count(F.when(own.isNull(), 1)).alias("n_fallback"))


def last_event_or_null(members: DataFrame, events: DataFrame, keys: list[str], time: str, name: str, sentinel: str = "1900-01-01") -> DataFrame:
    """Each member with its last event; the sentinel date stands for never and becomes null."""
    last = events.groupBy(*keys).agg(F.max(time).alias(name))
    never = F.expr(f"timestamp_ntz'{sentinel}'")
    return members.join(last, keys, "left").withColumn(name, F.when(F.col(name) != never, F.col(name)))


def merge_partials(left: DataFrame, right: DataFrame, keys: list[str], defaults: dict | None = None) -> DataFrame:
    """Two extracts of one entity by key; each gives its columns, a missing side null or its default."""
    return left.join(right, keys, "full").na.fill(defaults or {})


def pool_inherit(members: DataFrame, measured: DataFrame, member: str, pool: str) -> DataFrame:
    """measured rows, and for members without one a copy of their pool's (the pool's rows of the first measured member)."""
    has = measured.select(member).distinct()
    donors = members.join(has, member, "left_semi").groupBy(pool).agg(F.min(member).alias("_donor"))
    heirs = members.join(has, member, "left_anti").join(donors, pool).select(F.col(member).alias("_heir"), "_donor")
    copies = measured.join(heirs, measured[member] == heirs["_donor"]).withColumn(member, F.col("_heir")).select(*measured.columns)
    return measured.withColumn("inherited", F.lit(False)).unionByName(copies.withColumn("inherited", F.lit(True)))


def latest_sample(samples: DataFrame, pool: list[str], time: str, tie: str, limit: str, used: str) -> DataFrame:
    """Newest sample of each pool with free = limit * (100 - used) / 100."""
    x = samples.groupBy(*pool).agg(F.max(F.struct(time, tie, limit, used)).alias("_s"))
    return x.select(*pool, F.col(f"_s.{time}").alias(time), F.round(F.col(f"_s.{limit}") * (100 - F.col(f"_s.{used}")) / 100, 4).alias("free"))


def growth_events(log: DataFrame, files: DataFrame, keys: list[str], by: list[str], pages: str, time: str, after: str) -> DataFrame:
    """Grown KB (pages of 8 KB) by file and session after a watermark, of files that are known; only growth above 0."""
    x = log.where(F.col(time) > F.expr(f"timestamp_ntz'{after}'")).groupBy(*keys, *by).agg(F.sum(F.col(pages) * 8).alias("growth_kb"))
    return x.where("growth_kb > 0").join(files, keys)
