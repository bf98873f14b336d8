"""Maintenance decisions as data: what to rebuild, update, keep, delete and run."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.functions.measures import stale
from fleetlens.operators.frames import ranked


def heap_action(fragmentation: Column, deviation: Column, forwarded: Column, rebuild: float, defrag: float) -> Column:
    return F.when((fragmentation >= rebuild) | (deviation >= rebuild) | (forwarded >= defrag), "rebuild").otherwise("none")


def index_action(pages: Column, fragmentation: Column, deviation: Column, deleted_segments: Column, columnstore: Column, defrag: float, rebuild: float, least_pages: int, most_pages: int) -> Column:
    """none below least_pages; column stores by deleted segments; reorganize between the limits, or above most_pages; else rebuild."""
    bad = F.greatest(fragmentation, F.coalesce(deviation, F.lit(0.0)))
    return (
        F.when(pages < least_pages, "none")
        .when(columnstore, F.when(deleted_segments >= rebuild, "rebuild").when(deleted_segments >= defrag, "reorganize").otherwise("none"))
        .when(bad < defrag, "none")
        .when((bad < rebuild) | (pages > most_pages), "reorganize")
        .otherwise("rebuild")
    )


def segment_health(segments: DataFrame, keys: list[str], rows: str, deleted: str) -> DataFrame:
    """Percent of deleted rows and of segments without a row left."""
    x = segments.groupBy(*keys).agg(F.sum(rows).alias("_r"), F.sum(deleted).alias("_d"), F.count("*").alias("segments_count"), F.count(F.when(F.col(rows) <= F.col(deleted), 1)).alias("deleted_segments_count"))
    pct = lambda a, b: F.round(F.try_divide(F.col(a) * 100.0, F.col(b)), 2)
    return x.select(*keys, "segments_count", "deleted_segments_count", pct("_d", "_r").alias("deleted_rows_percentage"), pct("deleted_segments_count", "segments_count").alias("deleted_segments_percentage"))


def size_floor(objects: DataFrame, keys: list[str], size: str, least: float) -> DataFrame:
    big = objects.groupBy(*keys).agg(F.sum(size).alias("_s")).where(F.col("_s") >= least).select(*keys)
    return objects.join(big, keys, "left_semi")


def dependents(indexes: DataFrame, pending: DataFrame, keys: list[str]) -> DataFrame:
    return indexes.join(pending, keys, "left_semi")


def fill_advice(fill: Column, step: int, floor: int) -> Column:
    """A fill factor lower by step, if that is not below floor; 0 means 100."""
    now = F.when(fill == 0, 100).otherwise(fill)
    return F.when(now - step >= floor, now - step)


def backup_type(changed: Column, total: Column, percent: float) -> Column:
    return F.when(F.try_divide(changed * 100.0, total) >= percent, "full").otherwise("diff")


def _band(x: Column, level: Column) -> Column:
    """The band of a number among bands of 2 ** level; it rises with the number, which is all that is needed of it."""
    return F.floor(x.cast("decimal(38,0)") / F.pow(F.lit(2.0), level).cast("decimal(38,0)"))


def covered(points: DataFrame, intervals: DataFrame, key: str, point: str, first: str, last: str) -> DataFrame:
    """Distinct (key, point) of points that lie in an interval [first, last] of their key; numbers, times or null, which lie nowhere.

    A join by bands: an interval is put in the two bands, of the power of two that is as long as itself or the next longer one,
    that it can reach, and a point in one band of each length that there is; equal bands meet and the exact test decides. So
    a key with all rows is dealt over its bands, and a point meets only intervals about it and not all of its key.
    """
    number = lambda c: c if points.schema[point].dataType.typeName() not in ("timestamp", "timestamp_ntz", "date") else F.unix_micros(c.cast("timestamp"))
    f = intervals.select(F.col(key).alias("_k"), number(F.col(first)).alias("_f"), number(F.col(last)).alias("_l")).where("_f <= _l").distinct()
    length = (F.col("_l") - F.col("_f")).cast("double")
    level = F.ceil(F.log2(length + 1)).cast("int")
    f = f.withColumn("_level", F.when(F.pow(F.lit(2.0), level) < length, level + 1).otherwise(level))
    levels = sorted(r[0] for r in f.select("_level").distinct().collect())  # 128 at most, as numbers have so many bits
    f = f.withColumn("_band", F.explode(F.array_distinct(F.array(_band(F.col("_f"), F.col("_level")), _band(F.col("_l"), F.col("_level"))))))
    p = points.select(F.col(key).alias("_key"), F.col(point).alias("_point"), number(F.col(point)).alias("_at")).where("_at is not null").distinct()
    p = p.withColumn("_on", F.explode(F.array(*map(F.lit, levels)).cast("array<int>"))).withColumn("_in", _band(F.col("_at"), F.col("_on")))
    hit = p.join(f, (F.col("_key") == F.col("_k")) & (F.col("_on") == F.col("_level")) & (F.col("_in") == F.col("_band")) & F.col("_at").between(F.col("_f"), F.col("_l")), "left_semi")
    return hit.select(F.col("_key").alias(key), F.col("_point").alias(point)).distinct()


def missing_base(chains: DataFrame, fulls: DataFrame, key: str, base: str, first: str, last: str) -> DataFrame:
    """Diffs and logs whose base lies in no full backup of the same member; see covered()."""
    return chains.join(covered(chains, fulls, key, base, first, last), [key, base], "left_anti").select(*chains.columns)


def deletable(sets: DataFrame, keys: list[str], keep: int, mode: str, as_of: str | None = None, orphans: bool = True) -> DataFrame:
    """Backup sets (keys, set_id, kind full/diff/log, start_time, first_lsn, base_lsn) that may be deleted.

    mode days: F is the newest full of age keep or more. mode count: the anchor is the oldest of the newest keep fulls and diffs;
    F is the newest full before it if it is a diff, else itself. A set goes when it starts before F; with orphans also diffs and
    logs before F that do not build on it, and those before X, the newest diff of age keep or more after F (days only). Without
    an F nothing goes. F, X and the anchor are aggregates of a member, told to its sets by a join that Spark can split; of the
    newest `keep` no task keeps more than so many of a member before the shuffle.
    """
    full, diff = F.col("kind") == "full", F.col("kind") == "diff"
    row = F.struct("start_time", "set_id", "first_lsn")

    def told(of: DataFrame) -> DataFrame:
        same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
        return sets.join(of.select(*(F.col(k).alias(f"_{k}") for k in keys), *(c for c in of.columns if c not in keys)), same).drop(*(f"_{k}" for k in keys))

    if mode == "days":
        old = F.col("start_time") <= F.expr(f"timestamp_ntz'{as_of}' - interval {keep} days")
        of = sets.groupBy(*keys).agg(F.max(F.when(full & old, row)).alias("_f"))
        later = told(of).where(diff & old & (F.col("set_id") > F.col("_f.set_id"))).groupBy(*(F.col(k).alias(f"_{k}") for k in keys)).agg(F.max("set_id").alias("_x"))
        of = of.join(later, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "left").select(*keys, "_f", "_x")
    else:
        newest = Window.partitionBy(*keys).orderBy(F.col("start_time").desc(), F.col("set_id").desc())
        top = sets.where(full | diff).select(*keys, "start_time", "set_id").withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= keep)
        anchor = top.groupBy(*keys).agg(F.min(F.struct("start_time", "set_id")).alias("_anchor"), F.count("*").alias("_got")).where(F.col("_got") >= keep)
        of = told(anchor).where(full & (F.struct("start_time", "set_id") <= F.col("_anchor"))).groupBy(*keys).agg(F.max(row).alias("_f")).withColumn("_x", F.lit(None).cast("long"))
    x = told(of.where("_f is not null"))
    later = diff | (F.col("kind") == "log")
    gone = F.col("start_time") < F.col("_f.start_time")
    if orphans:
        gone = gone | ((F.col("set_id") < F.col("_f.set_id")) & later & ~F.col("base_lsn").eqNullSafe(F.col("_f.first_lsn"))) | ((F.col("set_id") < F.col("_x")) & later)
    return x.where(F.coalesce(gone, F.lit(False))).select(*sets.columns)


def chain_gaps(backups: DataFrame, keys: list[str], order: str, first: str, last: str) -> DataFrame:
    """Each backup's state against the one before: ok, gap (starts after its end) or overlap; first rows are ok."""
    w = Window.partitionBy(*keys).orderBy(order)
    before = F.lag(last).over(w)
    return backups.withColumn("state", F.when(before.isNull() | (F.col(first) == before), "ok").when(F.col(first) > before, "gap").otherwise("overlap"))


def lsn_number(triple: Column) -> Column:
    """A hexadecimal sequence number aaaaaaaa:bbbbbbbb:cccc as decimal(25): the parts with 10 and 5 digits behind each other."""
    part = lambda i, n: F.lpad(F.conv(F.split_part(triple, F.lit(":"), F.lit(i)), 16, 10), n, "0")
    return F.concat(part(1, 10), part(2, 10), part(3, 5)).cast("decimal(25,0)")


def due_tasks(schedule: DataFrame, projects: DataFrame, day: str) -> DataFrame:
    """Tasks of a day by project: the project's own row of the schedule, else the default row (null project).

    The default tasks that are due go to every project, which is the result asked for; others are left out before that.
    """
    on = F.col("active") & F.col("scheduled_weekday").isin("Daily", pd.Timestamp(day).day_name())
    own = schedule.where("project_id is not null").select("project_id", "task_id", on.alias("_due"))
    default = schedule.where("project_id is null").where(on).select("task_id")
    by_default = projects.select("project_id").crossJoin(default).join(own, ["project_id", "task_id"], "left_anti")
    return by_default.unionByName(own.where("_due").select("project_id", "task_id"))


def work_list(members: DataFrame, tasks: DataFrame, skip: DataFrame, queued: DataFrame, keys: list[str]) -> DataFrame:
    """Members by tasks, which is the work there may be, less skipped and queued ones; tasks is the short list of what is due."""
    return members.crossJoin(tasks).join(skip, keys, "left_anti").join(queued, keys, "left_anti")


def queue_stats(queue: DataFrame, time: str, as_of: str, expire_hours: int, keys: list[str]) -> DataFrame:
    """Rows by state (status -1 pending, 4 running, 0 failed, else finished), and pending ones that have expired."""
    s = F.col("status")
    old = F.col(time) < F.expr(f"timestamp_ntz'{as_of}' - interval {expire_hours} hours")
    n = lambda c, name: F.count(F.when(c, 1)).alias(name)
    return queue.groupBy(*keys).agg(n(s == -1, "pending"), n(s == 4, "running"), n(s == 0, "failed"), n(~s.isin(-1, 0, 4), "finished"), n((s == -1) & old, "expired"))


def overdue_checks(members: DataFrame, key: str, last_check: str, as_of: str, days: int, unreadable: DataFrame, production: str | None = None) -> DataFrame:
    """Members whose last check is days old or more, or that never had one, without those that an unreadable replica holds; with production only these."""
    x = members.where(F.col(production)) if production else members
    age = F.datediff(F.to_date(F.lit(as_of)), F.to_date(F.col(last_check)))
    return x.where(F.col(last_check).isNull() | (age >= days)).withColumn("age_days", age).join(unreadable.select(key), key, "left_anti")


def starts_per_minute(starts: DataFrame, time: str, heavy: Column) -> DataFrame:
    """Job starts of each minute, and those that are resource-intensive."""
    return starts.groupBy(F.date_trunc("minute", time).cast("timestamp_ntz").alias("minute")).agg(F.count("*").alias("starts"), F.count(F.when(heavy, 1)).alias("heavy"))


def shared_volume_load(pending: DataFrame, running: DataFrame, instance: str, key: str, volumes: str, heavy: str, separator: str = ",") -> DataFrame:
    """(key, n_running, n_same_volume): for each pending job what runs on its instance, and the resource-intensive jobs of these on one of its volumes.

    Jobs of an instance with the same set of volumes are a class with a count. Classes meet by their volumes, each pair of them
    once, and a class's sum is told to its jobs; so what is made between is bounded by the classes of an instance, squared, and
    not by its jobs. Volumes of rows with the same key are put together; a null key is no job, a null list has no volume.
    """

    def classes(df: DataFrame) -> DataFrame:
        one = df.where(F.col(key).isNotNull()).select(instance, F.col(key).alias("_key"), F.explode(F.split(F.col(volumes), separator)).alias("_v")).withColumn("_v", F.trim("_v"))
        return one.groupBy(instance, "_key").agg(F.array_sort(F.collect_set("_v")).alias("_set"))

    n = running.groupBy(instance).agg(F.count("*").alias("n_running"))
    mine, busy = classes(pending), classes(running.where(heavy)).groupBy(instance, "_set").agg(F.count("*").alias("_jobs"))
    left = mine.select(F.col(instance).alias("_i"), F.col("_set").alias("_mine")).distinct().withColumn("_v", F.explode("_mine"))
    right = busy.select(F.col(instance).alias("_j"), F.col("_set").alias("_other"), "_jobs").withColumn("_w", F.explode("_other"))
    pairs = left.join(right, (F.col("_i") == F.col("_j")) & (F.col("_v") == F.col("_w"))).select("_i", "_mine", "_other", "_jobs").distinct()
    loads = pairs.groupBy("_i", "_mine").agg(F.sum("_jobs").alias("n_same_volume"))
    same = mine.join(loads, (F.col(instance) == F.col("_i")) & (F.col("_set") == F.col("_mine"))).groupBy("_key").agg(F.sum("n_same_volume").alias("n_same_volume"))
    x = pending.select(instance, key).join(n, instance, "left").join(same, F.col(key) == F.col("_key"), "left")
    return x.select(key, F.coalesce("n_running", F.lit(0)).alias("n_running"), F.coalesce("n_same_volume", F.lit(0)).alias("n_same_volume"))


def ghost_totals(indexes: DataFrame, acted_on: DataFrame, keys: list[str], group: list[str], ghosts: str, least: int) -> DataFrame:
    """Ghost records of each group over the members that no action was taken on, where they reach a total."""
    return indexes.join(acted_on.select(*keys), keys, "left_anti").groupBy(*group).agg(F.sum(ghosts).alias("ghosts")).where(F.col("ghosts") >= least)


def stale_partitions(statistics: DataFrame, keys: list[str], partition: str, age: Column, rows: Column, changes: Column, most_age: int, percent: float) -> DataFrame:
    """Incremental statistics by partition: (keys, partitions): the stale ones of each, in order; those without rows do not count."""
    x = statistics.where((rows > 0) & stale(age, rows, changes, most_age, percent))
    return x.groupBy(*keys).agg(F.array_join(F.transform(F.sort_array(F.collect_set(partition)), lambda p: p.cast("string")), ",").alias("partitions"), F.count("*").alias("n_stale"))


def replica_eligibility(members: DataFrame, rules: DataFrame, keys: list[str]) -> DataFrame:
    """members with run and reason of the decision table (role, preference, task); no row of it means run.

    rules: (role, preference, task, reason), a reason null to run. A member whose data is not synchronised is skipped.
    """
    x = members.join(rules, keys, "left")
    why = F.when(~F.col("synchronised"), "not synchronised").otherwise(F.col("reason"))
    return x.withColumn("reason", why).withColumn("run", F.col("reason").isNull())


def pack(queue: DataFrame, group: list[str], budget_minutes: float, parallel: int) -> DataFrame:
    """queue (group, item_id, production, last_check, runtime, size) with priority: a greedy fill of budget * parallel minutes.

    Items with a known runtime come by production, oldest check and longest runtime; one is taken if it fits what remains and
    the budget itself, and the walk goes on past those that do not. The others follow, by production and then longest.
    An item is skipped or taken by what was taken before, so a group is walked in order, in sorted batches that stream through;
    only the remaining minutes are kept.
    """
    known = queue.where("runtime is not null").repartition(*group).sortWithinPartitions(*group, F.col("production").desc(), F.col("last_check").asc_nulls_first(), F.col("runtime").desc(), "item_id")

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, left, n = None, 0.0, 0
        for b in batches:
            taken = []
            for key, runtime in zip(b[group].itertuples(index=False, name=None), b["runtime"], strict=True):
                if key != name:
                    name, left, n = key, budget_minutes * parallel, 0
                fits = left > 0 and runtime <= left and runtime <= budget_minutes
                n += fits
                left -= runtime if fits else 0
                taken.append(n if fits else None)
            yield b.assign(_taken=pd.array(taken, dtype="Int64"))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in queue.schema)
    done = known.mapInPandas(walk, f"{schema}, _taken long").unionByName(queue.where("runtime is null").withColumn("_taken", F.lit(None).cast("long")))
    w = Window.partitionBy(*group)
    behind = F.row_number().over(Window.partitionBy(*group, F.col("_taken").isNull()).orderBy(F.col("production").desc(), F.coalesce("runtime", "size").desc(), "item_id"))
    x = done.withColumn("_most", F.coalesce(F.max("_taken").over(w), F.lit(0))).withColumn("_behind", behind)
    return x.select(*queue.columns, F.col("_taken").isNotNull().alias("in_budget"), F.coalesce("_taken", F.col("_most") + F.col("_behind")).alias("priority"))


def address_profile(rows: DataFrame, group: list[str], address: str) -> DataFrame:
    """Valid and invalid IPv4 addresses by group: four parts of digits up to 255."""
    parts = F.split(F.col(address), r"\.")
    ok = (F.size(parts) == 4) & F.forall(parts, lambda p: p.rlike("^[0-9]{1,3}$") & (p.try_cast("int") <= 255))
    return rows.groupBy(*group).agg(F.count(F.when(ok, 1)).alias("valid"), F.count(F.when(~F.coalesce(ok, F.lit(False)), 1)).alias("invalid"))


def schema_audit(columns: DataFrame, uses: DataFrame, keys: list[str], kinds: list[str], functions: list[str]) -> DataFrame:
    """Objects whose columns are of listed types, or whose text calls listed functions, with the reason."""
    typed = columns.where(F.lower("type").isin(*kinds)).select(*keys, F.concat(F.lit("type "), F.lower("type")).alias("reason"))
    hit = F.filter(F.array(*map(F.lit, functions)), lambda f: F.lower(F.col("text")).contains(f))
    called = uses.select(*keys, F.explode(hit).alias("_f")).select(*keys, F.concat(F.lit("function "), "_f").alias("reason"))
    return typed.unionByName(called).distinct()


def missing_statistics(columns: DataFrame, statistics: DataFrame, keys: list[str], kinds: list[str]) -> DataFrame:
    """Columns of usable types that lead no statistics."""
    return columns.where(~F.col("type").isin(*kinds)).join(statistics.where("position = 1"), keys, "left_anti")


def project_order(packed: DataFrame, project: str, priority: str, path: str) -> DataFrame:
    """Projects in the order of their first item, over all of them, by ranges (see frames.ranked(), which writes to path)."""
    x = packed.groupBy(project).agg(F.min(priority).alias("first_priority"))
    return ranked(x, [F.col("first_priority").asc(), F.col(project).asc()], "project_order", path)


def archive_finished(queue: DataFrame, history: DataFrame, inactive: DataFrame, key: str, pending: tuple = (-1, 4)) -> tuple[DataFrame, DataFrame]:
    """(queue, history) after finished rows moved to the history and pending rows of inactive members were dropped."""
    done = ~F.col("status").isin(*pending)
    left = queue.where(~done).join(inactive.select(key), key, "left_anti").select(*queue.columns)
    return left, history.unionByName(queue.where(done).select(*history.columns))
