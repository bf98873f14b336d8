"""Catalog views: members with their machine, project and solution, and decoded codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.functions import texts
from fleetlens.sources.tables import shred


def projects(project: DataFrame, solution: DataFrame) -> DataFrame:
    s = solution.select(F.col("id").alias("solution_id"), F.col("name").alias("solution_name"))
    return project.join(s, "solution_id", "left")


def full_name(machine: Column, domain: Column) -> Column:
    return F.when(domain.isNotNull(), F.concat(machine, F.lit("."), domain)).otherwise(machine)


def instances(project: DataFrame, machine: DataFrame, instance: DataFrame) -> DataFrame:
    """Instances with project, machine and, if clustered, the machine of the node they run on."""
    m = machine.select(F.col("id").alias("machine_id"), "project_id", F.col("name").alias("machine_name"), "domain")
    node = machine.select(F.col("id").alias("cluster_node_machine_id"), "project_id", F.col("name").alias("cluster_node_machine_name"))
    p = project.select(F.col("id").alias("project_id"), F.col("code").alias("project_code"))
    x = instance.join(p, "project_id").join(m, ["machine_id", "project_id"]).join(node, ["cluster_node_machine_id", "project_id"], "left")
    return x.withColumn("host_name", full_name(F.col("machine_name"), F.col("domain")))


def databases(project: DataFrame, instance: DataFrame, database: DataFrame) -> DataFrame:
    p = project.select(F.col("id").alias("project_id"), F.col("code").alias("project_code"))
    i = instance.select(F.col("id").alias("instance_id"), "project_id", F.col("name").alias("instance_name"), F.col("active").alias("instance_active"))
    return database.join(i, ["instance_id", "project_id"]).join(p, "project_id")


def of_instance(facts: DataFrame, instance: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """Fact rows (disks, logs, job runs, errors) with their instance's name and state; extra keys join too."""
    keys = ["instance_id", "project_id", *(extra or [])]
    i = instance.select(F.col("id").alias("instance_id"), "project_id", F.col("name").alias("instance_name"), F.col("active").alias("instance_active"), *(extra or []))
    return facts.join(i, keys)


def of_database(facts: DataFrame, instance: DataFrame, database: DataFrame) -> DataFrame:
    """Fact rows (details, usage) of a catalogued database with its and its instance's name, and the total of data and log size."""
    i = instance.select(F.col("id").alias("instance_id"), "project_id", F.col("name").alias("instance_name"))
    b = database.select(F.col("id").alias("catalog_database_id"), "instance_id", "project_id", F.col("name").alias("database_name"), F.col("active").alias("database_active"))
    x = facts.join(b, ["catalog_database_id", "instance_id"]).join(i, ["instance_id", "project_id"])
    return x.withColumn("size_mb", F.col("data_size_mb") + F.col("log_size_mb"))


def os_events(facts: DataFrame, instance: DataFrame) -> DataFrame:
    """Events of operating systems, by instance, project and machine, with their log and level as text (null for others)."""
    x = of_instance(facts, instance, ["machine_id"])
    return x.withColumns({"log_type_desc": texts.decode("log_type_id", texts.OS_LOG, None), "level_desc": texts.decode("level_id", texts.OS_LEVEL, None)})


def task_schedule(schedule: DataFrame, task: DataFrame, project: DataFrame) -> DataFrame:
    """Scheduled weekdays with their task, and the project if it is not the default row."""
    t = task.select(F.col("id").alias("task_id"), F.col("descriptor").alias("job_descriptor"), "task_name")
    p = project.select(F.col("id").alias("project_id"), F.col("code").alias("project_code"))
    return schedule.join(t, "task_id").join(p, "project_id", "left")


def object_skip_list(skip: DataFrame, task: DataFrame) -> DataFrame:
    """Objects that a task leaves out, with the task's name and flags."""
    t = task.select(F.col("id").alias("task_id"), F.col("descriptor").alias("job_descriptor"), "task_name", "flg_actions")
    return skip.join(t, "task_id")


def job_queue(queue: DataFrame, instance: DataFrame) -> DataFrame:
    """Queue rows with the name of the instance they run for (null for an unknown one) and the status as text."""
    i = instance.select(F.col("id").alias("for_instance_id"), F.col("name").alias("for_instance_name"))
    return queue.join(i, "for_instance_id", "left").withColumn("status_desc", texts.decode("status", texts.QUEUE_STATUS))


def job_history(history: DataFrame, queue: DataFrame) -> DataFrame:
    return history.unionByName(queue, allowMissingColumns=True)


def job_statistics(history: DataFrame, live: DataFrame, keys: list[str], start: str, seconds: str) -> DataFrame:
    """Minutes of each run: in parallel (first start to last end) and one by one (sum), recorded and live."""
    begun = F.unix_seconds(F.col(start).cast("timestamp"))
    x = live.groupBy(*keys).agg(F.round((F.max(begun + F.col(seconds)) - F.min(begun)) / 60.0, 2).alias("duration_minutes_parallel"), F.round(F.sum(seconds) / 60.0, 2).alias("duration_minutes_serial"))
    return history.unionByName(x.select(*history.columns))


def job_schedules(schedules: DataFrame) -> DataFrame:
    """Frequency, days, clock and next run as text and time (freq_type, freq_interval, start_time, next_run_date, next_run_time)."""
    from fleetlens.functions.times import packed_timestamp

    clock = F.lpad(F.col("start_time").cast("string"), 6, "0")
    return schedules.withColumns({
        "frequency": texts.decode("freq_type", texts.FREQUENCY),
        "days": F.when(F.col("freq_type") == 8, texts.weekdays("freq_interval")).otherwise(""),
        "start_clock": F.concat(F.substring(clock, 1, 2), F.lit(":"), F.substring(clock, 3, 2), F.lit(":"), F.substring(clock, 5, 2)),
        "next_run": packed_timestamp("next_run_date", "next_run_time"),
    })


def either_key(left: DataFrame, right: DataFrame, by_id: tuple[str, str], by_name: tuple[str, str]) -> DataFrame:
    """Rows that match by id or by name: two equal joins put together, each pair once."""
    a = left.join(right, left[by_id[0]] == right[by_id[1]])
    b = left.join(right, (left[by_name[0]] == right[by_name[1]]) & ~left[by_id[0]].eqNullSafe(right[by_id[1]]))
    return a.unionByName(b)


def events(log: DataFrame, instance: DataFrame, payload: str | None = None, schema: str | None = None) -> DataFrame:
    """Logged events with their instance (null for an unknown one) and type as text, and the fields of an XML payload."""
    i = instance.select(F.col("id").alias("instance_id"), "project_id", F.col("name").alias("instance_name"))
    x = log.join(i, ["instance_id", "project_id"], "left").withColumn("event_type_desc", texts.decode("event_type", texts.EVENT_TYPE))
    return shred(x, payload, schema) if payload else x


def database_details(details: DataFrame) -> DataFrame:
    return details.withColumns({
        "size_mb": F.coalesce("data_size_mb", F.lit(0)) + F.coalesce("log_size_mb", F.lit(0)),
        "recovery_model_desc": texts.decode("recovery_model", texts.RECOVERY_MODEL),
        "page_verify_option_desc": texts.decode("page_verify_option", texts.PAGE_VERIFY),
    })


def replica_details(replicas: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """Replicas whose state is INSTANCE OFFLINE where their instance is not active."""
    x = replicas.join(members.select(key, "instance_active"), key)
    return x.withColumn("synchronization_state_desc", F.when(F.col("instance_active"), F.col("synchronization_state_desc")).otherwise("INSTANCE OFFLINE"))


def owner_or_default(members: DataFrame, owners: DataFrame, keys: list[str], owner: str, default: str) -> DataFrame:
    return members.join(owners, keys, "left").withColumn(owner, F.coalesce(owner, F.lit(default)))


def node_list(members: DataFrame, keys: list[str], node: str, separator: str = ",") -> DataFrame:
    return members.groupBy(*keys).agg(F.array_join(F.sort_array(F.collect_set(node)), separator).alias("nodes"))


def state_class(state: Column, read_only: Column, standby: Column) -> Column:
    return F.when(standby, F.concat(state, F.lit(", STANDBY"))).when(read_only, F.concat(state, F.lit(", READ ONLY"))).otherwise(state)


def leftovers_first(items: DataFrame, left: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """items with their rank, those left over from the last run before the others; by first key as planning group."""
    x = items.join(left.select(*keys, F.lit(True).alias("_left")).distinct(), keys, "left").withColumn("leftover", F.coalesce("_left", F.lit(False))).drop("_left")
    return x.withColumn("priority", F.row_number().over(Window.partitionBy(keys[0]).orderBy(F.col("leftover").desc(), *order)))
