"""The task log: leases, fencing by epoch, retries, and progress.

Task tables are never updated in place: every operation maps a task table (and requests) to a new one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalith.functions import scalars as X
from catalith.schemas import STATUSES

MAX_RETRIES = 3


# --- creation ------------------------------------------------------------------------------------------------------


def ordered_distinct(rows: DataFrame, key: str, position: str) -> DataFrame:
    """Keys in order of first appearance, with that position; a pre-aggregated minimum, no window."""
    return rows.groupBy(key).agg(F.min(position).alias(position))


def create_batch(batches: DataFrame, new: DataFrame) -> DataFrame:
    """Insert or ignore by name."""
    return batches.unionByName(new.join(batches, "name", "left_anti"), allowMissingColumns=True)


def new_tasks(tasks: DataFrame, wanted: DataFrame) -> DataFrame:
    """Wanted (batch_id, asin) that have no task yet, stripped and distinct."""
    keys = wanted.withColumn("asin", X.strip(F.col("asin"))).where("asin <> ''").dropDuplicates(["batch_id", "asin"])
    return keys.join(tasks, ["batch_id", "asin"], "left_anti")


def first_seen_flags(members: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Members with ``is_new``: whether the key was unknown when the batch was made."""
    there = known.select(key).distinct().withColumn("__known", F.lit(True))
    return members.join(there, key, "left").withColumn("is_new", F.col("__known").isNull()).drop("__known")


# --- leases --------------------------------------------------------------------------------------------------------


def dequeue(tasks: DataFrame, count: int, needs_screenshot: bool | None = None) -> DataFrame:
    """Pending tasks of the highest priority in order of id: a one-row maximum, then a top-k."""
    pending = tasks.where(F.col("status") == "pending")
    if needs_screenshot is not None:
        pending = pending.where(F.col("needs_screenshot") == needs_screenshot)
    top = pending.agg(F.coalesce(F.max("priority"), F.lit(0)).alias("__top"))
    return pending.join(F.broadcast(top), F.col("priority") == F.col("__top")).drop("__top").orderBy("id").limit(count)


def lease(tasks: DataFrame, taken: DataFrame, worker_id: str, now: Column) -> DataFrame:
    """Mark the taken tasks as being processed by the worker; the epoch stays."""
    ids = taken.select("id").withColumn("__taken", F.lit(True))
    got = F.coalesce(F.col("__taken"), F.lit(False))
    return tasks.join(ids, "id", "left").withColumns({
        "status": F.when(got, "processing").otherwise(F.col("status")),
        "worker_id": F.when(got, F.lit(worker_id)).otherwise(F.col("worker_id")),
        "updated_at": F.when(got, now).otherwise(F.col("updated_at")),
    }).drop("__taken")


def reclaim(tasks: DataFrame, dead_workers: list[str], cutoff: Column, now: Column) -> DataFrame:
    """Tasks of dead workers or past the hard timeout go back to pending; the epoch rises once."""
    expired = (F.col("status") == "processing") & (F.coalesce(F.col("worker_id").isin(dead_workers), F.lit(False)) | (F.col("updated_at") < cutoff))
    return _back_to_pending(tasks, expired, now)


def _back_to_pending(tasks: DataFrame, which: Column, now: Column, bump: bool = True) -> DataFrame:
    hit = F.coalesce(which, F.lit(False))
    return tasks.withColumns({
        "status": F.when(hit, "pending").otherwise(F.col("status")),
        "worker_id": F.when(hit, F.lit(None)).otherwise(F.col("worker_id")),
        "lease_epoch": F.when(hit, F.col("lease_epoch") + int(bump)).otherwise(F.col("lease_epoch")),
        "updated_at": F.when(hit, now).otherwise(F.col("updated_at")),
    })


def release(tasks: DataFrame, released: DataFrame, now: Column) -> DataFrame:
    """Fenced release: (id, worker_id, lease_epoch) must hold the lease."""
    keys = ["id", "worker_id", "lease_epoch"]
    held = released.select(*[F.col(k).alias(f"r_{k}") for k in keys]).distinct()
    on = (F.col("id") == F.col("r_id")) & (F.col("worker_id") == F.col("r_worker_id")) & (F.col("lease_epoch") == F.col("r_lease_epoch"))
    return _back_to_pending(tasks.join(held, on, "left"), F.col("r_id").isNotNull() & (F.col("status") == "processing"), now).drop(*[f"r_{k}" for k in keys])


def release_by_id(tasks: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    """Release without a lease (column id): whatever holds a task that is being processed. ``now`` is a local time."""
    named = ids.select(F.col("id").alias("r_id")).distinct()
    return _back_to_pending(tasks.join(named, F.col("id") == F.col("r_id"), "left"), F.col("r_id").isNotNull() & (F.col("status") == "processing"), now).drop("r_id")


def prioritize(tasks: DataFrame, batch_id: int, priority: int = 10) -> DataFrame:
    hit = (F.col("batch_id") == batch_id) & (F.col("status") == "pending")
    return tasks.withColumn("priority", F.when(hit, priority).otherwise(F.col("priority")))


def retry_batch(tasks: DataFrame, batch_id: int, now: Column) -> DataFrame:
    """Failed tasks of a batch start anew; the epoch does not rise."""
    hit = (F.col("batch_id") == batch_id) & (F.col("status") == "failed")
    again = tasks.withColumn("retry_count", F.when(hit, 0).otherwise(F.col("retry_count")))
    return _back_to_pending(again, hit, now, bump=False)


# --- results -------------------------------------------------------------------------------------------------------


def fence(results: DataFrame, tasks: DataFrame) -> DataFrame:
    """Results with ``stale``: whether the lease they name is no longer held.

    Of several results for one lease only the first (by ``seq``) can be accepted; the rest come late.
    """
    held = tasks.where(F.col("status") == "processing").select(
        F.col("id").alias("task_id"), "worker_id", "lease_epoch", F.col("retry_count").alias("retries"), F.lit(True).alias("__held")
    )
    joined = results.join(held, ["task_id", "worker_id", "lease_epoch"], "left")
    first = F.row_number().over(Window.partitionBy("task_id", "worker_id", "lease_epoch").orderBy("seq")) == 1
    return joined.withColumn("stale", F.col("__held").isNull() | ~first).drop("__held")


def outcome(fenced: DataFrame, parse_failure: Column, max_retries: int = MAX_RETRIES) -> DataFrame:
    """What each result does: stale, done, rejected, failed (out of retries) or retry, and the counter it goes to."""
    effect = (
        F.when(F.col("stale"), "stale")
        .when(F.col("success") & parse_failure, "rejected")
        .when(F.col("success"), "done")
        .when(F.col("retries") + 1 >= max_retries, "failed")
        .otherwise("retry")
    )
    counter = F.when(F.col("effect") == "stale", "stale").when(F.col("effect") == "rejected", "failed").otherwise("accepted")
    return fenced.withColumn("effect", effect).withColumn("counter", counter)


def after_results(tasks: DataFrame, outcomes: DataFrame, now: Column) -> DataFrame:
    """Task table after the accepted results."""
    live = outcomes.where("effect <> 'stale'").select(F.col("task_id").alias("id"), "effect", F.col("error_type").alias("new_error"))
    hit = F.col("effect").isNotNull()
    retry = F.col("effect") == "retry"
    status = F.when(F.col("effect") == "done", "done").when(F.col("effect").isin("failed", "rejected"), "failed").when(retry, "pending")
    return tasks.join(live, "id", "left").withColumns({
        "status": F.coalesce(status, F.col("status")),
        "retry_count": F.col("retry_count") + F.when(F.col("effect").isin("retry", "failed"), 1).otherwise(0),
        "error_type": F.when(F.col("effect") == "rejected", "server_reject").when(F.col("effect").isin("retry", "failed"), F.col("new_error")).otherwise(F.col("error_type")),
        "worker_id": F.when(retry, F.lit(None)).otherwise(F.col("worker_id")),
        "lease_epoch": F.col("lease_epoch") + F.when(retry, 1).otherwise(0),
        "updated_at": F.when(hit, now).otherwise(F.col("updated_at")),
    }).drop("effect", "new_error")


# --- progress ------------------------------------------------------------------------------------------------------


def batch_counts(batches: DataFrame, tasks: DataFrame, key: str, status: Column, names: dict[str, str]) -> DataFrame:
    """Per batch: number of tasks and of each status; a batch without tasks counts zeros.

    Tasks are counted before the join, so the join meets one row per batch.
    """
    per_status = [F.count_if(status == code).alias(name) for name, code in names.items()]
    counts = tasks.groupBy(key).agg(F.count("*").alias("total"), *per_status)
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("total", *names)]
    return batches.join(counts, key, "left").select(key, *zero)


def progress(tasks: DataFrame, status: Column, codes: dict[str, str], by: list[str] | None = None) -> DataFrame:
    """Counts of the known statuses, completion and success rates in percent."""
    counts = [F.count_if(status == codes[s]).alias(s) if s in codes else F.lit(0).cast("long").alias(s) for s in STATUSES]
    grouped = tasks.groupBy(*(by or [])).agg(*[c for c in counts])
    total = sum((F.col(s) for s in STATUSES[1:]), F.col(STATUSES[0]))
    return grouped.withColumn("total", total).withColumns({
        "completion_rate": X.percent(F.col("done"), F.col("total")),
        "success_rate": X.percent(F.col("done"), F.col("done") + F.col("failed")),
    })


def screenshot_progress(shots: DataFrame, by: list[str]) -> DataFrame:
    """Counts of the known statuses per batch, and a total that takes in all others too."""
    return shots.groupBy(*by).agg(*[F.count_if(F.col("status") == s).alias(s) for s in STATUSES], F.count("*").alias("total"))


def diagnostics(entities: DataFrame, task_log: DataFrame, workers: DataFrame, settings_version: int) -> DataFrame:
    """One row: number of entities, task counts and rates, registered workers, version of the settings."""
    counted = progress(task_log, F.col("status"), {s: s for s in STATUSES})
    sizes = [df.agg(F.count("*").alias(name)) for name, df in (("total_asins", entities), ("active_workers", workers))]
    return counted.join(F.broadcast(sizes[0])).join(F.broadcast(sizes[1])).withColumn("settings_version", F.lit(settings_version))  # one row each


def error_histogram(tasks: DataFrame, kind: Column) -> DataFrame:
    return tasks.groupBy(kind.alias("error_type")).agg(F.count("*").alias("n"))


def complete(progress_rows: DataFrame) -> DataFrame:
    """Batches whose every task is done or failed."""
    return progress_rows.where((F.col("total") > 0) & (F.col("done") + F.col("failed") >= F.col("total")))


def preempt(queue: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items kept and items released when tasks arrive: if any of these has priority, only items with priority stay."""
    urgent = F.broadcast(incoming.agg(F.coalesce(F.bool_or(F.coalesce(F.col("priority") > 0, F.lit(False))), F.lit(False)).alias("__urgent")))  # one row
    marked = queue.join(urgent).withColumn("__keep", ~F.col("__urgent") | F.coalesce(F.col("priority") > 0, F.lit(False)))
    return tuple(marked.where(which).drop("__urgent", "__keep") for which in (F.col("__keep"), ~F.col("__keep")))


def local_order(queue: DataFrame) -> DataFrame:
    """First attempts before retries, then by arrival."""
    return queue.orderBy(F.when(F.col("retry_count") == 0, 0).otherwise(1), "seq")


# --- screenshots ---------------------------------------------------------------------------------------------------


def screenshot_update(shots: DataFrame, updates: DataFrame) -> DataFrame:
    """Latest update per (asin, batch_id) laid over the table; a failure counts as one more retry."""
    last = updates.groupBy("asin", "batch_id").agg(F.max_by(F.struct("status", "file_path", "error_detail"), "seq").alias("u"), F.count_if(F.col("status") == "failed").alias("f"))
    return shots.join(last, ["asin", "batch_id"], "left").withColumns({
        "status": F.coalesce("u.status", "status"),
        "file_path": F.coalesce("u.file_path", "file_path"),
        "error_detail": F.coalesce("u.error_detail", "error_detail"),
        "retry_count": F.col("retry_count") + F.coalesce("f", F.lit(0)),
    }).drop("u", "f")


def paths_after(entities: DataFrame, updates: DataFrame) -> DataFrame:
    """A finished screenshot's path goes to its entity; other updates leave it."""
    done = updates.where((F.col("status") == "done") & X.normal_path(F.col("file_path")).isNotNull())
    last = done.groupBy("asin").agg(F.max_by("file_path", "seq").alias("__path"))
    return entities.join(last, "asin", "left").withColumn("screenshot_path", F.coalesce("__path", "screenshot_path")).drop("__path")


def pending_screenshots(shots: DataFrame, count: int) -> DataFrame:
    return shots.where("status = 'pending'").orderBy("id").limit(count)


# --- schedules -----------------------------------------------------------------------------------------------------


def run_due(due: DataFrame, members: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """New automatic batches of due schedules, and their wanted tasks (schedule_id, asin in ``members``; a schedule
    without members of its own takes the whole catalog, under a NULL schedule_id)."""
    batches = due.select(F.col("id").alias("schedule_id"), X.batch_name(now, F.col("name")).alias("name"), F.lit(True).alias("is_auto"), "needs_screenshot", now.alias("created_at"))
    own = members.where(F.col("schedule_id").isNotNull())
    listed = batches.join(own, "schedule_id").select("name", "asin")
    whole = batches.join(own.select("schedule_id").distinct(), "schedule_id", "left_anti").select("name")
    catalog = members.where(F.col("schedule_id").isNull()).select("asin")
    return batches, listed.unionByName(catalog.crossJoin(whole))  # every schedule without members takes the whole catalog


def after_run(schedules: DataFrame, due: DataFrame, now: Column) -> DataFrame:
    ran = due.select("id", F.lit(True).alias("__ran"))
    return schedules.join(ran, "id", "left").withColumn("last_run_date", F.when(F.col("__ran"), F.date_format(now, "yyyy-MM-dd")).otherwise(F.col("last_run_date"))).drop("__ran")


def updated_settings(settings: dict, changes: dict, known: set[str]) -> dict:
    """Known keys laid over the settings under the next version."""
    return settings | {k: v for k, v in changes.items() if k in known} | {"version": settings.get("version", 0) + 1}


def reset_settings(settings: dict, defaults: dict) -> dict:
    """The defaults under the next version."""
    return defaults | {"version": settings.get("version", 0) + 1}
