"""Operational metrics: window snapshots, trailing frames, smoothed latency, control ladder, quotas."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalith.functions import scalars as X

SHORT, LONG = 0.3, 0.05


def snapshot(requests: DataFrame, by: list[str], window_s: float = 30.0, cap_mbps: float = 0.0) -> DataFrame:
    """Per group: number, success and block rates, median and p95 latency (interpolated), bytes per second."""
    grouped = requests.groupBy(*by).agg(
        F.count("*").alias("total"),
        F.avg(F.col("success").cast("int")).alias("success_rate"),
        F.avg(F.col("blocked").cast("int")).alias("block_rate"),
        F.percentile("latency_s", 0.5).alias("latency_p50"),
        F.percentile("latency_s", 0.95).alias("latency_p95"),
        F.sum("resp_bytes").alias("bytes"),
        (F.max("ts").cast("double") - F.min("ts").cast("double")).alias("span"),
    )
    span = F.greatest(F.when(F.col("total") > 1, F.col("span")).otherwise(F.lit(window_s)), F.lit(1.0))
    speed = F.col("bytes") / span
    return grouped.withColumn("bandwidth_bps", speed).withColumn("bandwidth_pct", X.bandwidth_share(F.col("bandwidth_bps"), cap_mbps)).drop("bytes", "span")


EMPTY_SNAPSHOT = {"total": 0, "success_rate": 1.0, "block_rate": 0.0, "latency_p50": 0.0, "latency_p95": 0.0, "bandwidth_bps": 0.0, "bandwidth_pct": 0.0, "rtt_gradient": 1.0}


def filled(snapshots: DataFrame) -> DataFrame:
    """Missing figures as an empty window has them."""
    return snapshots.fillna({k: v for k, v in EMPTY_SNAPSHOT.items() if k in snapshots.columns})


def trailing(requests: DataFrame, key: str, at: str, seconds: float, **figures: Column) -> DataFrame:
    """Figures over the frame of the last ``seconds`` at each row; peers in time share a frame."""
    frame = Window.partitionBy(key).orderBy(F.unix_micros(F.col(at))).rangeBetween(-int(seconds * 1_000_000), 0)
    return requests.withColumns({name: c.over(frame) for name, c in figures.items()})


def _folded(rows: DataFrame, key: str, order: list[str], value: str, alphas: list[float]) -> DataFrame:
    """Per key an array ``e`` of exponentially smoothed values, one for each of ``alphas``.

    Rows are dealt by range over key and order, so a key of any size is spread over tasks, each of which folds its rows one
    by one. A part turns a value before it, v, into decay * v + added, or into ``alone`` where there is none (or the part
    holds a null, which starts anew). A key has one such row per task at most; these are combined in order.
    """
    places = [f"o{i}" for i in range(len(order))]
    slim = rows.select(F.col(key).alias("k"), *[F.col(c).alias(p) for c, p in zip(order, places, strict=True)], F.col(value).cast("double").alias("x"))
    dealt = slim.repartitionByRange("k", *places, "x").sortWithinPartitions("k", *places, "x").select("k", "x")
    kind = dealt.schema["k"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        m = range(len(alphas))
        now, started = None, False
        typed = None

        def of() -> pa.RecordBatch:
            columns = [pa.array([now], typed), pa.array([part], pa.int64())]
            return pa.RecordBatch.from_arrays([*columns, *[pa.array([v], pa.list_(pa.float64())) for v in (alone, decay, added)]], names=["k", "part", "alone", "decay", "added"])

        for batch in batches:
            typed = batch.column(0).type
            for k, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not started or k != now and not (k != k and now != now):
                    if started:
                        yield of()
                    now, started = k, True
                    alone, decay, added = [None] * len(alphas), [1.0] * len(alphas), [0.0] * len(alphas)
                for i in m:
                    a = alphas[i]
                    if x is None:
                        alone[i] = decay[i] = added[i] = None
                        continue
                    alone[i] = x if alone[i] is None else a * x + (1 - a) * alone[i]
                    if decay[i] is not None:
                        decay[i], added[i] = (1 - a) * decay[i], a * x + (1 - a) * added[i]
        if started:
            yield of()

    schema = T.StructType([T.StructField("k", kind), T.StructField("part", T.LongType()), *[T.StructField(n, T.ArrayType(T.DoubleType())) for n in ("alone", "decay", "added")]])
    parts = dealt.mapInArrow(run, schema)
    start = F.array(*[F.lit(None).cast("double") for _ in alphas])

    def step(acc: Column, p: Column) -> Column:
        after = lambda i: F.when(acc[i].isNull() | p["decay"][i].isNull(), p["alone"][i]).otherwise(p["decay"][i] * acc[i] + p["added"][i])
        return F.array(*[after(i) for i in range(len(alphas))])

    ordered = F.array_sort(F.collect_list(F.struct("part", "alone", "decay", "added")))
    return parts.groupBy(F.col("k").alias(key)).agg(F.aggregate(ordered, start, step).alias("e"))


def ewma(rows: DataFrame, key: str, order: list[str], value: str, alpha: float, name: str) -> DataFrame:
    """Exponentially smoothed value per key, started by the first value; folds the key's ordered values."""
    return _folded(rows, key, order, value, [alpha]).select(key, F.col("e")[0].alias(name))


def dual_ewma(requests: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Short and long smoothed latency of successful requests and their gradient long / short (1 without data)."""
    ok = requests.where(F.col("success") & (F.col("latency_s") > 0))
    smooth = _folded(ok, key, order, "latency_s", [SHORT, LONG])
    short, long = F.col("e")[0], F.col("e")[1]
    return smooth.select(key, short.alias("ewma_short"), long.alias("ewma_long"), F.when(short > 0, long / short).otherwise(F.lit(1.0)).alias("rtt_gradient"))


@dataclass(frozen=True)
class Control:
    """Limits of the concurrency ladder (fixed values: the model's defaults)."""

    initial: int = 16
    least: int = 16
    most: int = 32
    target_latency: float = 5.0
    max_latency: float = 8.0
    target_success: float = 0.95
    min_success: float = 0.85
    max_block: float = 0.05
    decrease: float = 0.7
    cooldown_s: int = 30
    soft_cap: float = 0.8


def decide(snapshots: DataFrame, current: Column, cooling: Column, c: Control = Control()) -> DataFrame:
    """Next concurrency and the rule that set it, the first that holds; fewer than five samples decide nothing."""
    col = F.col
    cut = F.greatest(F.lit(c.least), F.floor(current * c.decrease).cast("int"))
    rules = [
        ("few_samples", col("total") < 5, current),
        ("cooldown", cooling, current),
        ("blocked", col("block_rate") > c.max_block, cut),
        ("low_success", col("success_rate") < c.min_success, cut),
        ("slow", col("latency_p50") > c.max_latency, cut),
        ("rising", (col("rtt_gradient") < 0.85) & (col("ewma_short") > 0) & (col("bandwidth_pct") > 0.5), F.greatest(F.lit(c.initial), current - 1)),
        ("saturated", col("bandwidth_pct") > c.soft_cap, current),
        ("grow", (col("success_rate") >= c.target_success) & (col("latency_p50") < c.target_latency) & (col("rtt_gradient") >= 0.9), F.least(F.lit(c.most), current + 2)),
    ]
    rule, value = F.lit("steady"), current
    for name, holds, new in reversed(rules):
        rule, value = F.when(holds, name).otherwise(rule), F.when(holds, new).otherwise(value)
    soft = max(15, c.cooldown_s // 2)
    wait = F.when(rule == "blocked", c.cooldown_s).when(rule.isin("low_success", "slow"), soft).otherwise(0)
    return snapshots.withColumns({"rule": rule, "concurrency": value.cast("int"), "cooldown_s": wait})


def quotas(workers: DataFrame, max_concurrency: int = 1000, max_qps: float = 1000.0, least: int = 16, worker_concurrency: int = 32, worker_qps: float = 64.0) -> DataFrame:
    """Share of the global limits by health, max(0.1, success * (1 - 5 * block)), between a floor and the worker's cap.

    The total is a one-row aggregate joined back, so no window collects all workers in one task.
    """
    score = F.greatest(F.lit(0.1), F.coalesce("success_rate", F.lit(1.0)) * (1 - 5 * F.coalesce("block_rate", F.lit(0.0))))
    scored = workers.withColumn("score", score)
    total = scored.agg(F.sum("score").alias("__total"))
    weight = F.col("score") / F.col("__total")
    return scored.join(F.broadcast(total)).withColumns({
        "weight": weight,
        "quota_concurrency": F.least(F.lit(worker_concurrency), F.greatest(F.lit(least), F.floor(max_concurrency * weight).cast("int"))),
        "quota_qps": F.least(F.lit(worker_qps), F.greatest(F.lit(1.0), max_qps * weight)),
    }).drop("__total")


def token_bucket(arrivals: DataFrame, key: str, at: str, rate: float, burst: int = 1) -> DataFrame:
    """Start time of each ordered arrival at a bucket that is empty when the first one comes.

    The bucket is full again at max over k of (t_k + (n - k + 1) / rate) after n arrivals, or where the first fill puts
    it; arrival n starts burst - 1 tokens ahead of that. So starts follow from a running maximum, without a fold.
    """
    order = Window.partitionBy(key).orderBy(at)
    n, t = F.row_number().over(order), F.col(at).cast("double")
    numbered = arrivals.withColumns({"__n": n, "__first": F.first(t).over(order)})
    before = F.max(t - F.col("__n") / rate).over(order.rowsBetween(Window.unboundedPreceding, -1)) + F.col("__n") / rate
    full = F.greatest(F.col("__first") + (burst + F.col("__n") - 1) / rate, before)
    return numbered.withColumn("start", F.greatest(t, full - (burst - 1) / rate)).drop("__n", "__first")


def due_schedules(schedules: DataFrame, now: Column) -> DataFrame:
    """Enabled schedules whose time of day has come and whose interval has passed."""
    parts = F.split("time", ":")
    hour, minute = F.try_element_at(parts, F.lit(1)).try_cast("int"), F.try_element_at(parts, F.lit(2)).try_cast("int")
    reached = X.valid_clock(F.col("time")) & (F.hour(now) * 60 + F.minute(now) >= hour * 60 + minute)
    rested = F.datediff(now, F.try_to_date(F.col("last_run_date"), "yyyy-MM-dd")) >= F.coalesce("interval_days", F.lit(1))
    return schedules.where(F.col("enabled") & reached & F.coalesce(rested, F.lit(True)))


def liveness(heartbeats: DataFrame, now: Column, online_s: float = 60, dead_s: float = 120) -> DataFrame:
    """Latest heartbeat per worker: seconds since, online and dead flags, uptime."""
    per = heartbeats.groupBy("worker_id").agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
    ago = now.cast("double") - F.col("last_seen").cast("double")
    return per.withColumns({"last_seen_ago": ago, "online": ago < online_s, "dead": ago > dead_s, "uptime": X.duration(F.col("last_seen").cast("double") - F.col("first_seen").cast("double"))})


def registry(workers: DataFrame, coordinator: DataFrame) -> DataFrame:
    """Registered workers with what the coordinator knows of them: metrics and quota are empty where it knows nothing, the
    counts of accepted and stale results are then 0."""
    counts = [c for c in ("accepted", "stale") if c in coordinator.columns]
    return workers.join(coordinator, "worker_id", "left").fillna(0, counts)


def latest_settings(settings: DataFrame, key: str) -> DataFrame:
    """The highest version of each key's settings; older ones that arrive late change nothing."""
    rest = [c for c in settings.columns if c not in (key, "version")]
    return settings.groupBy(key).agg(F.max("version").alias("version"), *[F.max_by(F.col(c), F.col("version")).alias(c) for c in rest])


def speeds(samples: DataFrame, key: str, at: str, done: str) -> DataFrame:
    """Items per minute between successive samples of a counter; samples under a second apart are left out."""
    order = Window.partitionBy(key).orderBy(at)
    apart = F.col(at).cast("double") - F.lag(F.col(at).cast("double")).over(order)
    kept = samples.withColumn("__apart", apart).where(F.col("__apart").isNull() | (F.col("__apart") >= 1))
    gap = F.col(at).cast("double") - F.lag(F.col(at).cast("double")).over(order)
    return kept.withColumn("speed", (F.col(done) - F.lag(done).over(order)) / gap * 60).drop("__apart")


def smoothed_speed(samples: DataFrame, key: str, at: str, done: str, alpha: float = SHORT) -> DataFrame:
    """Exponentially smoothed items per minute of each counter, from its successive samples."""
    rated = speeds(samples, key, at, done).where(F.col("speed").isNotNull())
    return ewma(rated, key, [at], "speed", alpha, "speed")


def coordinator_totals(quota_rows: DataFrame) -> DataFrame:
    """Sums of the quotas given out and the number of workers."""
    return quota_rows.agg(F.sum("quota_concurrency").alias("concurrency"), F.sum("quota_qps").alias("qps"), F.count("*").alias("workers"))


def fleet_totals(workers: DataFrame) -> DataFrame:
    """Requests in flight over the online workers, and how many these are."""
    return workers.agg(F.coalesce(F.sum(F.when(F.col("online"), F.col("inflight"))), F.lit(0)).alias("inflight"), F.count_if("online").alias("online"))


def duplicate_work(local: DataFrame, served: DataFrame) -> DataFrame:
    """Per worker: successes it counted beyond the results that were accepted."""
    here = local.groupBy("worker_id").agg(F.count_if("success").alias("succeeded"))
    there = served.groupBy("worker_id").agg(F.count_if(F.col("counter") == "accepted").alias("accepted"), F.count_if(F.col("counter") == "stale").alias("stale"))
    joined = here.join(there, "worker_id", "left").fillna(0, ["accepted", "stale"])
    return joined.withColumn("duplicates", F.col("succeeded") - F.col("accepted"))
