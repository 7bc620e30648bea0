"""Streaming forms: sliding metrics, baseline changes with state per entity, fencing of late results, latest settings.

Each function maps a streaming DataFrame to one, or starts from one a query that drains what is there
(``availableNow``); a long-running job uses the same plans with another trigger. State lives in Spark's state store and
checkpoints in a shared folder, so a lost executor repeats a micro-batch at most.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from catalith.sources.layout import shared_folder

WINDOW, SLIDE, LATENESS = "30 seconds", "3 seconds", "1 minute"


def sliding_metrics(requests: DataFrame, by: list[str], window: str = WINDOW, slide: str = SLIDE, lateness: str = LATENESS) -> DataFrame:
    """Number, success rate and bytes per sliding window; requests later than ``lateness`` are dropped."""
    marked = requests.withWatermark("ts", lateness)
    return marked.groupBy(F.window("ts", window, slide), *by).agg(F.count("*").alias("total"), F.avg(F.col("success").cast("int")).alias("success_rate"), F.sum("resp_bytes").alias("bytes"))


#: Size of a quantile sketch: exact up to about so many values, beyond with a rank error of about 0.06 %.
SKETCH_K = 4096
QUANTILES = {"latency_p50": "0.5", "latency_p95": "0.95"}


def slide_figures(requests: DataFrame, by: list[str], slide: str = SLIDE, lateness: str = LATENESS) -> DataFrame:
    """Per slide: number, successes, bytes, and a mergeable sketch of latencies. Every request is counted in one slide, and
    what is kept of a slide does not grow with its requests."""
    marked = requests.withWatermark("ts", lateness) if requests.isStreaming else requests
    return marked.groupBy(F.window("ts", slide).alias("slide"), *by).agg(
        F.count("*").alias("total"), F.count("success").alias("judged"), F.count_if("success").alias("successes"), F.sum("resp_bytes").alias("bytes"), F.kll_sketch_agg_double("latency_s", SKETCH_K).alias("sketch")
    )


def window_figures(slides: DataFrame, by: list[str], window: str = WINDOW, slide: str = SLIDE) -> DataFrame:
    """The slides merged to sliding windows: number, success rate, bytes, median and p95 of latency. A further step of the same
    stream (windows come when the watermark closes them), or over stored slides."""
    quantiles = [_quantile(float(q)).alias(name) for name, q in QUANTILES.items()]
    return _merged(slides, by, window, slide).select("window", *by, "total", "success_rate", "bytes", *quantiles)


def _quantile(q: float) -> Column:
    """Of a sketch; NULL of an empty one."""
    return F.when(F.kll_sketch_get_n_double("sketch") > 0, F.kll_sketch_get_quantile_double("sketch", F.lit(q)))


def _merged(slides: DataFrame, by: list[str], window: str, slide: str) -> DataFrame:
    at = F.window_time("slide") if slides.isStreaming else F.col("slide.start")
    merged = slides.groupBy(F.window(at, window, slide), *by).agg(
        F.sum("total").alias("total"), F.sum("judged").alias("judged"), F.sum("successes").alias("successes"), F.sum("bytes").alias("bytes"), F.kll_merge_agg_double("sketch").alias("sketch")
    )
    return merged.withColumn("success_rate", F.col("successes") / F.nullif(F.col("judged"), F.lit(0)))


#: How far, as a share of the requests, the bounds of a quantile lie from it: several times a sketch's error.
BRACKET = 0.005


def stored_slides(requests: DataFrame, by: list[str], slide: str = SLIDE) -> tuple[DataFrame, DataFrame]:
    """Drain a stream of requests into slides, as ``slide_figures`` has them, and how often each latency occurs in a slide. A
    micro-batch stores its own under its number, so nothing is kept between them; a slide of many micro-batches has many rows."""
    spark, at = requests.sparkSession, shared_folder(requests.sparkSession)

    def put(df: DataFrame, n: int) -> None:
        slide_figures(df, by, slide).write.mode("overwrite").parquet(f"{at}/slides/batch={n}")
        values = df.where("latency_s IS NOT NULL").groupBy(F.window("ts", slide).alias("slide"), *by, "latency_s").agg(F.count("*").alias("n"))
        values.write.mode("overwrite").parquet(f"{at}/values/batch={n}")

    drained(requests, into=put)
    return spark.read.parquet(f"{at}/slides").drop("batch"), spark.read.parquet(f"{at}/values").drop("batch")


def exact_figures(slides: DataFrame, values: DataFrame, by: list[str], window: str = WINDOW, slide: str = SLIDE) -> DataFrame:
    """``window_figures`` with exact percentiles. The merged sketches put bounds about each; counts of the values below, between
    and above them say where it lies for certain, and only the values there are put in order."""
    group = ["window", *by]
    merged = _merged(slides, by, window, slide)
    bounds = merged.select(*group, F.inline(F.array(*[F.struct(F.lit(name).alias("name"), F.lit(Decimal(q)).cast("decimal(4,2)").alias("q"), _quantile(max(float(q) - BRACKET, 0.0)).alias("lo"), _quantile(min(float(q) + BRACKET, 1.0)).alias("hi")) for name, q in QUANTILES.items()])))
    counted = values.groupBy(F.window("slide.start", window, slide), *by, "latency_s").agg(F.sum("n").alias("n"))
    n, v = F.col("n"), F.col("latency_s")
    place = F.when(v < F.col("lo"), 0).when(v <= F.col("hi"), 1).otherwise(2)
    sums = _beside(counted, bounds, group, "inner").groupBy(*group, "name").agg(F.first("q").alias("q"), F.first("lo").alias("lo"), F.first("hi").alias("hi"), *[F.sum(F.when(place == k, n).otherwise(0)).alias(f"n{k}") for k in (0, 1, 2)])
    rank = F.greatest(F.lit(1), F.ceil(F.col("q") * (F.col("n0") + F.col("n1") + F.col("n2"))))
    ranked = sums.withColumn("rank", rank)
    at = F.when(F.col("rank") <= F.col("n0"), 0).when(F.col("rank") <= F.col("n0") + F.col("n1"), 1).otherwise(2)
    before = F.when(at == 0, 0).when(at == 1, F.col("n0")).otherwise(F.col("n0") + F.col("n1"))
    wanted = ranked.select(*group, "name", "lo", "hi", at.alias("at"), (F.col("rank") - before).alias("rank"))
    inside = _beside(counted, wanted, group, "inner").where(place == F.col("at"))
    so_far = inside.withColumn("so_far", F.sum("n").over(Window.partitionBy(*group, "name").orderBy("latency_s")))
    found = so_far.where(F.col("so_far") >= F.col("rank")).groupBy(*group).agg(*[F.min(F.when(F.col("name") == name, v)).alias(name) for name in QUANTILES])
    return _beside(merged, found, group, "left").select("window", *by, "total", "success_rate", "bytes", *QUANTILES)


def _beside(df: DataFrame, other: DataFrame, keys: list[str], how: str) -> DataFrame:
    """A join in which a missing key is a key."""
    named = other.withColumnsRenamed({k: f"_{k}" for k in keys})
    return df.join(named, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], how).drop(*[f"_{k}" for k in keys])


def duplicated(local: DataFrame, served: DataFrame, within: str = "10 minutes", lateness: str = LATENESS) -> DataFrame:
    """Successes that a worker counted and no accepted result followed within ``within``: a stream-stream outer join.

    Needs (worker_id, result_id, ts, success) and (worker_id, result_id, ts, counter); state is dropped as the watermarks pass.
    """
    ours = local.where("success").select("worker_id", "result_id", "ts").withWatermark("ts", lateness)
    theirs = served.where("counter = 'accepted'").select(F.col("worker_id").alias("s_worker"), F.col("result_id").alias("s_result"), F.col("ts").alias("s_ts")).withWatermark("s_ts", lateness)
    on = (F.col("worker_id") == F.col("s_worker")) & (F.col("result_id") == F.col("s_result")) & (F.col("s_ts") >= F.col("ts")) & (F.col("s_ts") <= F.col("ts") + F.expr(f"INTERVAL {within}"))
    return ours.join(theirs, on, "leftOuter").where("s_result IS NULL").select("worker_id", "result_id", "ts")


def accepted_once(results: DataFrame, lease: list[str]) -> DataFrame:
    """The first result of each lease; repeats are stale and dropped, however late. The state keeps every lease."""
    return results.dropDuplicates(lease)


def price_changes(observations: DataFrame) -> DataFrame:
    """Changes of numeric price and stock against the baseline that the last scheduled sighting set.

    Needs asin, seq (long), is_auto, price, stock. Sightings count in order of seq within a micro-batch and of arrival across
    them. The state of a key is its baseline alone, so it does not grow with the log. A key's rows of one micro-batch come in
    no order and are sorted in memory: bound the micro-batches, as ``file_stream`` does by files.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values("seq")
        price, stock = state.get if state.exists else (None, None)
        known = state.exists
        out = []
        number = lambda v: None if v is None or pd.isna(v) else float(v)
        for seq, auto, new_price, new_stock in zip(rows.seq, rows.is_auto, map(number, rows.price), map(number, rows.stock), strict=True):
            if known and price is not None:
                parts = [f"{n}:{'up' if b > a else 'down'}" for n, a, b in (("price", price, new_price), ("stock_qty", stock, new_stock)) if a is not None and b is not None and a != b]
                if parts:
                    out.append((key[0], int(seq), ", ".join(parts)))
                    if len(out) == 10_000:
                        yield pd.DataFrame(out, columns=["asin", "seq", "change_detail"])
                        out = []
            if not known or auto:
                price, stock, known = new_price, new_stock, True
        state.update((price, stock))
        yield pd.DataFrame(out, columns=["asin", "seq", "change_detail"])

    schema = "asin long, seq long, change_detail string"
    return observations.groupBy("asin").applyInPandasWithState(run, schema, "price double, stock double", "append", GroupStateTimeout.NoTimeout)


def silent_workers(heartbeats: DataFrame, timeout: str = "120 seconds", lateness: str = LATENESS) -> DataFrame:
    """Sessions of heartbeats; a closed session names a worker that went silent, and when."""
    sessions = heartbeats.withWatermark("ts", lateness).groupBy("worker_id", F.session_window("ts", timeout).alias("s")).agg(F.count("*").alias("beats"), F.max("ts").alias("last_seen"))
    return sessions.select("worker_id", "beats", "last_seen", F.col("s.end").alias("dead_at"))


def latest(settings: DataFrame, key: str) -> DataFrame:
    """The highest version of each key's settings, kept in the state store; emits each key that a micro-batch changes."""
    rest = [c for c in settings.columns if c not in (key, "version")]
    return settings.groupBy(key).agg(F.max("version").alias("version"), *[F.max_by(c, "version").alias(c) for c in rest])


def drained(stream: DataFrame, mode: str = "append", into: Callable[[DataFrame, int], None] | None = None) -> str:
    """Run a stream over all that is there; returns the folder that holds its rows as Parquet (append: all; update: those of
    each micro-batch under its number; complete: the last micro-batch's)."""
    spark = stream.sparkSession
    at = shared_folder(spark)

    def write(df: DataFrame, n: int) -> None:
        df.write.mode("overwrite").parquet(f"{at}/rows/batch={n}" if mode == "update" else f"{at}/rows")

    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True)
    if into is None and mode == "append":
        query = writer.format("parquet").start(f"{at}/rows")
    else:
        query = writer.foreachBatch(into or write).start()
    query.awaitTermination()
    return f"{at}/rows"


def file_stream(spark: SparkSession, sf_dir: str, name: str, files: int = 1) -> DataFrame:
    """A table's Parquet file (or folder) as a stream."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{sf_dir}/{name}.parquet*")


def whole_second(c: Column) -> Column:
    """A time to the nearest second, halves to the even one."""
    return F.timestamp_seconds(F.rint(seconds(c)).cast("long"))


def seconds(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp")) / 1e6
