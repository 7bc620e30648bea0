"""Pages from a range layout, percentiles from sketches and the duplicate-work join against plain versions."""

import random
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from catalith.operators import metrics, paging, results
from catalith.streaming import jobs
from catalith.streaming import queries as streaming

from .test_queries import written_in_turn

ROWS = [(i * 3, f"t{i % 7}") for i in range(400)] + [(i * 3, "again") for i in range(90, 130)]


@pytest.fixture(scope="module")
def layout(spark, tmp_path_factory):
    df = spark.createDataFrame([*ROWS, (None, "nowhere")], "id long, title string").repartition(5)
    return paging.build(df, str(tmp_path_factory.mktemp("layout")), file_rows=40)


@pytest.mark.parametrize("cursor", [None, 0, 1, 300, 388, 1197, 5000])
@pytest.mark.parametrize("direction", ["next", "prev"])
@pytest.mark.parametrize("size", [1, 20, 500])
def test_pages_of_few_files(layout, cursor, direction, size):
    got = [r.id for r in layout.page(cursor, size, direction).collect()]
    ids = sorted((i for i, _ in ROWS if cursor is None or (i < cursor if direction == "next" else i > cursor)), reverse=direction == "next")
    assert got == ids[: min(size, results.MAX_PAGE) + 1]


def test_files_read_are_bounded_at_any_depth(spark, layout):
    assert layout.total() == len(ROWS) and layout.bounds.count() >= 8
    for cursor in range(100, 1200, 180):
        assert len(layout.page(cursor, 20).inputFiles()) <= 3  # of files of about 40 rows: the cursor's and those of 21 rows
        assert len(layout.page(cursor, 20, "prev").inputFiles()) <= 3


def test_pages_with_a_condition_go_on(layout):
    hit = F.col("title") == "t3"
    want = sorted((i for i, t in ROWS if t == "t3" and i < 900), reverse=True)
    assert [r.id for r in layout.page(900, 30, condition=hit).collect()] == want[:31]
    assert layout.page(900, 30, condition=F.lit(False)).count() == 0


def test_an_empty_layout(spark, tmp_path):
    made = paging.build(spark.createDataFrame([], "id long, title string"), str(tmp_path / "layout"))
    assert made.total() == 0 and made.page(5).count() == 0


# --- sketches ------------------------------------------------------------------------------------------------------

REQUESTS = "worker_id string, ts timestamp, success boolean, resp_bytes long, latency_s double"


def requests(rng, n):
    return [(rng.choice("ab"), 1_700_000_000.0 + i * 0.05, rng.random() < 0.9, rng.randrange(100), rng.lognormvariate(0, 1)) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "worker_id string, at double, success boolean, resp_bytes long, latency_s double").select("worker_id", F.timestamp_seconds("at").alias("ts"), "success", "resp_bytes", "latency_s")


def test_merged_sketches_keep_their_error_bound(spark):
    """Latencies of 20,000 requests in windows of about 300 (exact), and in one window (within the stated rank error)."""
    df = frame(spark, requests(random.Random(5), 20_000))
    exact = df.groupBy(F.window("ts", "30 seconds", "3 seconds"), "worker_id").agg(F.count("*").alias("total"), F.sum("resp_bytes").alias("bytes"), F.percentile_disc("latency_s", 0.5).alias("p50") if hasattr(F, "percentile_disc") else F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY latency_s)").alias("p50"))
    got = jobs.window_figures(jobs.slide_figures(df, ["worker_id"]), ["worker_id"])
    want = {(r.window.start, r.worker_id): (r.total, r.bytes, r.p50) for r in exact.collect()}
    assert {(r.window.start, r.worker_id): (r.total, r.bytes, r.latency_p50) for r in got.collect()} == want
    whole = jobs.window_figures(jobs.slide_figures(df, ["worker_id"], "1 minute"), ["worker_id"], "365 days", "365 days").collect()
    for r in whole:
        values = sorted(x.latency_s for x in df.where(F.col("worker_id") == r.worker_id).collect())
        for q, v in ((0.5, r.latency_p50), (0.95, r.latency_p95)):
            assert abs(sum(x <= v for x in values) / len(values) - q) < 0.002


def test_percentiles_in_one_stream(spark, tmp_path):
    """Both steps in a stream: the windows that the watermark has closed, as a batch has them."""
    rows = requests(random.Random(6), 4_000)
    written_in_turn([frame(spark, rows[i : i + 1000]) for i in range(0, 4000, 1000)], f"{tmp_path}/in")
    stream = spark.readStream.schema(REQUESTS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    got = spark.read.parquet(jobs.drained(jobs.window_figures(jobs.slide_figures(stream, ["worker_id"]), ["worker_id"])))
    want = {(r.window.start, r.worker_id): tuple(r)[2:] for r in jobs.window_figures(jobs.slide_figures(frame(spark, rows), ["worker_id"]), ["worker_id"]).collect()}
    found = {(r.window.start, r.worker_id): tuple(r)[2:] for r in got.collect()}
    assert len(found) > 40 and all(want[k] == v for k, v in found.items())


def against_sql(spark, events, at, name):
    """Rows of a registered query over these events, and of its SQL."""
    df = spark.createDataFrame(events, "event_id long, t double, user_id long, event_type string, value double, props string")
    df.withColumn("ts", F.timestamp_seconds("t").cast("timestamp_ntz")).drop("t").coalesce(2).write.parquet(f"{at}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{at}/events.parquet/*.parquet')")
    cursor = con.execute(streaming.SQL[name])
    columns = [d[0] for d in cursor.description]
    return Counter(map(tuple, streaming.QUERIES[name](spark, str(at)).select(columns).collect())), Counter(cursor.fetchall())


@pytest.mark.parametrize("values", [6_000, 50])
def test_percentiles_of_large_windows_equal_sql(spark, tmp_path, values):
    """More requests in a window than a sketch holds, of many and of few values; a group without a name, one without latencies."""
    rng = random.Random(9)
    events = [(i, 1_704_067_200.0 + rng.random() * 90_000, i, rng.choice(["a", "a", "a", "b", None]), rng.randrange(values) / 4, '{"k": 3}') for i in range(40_000)]
    events += [(i, 1_704_067_200.0, i, "none", None, '{"k": 3}') for i in range(5)] + [(9, 1_704_067_200.0, 9, "one", 7.5, '{"k": 3}')]
    got, want = against_sql(spark, events, tmp_path, "stream_percentiles")
    assert got == want and len(want) > 12


def test_windows_and_rates_round_as_sql_does(spark, tmp_path):
    """Requests within half a second of a window's end, and a rate that lies between two values of six digits."""
    start = 1_704_067_200.0
    events = [(i, start + 43_199 + i / 10, i, "edge", 20.0, '{"k": 3}') for i in range(1, 10)] + [(i, start + 43_198.5, i, "even", 20.0, '{"k": 3}') for i in range(3)]
    events += [(i, start + i, i, "rate", 20.0 if i < 2_997 else 1.0, '{"k": 3}') for i in range(5_760)]
    got, want = against_sql(spark, events, tmp_path, "sliding_stream_metrics")
    assert got == want and {r[3] for r in want if r[0] == "rate"} == {0.520312}


# --- duplicates ----------------------------------------------------------------------------------------------------


def test_duplicates_of_the_drained_log(spark, tmp_path):
    rng = random.Random(7)
    start = 1_700_000_000.0
    local = [(f"w{i % 4}", i, start + i, rng.random() < 0.8) for i in range(300)]
    served = [(w, i, at + rng.randrange(300), "accepted" if rng.random() < 0.7 else "stale") for w, i, at, ok in local if ok and rng.random() < 0.9]
    end = [("end", -1, start + 10**7, True)]
    read = lambda rows, last: spark.createDataFrame(rows, f"worker_id string, result_id long, at double, {last}").withColumn("ts", F.timestamp_seconds("at")).drop("at")
    frames = read(local + end, "success boolean"), read(served + [("end", -2, start + 10**7, "accepted")], "counter string")
    streams = []
    for name, df in zip(("local", "served"), frames, strict=True):
        written_in_turn([df], f"{tmp_path}/{name}")
        streams.append(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/{name}/*"))
    got = spark.read.parquet(jobs.drained(jobs.duplicated(*streams))).where("worker_id <> 'end'").groupBy("worker_id").count()
    want = metrics.duplicate_work(frames[0].where("worker_id <> 'end'"), frames[1].where("worker_id <> 'end'")).where("duplicates > 0")
    assert {r.worker_id: r["count"] for r in got.collect()} == {r.worker_id: r.duplicates for r in want.collect()}
