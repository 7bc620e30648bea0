"""Scalars, changes, the task log, results and metrics on hand-written rows."""

import datetime

import pytest
from pyspark.sql import functions as F

from catalith.functions import quality
from catalith.functions import scalars as X
from catalith.operators import changes, metrics, results, tasks
from catalith.sources import identifiers


def one(spark, column, **values):
    schema = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("v")).first().v


PRICES = [("$1,299.00", 1299.0), ("US$ 5", 5.0), ("$2 - $3", None), ("N/A", None), ("", None), (None, None), ("12.9 USD", None), ("1_000", None), ("12.5d", None), ("1e3", 1000.0), ("[非USD]CNY 12", 12.0), (" $7 ", 7.0), ("-3", -3.0)]


@pytest.mark.parametrize(("text", "value"), PRICES)
def test_parse_price(spark, text, value):
    assert one(spark, X.parse_price(F.col("c")), c=text) == value


@pytest.mark.parametrize(("text", "value"), [("Only 5 left", 5), ("1,000", 1000), ("999", 999), ("N/A", None), ("", None), (None, None)])
def test_parse_int(spark, text, value):
    assert one(spark, X.parse_int(F.col("c")), c=text) == value


@pytest.mark.parametrize(("price", "ship", "total"), [("$10.00", "FREE", "$10.00"), ("$1,000.50", "$5.25", "$1005.75"), ("$3", "free", "$3.00"), ("$3", "soon", "$3.00"), ("N/A", "$1", ""), (None, None, ""), ("$0.125", "0", "$0.13")])
def test_total_price(spark, price, ship, total):
    assert one(spark, X.total_price(F.col("p"), F.col("s")), p=price, s=ship) == total


@pytest.mark.parametrize(("old", "new", "out"), [("In Stock", " in stock ", None), ("In Stock", "Gone", "changed"), ("N/A", "Gone", None), (None, "x", None)])
def test_compare_status(spark, old, new, out):
    assert one(spark, X.compare_status(F.col("a"), F.col("b")), a=old, b=new) == out


@pytest.mark.parametrize(
    ("column", "text", "value"),
    [
        (X.normal_path, " None ", None), (X.normal_path, " a/b ", "a/b"), (X.clean_brand, "Visit the Acme Store", "Acme"), (X.clean_brand, "x" * 81, None), (X.zip5, "to 90210-1", "90210"),
        (X.zip5, "none", None), (X.fulfillment, "Other", "FBM"), (X.fulfillment, None, "FBA"), (X.tag_foreign, "EUR 5", "[非USD]EUR 5"), (X.tag_foreign, "$5", "$5"), (X.safe_name, "a b/c", "a_b_c"),
        (X.valid_clock, "23:59", True), (X.valid_clock, "24:00", False), (X.valid_clock, "x", False), (X.escaped_html, "<a&\"b\">", "&lt;a&amp;&quot;b&quot;&gt;"), (X.error_class, "ReadTimeout", "timeout"),
        (X.error_class, "Reset", "network"), (X.strip, "  x　", "x"), (X.plain_text, "<p>a</p>\n <b>b</b>", "a b"), (X.detail_field, "Item Model Number", "model_number"), (X.detail_field, "Brand Name", None), (X.detail_field, " Brand", "brand"),
    ],
)
def test_text_scalars(spark, column, text, value):
    assert one(spark, column(F.col("c")), c=text) == value


def test_number_scalars(spark):
    row = spark.range(1).select(
        X.percent(F.lit(1), F.lit(16)).alias("tie"), X.percent(F.lit(1), F.lit(0)).alias("none"), X.bounded_percent(F.lit(5), F.lit(2)).alias("most"), X.duration(F.lit(7384)).alias("d"),
        X.band_success(F.lit(90)).alias("s"), X.band_block(F.lit(0)).alias("b"), X.linear_backoff(F.lit(3)).alias("l"), X.exponential_backoff(F.lit(3)).alias("e"),
        X.labelled(F.lit("x"), {"y": "Y"}).alias("same"), X.labelled(F.lit("y"), {"y": "Y"}).alias("label"),
    ).first()
    assert tuple(row) == (6.2, 0.0, 100.0, "2h 3m", "warn", "good", 5, 8.0, "x", "Y")


def test_delivery_days(spark):
    day = F.lit(datetime.date(2024, 12, 30))
    phrases = spark.createDataFrame([(["Jan 2", "Tomorrow", "Dec. 31", "nothing"],), (["Dec 1"],), ([],)], "p array<string>")
    assert [tuple(r.v) for r in phrases.select(X.first_delivery(F.col("p"), day).alias("v")).collect()] == [(1, "Tomorrow"), (999, "N/A"), (999, "N/A")]


def test_hash_keeps_places(spark):
    assert one(spark, X.joined_hash([F.col("a"), F.col("b")]), a=None, b="x") != one(spark, X.joined_hash([F.col("a"), F.col("b")]), a="x", b=None)


def test_quality_classes(spark):
    page = lambda status, body: spark.range(1).select(quality.response_class(F.lit(status), F.lit(body)).alias("v")).first().v
    assert [page(404, "x"), page(503, "x"), page(200, "validateCaptcha"), page(200, "short"), page(200, "y" * 2000)] == ["missing", "blocked", "blocked", "empty", "ok"]
    cases = [
        (("captcha", "t", "$1", "b"), ("captcha", "captcha", True)), (("api_block", "t", "$1", "b"), ("api_block", "blocked", True)),
        ((None, "[HTML解析失败]", "$1", "b"), ("parse_error", "parse_error", True)), ((None, "", "$1", "b"), ("blank_title", "parse_error", True)),
        ((None, "none", "$1", "b"), ("ok", None, False)), ((None, "[商品不存在]", "N/A", "N/A"), ("missing", None, False)),
        ((None, "t", "[非USD]x", "b"), ("foreign_price", "parse_error", True)), ((None, "t", "£5", "b"), ("foreign_price", "parse_error", True)),
        ((None, "t", "12.000,50", "b"), ("foreign_price", "parse_error", True)), ((None, "t", "12 or more", "b"), ("ok", None, False)),
        ((None, "t", "不可售", "N/A"), ("ok", None, False)), ((None, "t", "N/A", "0"), ("degraded", "parse_error", True)), ((None, "t", None, "n/a"), ("degraded", "parse_error", True)),
        ((None, "t", "none", "N/A"), ("ok", None, False)), ((None, "t", "$1", "b"), ("ok", None, False)),
    ]
    df = spark.createDataFrame([c[0] for c in cases], "block string, title string, price string, brand string").coalesce(1)
    got = df.select(quality.record_class(F.col("block"), F.col("title"), F.col("price"), [F.col("price"), F.col("brand")], X.FOREIGN).alias("v"))
    assert [tuple(r.v) for r in got.collect()] == [c[1] for c in cases]


def test_worker_ids_and_regions(spark):
    ids = spark.createDataFrame([(t,) for t in ("w-1_a", "", "a b", "x" * 65, None)], "w string").coalesce(1)
    assert [r.v for r in ids.select(quality.valid_worker_id(F.col("w")).alias("v")).collect()] == [True, False, False, False, False]
    pages = [("Deliver to 10001", "€", True), ("Deliver to 90210", "$", False), (None, "prices in $", True), ("", "a £ sign", False), (None, "plain", True), (None, "x" * 50_000 + "€", True), (None, None, True)]
    df = spark.createDataFrame([p[:2] for p in pages], "widget string, body string").coalesce(1)
    assert [r.v for r in df.select(quality.region_ok(F.col("widget"), F.col("body"), "10001").alias("v")).collect()] == [p[2] for p in pages]


OBS = "asin string, seq long, batch_id long, is_auto boolean, title string, bullet_points string, current_price string, buybox_price string, stock_count string, stock_status string"


def test_changes_follow_the_baseline(spark):
    rows = [
        ("a", 1, 5, False, "T", "b", "$10", "$10", "5", "In"), ("a", 2, 6, False, "T", "b", "$12", "$10", "5", "in "), ("a", 3, 7, True, "T2", "b", "$9", None, "6", "In"),
        ("a", 4, 8, False, "T2", "b", "$9", "$1", "6", "Out"), ("a", 5, 9, True, "T2", "b", None, "$1", "6", "Out"), ("a", 6, 9, False, "T3", "b", "$1", "$1", "1", "x"),
        ("n", 1, None, False, "T", "b", "$1", "$1", "1", "x"), ("e", 1, 1, False, "T", "b", "", "$1", "1", "x"), ("e", 2, 1, False, "T", "b", "$2", "$1", "2", "x"),
    ]
    got = {(r.asin, r.seq, r.change_type): (r.change_detail, r.prev_value) for r in changes.detect_changes(spark.createDataFrame(rows, OBS)).collect()}
    assert {k: v[0] for k, v in got.items()} == {
        ("a", 1, "new"): "first_seen", ("a", 2, "price_stock"): "price:up", ("a", 3, "price_stock"): "price:down, stock_qty:up", ("a", 3, "title_bullets"): "title_or_bullets_changed",
        ("a", 4, "price_stock"): "stock_status:changed", ("a", 5, "price_stock"): "stock_status:changed", ("e", 1, "new"): "first_seen", ("e", 2, "price_stock"): "stock_qty:up",
    }
    assert got["a", 4, "price_stock"][1] == "price=$9, buybox=None, stock=6, status=In" and got["a", 3, "title_bullets"][1] == "title=T"
    state = {r.asin: r.current_price for r in changes.current_state(spark.createDataFrame(rows, OBS), ["current_price"]).collect()}
    assert state == {"a": "$1", "n": "$1", "e": "$2"}


TASKS = "id long, batch_id long, asin string, status string, priority int, needs_screenshot boolean, worker_id string, lease_epoch int, retry_count int, updated_at timestamp, error_type string"
NOW = datetime.datetime(2024, 1, 1)


def task(i, status="processing", worker="w", epoch=1, retries=0, priority=0, batch=1):
    return (i, batch, f"k{i}", status, priority, False, worker, epoch, retries, NOW, None)


def test_fencing_and_retries(spark):
    held = spark.createDataFrame([task(1), task(2, retries=2), task(3), task(4, epoch=2), task(5)], TASKS)
    sent = [(1, "w", 1, True, False, 1), (1, "w", 1, True, False, 2), (2, "w", 1, False, False, 3), (3, "w", 1, False, False, 4), (4, "w", 1, True, False, 5), (5, "w", 1, True, True, 6), (9, "w", 1, True, False, 7)]
    results_ = spark.createDataFrame([(*r, "boom") for r in sent], "task_id long, worker_id string, lease_epoch int, success boolean, shell boolean, seq long, error_type string")
    out = tasks.outcome(tasks.fence(results_, held), F.col("shell"))
    assert {r.seq: (r.effect, r.counter) for r in out.collect()} == {1: ("done", "accepted"), 2: ("stale", "stale"), 3: ("failed", "accepted"), 4: ("retry", "accepted"), 5: ("stale", "stale"), 6: ("rejected", "failed"), 7: ("stale", "stale")}
    after = {r.id: (r.status, r.retry_count, r.lease_epoch, r.error_type) for r in tasks.after_results(held, out, F.current_timestamp()).collect()}
    assert after == {1: ("done", 0, 1, None), 2: ("failed", 3, 1, "boom"), 3: ("pending", 1, 2, "boom"), 4: ("processing", 0, 2, None), 5: ("failed", 0, 1, "server_reject")}


def test_queue(spark):
    queue = spark.createDataFrame([task(i, "pending", None, priority=i % 3) for i in range(9)] + [task(20)], TASKS)
    taken = tasks.dequeue(queue, 2)
    assert [r.id for r in taken.collect()] == [2, 5]
    leased = {r.id: (r.status, r.worker_id, r.lease_epoch) for r in tasks.lease(queue, taken, "me", F.current_timestamp()).collect()}
    assert leased[2] == ("processing", "me", 1) and leased[8][0] == "pending"
    back = {r.id: (r.status, r.lease_epoch) for r in tasks.reclaim(queue, ["w"], F.lit(NOW), F.current_timestamp()).collect()}
    assert back[20] == ("pending", 2) and back[1] == ("pending", 1)
    freed = spark.createDataFrame([(20, "w", 1), (20, "w", 9)], "id long, worker_id string, lease_epoch int")
    assert {r.id: r.lease_epoch for r in tasks.release(queue, freed, F.current_timestamp()).collect()}[20] == 2
    assert tasks.prioritize(queue, 1).where("priority = 10").count() == 9
    failed = spark.createDataFrame([task(1, "failed", retries=3)], TASKS)
    assert tuple(tasks.retry_batch(failed, 1, F.current_timestamp()).select("status", "retry_count", "lease_epoch").first()) == ("pending", 0, 1)
    assert [r.id for r in tasks.local_order(spark.createDataFrame([(1, 2, 0), (2, 1, 1), (3, 1, 0)], "id long, seq long, retry_count int")).collect()] == [3, 1, 2]


def test_preemption(spark):
    queue = spark.createDataFrame([task(1, "pending", None), task(2, "pending", None, priority=5), task(3, "pending", None, priority=None)], TASKS)
    for incoming, kept in (([task(9, "pending", None, priority=1), task(8, "pending", None)], {2}), ([task(9, "pending", None)], {1, 2, 3}), ([], {1, 2, 3})):
        stay, go = tasks.preempt(queue, spark.createDataFrame(incoming, TASKS))
        assert {r.id for r in stay.collect()} == kept and {r.id for r in go.collect()} == {1, 2, 3} - kept and stay.columns == queue.columns


def test_release_by_id(spark):
    held = spark.createDataFrame([task(1), task(2, "done"), task(3)], TASKS)
    after = tasks.release_by_id(held, spark.createDataFrame([(1,), (1,), (2,), (7,)], "id long"), F.current_timestamp())
    assert {r.id: (r.status, r.worker_id, r.lease_epoch) for r in after.collect()} == {1: ("pending", None, 2), 2: ("done", "w", 1), 3: ("processing", "w", 1)}


def test_progress_barrier_and_totals(spark):
    log = spark.createDataFrame([task(1, "done"), task(2, "failed"), task(3, "done", batch=2), task(4, "pending", batch=2)], TASKS)
    rows = tasks.progress(log, F.col("status"), {x: x for x in ("pending", "processing", "done", "failed")}, ["batch_id"])
    assert [r.batch_id for r in tasks.complete(rows).collect()] == [1]
    assert tasks.complete(rows.where("batch_id = 9")).count() == 0
    shots = spark.createDataFrame([(1, s) for s in ("done", "odd", "failed", "odd")], "batch_id long, status string")
    r = tasks.screenshot_progress(shots, ["batch_id"]).first()
    assert (r.pending, r.processing, r.done, r.failed, r.total) == (0, 0, 1, 1, 4)
    d = tasks.diagnostics(spark.range(3), log, spark.range(2), 7).first()
    assert (d.total_asins, d.total, d.done, d.active_workers, d.settings_version) == (3, 4, 2, 2, 7)


def test_histories_batches_and_names(spark):
    log = spark.createDataFrame([("a", 1, "new"), ("b", 2, "new"), ("a", 3, "price_stock")], "asin string, seq long, change_type string")
    assert [r.seq for r in changes.change_history(log, "a").collect()] == [3, 1]
    tables = {"tasks": spark.createDataFrame([(1, "x"), (2, "y"), (None, "z")], "batch_id long, v string"), "none": spark.createDataFrame([], "batch_id long")}
    assert {r.v for r in results.delete_batch(tables, 1)["tasks"].collect()} == {"y", "z"} and results.delete_batch(tables, 1)["none"].count() == 0
    assert identifiers.safe_archive_name("a b/ü-1_2.x") == "a_b__-1_2_x"
    assert spark.range(1).select(X.safe_name(F.lit("a b/ü-1_2.x")).alias("v")).first().v == "a_b__-1_2_x"
    known = ["asin", "brand", "current_price", "site", "stock_count"]
    assert results.price_stock_fields(known) == ["asin", "current_price", "stock_count"]
    assert tasks.reset_settings({"a": 5, "version": 3}, {"a": 1}) == {"a": 1, "version": 4}


def test_fleet_and_registry(spark):
    workers = spark.createDataFrame([("a", True, 3), ("b", False, 5), ("c", True, None)], "worker_id string, online boolean, inflight long")
    assert tuple(metrics.fleet_totals(workers).first()) == (3, 2) and tuple(metrics.fleet_totals(workers.limit(0)).first()) == (0, 0)
    known = spark.createDataFrame([("a", 0.9, 4, None), ("z", 0.1, 1, 1)], "worker_id string, success_rate double, accepted long, stale long")
    got = {r.worker_id: (r.success_rate, r.accepted, r.stale) for r in metrics.registry(workers, known).collect()}
    assert got == {"a": (0.9, 4, 0), "b": (None, 0, 0), "c": (None, 0, 0)}


def test_creation(spark):
    batches = spark.createDataFrame([(1, "a")], "id long, name string")
    assert tasks.create_batch(batches, spark.createDataFrame([("a",), ("b",)], "name string")).count() == 2
    wanted = spark.createDataFrame([(1, " k1 "), (1, "k2"), (1, "k2"), (1, "  ")], "batch_id long, asin string")
    assert [r.asin for r in tasks.new_tasks(spark.createDataFrame([task(1)], TASKS), wanted).collect()] == ["k2"]


def test_schedules(spark):
    now = F.to_timestamp(F.lit("2024-05-02 10:30:00"))
    rows = [("s1", "daily", "10:30", 1, True, "2024-05-01"), ("s2", "later", "10:31", 1, True, None), ("s3", "rests", "09:00", 2, True, "2024-05-01"), ("s4", "off", "09:00", 1, False, None), ("s5", "new", "09:00", 1, True, None), ("s6", "bad", "25:00", 1, True, None)]
    schedules = spark.createDataFrame([(*r, False) for r in rows], "id string, name string, time string, interval_days int, enabled boolean, last_run_date string, needs_screenshot boolean")
    due = metrics.due_schedules(schedules, now)
    assert {r.id for r in due.collect()} == {"s1", "s5"}
    members = spark.createDataFrame([("s1", "k1"), (None, "k1"), (None, "k2")], "schedule_id string, asin string")
    batches, wanted = tasks.run_due(due, members, now)
    assert {r.name for r in batches.collect()} == {"auto_daily_20240502_1030", "auto_new_20240502_1030"}
    assert sorted((r.name[:10], r.asin) for r in wanted.collect()) == [("auto_daily", "k1"), ("auto_new_2", "k1"), ("auto_new_2", "k2")]
    assert {r.id: r.last_run_date for r in tasks.after_run(schedules, due, now).collect()}["s5"] == "2024-05-02"
    assert tasks.updated_settings({"a": 1, "version": 3}, {"a": 2, "z": 1}, {"a"}) == {"a": 2, "version": 4}


def test_search_and_pages(spark):
    df = spark.createDataFrame([(i, f"K{i}", t, "b") for i, t in enumerate(["50% off_x", "Äpfel", "plain", None])], "id long, asin string, title string, brand string")
    q = results.ResultQuery(df)
    found = lambda text, **k: sorted(r.id for r in q.search(text, **k).rows().collect())
    assert found("0% O") == [0] and found("äPF,\nk3") == [1, 3] and found("%") == [0] and found("p%n", wildcards=True) == [2] and found(" , ") == [0, 1, 2, 3] and found("\\b") == []
    page = q.page(limit=2).collect()
    assert [r.id for r in page] == [3, 2, 1] and [r.id for r in q.page(cursor=0, direction="prev", limit=2).collect()] == [3, 2, 1]
    assert tuple(results.cursors(q.page(cursor=2)).first()) == (0, 1)
    members = spark.createDataFrame([(0, "K0", True), (0, "K1", False)], "batch_id long, asin string, is_new boolean")
    assert q.in_batch(members, 0).rows().count() == 2 and q.in_batch(members, None).rows().count() == 4
    assert results.deletion_targets(None, None, None) is None
    assert results.deletion_targets(df.select("asin").limit(0), None, members.select("asin")).count() == 0


def test_metrics(spark):
    rows = [("w", NOW + datetime.timedelta(seconds=s), lat, ok, False, 100) for s, lat, ok in [(0, 1.0, True), (1, 3.0, True), (2, 9.0, False), (4, 2.0, True)]]
    req = spark.createDataFrame(rows, "worker_id string, ts timestamp, latency_s double, success boolean, blocked boolean, resp_bytes long")
    s = metrics.snapshot(req, ["worker_id"]).first()
    assert (s.total, s.success_rate, s.latency_p50, s.bandwidth_bps) == (4, 0.75, 2.5, 100.0)
    e = metrics.dual_ewma(req, "worker_id", ["ts"]).first()
    assert e.ewma_short == pytest.approx(0.3 * 2 + 0.7 * 1.6) and e.ewma_long == pytest.approx(0.05 * 2 + 0.95 * 1.1)
    counter = spark.createDataFrame([("w", NOW + datetime.timedelta(seconds=t), d) for t, d in [(0, 0), (0.5, 1), (10, 10), (20, 40)]], "worker_id string, at timestamp, done long")
    speeds = [r.speed for r in metrics.speeds(counter, "worker_id", "at", "done").orderBy("at").collect()]
    assert speeds[0] is None and speeds[-1] == pytest.approx(180.0)
    assert metrics.smoothed_speed(counter, "worker_id", "at", "done").first().speed > 0
    quota = metrics.quotas(spark.createDataFrame([("a", 1.0, 0.0), ("b", None, None), ("c", 0.0, 1.0)], "worker_id string, success_rate double, block_rate double"))
    totals = metrics.coordinator_totals(quota).first()
    assert totals.workers == 3 and totals.concurrency == 96
    live = metrics.liveness(req.select("worker_id", "ts"), F.lit(NOW + datetime.timedelta(seconds=90))).first()
    assert (live.online, live.dead) == (False, False)
    local = spark.createDataFrame([("w", True), ("w", True), ("v", False)], "worker_id string, success boolean")
    served = spark.createDataFrame([("w", "accepted"), ("w", "stale")], "worker_id string, counter string")
    assert {r.worker_id: r.duplicates for r in metrics.duplicate_work(local, served).collect()} == {"w": 1, "v": 0}


def test_control_ladder(spark):
    base = {"total": 10, "block_rate": 0.0, "success_rate": 1.0, "latency_p50": 1.0, "rtt_gradient": 1.0, "ewma_short": 1.0, "bandwidth_pct": 0.0}
    cases = [({"total": 4}, "few_samples", 20), ({"block_rate": 0.2}, "blocked", 16), ({"success_rate": 0.5}, "low_success", 16), ({"latency_p50": 9.0}, "slow", 16), ({"bandwidth_pct": 0.9}, "saturated", 20), ({}, "grow", 22), ({"success_rate": 0.9}, "steady", 20)]
    rows = spark.createDataFrame([tuple((base | c[0]).values()) for c in cases], "total int, block_rate double, success_rate double, latency_p50 double, rtt_gradient double, ewma_short double, bandwidth_pct double")
    got = metrics.decide(rows.coalesce(1), F.lit(20), F.lit(False)).select("rule", "concurrency").collect()
    assert [tuple(r) for r in got] == [c[1:] for c in cases]


def test_token_bucket_equals_a_simulation(spark):
    times = [0.0, 0.1, 0.2, 5.0, 5.05, 5.1, 9.0]
    rate, burst = 2.0, 2
    got = [r.start for r in metrics.token_bucket(spark.createDataFrame([("k", t) for t in times], "k string, t double"), "k", "t", rate, burst).orderBy("t").collect()]
    tokens, clock, wanted = 0.0, times[0], []
    for t in times:
        t = max(t, clock)
        tokens = min(burst, tokens + (t - clock) * rate)
        wait = max(0.0, (1 - tokens) / rate)
        clock = t + wait
        tokens = min(burst, tokens + wait * rate) - 1
        wanted.append(clock)
    assert got == pytest.approx(wanted)


def test_screenshots(spark):
    shots = spark.createDataFrame([("a", 1, "pending", None, None, 0)], "asin string, batch_id long, status string, file_path string, error_detail string, retry_count int")
    ups = spark.createDataFrame([("a", 1, "failed", None, "x", 1), ("a", 1, "done", "p.png", None, 2)], "asin string, batch_id long, status string, file_path string, error_detail string, seq long")
    r = tasks.screenshot_update(shots, ups).first()
    assert (r.status, r.file_path, r.retry_count) == ("done", "p.png", 1)
    assert tasks.paths_after(spark.createDataFrame([("a", None), ("b", "old")], "asin string, screenshot_path string"), ups).orderBy("asin").collect()[0].screenshot_path == "p.png"


def test_smoothing_spreads_a_hot_key_over_tasks(spark):
    values = [(i * 37 % 101) / 7 + 0.1 for i in range(4000)]
    rows = [("hot", i, v) for i, v in enumerate(values)] + [("b", 1, 2.0), ("b", 2, None), ("b", 3, 5.0), ("b", 4, 7.0), (None, 1, 3.0), ("c", 1, None)]
    table = spark.createDataFrame(rows, "k string, at int, v double").repartition(5)
    want = values[0]
    for v in values[1:]:
        want = 0.001 * v + 0.999 * want
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else the few rows of a test are put into one task
    try:
        df = metrics.ewma(table, "k", ["at"], "v", 0.001, "e")
        got = {r.k: r.e for r in df.collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert got["hot"] == pytest.approx(want, rel=1e-12) and got["b"] == pytest.approx(0.001 * 7 + 0.999 * 5) and got[None] == 3.0 and got["c"] is None
    assert "rangepartitioning" in df._jdf.queryExecution().executedPlan().toString()


def test_receive_speed(spark):
    df = spark.createDataFrame([(100.0, 3), (100.0, 0), (None, 2)], "cap double, inflight int")
    assert [r.v for r in df.select(X.receive_speed(F.col("cap"), F.col("inflight")).alias("v")).collect()] == [33, 100, None]


def test_pending_screenshots(spark):
    rows = [(5, "pending"), (3, "done"), (2, "pending"), (9, "pending"), (4, "failed"), (1, None)]
    df = spark.createDataFrame(rows, "id long, status string")
    assert [r.id for r in tasks.pending_screenshots(df, 2).collect()] == [2, 5] and tasks.pending_screenshots(df, 50).count() == 3
