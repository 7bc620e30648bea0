"""The lease stream and the submit sink against row-by-row versions, over micro-batches, timers and restarts."""

import json
import random
import time
from collections import Counter
from pathlib import Path
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from catalith.operators import tasks as task_log
from catalith.streaming import jobs, leases, submit

from .test_queries import written_in_turn

TASKS = "id long, status string, worker_id string, lease_epoch int, retry_count int, error_type string"


def run_leases(spark, batches, tasks, at):
    written_in_turn([spark.createDataFrame(b, leases.EVENTS) for b in batches], at)
    stream = spark.readStream.schema(leases.EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{at}/*")
    with leases.rocks(spark):
        return spark.read.parquet(jobs.drained(leases.lease_changes(stream, tasks, lease_s=None)))


def brute_leases(batches, tasks, max_retries=3):
    """Event by event: (counts of effects, final tasks)."""
    state, effects = {t[0]: list(t[1:]) for t in tasks}, Counter()
    for batch in batches:
        for task, _, kind, worker, epoch, success, rejected, error in sorted(batch, key=lambda e: (e[0], e[1])):
            now = state.get(task)
            held = now is not None and now[0] == "processing" and (kind == "reclaim" or now[1:3] == [worker, epoch])
            if kind == "lease":
                ok = now is None or now[0] == "pending" and now[2] == epoch
                if ok:
                    state[task] = ["processing", worker, epoch, now[3] if now else 0, now[4] if now else None]
                effects["leased" if ok else "stale"] += 1
            elif not held:
                effects["stale"] += 1
            elif kind == "renew":
                effects["renewed"] += 1
            elif kind in ("release", "reclaim"):
                now[:3] = ["pending", None, now[2] + 1]
                effects[kind + ("d" if kind[-1] == "e" else "ed")] += 1
            elif success and rejected:
                now[0], now[4] = "failed", "server_reject"
                effects["rejected"] += 1
            elif success:
                now[0] = "done"
                effects["done"] += 1
            elif now[3] + 1 >= max_retries:
                now[0], now[3], now[4] = "failed", now[3] + 1, error
                effects["failed"] += 1
            else:
                now[:] = ["pending", None, now[2] + 1, now[3] + 1, error]
                effects["retry"] += 1
    return effects, {k: tuple(v) for k, v in state.items()}


def test_any_log_of_events(spark, tmp_path):
    """Shuffled micro-batches of all kinds of events, with late submits of leases long given back."""
    rng = random.Random(6)
    held = [(i, "processing", f"w{i % 2}", i % 2, i % 3, None) for i in range(12)] + [(100, "done", "w", 0, 0, None), (101, "pending", None, 2, 1, "old")]
    kinds = ["lease", "lease", "result", "result", "result", "release", "reclaim", "renew"]
    events, now = [], {t[0]: t[1:] for t in held}
    for i in range(900):
        task = rng.randrange(30) if rng.random() < 0.9 else rng.choice([100, 101])
        _, worker, epoch = (*now.get(task, ("", None, 0)),)[:3]
        if rng.random() < 0.4:
            worker, epoch = f"w{rng.randrange(3)}", rng.randrange(4)
        events.append((task, [float(i), 0.5], rng.choice(kinds), worker or "w0", epoch, rng.random() < 0.1, rng.random() < 0.3, rng.choice(["timeout", None])))
        now |= brute_leases([events[-1:]], [(k, *v) for k, v in now.items()])[1]
    batches = [rng.sample(events[i : i + 225], 225) for i in range(0, 900, 225)]
    start = spark.createDataFrame(held, TASKS)
    got = run_leases(spark, batches, start, f"{tmp_path}/in")
    effects, state = brute_leases(batches, held)
    assert Counter(r.effect for r in got.collect()) == effects and len(effects) == 9
    every = spark.createDataFrame([*held, *[(i, "pending", None, 0, 0, None) for i in range(30) if i >= 12]], TASKS)
    now = {r.id: tuple(r)[1:] for r in leases.tasks_now(every, got).collect()}
    assert {k: now[k] for k in state} == state


def test_state_is_read_and_written_once_for_many_tasks():
    """600 events of 300 tasks: one state, one read, one write."""

    class Shelf:
        value, reads, writes = None, 0, 0

        def exists(self):
            return self.value is not None

        def get(self):
            self.reads += 1
            return self.value

        def update(self, value):
            self.value, self.writes = value, self.writes + 1

    shelf, made = Shelf(), leases.Leases(lease_s=None)
    made.init(SimpleNamespace(getValueState=lambda name, schema: shelf))
    ids = range(300)
    made.handleInitialState((0,), pd.DataFrame({"id": ids, "status": "processing", "worker_id": "w", "lease_epoch": 1, "retry_count": 0, "error_type": None}), None)
    shelf.reads = shelf.writes = 0
    frame = pd.DataFrame({"id": [*ids, *ids], "seq": [np.array([1.0])] * 300 + [np.array([0.0])] * 300, "kind": "result", "worker_id": "w", "lease_epoch": [1] * 300 + [2] * 300, "success": True, "rejected": False, "error_type": None})
    out = pd.concat(list(made.handleInputRows((0,), iter([frame[:200], frame[200:]]), None)))
    assert (shelf.reads, shelf.writes) == (1, 1) and len(shelf.value[1]) == 300
    assert out.id.tolist() == sorted([*ids, *ids]) and out.effect.tolist() == ["stale", "done"] * 300


def test_stream_equals_the_batch_operator(spark, tmp_path):
    """Single leases with repeats: the table after the stream is the one of ``after_results``."""
    rng = random.Random(2)
    held = [(i, "processing", f"w{i % 3}", i % 2, i % 3, None) for i in range(40)]
    results = [(rng.randrange(45), i, f"w{rng.randrange(3)}", rng.randrange(2), rng.random() < 0.5, rng.random() < 0.3, "timeout") for i in range(300)]
    start = spark.createDataFrame(held, TASKS).withColumn("updated_at", F.current_timestamp())
    seen = spark.createDataFrame(results, "task_id long, seq long, worker_id string, lease_epoch int, success boolean, shell boolean, error_type string")
    want = task_log.after_results(start, task_log.outcome(task_log.fence(seen, start), F.col("shell")), F.current_timestamp())
    events = [(t, [float(s)], "result", w, e, ok, shell, error) for t, s, w, e, ok, shell, error in results]
    rng.shuffle(events)
    got = leases.tasks_now(start, run_leases(spark, [events], start, f"{tmp_path}/in"))
    columns = [c.split()[0] for c in TASKS.split(", ")]
    assert Counter(map(tuple, got.select(columns).collect())) == Counter(map(tuple, want.select(columns).collect()))


def test_a_lease_that_runs_out_is_reclaimed_once(spark, tmp_path):
    """By a timer, at its deadline; a restart from the checkpoint repeats nothing and keeps timers that are still to come."""
    written_in_turn([spark.createDataFrame([(1, [1.0], "lease", "w1", 0, None, None, None), (2, [1.0], "lease", "w1", 0, None, None, None), (2, [2.0], "result", "w1", 0, True, False, None)], leases.EVENTS)], f"{tmp_path}/in")
    stream = spark.readStream.schema(leases.EVENTS).parquet(f"{tmp_path}/in/*")
    start = spark.createDataFrame([(3, "processing", "w9", 4, 0, None)], TASKS)
    rows = lambda: [tuple(r)[:6] for r in spark.read.schema(leases.CHANGES).parquet(f"{tmp_path}/rows").orderBy("id", "version").collect()]

    def run(until, most_s):
        with leases.rocks(spark):
            query = leases.lease_changes(stream, start, lease_s=4).writeStream.format("parquet").option("path", f"{tmp_path}/rows").option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(processingTime="1 second").start()
        ends = time.time() + most_s
        try:
            while time.time() < ends and not until():
                query.exception() and pytest.fail(str(query.exception()))
                time.sleep(0.5)
        finally:
            query.stop()
            query.awaitTermination(20)

    there = lambda: Path(f"{tmp_path}/rows/_spark_metadata/0").exists()
    run(lambda: there() and sum(r[2] in ("leased", "done") for r in rows()) == 3, 60)
    time.sleep(4)  # the deadline passes while nothing runs
    run(lambda: sum(r[2] == "expired" for r in rows()) == 2, 60)
    run(lambda: False, 6)
    want = [(1, 1, "leased", "processing", "w1", 0), (1, 2, "expired", "pending", None, 1), (2, 1, "leased", "processing", "w1", 0), (2, 2, "done", "done", "w1", 0), (3, 1, "expired", "pending", None, 5)]
    assert rows() == want


# --- submits -------------------------------------------------------------------------------------------------------


def test_deliver_finds_the_bad_rows():
    calls = []

    def service(rows):
        calls.append(len(rows))
        if any(r["bad"] for r in rows):
            raise ValueError("refused")

    rows = [{"bad": i in (3, 17)} for i in range(20)]
    got = submit.deliver(rows, service, retries=3, wait_s=0)
    assert [i for i, e in enumerate(got) if e] == [3, 17] and got[3] == "ValueError: refused" and calls[:3] == [20] * 3
    assert submit.deliver([], service, wait_s=0) == []
    fails = iter([1, 1, 0])

    def flaky(rows):
        if next(fails):
            raise OSError("busy")

    assert submit.deliver(rows, flaky, wait_s=0) == [None] * 20


class Service:
    """Takes submits into a folder under their keys; refuses any with a negative value."""

    def __init__(self, folder):
        self.folder = folder

    def __call__(self, rows):
        if any(r["v"] < 0 for r in rows):
            raise ValueError("negative")
        for r in rows:
            Path(self.folder, r["submit_key"]).write_text(json.dumps(r["v"]))


def test_a_batch_loses_its_bad_rows_only_and_counts_once(spark, tmp_path):
    """Two bad rows in each of two micro-batches, the first of them repeated as after a failure before and after its end."""
    (tmp_path / "service").mkdir()
    service = Service(str(tmp_path / "service"))
    batches = [[(i,) for i in range(1, 60)] + [(-1,), (-2,)], [(i,) for i in range(60, 99)] + [(-3,), (-4,)]]
    at = f"{tmp_path}/out"
    put = submit.submit_into(at, service, wait_s=0)

    def broken(rows):
        service(rows)
        if any(r["v"] == 7 for r in rows):
            raise SystemError("the worker goes")

    first = spark.createDataFrame(batches[0], "v long").repartition(3)
    list(submit.deliver([{"v": 7, "submit_key": "x"}], broken, retries=1, wait_s=0))  # a try that took rows and yet failed
    Path(tmp_path / "service" / "x").unlink()
    submit.submitted(first, service, "0", wait_s=0).collect()  # submitted, but its outcome was never stored
    put(first, 0)
    put(first, 0)
    put(spark.createDataFrame(batches[1], "v long"), 1)
    assert sorted(r.v for r in submit.outcomes(spark, at, dead=False).collect()) == list(range(1, 99))
    dead = submit.outcomes(spark, at, dead=True).collect()
    assert sorted(r.v for r in dead) == [-4, -3, -2, -1] and {r.error for r in dead} == {"ValueError: negative"}
    assert sorted(int(p.read_text()) for p in (tmp_path / "service").iterdir()) == list(range(1, 99))  # repeats had their keys


def test_the_sink_in_a_stream_that_restarts(spark, tmp_path):
    (tmp_path / "service").mkdir()
    service, at = Service(str(tmp_path / "service")), f"{tmp_path}/out"
    written_in_turn([spark.createDataFrame([(i,) for i in part], "v long") for part in (range(5), range(5, 9))], f"{tmp_path}/in")

    def drain(paths):
        stream = spark.readStream.schema("v long").option("maxFilesPerTrigger", 1).parquet(paths)
        stream.writeStream.foreachBatch(submit.submit_into(at, service, wait_s=0)).option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start().awaitTermination()

    drain(f"{tmp_path}/in/*")
    spark.createDataFrame([(9,), (-1,)], "v long").coalesce(1).write.parquet(f"{tmp_path}/in/2")
    drain(f"{tmp_path}/in/*")
    drain(f"{tmp_path}/in/*")
    assert sorted(r.v for r in submit.outcomes(spark, at, dead=False).collect()) == list(range(10))
    assert [r.v for r in submit.outcomes(spark, at, dead=True).collect()] == [-1]
