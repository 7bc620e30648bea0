"""The task log as one stateful stream: leases, results, releases and reclaims, fenced by epoch, with lease timers.

State holds each task that ever held a lease: who holds it, its epoch, retries, and when the lease runs out. Tasks of 1,024
neighbouring ids share a row of state, which is read and written once for a micro-batch's events of them. Events of a task
are applied in order of ``seq`` within a micro-batch and of arrival across them; what names a lease that is no longer held is
stale, however late it comes. A lease that runs out goes back to pending by a processing-time timer, once: the timer and the
state commit with the micro-batch, so a restart from the checkpoint neither loses nor repeats it.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from catalith.operators.tasks import MAX_RETRIES

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Seconds that a lease lasts without a renewal (a fixed value: the model's hard timeout).
LEASE_S = 600.0

#: Tasks of neighbouring ids are kept together, 2 ** this of them, so that state is read and written once for all of them.
SHELF_BITS = 10

TASK = "id long, status string, worker_id string, lease_epoch int, retry_count int, error_type string, version long, deadline long"
STATE = f"timer long, tasks array<struct<{TASK}>>"
EVENTS = "id long, seq array<double>, kind string, worker_id string, lease_epoch int, success boolean, rejected boolean, error_type string"
CHANGES = "id long, version long, effect string, status string, worker_id string, lease_epoch int, retry_count int, error_type string"
_CHANGE_TYPES = {"id": "Int64", "version": "Int64", "effect": object, "status": object, "worker_id": object, "lease_epoch": "Int32", "retry_count": "Int32", "error_type": object}


def _values(column: pd.Series) -> list:
    """Python values with None for what is missing; numbers of a column with gaps come as floats."""
    if not column.hasnans:
        return column.tolist()
    return [None if v is None or v != v else int(v) if isinstance(v, float) else v for v in column.tolist()]


class Leases(StatefulProcessor):
    """Applies the events of a shelf's tasks to its state and emits a task after each of them.

    Kinds of events: ``lease`` (of a pending task, at the epoch it has), ``renew``, ``release``, ``reclaim`` and ``result``.
    A task is a list [status, worker_id, lease_epoch, retry_count, error_type, version, deadline].
    """

    def __init__(self, lease_s: float | None = LEASE_S, max_retries: int = MAX_RETRIES):
        self.lease_ms, self.max_retries = None if lease_s is None else int(lease_s * 1000), max_retries

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.shelf = handle.getValueState("shelf", STATE)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        timer, tasks = self._stored()
        columns = [_values(initialState[c]) for c in ("id", "status", "worker_id", "lease_epoch", "retry_count", "error_type")]
        for task, status, *rest in zip(*columns, strict=True):
            tasks[task] = [status, *rest, 0, self._deadline(timerValues) if status == "processing" else 0]
        self._keep(timer, tasks)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        timer, tasks = self._stored()
        events = []
        for frame in rows:
            fields = [_values(frame[c]) for c in ("kind", "worker_id", "lease_epoch", "success", "rejected", "error_type")]
            events += zip(_values(frame["id"]), [s if s is None else s.tolist() for s in frame["seq"]], *fields, strict=True)
        events.sort(key=lambda e: (e[0] is not None, e[0] or 0, e[1]))
        out = []
        for task, _, kind, worker, epoch, success, rejected, error in events:
            state = tasks.get(task)
            effect = self._effect(state, kind, worker, epoch, success, rejected)
            if effect == "leased" and state is None:
                state = ["pending", None, epoch, 0, None, 0, 0]
            if effect != "stale":
                state = tasks[task] = self._after(state, effect, worker, error)
                state[6] = self._deadline(timerValues) if effect in ("leased", "renewed") else 0
            out.append(self._row(task, state, effect))
        self._keep(timer, tasks)
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        timer, tasks = self._stored()
        now, out = expiredTimerInfo.getExpiryTimeInMs(), []
        for task, state in sorted(tasks.items(), key=lambda t: t[0] or 0):
            if state[0] == "processing" and state[6] and state[6] <= now:
                tasks[task] = self._after(state, "expired", None, None)
                out.append(self._row(task, tasks[task], "expired"))
        self._keep(0 if timer == now else timer, tasks)  # a timer that has run out goes by itself
        if out:
            yield self._frame(out)

    def close(self) -> None:
        pass

    def _deadline(self, timer_values) -> int:
        return 0 if self.lease_ms is None else timer_values.getCurrentProcessingTimeInMs() + self.lease_ms

    def _stored(self) -> tuple[int, dict]:
        if not self.shelf.exists():
            return 0, {}
        timer, tasks = self.shelf.get()
        return timer, {t[0]: list(t[1:]) for t in tasks}

    def _keep(self, timer: int, tasks: dict) -> None:
        """Store a shelf; one timer is set at most, for the first of its leases that runs out."""
        first = min((t[6] for t in tasks.values() if t[6]), default=0)
        if timer and timer != first:
            self.handle.deleteTimer(timer)
        if first and timer != first:
            self.handle.registerTimer(first)
        if tasks:
            self.shelf.update((first, [(task, *state) for task, state in tasks.items()]))

    def _effect(self, state: list | None, kind: str, worker_id: str | None, epoch: int | None, success: bool | None, rejected: bool | None) -> str:
        if kind == "lease":
            free = state is None or state[0] == "pending" and state[2] == epoch
            return "leased" if free else "stale"
        if state is None or state[0] != "processing" or (kind != "reclaim" and state[1:3] != [worker_id, epoch]):
            return "stale"
        if kind != "result":
            return {"renew": "renewed", "release": "released", "reclaim": "reclaimed"}[kind]
        if success:
            return "rejected" if rejected else "done"
        return "failed" if state[3] + 1 >= self.max_retries else "retry"

    def _after(self, state: list, effect: str, worker_id: str | None, error_type: str | None) -> list:
        status, worker, epoch, retries, error, version, _ = state
        if effect in ("released", "reclaimed", "expired", "retry"):
            status, worker, epoch = "pending", None, epoch + 1
        elif effect == "leased":
            status, worker = "processing", worker_id
        elif effect != "renewed":
            status = "done" if effect == "done" else "failed"
        if effect in ("retry", "failed"):
            retries, error = retries + 1, error_type
        elif effect == "rejected":
            error = "server_reject"
        return [status, worker, epoch, retries, error, version + 1, 0]

    @staticmethod
    def _row(task: int | None, state: list | None, effect: str) -> tuple:
        status, worker, epoch, retries, error, version = (state or [None] * 6)[:6]
        return task, version, effect, status, worker, epoch, retries, error

    @staticmethod
    def _frame(rows: list[tuple]) -> pd.DataFrame:
        columns = zip(*rows, strict=True) if rows else [()] * len(_CHANGE_TYPES)
        return pd.DataFrame({name: pd.Series(values, dtype=kind) for (name, kind), values in zip(_CHANGE_TYPES.items(), columns, strict=True)})


def lease_changes(events: DataFrame, tasks: DataFrame, lease_s: float | None = LEASE_S, max_retries: int = MAX_RETRIES) -> DataFrame:
    """The task after each of its events, and after leases that ran out; ``effect`` says what happened.

    A stream with timers goes on until it is stopped; without (``lease_s`` None) it can be drained.

    ``events`` (a stream) has the columns of ``EVENTS``. ``tasks`` is the table as it stands at the start; only leases that are
    held and tasks with a history need to be in it, others count as pending at the epoch of their first lease.
    """
    start = tasks.select(F.col("id").cast("long").alias("id"), "status", "worker_id", F.col("lease_epoch").cast("int").alias("lease_epoch"), F.col("retry_count").cast("int").alias("retry_count"), "error_type")
    mode = "None" if lease_s is None else "ProcessingTime"
    shelf = F.shiftright("id", SHELF_BITS).alias("shelf")
    shelved = events.select("*", shelf).groupBy("shelf")
    return shelved.transformWithStateInPandas(Leases(lease_s, max_retries), CHANGES, "Append", mode, initialState=start.select("*", shelf).groupBy("shelf"))


def tasks_now(tasks: DataFrame, changes: DataFrame) -> DataFrame:
    """The task table with the latest change of each task laid over it."""
    fields = ["status", "worker_id", "lease_epoch", "retry_count", "error_type"]
    last = changes.where("effect <> 'stale'").groupBy("id").agg(F.max_by(F.struct(*fields), "version").alias("now"))
    took: list[Column] = [F.when(F.col("now").isNotNull(), F.col(f"now.{f}")).otherwise(F.col(f)).alias(f) for f in fields]
    return tasks.join(last, "id", "left").select(*[c for c in tasks.columns if c not in fields], *took)


@contextmanager
def rocks(spark: SparkSession):
    """State with timers needs this store; the setting counts for queries that start inside."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(name, before)
