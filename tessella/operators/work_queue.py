"""A queue of tasks with leases: a worker that doesn't report in time loses its task to the next, and after the last attempt the task has failed.

``step`` is the rule for one event of one task; the batch fold here and the
stream in ``tessella.streaming.events`` both go by it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEASE_SECONDS, ATTEMPTS = 3600, 3


@dataclass(frozen=True)
class Task:
    """Where a task stands; ``until`` (microseconds) and ``worker`` count while it is leased."""

    status: str = "unknown"
    attempts: int = 0
    until: int = 0
    worker: str = ""


def given_back(task: Task, now: int, attempts: int = ATTEMPTS) -> Task:
    """The task as it is at ``now``: a lease that has run out is over."""
    if task.status != "leased" or now < task.until:
        return task
    return replace(task, status="failed" if task.attempts >= attempts else "queued")


def step(task: Task, action: str | None, worker: str | None, now: int, lease: int, attempts: int = ATTEMPTS) -> tuple[Task, bool]:
    """The task after an event, and whether the event was accepted.

    ``enqueue`` starts a task that is unknown, done or failed; ``claim`` leases
    a queued one for ``lease`` microseconds; ``done`` and ``fail`` count from the
    worker that has the lease alone. Anything else is refused.
    """
    task, worker = given_back(task, now, attempts), worker or ""
    if action == "enqueue" and task.status in ("unknown", "done", "failed"):
        return Task("queued"), True
    if action == "claim" and task.status == "queued":
        return Task("leased", task.attempts + 1, now + lease, worker), True
    if task.status == "leased" and task.worker == worker:
        if action == "done":
            return replace(task, status="done"), True
        if action == "fail":
            return replace(task, status="failed" if task.attempts >= attempts else "queued"), True
    return task, False


def follow_tasks(events: DataFrame, lease_seconds: int = LEASE_SECONDS, attempts: int = ATTEMPTS) -> DataFrame:
    """``task, id, accepted, status, attempts`` after each event of ``events`` (``task, action, worker, at, id``), in the order of ``at, id``.

    Events of a task stream past sorted, so that a task of any number of them
    takes the memory of one state. A null task is none: such rows are left out,
    as are those without a time.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, task = None, Task()
        for batch in batches:
            accepted, states = [], []
            for own, action, worker, now in zip(*(batch.column(c).to_pylist() for c in ("task", "action", "worker", "micros"))):
                if own != key:
                    key, task = own, Task()
                task, ok = step(task, action, worker, now, lease_seconds * 1_000_000, attempts)
                accepted.append(ok)
                states.append(task)
            columns = [pa.array(accepted, pa.bool_()), pa.array([s.status for s in states], pa.string()), pa.array([s.attempts for s in states], pa.int32())]
            yield pa.RecordBatch.from_arrays([batch.column("task"), batch.column("id"), *columns], names=["task", "id", "accepted", "status", "attempts"])

    rows = events.select("task", "action", "worker", F.col("id").cast("long").alias("id"), F.unix_micros(F.col("at").cast("timestamp")).alias("micros")).where("task IS NOT NULL AND micros IS NOT NULL")
    ordered = rows.repartition("task").sortWithinPartitions("task", "micros", "id")
    return ordered.mapInArrow(fold, "task string, id long, accepted boolean, status string, attempts int")


def standing(events: DataFrame, now: str, lease_seconds: int = LEASE_SECONDS, attempts: int = ATTEMPTS) -> DataFrame:
    """``task, status, attempts`` at ``now``: what ``follow_tasks`` left, with leases that have run out since given back."""
    tick = events.select("task").distinct().select("task", F.lit("tick").alias("action"), F.lit("").alias("worker"), F.lit(now).cast("timestamp").alias("at"), F.lit(None).cast("long").alias("id"))
    before = events.select("task", "action", "worker", F.col("at").cast("timestamp").alias("at"), F.col("id").cast("long").alias("id")).where(F.col("at") < F.lit(now).cast("timestamp"))
    return follow_tasks(before.unionByName(tick), lease_seconds, attempts).where("id IS NULL").select("task", "status", "attempts")
