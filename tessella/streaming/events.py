"""Streams over messages: limits, tokens and held-back answers with keyed state, and windowed counts with watermarks.

Each keyed rule is a fold of one key's rows in time order; the batch twins are
in ``tessella.operators.state``. ``events`` streams must carry a timestamp with
zone for watermarks (``with_event_time``).
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessella.functions.rules import split_visible
from tessella.operators.work_queue import ATTEMPTS, LEASE_SECONDS, Task, given_back, step


def read_events(spark: SparkSession, path: str, schema: str, per_batch: int = 1) -> DataFrame:
    """Parquet files of a landing folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(path)


def with_event_time(events: DataFrame, column: str = "ts", late: str = "10 minutes") -> DataFrame:
    """The column as a timestamp with a watermark behind it."""
    return events.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, late)


def tumbling_counts(events: DataFrame, column: str = "ts", width: str = "1 day") -> DataFrame:
    """Events per window and type. An extension: the reference flows have no event-time windows."""
    return events.groupBy(F.window(column, width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def idle_sessions(events: DataFrame, key: str = "user_id", column: str = "ts", gap: str = "30 minutes") -> DataFrame:
    """Threads that end after a time without messages."""
    return events.groupBy(key, F.session_window(column, gap).alias("w")).agg(F.count("*").alias("turns")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "turns")


def once(events: DataFrame, key: str = "event_id") -> DataFrame:
    """Each event once within the watermark."""
    return events.dropDuplicatesWithinWatermark([key])


def _rows(pdfs: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    return pd.concat(list(pdfs), ignore_index=True).sort_values(by, kind="stable")


def _later(state: GroupState, start: float | None, seconds: int) -> int:
    """When a key may be forgotten, in milliseconds of event time: long after its window, and after the watermark."""
    return int(max((start or 0.0) * 1000, state.getCurrentWatermarkMs()) + 2000 * seconds)


def rate_limited(hits: DataFrame, limit: int = 20, seconds: int = 60) -> DataFrame:
    """``key, id, used, allowed`` for hits ``key, id, at``: a key's window starts at its first hit and isn't prolonged; 0 is no limit.

    State is one start and one count per key, dropped when the window is long over.
    """

    def fold(key: Any, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        start, used = state.get if state.exists else (None, 0)
        rows, out = _rows(pdfs, ["at", "id"]), []
        for at in rows["at"]:
            moment = pd.Timestamp(at).timestamp()
            if start is None or moment - start >= seconds:
                start, used = moment, 0
            used += 1
            out.append(used)
        state.update((start, used))
        state.setTimeoutTimestamp(_later(state, start, seconds))
        yield pd.DataFrame({"key": rows["key"], "id": rows["id"], "used": out, "allowed": [limit <= 0 or u <= limit for u in out]})

    return with_event_time(hits.select("key", "id", "at"), "at").groupBy("key").applyInPandasWithState(
        fold, "key string, id long, used int, allowed boolean", "start double, used int", "append", GroupStateTimeout.EventTimeTimeout
    )


def token_takes(events: DataFrame, ttl_seconds: int = 900) -> DataFrame:
    """``token, id, ok`` for takes in ``token, action, id, at``: the first take within the time to live of an issued token."""

    def fold(key: Any, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        issued, taken = state.get if state.exists else (None, False)
        out = []
        for row in _rows(pdfs, ["at", "id"]).itertuples():
            moment = pd.Timestamp(row.at).timestamp()
            if row.action == "issue":
                issued = moment if issued is None else issued
            else:
                ok = issued is not None and not taken and moment - issued < ttl_seconds
                taken = taken or ok
                out.append((row.token, row.id, ok))
        state.update((issued, taken))
        state.setTimeoutTimestamp(_later(state, issued, ttl_seconds))
        yield pd.DataFrame(out, columns=["token", "id", "ok"])

    return with_event_time(events.select("token", "action", "id", "at"), "at").groupBy("token").applyInPandasWithState(
        fold, "token string, id long, ok boolean", "issued double, taken boolean", "append", GroupStateTimeout.EventTimeTimeout
    )


def leased_tasks(events: DataFrame, lease_seconds: int = LEASE_SECONDS, attempts: int = ATTEMPTS, late: str = "10 minutes") -> DataFrame:
    """``task, id, accepted, status, attempts`` for events ``task, action, worker, at, id`` of a work queue.

    A timer gives a lease back when the watermark has passed its end, as a row without ``id``, so that a worker that died
    holds its task no longer than that. State is one task, and goes with it when it is done or has failed: a later
    enqueue starts anew. Events that come after the watermark are refused with their time's rule, by the state there is.
    """
    names = ["task", "id", "accepted", "status", "attempts"]

    def fold(key: Any, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        task, out = Task(*state.get) if state.exists else Task(), []
        if state.hasTimedOut:
            task = given_back(task, task.until, attempts)
            out.append((key[0], None, True, task.status, task.attempts))
        else:
            for row in _rows(pdfs, ["at", "id"]).itertuples():
                task, ok = step(task, row.action, row.worker, pd.Timestamp(row.at).value // 1000, lease_seconds * 1_000_000, attempts)
                out.append((key[0], row.id, ok, task.status, task.attempts))
        if task.status in ("unknown", "done", "failed"):
            if state.exists:
                state.remove()
        else:
            state.update((task.status, task.attempts, task.until, task.worker))
            if task.status == "leased":
                state.setTimeoutTimestamp(max(task.until // 1000, state.getCurrentWatermarkMs() + 1))
        found = pd.DataFrame(out, columns=names)
        yield found.astype({"id": "Int64"})

    timed = with_event_time(events.select("task", "action", "worker", "at", "id").where("task IS NOT NULL AND at IS NOT NULL"), "at", late)
    return timed.groupBy("task").applyInPandasWithState(
        fold, "task string, id long, accepted boolean, status string, attempts int", "status string, attempts int, until long, worker string", "append", GroupStateTimeout.EventTimeTimeout
    )


def in_sequence(waiting: dict[int, str], expected: int, rows: Any, give_up: bool = False) -> tuple[list[tuple[int, str]], dict[int, str], int]:
    """Frames of one message whose turn has come, those that wait for a gap before them, and the number expected next.

    ``rows`` are new frames (``seq``, ``text``) in any order; numbers that were shown or wait already are repeats. Where
    ``give_up``, gaps are skipped and nothing waits.
    """
    waiting = dict(waiting)
    for seq, text in rows:
        if seq >= expected:
            waiting.setdefault(seq, text)
    out = []
    for seq in sorted(waiting):
        if seq != expected and not give_up:
            break
        out.append((seq, waiting.pop(seq)))
        expected = seq + 1
    return out, waiting, expected


def visible_deltas(deltas: DataFrame, patience_ms: int = 60_000, first: int = 1) -> DataFrame:
    """``message_id, seq, shown`` for growing answers ``message_id, seq, text``, numbered from ``first``: the start of a marker is held back until it is none.

    Frames that come before their turn wait in the message's state, over batches, until the gap closes; repeated ones are
    left out. After ``patience_ms`` without a frame what waits is shown in its order, what is held back too as no more can
    come, and the state goes; a later frame of that message starts anew.
    """

    def fold(key: Any, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, done, expected, waiting = state.get if state.exists else ("", False, first, "{}")
        late = state.hasTimedOut
        rows = [] if late else [(r.seq, r.text) for pdf in pdfs for r in pdf.itertuples()]
        turn, left, expected = in_sequence({int(k): v for k, v in json.loads(waiting).items()}, expected, rows, late)
        out = []
        for seq, text in turn:
            shown = ""
            if not done:
                buffer = held + (text or "")
                shown, held = split_visible(buffer)
                done = len(shown) + len(held) < len(buffer)  # the marker came: nothing after it is shown
            out.append((key[0], seq, shown))
        if late:
            if held and not done:
                out.append((key[0], expected, held))
            state.remove()
        else:
            state.update((held, done, expected, json.dumps(left)))
            state.setTimeoutDuration(patience_ms)
        yield pd.DataFrame(out, columns=["message_id", "seq", "shown"])

    return deltas.select("message_id", "seq", "text").groupBy("message_id").applyInPandasWithState(
        fold, "message_id long, seq long, shown string", "held string, done boolean, expected long, waiting string", "append", GroupStateTimeout.ProcessingTimeTimeout
    )


def last_final(frames: DataFrame) -> DataFrame:
    """What a subscriber shows of ``message_id, seq, event, text``: the last final, else the deltas in order. For use in ``foreachBatch``."""
    deltas = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("event") == "delta", F.struct("seq", "text")))), lambda x: x["text"]), "")
    final = F.max_by(F.when(F.col("event") == "final", F.col("text")), F.when(F.col("event") == "final", F.col("seq")))
    return frames.groupBy("message_id").agg(F.coalesce(final, deltas).alias("text"))


def run_once(stream: DataFrame, name: str, checkpoint: str, mode: str = "append", seconds: float = 60) -> DataFrame:
    """All available input through the stream into a table in memory (tests and small results).

    State that waits for the clock keeps a query alive with empty batches; after two of them it is stopped.
    """
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    until = time.monotonic() + seconds
    while not q.awaitTermination(0.2) and time.monotonic() < until:
        last = q.recentProgress[-2:]
        if len(last) == 2 and not any(p["numInputRows"] for p in last):
            q.stop()
            break
    return stream.sparkSession.table(name)
