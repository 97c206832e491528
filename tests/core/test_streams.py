"""Streams against their batch twins."""

import time
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tessella.operators import state, work_queue
from tessella.streaming import events as s

T0 = datetime(2024, 1, 1)


def _stream(spark, tmp_path, rows, schema, parts):
    folder = tmp_path / "in"
    for i, (a, b) in enumerate(zip([0, *parts], [*parts, len(rows)])):
        spark.createDataFrame(rows[a:b], schema).coalesce(1).write.mode("append").parquet(str(folder))
    return s.read_events(spark, str(folder), schema)


def test_rate_limit(spark, tmp_path):
    rows = [("k", i, T0 + timedelta(seconds=2 * i)) for i in range(25)] + [("k", 25, T0 + timedelta(seconds=61)), ("j", 26, T0)]
    schema = "key string, id long, at timestamp"
    got = s.run_once(s.rate_limited(_stream(spark, tmp_path, rows, schema, [10, 27])), "rates", str(tmp_path / "c"))
    twin = state.anchored_window_hits(spark.createDataFrame(rows, schema))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, twin.collect()))
    assert got.where("NOT allowed").count() == 5


def test_tokens(spark, tmp_path):
    rows = [("t", "issue", 1, T0), ("t", "take", 2, T0 + timedelta(seconds=5)), ("t", "take", 3, T0 + timedelta(seconds=6)), ("u", "issue", 4, T0), ("u", "take", 5, T0 + timedelta(seconds=901)), ("v", "take", 6, T0)]
    schema = "token string, action string, id long, at timestamp"
    got = s.run_once(s.token_takes(_stream(spark, tmp_path, rows, schema, [3])), "tokens", str(tmp_path / "c"))
    assert {r["id"]: r["ok"] for r in got.collect()} == {2: True, 3: False, 5: False, 6: False}
    twin = state.take_tokens(spark.createDataFrame(rows, schema))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, twin.collect()))


def test_marker_is_held_back(spark, tmp_path):
    rows = [(1, 1, "Ответ [ES"), (1, 2, "CAL"), (1, 3, "ATE] ещё"), (1, 4, "!"), (2, 1, "a [E"), (2, 2, "x]")]
    got = s.run_once(s.visible_deltas(_stream(spark, tmp_path, rows, "message_id long, seq long, text string", [2])), "deltas", str(tmp_path / "c"))
    shown = {m: "".join(r["shown"] for r in got.where(F.col("message_id") == m).orderBy("seq").collect()) for m in (1, 2)}
    assert shown == {1: "Ответ ", 2: "a [Ex]"}


def test_windows_and_duplicates(spark, tmp_path):
    rows = [(1, T0, "view"), (1, T0, "view"), (2, T0 + timedelta(days=1), "view"), (3, T0 + timedelta(days=3), "click")]
    schema = "event_id long, ts timestamp_ntz, event_type string"
    stream = s.tumbling_counts(s.once(s.with_event_time(_stream(spark, tmp_path, rows, schema, [2]))))
    got = s.run_once(stream, "daily", str(tmp_path / "c"))
    assert {(r["start"].day, r["n"]) for r in got.collect()} >= {(1, 1)}


def test_last_final(spark):
    rows = [(1, 1, "delta", "a"), (1, 2, "delta", "b"), (1, 3, "final", "AB"), (2, 2, "delta", "d"), (2, 1, "delta", "c")]
    got = s.last_final(spark.createDataFrame(rows, "message_id int, seq int, event string, text string"))
    assert {r["message_id"]: r["text"] for r in got.collect()} == {1: "AB", 2: "cd"}


def test_frames_over_several_batches_come_in_order(spark, tmp_path):
    """Frames shuffled over batches, repeated ones, a marker cut by the shuffle: the text of the frames in order."""
    frames = {1: ["Сал", "ом", " ба", " шумо", " [E", "SC]", "!"], 2: ["да ", "[ESC", "ALATE]", " нет"], 3: ["x"]}
    rows = [(m, k + 1, text) for m, texts in frames.items() for k, text in enumerate(texts)]
    rows = rows[::-1] + rows[:3]
    got = s.run_once(s.visible_deltas(_stream(spark, tmp_path, rows, "message_id long, seq long, text string", [2, 5, 9])), "shuffled", str(tmp_path / "c"))
    found = sorted(map(tuple, got.collect()))
    assert [x[:2] for x in found] == sorted((m, k + 1) for m, texts in frames.items() for k in range(len(texts)))
    assert {m: "".join(x[2] for x in found if x[0] == m) for m in frames} == {1: "Салом ба шумо [ESC]!", 2: "да ", 3: "x"}


def test_a_gap_that_stays_open(spark, tmp_path):
    """After the time without frames what waited is shown in its order, and what was held back too."""
    rows = [(1, 1, "a"), (1, 4, "d"), (1, 3, "c [ES"), (2, 1, "x [E")]
    deltas = _stream(spark, tmp_path, rows, "message_id long, seq long, text string", [])
    q = s.visible_deltas(deltas, patience_ms=10).writeStream.format("memory").queryName("gap").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="100 milliseconds").start()
    try:
        for _ in range(100):
            if spark.table("gap").count() == 5:
                break
            time.sleep(0.3)
    finally:
        q.stop()
    assert sorted(map(tuple, spark.table("gap").collect())) == [(1, 1, "a"), (1, 3, "c "), (1, 4, "[ESd"), (2, 1, "x "), (2, 2, "[E")]


_QUEUE = "task string, action string, worker string, at timestamp, id long"


def _queue_rows():
    """w1 dies with task a; b fails three times; c is done; d is claimed before it exists."""
    at = lambda s: T0 + timedelta(seconds=s)
    rows = [("a", "enqueue", None, at(0), 1), ("a", "claim", "w1", at(1), 2), ("a", "claim", "w2", at(5), 3), ("b", "enqueue", None, at(0), 4), ("c", "enqueue", None, at(0), 5), ("c", "claim", "w2", at(2), 6), ("c", "done", "w1", at(3), 7), ("c", "done", "w2", at(4), 8), ("d", "claim", "w1", at(6), 9)]
    for k in range(4):
        rows += [("b", "claim", "w1", at(10 + 2 * k), 20 + 2 * k), ("b", "fail", "w1", at(11 + 2 * k), 21 + 2 * k)]
    return rows + [("a", "claim", "w2", at(70), 40), ("a", "done", "w1", at(71), 41), ("a", "done", "w2", at(72), 42), ("c", "enqueue", None, at(80), 43)]


def test_leases_in_batch(spark):
    got = {r["id"]: tuple(r)[2:] for r in work_queue.follow_tasks(spark.createDataFrame(_queue_rows(), _QUEUE), 60).collect()}
    assert got[2] == (True, "leased", 1) and got[3] == (False, "leased", 1)
    assert got[40] == (True, "leased", 2) and got[41] == (False, "leased", 2) and got[42] == (True, "done", 2)
    assert got[7] == (False, "leased", 1) and got[8] == (True, "done", 1) and got[43] == (True, "queued", 0) and got[9] == (False, "unknown", 0)
    assert [got[21 + 2 * k] for k in range(4)] == [(True, "queued", 1), (True, "queued", 2), (True, "failed", 3), (False, "failed", 3)]
    odd = spark.createDataFrame([(None, "claim", "w", T0, 1), ("x", None, None, T0, 2), ("y", "enqueue", None, None, 3)], _QUEUE)
    assert [tuple(r) for r in work_queue.follow_tasks(odd).collect()] == [("x", 2, False, "unknown", 0)]
    assert work_queue.follow_tasks(odd.limit(0)).count() == 0


def test_leases_in_a_stream(spark, tmp_path):
    """Batches in order give the batch's rows; the timer gives back the lease of a worker that died, and the next gets the task."""
    rows = sorted(_queue_rows(), key=lambda r: (r[3], r[4]))
    late = [("z", "enqueue", None, T0 + timedelta(hours=1), 90), ("z", "claim", "w1", T0 + timedelta(hours=1, seconds=1), 91)]
    end = [("y", "enqueue", None, T0 + timedelta(hours=9), 92)]
    events = _stream(spark, tmp_path, rows + late + end, _QUEUE, [7, len(rows), len(rows) + 2])
    got = s.run_once(s.leased_tasks(events, 60, late="1 minute"), "leases", str(tmp_path / "c")).collect()
    twin = work_queue.follow_tasks(spark.createDataFrame(rows + late + end, _QUEUE), 60).collect()
    known = {r["id"]: tuple(r) for r in twin}
    for r in got:
        if r["id"] is not None:
            assert tuple(r) == known[r["id"]]
    assert {r["id"] for r in got} - {None} == set(known)
    assert [tuple(r) for r in got if r["id"] is None] == [("z", None, True, "queued", 1)]
