"""Hard negatives of anchors by exact integer scores, searched in an orthogonal rotation.

Vectors are quantised to integers and rotated to their principal components,
which keeps inner products. A partial product over leading components and the
product of the residual norms bound each score from both sides; pairs whose
bounds leave the range asked for, or lie below what k other pairs surely reach,
are discarded after a few components, and those that are left are scored with
integers. Slack for rounding goes into every bound, so that the result is that
of the integer products alone, whatever the rotation.

Rows stay where they are read; the anchors, a stated query set, are a table in the shared folder
that each task reads past its block of rows. The best of each block are ranked by a window.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.storage import lean, open_fs, shared_dir
from tessella.llm.words import mix

#: Every ANCHOR_EVERY-th ID is an anchor; the label of every RELABEL_EVERY-th is moved to the next of LABELS.
ANCHOR_EVERY, RELABEL_EVERY, LABELS = 50, 7, 10
#: Positives of an anchor, negatives of a positive, and the range of a negative's score in percent of the positive's.
POSITIVES, NEGATIVES, LOW_PERCENT, HIGH_PERCENT = 5, 3, 50, 95
#: Components become ``floor(SCALE * x)``, and stop at LARGEST on both sides, so that 2 ** 15 of them have a 64-bit product.
SCALE, LARGEST = 256, 1 << 24
#: Vectors of so many different lengths (the most frequent) and up to so many components are rotated; others are searched as they are.
ROTATED_LENGTHS, ROTATED_COMPONENTS = 4, 1024
#: Bytes of rows that a task holds while the anchors pass, rows and anchors that are bounded together, pairs verified at once.
BLOCK_BYTES, TILE_ROWS, TILE_ANCHORS, VERIFIED = 16 << 20, 4096, 256, 1 << 16
#: Parts that the sums of the second moments are added up in.
MOMENT_GROUPS = 256
_NO_ID = np.iinfo(np.int64).max


def quantised(embeddings: DataFrame) -> DataFrame:
    """``vec_id, label, q`` of the rows that take part: labels moved as stated, components as integers."""
    x = F.col("embedding")
    finite = ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    moved = F.when(F.col("vec_id") % RELABEL_EVERY == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    whole = F.transform(x, lambda v: F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), F.floor(v.cast("double") * SCALE))).cast("int"))
    rows = embeddings.where(F.col("label").isNotNull() & x.isNotNull() & finite)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), moved.cast("long").alias("label"), whole.alias("q"))


def _matrices(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of a batch by the length of their vectors: positions in the batch, and the vectors as a matrix."""
    lists = batch.column("q")
    offsets = np.frombuffer(lists.buffers()[1], np.int32)[lists.offset : lists.offset + len(lists) + 1]
    values = lists.values.to_numpy(zero_copy_only=False)
    lengths = np.diff(offsets)
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        yield at, values[offsets[:-1][at][:, None] + np.arange(n)]


def _moments(lengths: tuple[int, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {n: np.zeros((n, n)) for n in lengths}
        for batch in batches:
            for _, q in _matrices(batch):
                if q.shape[1] in sums:
                    sums[q.shape[1]] += q.astype(float).T @ q
        part = TaskContext.get().partitionId() % MOMENT_GROUPS
        yield pa.RecordBatch.from_pydict({"n": pa.array(list(sums), pa.int32()), "part": pa.array([part] * len(sums), pa.int32()), "m": [x.tobytes() for x in sums.values()]})

    return run


def _added(group: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x, float) for x in group.column("m").to_pylist())
    return pa.table({"n": group.column("n")[:1], "part": group.column("part")[:1], "m": [total.tobytes()]})


def rotations(rows: DataFrame) -> dict[int, np.ndarray]:
    """For each frequent length of vectors a matrix whose columns are the principal directions, leading ones first, of all rows of that length."""
    frequent = rows.groupBy(F.size("q").alias("n")).count().where(f"n BETWEEN 2 AND {ROTATED_COMPONENTS}").orderBy(F.desc("count"), "n").limit(ROTATED_LENGTHS)
    lengths = tuple(sorted(r.n for r in frequent.collect()))
    if not lengths:
        return {}
    schema = "n int, part int, m binary"
    parts = rows.select("q").mapInArrow(lean(_moments(lengths)), schema).groupBy("n", "part").applyInArrow(_added, schema)
    out = {}
    for n, m in ((r.n, np.frombuffer(r.m, float).reshape(r.n, r.n)) for r in parts.withColumn("part", F.lit(0)).groupBy("n", "part").applyInArrow(_added, schema).collect()):
        _, vectors = np.linalg.eigh(m)
        vectors = np.ascontiguousarray(vectors[:, ::-1])
        if np.isfinite(vectors).all() and np.abs(vectors.T @ vectors - np.eye(n)).max() <= 8 * n * np.finfo(float).eps:
            out[n] = vectors
    return out


class Side(NamedTuple):
    """Vectors of one side: IDs (missing ones last), labels, integers, rotated, norms of what follows each stage."""

    id: np.ndarray
    label: np.ndarray
    q: np.ndarray
    y: np.ndarray
    rest: np.ndarray

    def take(self, at) -> Side:
        return Side(*(x[at] for x in self))


def _stages(n: int) -> list[int]:
    return sorted({0, n // 4, n // 2, 3 * n // 4, n})


def side(ids: np.ndarray, labels: np.ndarray, q: np.ndarray, rotation: np.ndarray | None) -> Side:
    y = q.astype(float) if rotation is None else q.astype(float) @ rotation
    tail = np.concatenate([np.cumsum((y * y)[:, ::-1], axis=1)[:, ::-1], np.zeros((len(y), 1))], axis=1)
    return Side(ids, labels, q, y.astype(np.float32), np.sqrt(tail[:, _stages(q.shape[1])]).astype(np.float32))


def _slack(n: int) -> np.float32:
    """Of the product of two norms, what rounding can take from or add to a partial product, its margin and their sum: the rotation and its error in
    double, components, products and sums in single precision."""
    return np.float32(16 * (n + 1) ** 1.5 * np.finfo(float).eps + 4 * (n + 8) * np.finfo(np.float32).eps)


def survivors(anchors: Side, rows: Side, same_label: bool, bottom: np.ndarray, top: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs, as positions of anchor and row, whose score may lie between ``bottom`` and ``top`` of the anchor, both included. Rows of the anchor's own ID don't count."""
    n = rows.q.shape[1]
    stages = _stages(n)
    allowed = (anchors.label[:, None] == rows.label) == same_label
    allowed &= anchors.id[:, None] != rows.id
    at = np.flatnonzero(allowed.any(axis=0))
    if len(at) < allowed.shape[1]:
        rows, allowed = rows.take(at), allowed[:, at]
    partial = np.zeros(allowed.shape, np.float32)
    slack, low, high = _slack(n), bottom.astype(np.float32)[:, None], top.astype(np.float32)[:, None]
    for stage, (lo, hi) in enumerate(itertools.pairwise(stages), 1):
        partial += anchors.y[:, lo:hi] @ rows.y[:, lo:hi].T
        margin = anchors.rest[:, stage : stage + 1] * rows.rest[:, stage]
        margin += (slack * anchors.rest[:, :1]) * rows.rest[:, 0]
        margin += 1
        allowed &= partial >= low - margin
        allowed &= partial <= high + margin
        keep = np.flatnonzero(allowed.any(axis=0))
        if 2 * len(keep) < len(at):
            at, partial, allowed, rows = at[keep], partial[:, keep], allowed[:, keep], rows.take(keep)
    a, r = np.nonzero(allowed)
    return a, at[r]


def _scores(anchors: Side, rows: Side, a: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Integer inner products of pairs."""
    score = np.zeros(len(a), np.int64)
    for lo in range(0, len(a), VERIFIED):
        part = slice(lo, lo + VERIFIED)
        score[part] = np.einsum("ij,ij->i", anchors.q[a[part]].astype(np.int64), rows.q[r[part]].astype(np.int64))
    return score


def best(anchors: Side, rows: Side, same_label: bool, low: np.ndarray, high: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The first ``k`` rows of each anchor and range: anchor, range, row and score, as arrays.

    ``low`` and ``high`` have a row for each anchor and a column for each range;
    an empty range is one whose ends are crossed. Tiles of rows follow each
    other, the first ones small; in each only pairs count that may reach what
    ``k`` rows of the tiles before have.
    """
    reached = low.astype(float)
    top = np.where(low <= high, high, -np.inf).max(axis=1)
    empty = np.zeros(0, np.int64)
    found: list[tuple[np.ndarray, ...]] = [(empty, empty, empty, empty)] * low.shape[1]
    lo, size = 0, TILE_ROWS // 16
    while lo < len(rows.id):
        tile = rows.take(slice(lo, lo + size))
        a, r = survivors(anchors, tile, same_label, np.where(low <= high, reached, np.inf).min(axis=1), top)
        score = _scores(anchors, tile, a, r)
        for j in range(low.shape[1]):
            inside = (score >= reached[a, j]) & (score >= low[a, j]) & (score <= high[a, j])
            if not inside.any():
                continue
            old_a, old_r, old_id, old_score = found[j]
            all_a, all_r, all_score = np.append(old_a, a[inside]), np.append(old_r, r[inside] + lo), np.append(old_score, score[inside])
            all_id = np.append(old_id, tile.id[r[inside]])
            order = np.lexsort((all_id, -all_score, all_a))
            all_a = all_a[order]
            rank = np.arange(len(order)) - np.searchsorted(all_a, all_a, side="left")
            order, all_a = order[rank < k], all_a[rank < k]
            found[j] = (all_a, all_r[order], all_id[order], all_score[order])
            kth = rank[rank < k] == k - 1
            reached[all_a[kth], j] = found[j][3][kth]
        lo, size = lo + size, min(2 * size, TILE_ROWS)
    slots = np.repeat(np.arange(len(found)), [len(x[0]) for x in found])
    a, r, _, score = (np.concatenate(x) for x in zip(*found))
    return a, slots, r, score


def distinct_enough(rows: Side, k: int) -> Side:
    """Without copies that can't be among the first ``k``: of rows of equal label and vector the ``2 k`` least IDs, of those of equal ID too, ``k``. In the order of labels."""
    code = np.zeros(len(rows.id), np.uint64)
    with np.errstate(over="ignore"):
        for column in rows.q.T:
            code = mix(code + column.astype(np.uint64))
    order = np.lexsort((rows.id, code, rows.label))
    q, ids, label = rows.q[order], rows.id[order], rows.label[order]
    new = np.ones(len(order), bool)
    new[1:] = (label[1:] != label[:-1]) | (q[1:] != q[:-1]).any(axis=1)
    keep = np.ones(len(order), bool)
    for begins, most in ((new | np.append(True, ids[1:] != ids[:-1])[: len(ids)], k), (new, 2 * k)):
        kept = np.flatnonzero(keep)
        group = np.cumsum(begins)[kept]
        rank = np.arange(len(kept)) - np.searchsorted(group, group, side="left")
        keep[kept[rank >= most]] = False
    return rows.take(order[keep])


def _packs(folder: str) -> Iterator[pa.RecordBatch]:
    """The table of anchors, a pack after the other."""
    fs, base = open_fs(folder)
    for info in sorted(fs.get_file_info(pyarrow.fs.FileSelector(base)), key=lambda x: x.path):
        if info.path.endswith(".parquet"):
            with fs.open_input_file(info.path) as f:
                yield from pq.ParquetFile(f).iter_batches(TILE_ANCHORS)


def _ids(column: pa.Array) -> np.ndarray:
    return column.fill_null(_NO_ID).to_numpy(zero_copy_only=False)


_FOUND = "anchor_id long, anchor_key long, slot int, row_id long, score long"


def _search(folder: str, shared: Broadcast, same_label: bool, k: int):
    """Batches of rows against the anchors in ``folder``: with their columns ``low`` and ``high``, or any score where they have none."""

    def parts(anchors: Side, rows: Side) -> Iterator[tuple[np.ndarray, Side]]:
        """Anchors with the rows that they may be paired with: of their label, which rows are in the order of, or all."""
        if not same_label:
            yield np.arange(len(anchors.id)), rows
            return
        for label in np.unique(anchors.label):
            lo, hi = np.searchsorted(rows.label, [label, label + 1])
            yield np.flatnonzero(anchors.label == label), rows.take(slice(lo, hi))

    def against(blocks: dict[int, Side]) -> Iterator[pa.RecordBatch]:
        blocks = {n: distinct_enough(x, k) for n, x in blocks.items()}
        for pack in _packs(folder):
            for at, q in _matrices(pack):
                if (n := q.shape[1]) not in blocks:
                    continue
                anchors = side(_ids(pack.column("vec_id"))[at], pack.column("label").to_numpy()[at], q, shared.value.get(n))
                keys = pack.column("anchor_key").to_numpy()[at]
                low, high = np.full((len(at), 1), -np.inf), np.full((len(at), 1), np.inf)
                if "low" in pack.schema.names:
                    low = np.array([(x + [1] * POSITIVES)[:POSITIVES] for x in pack.column("low").to_pylist()], np.int64)[at]
                    high = np.array([(x + [0] * POSITIVES)[:POSITIVES] for x in pack.column("high").to_pylist()], np.int64)[at]
                for some, rows in parts(anchors, blocks[n]):
                    a, slot, r, score = best(anchors.take(some), rows, same_label, low[some], high[some], k)
                    if len(a):
                        a, ids = some[a], rows.id[r]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(anchors.id[a]), pa.array(keys[a]), pa.array(slot.astype(np.int32)), pa.array(ids, mask=ids == _NO_ID), pa.array(score)],
                            ["anchor_id", "anchor_key", "slot", "row_id", "score"],
                        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list[Side]] = {}
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            yield from against({n: Side(*(np.concatenate(x) for x in zip(*parts))) for n, parts in waiting.items()})

        for batch in batches:
            ids, labels = _ids(batch.column("vec_id")), batch.column("label").to_numpy()
            for at, q in _matrices(batch):
                waiting.setdefault(q.shape[1], []).append(side(ids[at], labels[at], q, shared.value.get(q.shape[1])))
                held += q.nbytes + 8 * len(at)
            if held >= BLOCK_BYTES:
                yield from flush()
                waiting.clear()
                held = 0
        if waiting:
            yield from flush()

    return lean(run)


def _first(found: DataFrame, k: int) -> DataFrame:
    """The first ``k`` of each anchor and slot with their rank from 1."""
    order = Window.partitionBy("anchor_id", "anchor_key", "slot").orderBy(F.desc("score"), F.col("row_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _percent(score: Column, percent: int, more: int, negative: int) -> Column:
    """``(percent * score + more) / 100`` without the fraction, in integers that don't overflow; ``negative`` for a negative score, which has no range."""
    hundreds = F.call_function("div", score, F.lit(100))
    return F.when(score < 0, F.lit(negative).cast("long")).otherwise(hundreds * percent + F.call_function("div", (score % 100) * percent + more, F.lit(100)))


def mine(embeddings: DataFrame) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` of ``embeddings`` (``vec_id``, ``embedding``, ``label``).

    Rows with a null label, a null vector or a component that is null or not
    finite take no part; other columns are ignored, whatever their names.
    Vectors meet those of their own length only. A row with a null ``vec_id`` is no anchor and comes last in
    ties. Repeated rows take a place each as positives and negatives, but are one anchor; no
    row is a positive of its own ID. Components beyond ``LARGEST`` stop there.
    A positive whose range holds no negative gives no row, and so does an empty table.
    """
    spark = embeddings.sparkSession
    rows = quantised(embeddings)
    shared = spark.sparkContext.broadcast(rotations(rows))  # at most ROTATED_LENGTHS * ROTATED_COMPONENTS ** 2 * 8 bytes
    anchors = rows.where(F.col("vec_id") % ANCHOR_EVERY == 0).dropDuplicates(["vec_id", "label", "q"])
    anchors = anchors.withColumn("anchor_key", F.xxhash64("label", "q"))
    folder = shared_dir(spark)
    anchors.write.parquet(f"{folder}/anchors")
    anchors = spark.read.parquet(f"{folder}/anchors")
    positives = _first(rows.mapInArrow(_search(f"{folder}/anchors", shared, True, POSITIVES), _FOUND), POSITIVES)
    positives.select("anchor_id", "anchor_key", "rank", F.col("row_id").alias("positive_id"), F.col("score").alias("positive_score")).write.parquet(f"{folder}/positives")
    positives = spark.read.parquet(f"{folder}/positives")
    ranges = positives.groupBy("anchor_id", "anchor_key").agg(F.sort_array(F.collect_list(F.struct("rank", "positive_score"))).alias("found"))  # POSITIVES at most
    ranges = ranges.select(
        F.col("anchor_id").alias("vec_id"), "anchor_key",
        F.transform("found", lambda x: _percent(x["positive_score"], LOW_PERCENT, 99, 1)).alias("low"), F.transform("found", lambda x: _percent(x["positive_score"], HIGH_PERCENT, 0, 0)).alias("high"),
    )
    anchors.join(ranges, ["vec_id", "anchor_key"]).write.parquet(f"{folder}/ranges")
    negatives = _first(rows.mapInArrow(_search(f"{folder}/ranges", shared, False, NEGATIVES), _FOUND), NEGATIVES)
    negatives = negatives.select("anchor_id", "anchor_key", (F.col("slot") + 1).alias("slot"), "rank", F.col("row_id").alias("negative_id"), F.col("score").alias("negative_score"))
    both = positives.withColumnRenamed("rank", "slot").join(negatives, ["anchor_id", "anchor_key", "slot"])
    return both.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
