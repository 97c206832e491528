"""Exact removal of word windows that an earlier document already has.

Fixed-block anchors: of each document the non-overlapping blocks of ``window //
2`` words are indexed, every rolling block of every document probes that index,
and hits are extended to maximal exact repeats, that is to the union of all
windows of ``window`` words around them that really occur in a document of
smaller ``doc_id``. Any such window holds a whole indexed block of the earlier
document, so that none is missed.

Rolling blocks outnumber the words of the index by far, so they are shuffled
packed: texts are taken in slices, the hash space is cut in buckets, and a row
holds all probes of one slice in one bucket, six bytes for each. Slices and
buckets grow with the data up to a bound, so that rows stay long. Equal blocks of one slice are sent once, so that a passage which a third
of the documents share costs a bucket one entry per slice. The words of windows
that are left (repeated regions only) meet in the same way under 96-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.storage import lean
from tessella.llm.words import U64, WHITESPACE_WORDS, Words, find_words, mix, slices, window_hashes, windows_inside

WINDOW = 50
#: Text that is hashed at once.
SLICE_BYTES = 1 << 20
#: Text that the entries of one bucket come from, on average, and text of one slice; the least and the most of each.
BUCKET_BYTES, BUCKET_MOST = 8 << 20, 32 << 20
PACKED_BYTES, PACKED_MOST = 1 << 20, 16 << 20
#: Bucket and slice grow from this size of all texts on.
GROWS_FROM = 4 << 30
#: Text of one partition of the joins that bring hits to the texts.
JOIN_BYTES = 64 << 20

_PACKED = pa.schema([("key", pa.int64()), ("slice", pa.int64()), ("entries", pa.binary()), ("at", pa.binary()), ("ids", pa.binary())])
_PACKED_SQL = "key long, slice long, entries binary, at binary, ids binary"
_FOUND_SQL = "slice long, at binary, least binary, ids binary"


def _bucket(hashes: np.ndarray, n: int) -> np.ndarray:
    return ((hashes >> U64(32)) * U64(n) >> U64(32)).astype(np.int64)


def _equal(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order that puts equal hashes together with the earliest first, whether each is the first of its kind, and the group of each."""
    order = np.argsort(hashes, kind="stable")
    sorted_ = hashes[order]
    head = np.concatenate([[True], sorted_[1:] != sorted_[:-1]])
    return order, head, np.cumsum(head) - 1


def _table(doc_ids: np.ndarray, text_hashes: np.ndarray, first: np.ndarray, copies: tuple[np.ndarray, np.ndarray]) -> bytes:
    """What it takes to get from places in a slice back to documents, and from the first of equal blocks to the others."""
    sizes = np.array([len(doc_ids), len(copies[0])], np.int64)
    return b"".join(x.astype(np.int64).tobytes() for x in (sizes, doc_ids, text_hashes, first, *copies))


def _untable(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    x = np.frombuffer(raw, np.int64)
    d, c = int(x[0]), int(x[1])
    cuts = np.cumsum([2, d, d, d + 1, c, c])
    return tuple(x[a:b] for a, b in zip(cuts, cuts[1:]))  # type: ignore[return-value]


def _rows(slice_id: int, bucket: np.ndarray, entries: list[np.ndarray], at: np.ndarray, table: bytes, n_buckets: int) -> pa.RecordBatch:
    """A row for each bucket that the slice has entries in, and one with the table; ``at`` ascends and is stored as differences."""
    order = np.argsort(bucket.astype(np.uint16) if n_buckets < 65536 else bucket, kind="stable")
    bucket, at, entries = bucket[order], at[order], [e[order] for e in entries]
    cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
    ends = np.append(cuts[1:], len(bucket)) if len(cuts) else cuts
    keys, body, places = [], [], []
    for a, b in zip(cuts.tolist(), ends.tolist()):
        steps = np.diff(at[a:b], prepend=0)
        steps = steps.astype(np.uint16 if steps.max() < 65536 else np.uint32)
        keys.append(int(bucket[a]))
        body.append(b"".join(e[a:b].tobytes() for e in entries))
        places.append(steps.tobytes())
    n = len(keys)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([*keys, -1 - slice_id % n_buckets], pa.int64()), pa.array([slice_id] * (n + 1), pa.int64()),
            pa.array([*body, None], pa.binary()), pa.array([*places, None], pa.binary()), pa.array([None] * n + [table], pa.binary()),
        ],
        schema=_PACKED,
    )


def _places(raw: bytes, n: int) -> np.ndarray:
    return np.cumsum(np.frombuffer(raw, np.uint16 if len(raw) == 2 * n else np.uint32), dtype=np.int64)


class _Slice:
    """Windows of several pieces of a batch, gathered until they make a slice."""

    def __init__(self, n_arrays: int):
        self.arrays: list[list[np.ndarray]] = [[] for _ in range(n_arrays)]
        self.ids: list[np.ndarray] = []
        self.hashes: list[np.ndarray] = []
        self.first: list[np.ndarray] = [np.zeros(1, np.int64)]
        self.docs = self.words = self.bytes = 0

    def add(self, ids: np.ndarray, text_hashes: np.ndarray, words: Words, place: np.ndarray, doc: np.ndarray, *values: np.ndarray) -> None:
        for kept, value in zip(self.arrays, (place + self.words, doc + self.docs, *values)):
            kept.append(value)
        self.ids.append(ids)
        self.hashes.append(text_hashes)
        self.first.append(words.first[1:] + self.words)
        self.docs += len(ids)
        self.words += int(words.first[-1])
        self.bytes += len(words.data)

    def gathered(self) -> tuple[np.ndarray, ...]:
        """IDs and hashes of the texts, first words, and the arrays; empty ones if there is no window."""
        if not self.ids:
            return ()
        return (np.concatenate(self.ids), np.concatenate(self.hashes), np.concatenate(self.first), *map(np.concatenate, self.arrays))


def _pieces(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, Words]]:
    for lo, hi in slices(batch.column("text"), SLICE_BYTES):
        part = batch.slice(lo, hi - lo)
        yield part, find_words(part.column("text"), WHITESPACE_WORDS)


def _packer(window: int, n_buckets: int, slice_bytes: int):
    """Probes of all rolling blocks; the lowest bits of an entry say that it is an indexed block too, and that several documents of the slice have it."""
    block = window // 2

    def probes(found: _Slice, slice_id: int) -> Iterator[pa.RecordBatch]:
        if not found.ids:
            return
        ids, text_hashes, first, valid, doc, hashes, aligned = found.gathered()
        order, head, group = _equal(hashes)
        firsts = order[head]
        starts = np.flatnonzero(head)
        indexed = np.bitwise_or.reduceat(aligned[order], starts)
        several = np.maximum.reduceat(doc[order], starts) != np.minimum.reduceat(doc[order], starts)
        entry = np.zeros(len(valid), np.uint32)
        entry[firsts] = (hashes[firsts] & U64(0x3FFFFFFF)).astype(np.uint32) << np.uint32(2) | indexed.astype(np.uint32) << np.uint32(1) | several
        again = order[~head]
        table = _table(ids, text_hashes, first, (valid[firsts[group[~head]]], valid[again]))
        kept = np.sort(firsts)
        yield _rows(slice_id, _bucket(hashes[kept], n_buckets), [entry[kept]], valid[kept], table, n_buckets)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TaskContext.get().partitionId() << 32
        found = _Slice(4)
        for batch in batches:
            for part, words in _pieces(batch):
                valid = np.flatnonzero(windows_inside(words.first, block))
                if not len(valid):
                    continue
                doc = np.repeat(np.arange(len(part)), words.counts)[valid]
                aligned = (valid - words.first[doc]) % block == 0
                found.add(part.column("doc_id").to_numpy(), part.column("text_hash").to_numpy(), words, valid, doc, window_hashes(words.hash, block)[valid], aligned)
                if found.bytes >= slice_bytes:
                    yield from probes(found, counter)
                    counter, found = counter + 1, _Slice(4)
        yield from probes(found, counter)

    return pack


def _match(group: pa.Table) -> pa.Table:
    """Entries of a bucket whose block is indexed somewhere and occurs in several documents."""
    if group.column("key")[0].as_py() < 0:
        none = pa.nulls(len(group), pa.binary())
        return pa.table({"slice": group.column("slice"), "at": none, "least": none, "ids": group.column("ids")})
    raw = group.column("entries").to_pylist()
    entries = np.frombuffer(b"".join(raw), np.uint32)
    sizes = [len(x) // 4 for x in raw]
    order = np.argsort(entries >> np.uint32(2), kind="stable")
    keys = (entries >> np.uint32(2))[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    count = np.diff(np.append(starts, len(keys)))
    flags = np.bitwise_or.reduceat(entries[order], starts)
    shared = (flags & 2 > 0) & ((flags & 1 > 0) | (count > 1))
    hit = np.zeros(len(entries), bool)
    hit[order] = np.repeat(shared, count)
    out, lo = [], 0
    for n, at in zip(sizes, group.column("at").to_pylist()):
        own = hit[lo : lo + n]
        out.append(_places(at, n)[own].tobytes() if own.any() else None)
        lo += n
    found = pa.array(out, pa.binary())
    none = pa.nulls(len(group), pa.binary())
    return pa.table({"slice": group.column("slice"), "at": found, "least": none, "ids": none}).filter(found.is_valid())


def _gathered(group: pa.Table) -> tuple[np.ndarray, np.ndarray, tuple] | None:
    """Places, the least documents that go with them, and the slice's table."""
    at = np.frombuffer(b"".join(x for x in group.column("at").to_pylist() if x), np.int64)
    least = np.frombuffer(b"".join(x for x in group.column("least").to_pylist() if x), np.int64)
    table = next((x for x in group.column("ids").to_pylist() if x), None)
    return (at, least, _untable(table)) if len(at) and table else None


def _per_doc(at: np.ndarray, table: tuple) -> tuple[np.ndarray, list[np.ndarray]]:
    """Documents (as places in the table) and the ascending word numbers in each."""
    at = np.unique(at)
    doc = np.searchsorted(table[2], at, side="right") - 1
    docs, starts = np.unique(doc, return_index=True)
    return docs, np.split(at - table[2][doc], starts[1:])


def _resolve_hits(group: pa.Table) -> pa.Table:
    found = _gathered(group)
    if not found:
        return pa.table({"doc_id": pa.array([], pa.int64()), "text_hash": pa.array([], pa.int64()), "hits": pa.array([], pa.binary())})
    at, _, table = found
    heads, copies = table[3], table[4]
    docs, lists = _per_doc(np.concatenate([at, copies[np.isin(heads, at)]]), table)
    return pa.table({"doc_id": table[0][docs], "text_hash": table[1][docs], "hits": pa.array([x.astype(np.uint32).tobytes() for x in lists], pa.binary())})


def _window_packer(window: int, n_buckets: int, slice_bytes: int):
    """Windows around hits, with the least document of the slice that has each."""
    block = window // 2

    def entries(found: _Slice, slice_id: int) -> Iterator[pa.RecordBatch]:
        if not found.ids:
            return
        ids, text_hashes, first, valid, doc, hashes, second = found.gathered()
        order, head, group = _equal(hashes)
        firsts, starts = order[head], np.flatnonzero(head)
        least = np.minimum.reduceat(ids[doc][order], starts)
        several = least != np.maximum.reduceat(ids[doc][order], starts)
        least_of = np.zeros(len(valid), np.int64)
        least_of[firsts] = least
        second[firsts] |= several.astype(np.uint32)
        again = order[~head]
        table = _table(ids, text_hashes, first, (valid[firsts[group[~head]]], valid[again]))
        kept = np.sort(firsts)
        yield _rows(slice_id, _bucket(hashes[kept], n_buckets), [hashes[kept], least_of[kept], second[kept]], valid[kept], table, n_buckets)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TaskContext.get().partitionId() << 32
        found = _Slice(4)
        for batch in batches:
            for part, words in _pieces(batch):
                if words.first[-1] < window:
                    continue
                edges = np.zeros(int(words.first[-1]) + 1, np.int32)
                for d, raw in enumerate(part.column("hits").to_pylist()):
                    hits = words.first[d] + np.frombuffer(raw, np.uint32).astype(np.int64)
                    np.add.at(edges, np.maximum(hits - (window - block), words.first[d]), 1)
                    np.add.at(edges, hits + 1, -1)
                near = np.cumsum(edges[:-1]) > 0
                inside = windows_inside(words.first, window)
                valid = np.flatnonzero(inside & near[: len(inside)])
                if not len(valid):
                    continue
                more = window_hashes(words.hash ^ U64(0x5851F42D4C957F2D), window)[valid]
                doc = np.repeat(np.arange(len(part)), words.counts)[valid]
                second = (more >> U64(32)).astype(np.uint32) & np.uint32(0xFFFFFFFE)
                found.add(part.column("id_key").to_numpy(), part.column("text_hash").to_numpy(), words, valid, doc, window_hashes(words.hash, window)[valid], second)
                if found.bytes >= slice_bytes:
                    yield from entries(found, counter)
                    counter, found = counter + 1, _Slice(4)
        yield from entries(found, counter)

    return pack


def _least(group: pa.Table) -> pa.Table:
    """Entries of a bucket whose window a smaller document has too, with the smallest."""
    if group.column("key")[0].as_py() < 0:
        none = pa.nulls(len(group), pa.binary())
        return pa.table({"slice": group.column("slice"), "at": none, "least": none, "ids": group.column("ids")})
    raw = group.column("entries").to_pylist()
    sizes = [len(x) // 20 for x in raw]
    hashes = np.concatenate([np.frombuffer(x, U64, n) for x, n in zip(raw, sizes)])
    own = np.concatenate([np.frombuffer(x, np.int64, n, 8 * n) for x, n in zip(raw, sizes)])
    second = np.concatenate([np.frombuffer(x, np.uint32, n, 16 * n) for x, n in zip(raw, sizes)])
    order = np.lexsort((second >> np.uint32(1), hashes))
    h, s = hashes[order], second[order] >> np.uint32(1)
    starts = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (s[1:] != s[:-1])]))
    low = np.zeros(len(own), np.int64)
    low[order] = np.repeat(np.minimum.reduceat(own[order], starts), np.diff(np.append(starts, len(h))))
    hit = (low < own) | (second & 1 > 0)
    at_out, low_out, lo = [], [], 0
    for n, at in zip(sizes, group.column("at").to_pylist()):
        mine = hit[lo : lo + n]
        at_out.append(_places(at, n)[mine].tobytes() if mine.any() else None)
        low_out.append(low[lo : lo + n][mine].tobytes() if mine.any() else None)
        lo += n
    found = pa.array(at_out, pa.binary())
    return pa.table({"slice": group.column("slice"), "at": found, "least": pa.array(low_out, pa.binary()), "ids": pa.nulls(len(group), pa.binary())}).filter(found.is_valid())


def _resolve_windows(group: pa.Table) -> pa.Table:
    found = _gathered(group)
    none = pa.table({"doc_id": pa.array([], pa.int64()), "text_hash": pa.array([], pa.int64()), "starts": pa.array([], pa.binary())})
    if not found:
        return none
    at, least, table = found
    order = np.argsort(at)
    at, least = at[order], least[order]
    heads, copies = table[3], table[4]
    where = np.searchsorted(at, heads)
    same = np.flatnonzero((where < len(at)) & (at[np.minimum(where, len(at) - 1)] == heads))
    at, least = np.concatenate([at, copies[same]]), np.concatenate([least, least[where[same]]])
    doc = np.searchsorted(table[2], at, side="right") - 1
    at = at[table[0][doc] > least]
    if not len(at):
        return none
    docs, lists = _per_doc(at, table)
    return pa.table({"doc_id": table[0][docs], "text_hash": table[1][docs], "starts": pa.array([x.astype(np.uint32).tobytes() for x in lists], pa.binary())})


def _finisher(window: int, with_text: bool):
    names = ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept_text"] * with_text

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, starts = batch.column("text").to_pylist(), batch.column("starts").to_pylist()
            rows: list[tuple] = []
            for text, raw in zip(texts, starts):
                words = (text or "").encode().split()
                n, removed = len(words), 0
                if raw:
                    edges = np.zeros(n + 1, np.int32)
                    at = np.frombuffer(raw, np.uint32).astype(np.int64)
                    edges[at] += 1
                    np.add.at(edges, at + window, -1)
                    gone = np.cumsum(edges[:-1]) > 0
                    removed = int(gone.sum())
                    words = [words[i] for i in np.flatnonzero(~gone)]
                kept = b" ".join(words)
                rows.append((n, removed, hashlib.sha256(kept).hexdigest(), kept.decode()) if with_text else (n, removed, hashlib.sha256(kept).hexdigest()))
            columns = [pa.array(x) for x in zip(*rows)] if rows else []
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=names)

    return finish


def remove_repeats(docs: DataFrame, window: int = WINDOW, with_text: bool = False) -> DataFrame:
    """Words of each row of ``docs`` (``doc_id``, ``text``) without those that an earlier document has.

    A word is removed if some window of ``window`` consecutive words that
    covers it also starts in a document of smaller ``doc_id``; windows are
    judged on the input. Words are runs of anything but ASCII white space.
    Returns ``doc_id, n_words, n_removed, kept_sha256`` (and ``kept_text``: the
    kept words joined by a space), a row for each input row. A null text has no
    words; a null ``doc_id`` is neither smaller nor larger than any, so such a
    row keeps all its words; rows of equal ``doc_id`` don't remove each
    other's. ``docs`` must give the same rows in the same order when it is read
    again, as tables do.
    """
    words = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("id_key"), F.xxhash64(F.coalesce("text", F.lit("\0null"))).alias("text_hash"), "text"
    )
    known = words.where("doc_id IS NOT NULL AND text IS NOT NULL")
    total = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    growth = max(1, total // GROWS_FROM)
    n_buckets = max(16, -(-total // min(BUCKET_BYTES * growth, BUCKET_MOST)))
    slice_bytes = min(PACKED_BYTES * growth, PACKED_MOST)
    keys = ["id_key", "text_hash"]
    partitions = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // JOIN_BYTES))
    words = words.repartition(partitions, *keys)  # both joins read this one exchange
    hits = (
        known.mapInArrow(lean(_packer(window, n_buckets, slice_bytes)), _PACKED_SQL)
        .groupBy("key").applyInArrow(_match, _FOUND_SQL)
        .groupBy("slice").applyInArrow(_resolve_hits, "doc_id long, text_hash long, hits binary")
        .groupBy(F.col("doc_id").alias("id_key"), "text_hash").agg(F.max("hits").alias("hits"))  # of repeated rows, that have equal hits
    )
    # both joins read ``words`` by the same keys, which can't be null, so that the texts are shuffled once
    starts = (
        words.join(hits.hint("merge"), keys)
        .mapInArrow(lean(_window_packer(window, n_buckets, slice_bytes)), _PACKED_SQL)
        .groupBy("key").applyInArrow(_least, _FOUND_SQL)
        .groupBy("slice").applyInArrow(_resolve_windows, "doc_id long, text_hash long, starts binary")
        .groupBy(F.col("doc_id").alias("id_key"), "text_hash").agg(F.max("starts").alias("starts"))
    )
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    own = F.when(F.col("doc_id").isNotNull(), F.col("starts")).alias("starts")
    return words.join(starts.hint("merge"), keys, "left").select("doc_id", "text", own).mapInArrow(lean(_finisher(window, with_text)), schema)
