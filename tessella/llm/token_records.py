"""Token ids as length-delimited binary records with a separate offset index.

Texts are ranged by ``doc_id``; each range is written by one task as a shard:
a header, then for each document its length, the masked checksum of the length,
the ids, and the masked checksum of the ids. The index, a Parquet table that
Spark commits, says in which shard and at which byte each record starts, so
that readers can fetch records in any order (``shuffled_records``). A shard that a failed or repeated
attempt left behind isn't in the index and is never read.
"""

from __future__ import annotations

import os
import struct
import unicodedata
import uuid
import zlib
from collections import OrderedDict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.storage import kept, lean, materialize, open_fs, shared_dir, small_batches

MAGIC = b"TSLREC01"
#: Header (format, bytes of an id), length and checksum, as ``struct`` formats.
_HEADER, _LENGTH, _CHECK = "<8sI", "<Q", "<I"
#: Words kept with their ids in each Python worker; the table starts anew beyond.
CACHED_WORDS = 200_000
#: Bytes of text, or of records, that one task writes or reads; less where there are too few tasks for the executors.
TASK_BYTES = 256 << 20
_LONGEST_CACHED = 64
#: Shards that a task of shuffled reads holds open.
OPEN_SHARDS = 64
#: Punctuation that is a pre-token of its own after letters.
_TAIL = ".,!?;:&$#%*"
#: Letters whose lower case depends on others or is longer, and how special tokens begin.
_AS_IT_IS = ("\u0130", "\u03a3", "<|")


def _lowered(text: str) -> str:
    """The text in lower case, as the normalizer makes it anyway, where that is sure to be the same."""
    if text.isascii():
        return text if "<|" in text else text.lower()
    if any(x in text for x in _AS_IT_IS) or not unicodedata.is_normalized("NFC", text):
        return text
    lowered = text.lower()  # may compose where the capital letter doesn't
    return lowered if unicodedata.is_normalized("NFC", lowered) else text


def masked_crc(data: bytes) -> int:
    """CRC-32, rotated and offset, so that a checksum of data that holds checksums stays sound."""
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    """The tokenizer, and one with its model alone that takes pre-tokens between blanks as they are."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer, pre_tokenizers

    whole = Tokenizer.from_file(path)
    bare = Tokenizer(whole.model)  # one model for both; no normalizer, as its pre-tokens are normalized
    bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return whole, bare


class Encoder:
    """Encodes texts word by word, remembering words.

    The tokenizer's pre-tokenizer drops white space and never joins what it
    separates, and neither does its normalizer, so that the ids of a text are
    those of its pieces between blanks, tabs and line feeds. A piece of letters
    and a tail of plain punctuation is two pre-tokens, of which the first is
    lower-cased and in NFC; those are remembered by themselves, and new ones are encoded
    many at a time, in one text, where each is one pre-token.
    """

    def __init__(self, path: str, end_id: int):
        self.tokenizer, self.bare = _tokenizer(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 65536 else "<u4")
        self.end = np.array([end_id], self.dtype).tobytes()
        self.known: dict[str, bytes] = {"": b""}
        self.cores: dict[str, bytes] = kept(path)  # for the next task of the worker too
        self.cores[""] = b""

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text and the end id, as little-endian ``dtype``."""
        pieces = [_lowered(t).replace("\n", " ").replace("\t", " ").split(" ") for t in texts]
        if len(self.known) > CACHED_WORDS:
            self.known = {"": b""}
        if len(self.cores) > CACHED_WORDS * 3 // 2:
            self.cores.clear()
            self.cores[""] = b""
        new = set().union(*pieces) - self.known.keys()
        self._learn(new)
        ids, end = self.known.__getitem__, self.end
        out = [b"".join(map(ids, p)) + end for p in pieces]
        for piece in new:
            if len(piece) > _LONGEST_CACHED:
                del self.known[piece]
        return out

    def _learn(self, new: set[str]) -> None:
        """Ids of pieces that aren't known yet."""
        known, cores = self.known, self.cores
        parts: list[tuple[str, str, str]] = []
        others: list[str] = []
        for piece in new:
            core = piece.rstrip(_TAIL)
            tail = piece[len(core) :]
            if core in cores:  # so it is a pre-token by itself
                if tail in cores:
                    known[piece] = cores[core] + cores[tail]
                else:
                    parts.append((piece, core, tail))
            elif core.isalpha() and core.lower() == core and (core.isascii() or unicodedata.is_normalized("NFC", core)):
                parts.append((piece, core, tail))
            else:
                others.append(piece)
        fresh = [x for x in {x for _, core, tail in parts for x in (core, tail)} if x not in cores]
        for lo in range(0, len(fresh), 1000):
            group = fresh[lo : lo + 1000]
            cores.update(zip(group, self._together(group)))
        for piece, core, tail in parts:
            known[piece] = cores[core] + cores[tail]
        for lo in range(0, len(others), 20_000):
            for piece, e in zip(others[lo : lo + 20_000], self.tokenizer.encode_batch_fast(others[lo : lo + 20_000], add_special_tokens=False)):
                known[piece] = np.array(e.ids, self.dtype).tobytes()

    def _together(self, group: list[str]) -> list[bytes]:
        """Ids of pre-tokens that are encoded in one text; one by one if the numbers don't agree."""
        e = self.bare.encode(" ".join(group), add_special_tokens=False)
        of = np.array(e.word_ids)
        if len(of) and of[-1] == len(group) - 1 and len(np.unique(of)) == len(group):
            raw, width = np.array(e.ids, self.dtype).tobytes(), self.dtype.itemsize
            cuts = np.concatenate([np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])), [len(of)]]) * width
            return [raw[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
        return [np.array(x.ids, self.dtype).tobytes() for x in self.tokenizer.encode_batch_fast(group, add_special_tokens=False)]


_INDEX = pa.schema([("doc_id", pa.int64()), ("shard", pa.string()), ("record", pa.int64()), ("offset", pa.int64()), ("length", pa.int64()), ("n_tokens", pa.int64()), ("before", pa.int64())])
_INDEX_SQL = "doc_id long, shard string, record long, offset long, length long, n_tokens long, before long"


def _writer(folder: str, path: str, end_id: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, stream, shard = Encoder(path, end_id), None, ""
        record = offset = before = 0
        try:
            for batch in batches:
                ids, texts = batch.column("doc_id"), batch.column("text").to_pylist()
                rows: list[tuple[int, int, int, int, int]] = []
                lo = size = 0
                for hi in range(1, len(texts) + 1):
                    size += len(texts[hi - 1] or "")
                    if size < 1 << 20 and hi < len(texts):
                        continue
                    for raw in encoder.encode([t or "" for t in texts[lo:hi]]):
                        if stream is None:
                            shard = f"shard-{TaskContext.get().partitionId():08d}-{uuid.uuid4().hex}.rec"
                            fs, base = open_fs(folder)
                            fs.create_dir(base, recursive=True)
                            stream = fs.open_output_stream(f"{base}/{shard}")
                            offset = stream.write(struct.pack(_HEADER, MAGIC, encoder.dtype.itemsize))
                        length = struct.pack(_LENGTH, len(raw))
                        n = len(raw) // encoder.dtype.itemsize
                        rows.append((record, offset, len(raw), n, before))
                        offset += stream.write(b"".join((length, struct.pack(_CHECK, masked_crc(length)), raw, struct.pack(_CHECK, masked_crc(raw)))))
                        record, before = record + 1, before + n
                    lo, size = hi, 0
                if rows:
                    columns = [pa.array(x, pa.int64()) for x in zip(*rows)]
                    yield pa.RecordBatch.from_arrays([ids, pa.array([shard] * len(rows)), *columns], schema=_INDEX)
        finally:
            if stream is not None:
                stream.close()

    return write


def _tasks(df: DataFrame, size: Column) -> int:
    """How many ranges rows of ``size`` bytes make."""
    total = df.agg(F.sum(size)).first()[0] or 0
    return max(2 * df.sparkSession.sparkContext.defaultParallelism, -(-total // TASK_BYTES))


def write_records(docs: DataFrame, tokenizer_path: str, end_id: int = 1, folder: str | None = None) -> tuple[DataFrame, str]:
    """Encode ``docs`` (``doc_id``, ``text``), write the shards to ``folder``, and return the committed index and the folder.

    Records are in ascending ``doc_id`` (null first; ties by text hash) within
    a shard and from shard to shard, so that rows of one ``doc_id``, or of none,
    may fill many shards. A null text is an empty one, and has the end id alone;
    every row makes a record, repeated rows too. An empty table writes no shard.
    Two passes over the texts' lengths and a sample of ``doc_id`` set the ranges.
    """
    folder = folder or shared_dir(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    place = "doc_id", F.xxhash64("text")
    ordered = rows.repartitionByRange(_tasks(rows, F.octet_length("text")), *place).sortWithinPartitions(*place)
    with small_batches(docs.sparkSession):
        return materialize(ordered.mapInArrow(lean(_writer(folder, tokenizer_path, end_id), tokenizer_path), _INDEX_SQL)), folder


def with_starts(index: DataFrame) -> DataFrame:
    """``index`` with ``start``, the ids of all records before: prefix sums of the shards, a row each, plus those inside.

    Names of shards are in the order of their ranges.
    """
    shards = index.groupBy("shard").agg(F.sum("n_tokens").alias("total"))
    ahead = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.select("shard", F.coalesce(F.sum("total").over(ahead), F.lit(0)).alias("ahead"))
    return index.join(shards, "shard").withColumn("start", F.col("ahead") + F.col("before")).drop("ahead")


def _width(header: bytes) -> int:
    """Bytes of an id in a shard that begins so."""
    magic, width = struct.unpack(_HEADER, header)
    if magic != MAGIC:
        raise ValueError("not a shard of records")
    return width


def _frame_bytes(length: int) -> int:
    return struct.calcsize(_LENGTH) + length + 2 * struct.calcsize(_CHECK)


def _unframed(frame: bytes, length: int, offset: int) -> bytes:
    """The ids of a record, checked against its checksums and the length that the index has."""
    n, c = struct.calcsize(_LENGTH), struct.calcsize(_CHECK)
    raw = frame[n + c : n + c + length]
    if len(frame) != _frame_bytes(length) or frame[: n + c] != struct.pack(_LENGTH, length) + struct.pack(_CHECK, masked_crc(frame[:n])) or frame[n + c + length :] != struct.pack(_CHECK, masked_crc(raw)):
        raise ValueError(f"damaged record at byte {offset}")
    return raw


def _reader(folder: str):
    def read(group: pa.Table) -> pa.Table:
        group = group.sort_by("offset")
        fs, base = open_fs(folder)
        crcs = []
        counts = []
        with fs.open_input_stream(f"{base}/{group.column('shard')[0].as_py()}", buffer_size=1 << 20) as stream:
            at = struct.calcsize(_HEADER)
            width = _width(stream.read(at))
            for offset, length in zip(group.column("offset").to_pylist(), group.column("length").to_pylist()):
                if offset > at:
                    stream.read(offset - at)
                raw = _unframed(stream.read(_frame_bytes(length)), length, offset)
                at = offset + _frame_bytes(length)
                ids = np.frombuffer(raw, np.dtype(f"<u{width}"))
                counts.append(len(ids))
                crcs.append(zlib.crc32(ids.astype("<u4").tobytes()))
        return pa.table({"doc_id": group.column("doc_id"), "start": group.column("start"), "n_tokens": pa.array(counts, pa.int64()), "ids_crc32": pa.array(crcs, pa.int64())})

    return read


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of each record of the index, read back from the shards with checksums verified."""
    return with_starts(index).groupBy("shard").applyInArrow(_reader(folder), "doc_id long, start long, n_tokens long, ids_crc32 long")


def _random_reader(folder: str):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_fs(folder)
        files: OrderedDict[str, tuple[pa.NativeFile, int]] = OrderedDict()

        def ids(shard: str, offset: int, length: int) -> np.ndarray:
            if shard not in files:
                if len(files) == OPEN_SHARDS:
                    files.popitem(last=False)[1][0].close()
                file = fs.open_input_file(f"{base}/{shard}")
                files[shard] = file, _width(file.read_at(struct.calcsize(_HEADER), 0))
            files.move_to_end(shard)
            file, width = files[shard]
            return np.frombuffer(_unframed(file.read_at(_frame_bytes(length), offset), length, offset), np.dtype(f"<u{width}")).astype("<i4")

        def out(rows: list) -> pa.RecordBatch:
            doc_ids, starts, arrays = zip(*rows)
            ends = np.cumsum([0, *map(len, arrays)], dtype=np.int32)
            return pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(starts, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays)))], names=["doc_id", "start", "ids"])

        try:
            for batch in batches:
                rows, size = [], 0
                for doc_id, start, shard, offset, length in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "start", "shard", "offset", "length"))):
                    rows.append((doc_id, start, ids(shard, offset, length)))
                    size += length
                    if size >= 1 << 22:
                        yield out(rows)
                        rows, size = [], 0
                if rows:
                    yield out(rows)
        finally:
            for file, _ in files.values():
                file.close()

    return read


def shuffled_records(index: DataFrame, folder: str, seed: int = 0) -> DataFrame:
    """``doc_id, start, ids`` of the records of an index that has ``start`` (``with_starts``), in the random order of ``seed``.

    Only index rows are shuffled, to ranges of a hash of ``start``; each task
    fetches its records from where they lie, in that order, whichever rows of the
    index are given: a sample or one epoch's share will do. The same seed gives
    the same order again. Checksums are verified; an empty index gives no rows.
    """
    rows = index.select("doc_id", "start", "shard", "offset", "length")
    key = F.xxhash64("start", F.lit(seed))
    ordered = rows.repartitionByRange(_tasks(rows, F.col("length")), key).sortWithinPartitions(key)
    return ordered.mapInArrow(lean(_random_reader(folder)), "doc_id long, start long, ids array<int>")


def token_records(docs: DataFrame, tokenizer_path: str, end_id: int = 1) -> DataFrame:
    """Write ``docs`` as records and return what is read back of them."""
    return read_records(*write_records(docs, tokenizer_path, end_id))
