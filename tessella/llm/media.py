"""Media payloads as content-defined chunks that are stored once.

A rolling gear hash cuts payloads where their content says so; chunks go to
pack files as they come, each compressed by itself, and each task leaves out
what it has packed before. Spark then joins all chunk digests, so that every
digest has one place. A medium is stored as a manifest (a header, then digest,
length and stored length of its chunks in order) and its stored chunks;
manifests and places are a table that Spark commits, so that media can be read
in another session. Equal texts are one medium. Reading goes by place, so
that packs are read in order, and verifies every chunk. Chunk bytes never take
part in a shuffle.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.storage import lean, materialize, open_fs, shared_dir
from tessella.llm.words import slices

#: Payloads are whole frames of so many 8-bit samples.
FRAME = 192
#: Sizes of chunks in bytes; after the least, one byte in 2 ** CUT_BITS is a cut.
LEAST, CUT_BITS, MOST = 512, 11, 8192
#: Stored bytes that are read together.
BLOCK = 256 * 1024
#: Digests that a packing task remembers, to leave out what it has packed already.
REMEMBERED = 200_000
#: Rows of equal payload that travel together.
ROWS_TOGETHER = 1000
_GEAR = np.random.default_rng(11).integers(0, 2**32, 256, dtype=np.uint32)


def payload(text: str | None) -> bytes:
    """UTF-8 of the text with blanks up to a positive multiple of ``FRAME``."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b" " * ((-len(raw)) % FRAME if raw else FRAME)


def gear_hashes(data: bytes) -> np.ndarray:
    """Gear hash (shift by one, add the byte's value; 32 bits, so 32 bytes count) at every byte, by doubling."""
    h = _GEAR[np.frombuffer(data, np.uint8)]
    width = 1
    while width < 32:
        more = h.copy()
        more[width:] += h[:-width] << np.uint32(width)
        h, width = more, 2 * width
    return h


def cut(data: bytes, hashes: np.ndarray | None = None) -> list[int]:
    """Ends of the chunks of a payload. The hash at a cut depends on the chunk's own bytes, since a chunk has ``LEAST`` > 32."""
    hashes = gear_hashes(data) if hashes is None else hashes
    marks = np.flatnonzero(hashes >> np.uint32(32 - CUT_BITS) == 0) + 1
    ends, start, n, k = [], 0, len(data), 0
    while n - start > LEAST:
        k += int(np.searchsorted(marks[k:], start + LEAST))
        end = min(int(marks[k]) if k < len(marks) else n, start + MOST, n)
        ends.append(end)
        start = end
    if start < n:
        ends.append(n)
    return ends


_PLACE = pa.struct([("digest", pa.binary()), ("length", pa.int32()), ("stored", pa.int32()), ("file", pa.string()), ("block", pa.int64()), ("size", pa.int32()), ("inner", pa.int32())])
_PACKED = pa.schema([("media", pa.binary()), ("n_bytes", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("chunks", pa.list_(_PLACE))])
_CHUNK_SQL = "digest: binary, length: int, stored: int, file: string, block: bigint, size: int, inner: int"
_PACKED_SQL = f"media binary, n_bytes long, doc_ids array<bigint>, chunks array<struct<{_CHUNK_SQL}>>"


class _Pack:
    """A pack file: stored chunks one after the other, in blocks that are read together."""

    def __init__(self, folder: str):
        fs, base = open_fs(folder)
        fs.create_dir(base, recursive=True)
        self.name = f"pack-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
        self.stream = fs.open_output_stream(f"{base}/{self.name}")
        self.at, self.filled = 0, 0

    def add(self, stored: bytes) -> int:
        """Write a stored chunk; its place in the current block."""
        inner = self.filled
        self.stream.write(stored)
        self.filled += len(stored)
        return inner

    def end_block(self) -> tuple[int, int]:
        """Place and size of the block that ends here."""
        block = self.at, self.filled
        self.at, self.filled = self.at + self.filled, 0
        return block


class _Packer:
    """What a packing task knows: chunks packed, and media of the current block with the rows that have them."""

    def __init__(self, folder: str):
        self.folder = folder
        self.pack: _Pack | None = None
        self.squeeze = zstandard.ZstdCompressor(level=3)
        self.seen: dict[bytes, dict] = {}  # places of chunks
        self.fresh: list[dict] = []  # chunks of the current block
        self.media: dict[bytes, tuple[int, list[int | None], list[bytes] | None]] = {}
        self.listed: set[bytes] = set()  # media whose chunks were given before
        self.rows = 0

    def add(self, doc_id: int | None, text: str | None) -> None:
        own = (text or "").encode("utf-8", "surrogatepass")
        media = hashlib.sha256(own).digest()
        self.rows += 1
        if media in self.media:
            self.media[media][1].append(doc_id)
            return
        digests: list[bytes] | None = None
        if media not in self.listed:
            raw, digests, start = payload(text), [], 0
            for end in cut(raw):
                chunk, start = raw[start:end], end
                digest = hashlib.sha256(chunk).digest()
                if digest not in self.seen:
                    self.pack = self.pack or _Pack(self.folder)
                    stored = self.squeeze.compress(chunk)
                    self.seen[digest] = {"digest": digest, "length": len(chunk), "stored": len(stored), "file": self.pack.name, "block": -1, "size": 0, "inner": self.pack.add(stored)}
                    self.fresh.append(self.seen[digest])
                digests.append(digest)
        self.media[media] = len(own), [doc_id], digests

    @property
    def full(self) -> bool:
        return self.rows >= 20_000 or self.pack is not None and self.pack.filled >= BLOCK

    def emit(self) -> Iterator[pa.RecordBatch]:
        """A row for each medium of the block and ``ROWS_TOGETHER`` of its rows; the first has the chunks."""
        if not self.media:
            return
        block, size = self.pack.end_block() if self.fresh else (0, 0)
        for place in self.fresh:
            place["block"], place["size"] = block, size
        columns: tuple[list, list, list, list] = ([], [], [], [])
        for media, (n, ids, digests) in self.media.items():
            chunks = [self.seen[d] for d in digests] if digests is not None else None
            for lo in range(0, len(ids), ROWS_TOGETHER):
                for column, value in zip(columns, (media, n, ids[lo : lo + ROWS_TOGETHER], None if lo else chunks)):
                    column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, _PACKED)], schema=_PACKED)
        self.listed |= self.media.keys()
        self.fresh, self.rows = [], 0
        self.media.clear()
        if len(self.seen) > REMEMBERED or len(self.listed) > REMEMBERED:
            self.seen.clear()
            self.listed.clear()


def _packing(folder: str):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = _Packer(folder)
        try:
            for batch in batches:
                for lo, hi in slices(batch.column("text")):
                    part = batch.slice(lo, hi - lo)
                    for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                        packer.add(doc_id, text)
                        if packer.full:
                            yield from packer.emit()
            yield from packer.emit()
        finally:
            if packer.pack:
                packer.pack.stream.close()

    return pack


_MAGIC, _BITS = b"TSLMED02", 8
_HEAD, _ENTRY = ">8sIQQI", ">32sII"


def _manifest(n_bytes: F.Column, chunks: F.Column) -> F.Column:
    """Bytes of a manifest, as ``_HEAD`` and ``_ENTRY`` have them, from chunks in order."""
    number = lambda value, width: F.lpad(F.hex(value.cast("long")), width, "0")
    total = F.aggregate(chunks, F.lit(0).cast("long"), lambda s, c: s + c["length"])
    entries = F.array_join(F.transform(chunks, lambda c: F.concat(F.hex(c["digest"]), number(c["length"], 8), number(c["stored"], 8))), "")
    return F.unhex(F.concat(F.lit(_MAGIC.hex()), number(F.lit(_BITS), 8), number(n_bytes, 16), number(total, 16), number(F.size(chunks), 8), entries))


def store(docs: DataFrame, folder: str | None = None) -> str:
    """Store the payloads of ``docs`` (``doc_id``, ``text``); the folder where they are.

    It holds the packs, the table ``rows`` (``media``, the SHA-256 of a
    text, with ``doc_ids`` of up to ``ROWS_TOGETHER`` rows that have it) and
    the table ``manifests``: a row for each medium, with ``n_bytes``,
    ``manifest`` and the places of its ``chunks`` in order. A task that is run
    again writes another pack; what no place names is never read.
    """
    folder = folder or shared_dir(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    packed = materialize(rows.mapInArrow(lean(_packing(folder)), _PACKED_SQL), f"{folder}/rows")
    media = packed.where("chunks IS NOT NULL").groupBy("media").agg(F.min("n_bytes").alias("n_bytes"), F.min_by("chunks", F.col("chunks")[0]["file"]).alias("chunks"))
    listed = media.select("media", "n_bytes", F.posexplode("chunks").alias("place", "c"))
    at = F.struct("c.file", "c.block", "c.size", "c.inner")
    places = listed.groupBy(F.col("c.digest").alias("digest")).agg(F.min(at).alias("at"))
    # a digest that very many media have is split by the skew join, as rows are small and one side has it once
    placed = listed.select("media", "n_bytes", "place", F.col("c.digest").alias("digest"), "c.length", "c.stored").join(places.hint("merge"), "digest")
    chunks = F.sort_array(F.collect_list(F.struct("place", "digest", "length", "stored", "at.file", "at.block", "at.size", "at.inner")))
    manifests = placed.groupBy("media", "n_bytes").agg(chunks.alias("chunks"))
    manifests.withColumn("manifest", _manifest(F.col("n_bytes"), F.col("chunks"))).write.parquet(f"{folder}/manifests")
    return folder


def features(samples: bytes) -> str:
    """Mean, deviation, peak and zero crossings of the 8-bit samples around the middle of their range."""
    x = np.frombuffer(samples, np.uint8).astype(np.float64) - 128
    crossings = int((np.signbit(x[1:]) != np.signbit(x[:-1])).sum())
    return f"mean={x.mean():.4f};std={x.std():.4f};peak={int(np.abs(x).max())};crossings={crossings}"


_READ = pa.schema(
    [("media", pa.binary()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]
)
_READ_SQL = "media binary, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


class _Blocks:
    """Blocks of packs, the latest few kept."""

    def __init__(self, folder: str):
        self.fs, self.base = open_fs(folder)
        self.files: dict[str, pa.NativeFile] = {}
        self.kept: dict[tuple[str, int], bytes] = {}

    def __call__(self, file: str, block: int, size: int) -> bytes:
        if (file, block) not in self.kept:
            if file not in self.files:
                if len(self.files) >= 32:
                    self.files.pop(next(iter(self.files))).close()
                self.files[file] = self.fs.open_input_file(f"{self.base}/{file}")
            if len(self.kept) >= 32:
                self.kept.pop(next(iter(self.kept)))
            self.kept[file, block] = self.files[file].read_at(size, block)
        return self.kept[file, block]

    def close(self) -> None:
        for file in self.files.values():
            file.close()


def read_medium(manifest: bytes, chunks: list[dict], blocks: _Blocks) -> tuple[int, bytes, list[bytes]]:
    """Text bytes, payload and stored chunks of a medium; raises ValueError where the stored bytes don't fit the manifest."""
    magic, bits, n_bytes, total, count = struct.unpack_from(_HEAD, manifest)
    if magic != _MAGIC or bits != _BITS or count != len(chunks) or len(manifest) != struct.calcsize(_HEAD) + count * struct.calcsize(_ENTRY):
        raise ValueError("damaged manifest")
    expand = zstandard.ZstdDecompressor()
    stored, payloads = [], []
    for (digest, length, size), c in zip(struct.iter_unpack(_ENTRY, manifest[struct.calcsize(_HEAD) :]), chunks):
        stored.append(blocks(c["file"], c["block"], c["size"])[c["inner"] : c["inner"] + size])
        try:
            payloads.append(expand.decompress(stored[-1]))
        except zstandard.ZstdError as e:
            raise ValueError(f"damaged chunk in {c['file']}") from e
        if len(payloads[-1]) != length or hashlib.sha256(payloads[-1]).digest() != digest:
            raise ValueError(f"damaged chunk in {c['file']}")
    data = b"".join(payloads)
    if len(data) != total:
        raise ValueError("damaged manifest")
    return n_bytes, data, stored


def _reader(folder: str):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = _Blocks(folder)
        try:
            for batch in batches:
                for lo in range(0, batch.num_rows, 200):
                    rows = []
                    for row in batch.slice(lo, 200).to_pylist():
                        n, data, stored = read_medium(row["manifest"], row["chunks"], blocks)
                        form = hashlib.sha256(row["manifest"])
                        for piece in stored:
                            form.update(piece)
                        size = len(row["manifest"]) + sum(map(len, stored))
                        rows.append((row["media"], n, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]), size, form.hexdigest(), features(data)))
                    yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows), _READ)], schema=_READ)
        finally:
            blocks.close()

    return read


def read_media(spark: SparkSession, folder: str) -> DataFrame:
    """Every medium of a folder, read from the packs and verified: ``media`` with sizes, digests and features of payload and stored form (manifest and stored chunks)."""
    manifests = spark.read.parquet(f"{folder}/manifests")
    first = manifests.withColumn("file", F.col("chunks")[0]["file"]).withColumn("block", F.col("chunks")[0]["block"])
    near = first.repartitionByRange("file", "block", "media").sortWithinPartitions("file", "block").select("media", "manifest", "chunks")  # by medium too: many may begin with the same chunk
    return near.mapInArrow(lean(_reader(folder)), _READ_SQL)


def store_and_read(docs: DataFrame) -> DataFrame:
    """Store the payload of every row of ``docs`` (``doc_id``, ``text``) and return what is read back.

    A null text is an empty one, whose payload is one frame of blanks. Equal
    texts are stored and read once. Repeated rows have a row each; an empty
    table gives none.
    """
    spark = docs.sparkSession
    folder = store(docs)
    rows = spark.read.schema(_PACKED_SQL).parquet(f"{folder}/rows").select("media", "n_bytes", "doc_ids")
    media = read_media(spark, folder).drop("n_bytes")
    return rows.join(media.hint("merge"), "media").select(F.explode("doc_ids").alias("doc_id"), "n_bytes", *[n for n in _READ.names if n not in ("media", "n_bytes")])
