"""Byte-level BPE encoding and decoding by the ranks of a vocabulary file.

Each pre-token is merged with a segment tree over its byte positions: a leaf
holds the rank of the pair of tokens that begins there, a node the leftmost
least rank below it. The root names the next merge; each merge updates three
leaves, those of the merged token, of the token it swallowed and of its live
neighbour to the left, in logarithmic time, so that a pre-token of n bytes takes
n log n steps however long it is.

New pre-tokens of many texts are merged together, a tree each, in arrays, and
remembered by the Python worker (a bounded table). A very long text is cut where
a blank follows something that isn't white space: no match of the pattern
goes over such a place.
"""

from __future__ import annotations

import base64
import gc
import itertools
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.storage import lean
from tessella.llm.words import slices

#: Pre-tokens remembered with their ids in each Python worker, each of so many characters at most; the table starts anew beyond.
REMEMBERED, LONGEST_REMEMBERED = 300_000, 64
#: Pre-tokens of up to so many bytes are merged together, so many at once.
MANY_BYTES, MANY = 64, 8192
#: A longer text is encoded in blocks of about so many characters.
BLOCK_CHARS = 1 << 20
#: Characters below this one are compared between the two libraries of patterns; blocks with others are left to the exact one.
_LOOKED_AT = 0x3000
_NO_PAIR = 1 << 62
_POSITION = (1 << 32) - 1


def merge(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """Ids of one pre-token: the pair of least rank is merged, the leftmost first, until none has a rank."""
    whole = ranks.get(piece)
    if whole is not None:
        return (whole,)
    n = len(piece)
    leaves = 1 << (n - 1).bit_length()
    tree = [_NO_PAIR] * (2 * leaves)
    rank = ranks.get
    for i in range(n - 1):
        of_pair = rank(piece[i : i + 2])
        if of_pair is not None:
            tree[leaves + i] = of_pair << 32 | i
    for node in range(leaves - 1, 0, -1):
        left, right = tree[2 * node], tree[2 * node + 1]
        tree[node] = left if left < right else right
    after = list(range(1, n + 1))  # where the next live token begins
    before = list(range(-1, n - 1))

    def put(at: int, end: int) -> None:
        """The leaf of the pair that begins at ``at`` and ends at ``end`` (0: no pair)."""
        of_pair = rank(piece[at:end]) if end else None
        node, value = leaves + at, _NO_PAIR if of_pair is None else of_pair << 32 | at
        tree[node] = value
        while node > 1:
            other = tree[node ^ 1]
            value = value if value < other else other
            node >>= 1
            if tree[node] == value:
                return
            tree[node] = value

    while tree[1] != _NO_PAIR:
        at = tree[1] & _POSITION
        swallowed = after[at]
        end = after[at] = after[swallowed]
        if end < n:
            before[end] = at
        put(swallowed, 0)
        put(at, after[end] if end < n else 0)
        if at:
            put(before[at], end)
    ids, at = [], 0
    while at < n:
        ids.append(ranks[piece[at : after[at]]])
        at = after[at]
    return tuple(ids)


class PairRanks:
    """Rank of a pair of neighbouring tokens, by their ids, for arrays of pairs: every cut of a token in two tokens."""

    def __init__(self, ranks: dict[bytes, int]):
        cuts = [(ranks[t[:i]] << 32 | ranks[t[i:]], rank) for t, rank in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        cuts.sort()
        self.pairs = np.array([p for p, _ in cuts] or [-1], np.int64)
        self.ranks = np.array([r for _, r in cuts] or [0], np.int64)

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, or -1."""
        pair = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.pairs, pair)
        return np.where(self.pairs.take(at, mode="clip") == pair, self.ranks.take(at, mode="clip"), -1)


def merge_many(pieces: list[bytes], leaves: int, byte_ids: np.ndarray, pairs: PairRanks) -> list[bytes]:
    """``merge`` of many pre-tokens of at most ``leaves`` bytes (a power of two) at once: a tree each, all updated together. Ids as bytes of ``int32``.

    Positions and nodes of all pre-tokens are in flat arrays; what belongs to the k-th begins at ``k * leaves``, or twice that in the tree.
    """
    count, bits = len(pieces), leaves.bit_length() - 1
    length = np.fromiter(map(len, pieces), np.int64, count)
    position = np.arange(leaves)
    token = byte_ids[np.frombuffer(b"".join(x.ljust(leaves, b"\0") for x in pieces), np.uint8)]
    live = position < length[:, None]
    tree = np.full((count, 2 * leaves), _NO_PAIR, np.int64)
    square = token.reshape(count, leaves)
    ranks = np.full((count, leaves - 1), -1)
    ranks[live[:, 1:]] = pairs.of(square[:, :-1][live[:, 1:]], square[:, 1:][live[:, 1:]])
    tree[:, leaves:-1] = np.where(ranks >= 0, ranks << bits | position[:-1], _NO_PAIR)
    width = leaves
    while width > 1:
        tree[:, width // 2 : width] = np.minimum(tree[:, width : 2 * width : 2], tree[:, width + 1 : 2 * width : 2])
        width //= 2
    tree, live = tree.ravel(), live.ravel()
    after = np.tile(position + 1, count)
    before = np.tile(position - 1, count)
    base = np.arange(count) * leaves
    end_of = base + length
    while True:
        best = tree[2 * base + 1]
        more = best != _NO_PAIR
        if not more.all():
            base, end_of, best = base[more], end_of[more], best[more]
        if not len(base):
            break
        at = best & (leaves - 1)
        here = base + at
        swallowed = after[here]
        end = after[base + swallowed]
        merged = best >> bits
        token[here] = merged
        live[base + swallowed] = False
        after[here] = end
        right = base + end
        inside = right < end_of
        right = np.where(inside, right, here)
        before[right] = np.where(inside, at, before[here])
        left = before[here]
        has_left = left >= 0
        left = np.where(has_left, left, swallowed)
        found = pairs.of(np.concatenate([merged, token[base + left]]), np.concatenate([token[right], merged]))
        found = np.where((found >= 0) & np.concatenate([inside, has_left]), found << bits | np.concatenate([at, left]), _NO_PAIR)
        root = 2 * base
        nodes = np.concatenate([leaves + at, leaves + left])
        roots = np.concatenate([root, root])
        tree[root + leaves + swallowed] = _NO_PAIR
        tree[roots + nodes] = found
        nodes, roots = np.concatenate([leaves + swallowed, nodes]), np.concatenate([root, roots])
        for _ in range(bits):
            below = roots + (nodes & ~1)
            nodes >>= 1
            tree[roots + nodes] = np.minimum(tree.take(below), tree.take(below + 1))
    raw, ends = token[live].astype("<i4").tobytes(), np.cumsum(live.reshape(count, leaves).sum(axis=1)) * 4
    return [raw[lo:hi] for lo, hi in zip([0, *ends[:-1].tolist()], ends.tolist())]


_CUT = re.compile(r"(?<=\S)(?= )")


def blocks(text: str, size: int = BLOCK_CHARS) -> Iterator[str]:
    """The text in parts of ``size`` characters or more, cut before a blank that follows something else than white space."""
    at = 0
    while len(text) - at > size and (cut := _CUT.search(text, at + size)):
        yield text[at : cut.start()]
        at = cut.start()
    if at < len(text):
        yield text[at:]


class Splitter:
    """Matches of a pattern. That of the public tokenizers is written for ``re`` where a block has no character whose class differs there."""

    def __init__(self, pattern: str):
        self.match = regex.compile(pattern).findall
        self.quick = pattern == public_tokenizers.PATTERN
        if self.quick:
            letter, number, space = (re.compile(x).match for x in (r"[^\W\d_]", r"\d", r"\s"))
            known = [regex.compile(x).match for x in (r"\p{L}", r"\p{N}", r"\s")]
            odd = [c for c in map(chr, range(_LOOKED_AT)) if any(bool(x(c)) != bool(y(c)) for x, y in zip((letter, number, space), known))]
            self.odd = re.compile(f"[{re.escape(''.join(odd))}{chr(_LOOKED_AT)}-\U0010ffff]").search
            self.plain = re.compile(pattern.replace(r"[^\s\p{L}\p{N}]+", r"(?:[^\s\w]|_)+").replace(r"\p{L}", r"[^\W\d_]").replace(r"\p{N}", r"\d")).findall

    def __call__(self, block: str) -> list[str]:
        return self.plain(block) if self.quick and not self.odd(block) else self.match(block)


class Codec:
    """Encoder and decoder of one rank file: lines of a token in base64, a blank and its rank."""

    def __init__(self, lines: bytes, pattern: str):
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in (x.split() for x in lines.splitlines() if x.strip())}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.pairs = PairRanks(self.ranks)
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        self.split = Splitter(pattern)
        self.known: dict[str, bytes] = {}

    def _learn(self, used: set[str]) -> None:
        """Ids, as bytes, of pre-tokens that aren't remembered."""
        if len(self.known) + len(used) > REMEMBERED:
            self.known = {x: self.known[x] for x in used if x in self.known}
        short: dict[int, list[tuple[str, bytes]]] = {}
        for piece in used - self.known.keys():
            raw = piece.encode()
            whole = self.ranks.get(raw)
            if whole is not None:
                self.known[piece] = whole.to_bytes(4, "little")
            elif len(raw) <= MANY_BYTES:
                short.setdefault(max(8, 1 << (len(raw) - 1).bit_length()), []).append((piece, raw))
            else:
                self.known[piece] = np.array(merge(raw, self.ranks), "<i4").tobytes()
        for leaves, group in short.items():
            for lo in range(0, len(group), MANY):
                part = group[lo : lo + MANY]
                self.known.update(zip([x for x, _ in part], merge_many([x for _, x in part], leaves, self.byte_ids, self.pairs)))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as bytes of ``int32``; many short texts, or a block of a long one, at a time."""
        out: list[list[bytes]] = [[] for _ in texts]
        waiting: list[tuple[int, list[str]]] = []
        size = 0

        def flush() -> None:
            used = set().union(*(x for _, x in waiting))
            self._learn(used)
            for k, pieces in waiting:
                out[k].append(b"".join(map(self.known.__getitem__, pieces)))
            for long in [x for x in used if len(x) > LONGEST_REMEMBERED]:
                del self.known[long]
            waiting.clear()

        for k, text in enumerate(texts):
            for block in blocks(text):
                waiting.append((k, self.split(block)))
                size += len(block)
                if size >= BLOCK_CHARS:
                    flush()
                    size = 0
        flush()
        return [b"".join(x) for x in out]

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=2)
def _codec(path: str, pattern: str) -> Codec:
    with open(path, "rb") as f:
        return Codec(f.read(), pattern)


def _encoded(codec: Codec, texts: pa.Array) -> pa.ListArray:
    ids = codec.encode([t or "" for t in texts.to_pylist()])
    offsets = np.cumsum([0, *(len(x) // 4 for x in ids)])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(b"".join(ids), np.int32)))


def _decoded(codec: Codec, ids: pa.ListArray) -> pa.Array:
    values, cuts = ids.flatten().to_pylist(), np.cumsum([0, *(pc.fill_null(pc.list_value_length(ids), 0).to_pylist())]).tolist()
    return pa.array([codec.decode(values[lo:hi]) for lo, hi in itertools.pairwise(cuts)], pa.binary())


def _over(column: str, path: str, pattern: str, *steps):
    """Batches of an id column and ``column``: the id and what each step makes of the result of the one before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path, pattern)
        gc.disable()  # of the many small objects none is in a cycle
        for batch in batches:
            ranges = slices(batch.column(column)) if column == "text" else [(0, len(batch))]
            for lo, hi in ranges:
                made, columns = batch.column(column).slice(lo, hi - lo), []
                for step in steps:
                    made = step(codec, made)
                    columns.append(made)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), *columns], ["doc_id", *(f"c{k}" for k in range(len(steps)))])

    return lean(run)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, ids`` of the whole text of each row of ``docs`` (``doc_id``, ``text``), in the ranks of the file at ``path``.

    A null or empty text has no ids; repeated rows and null ``doc_id``s each
    give a row; other columns are left out, whatever their names; an empty table
    gives no rows. Texts of any length are encoded in blocks that are cut where
    no match of ``pattern`` goes across. ``path`` is read by each executor.
    """
    rows = _texts(docs).mapInArrow(_over("text", path, pattern, _encoded), "doc_id long, c0 array<int>")
    return rows.withColumnRenamed("c0", "ids")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, bytes`` that the ``ids`` of each row of ``encoded`` stand for; null ids are none. An id without a token is an error."""
    rows = encoded.select("doc_id", "ids").mapInArrow(_over("ids", path, pattern, _decoded), "doc_id long, c0 binary")
    return rows.withColumnRenamed("c0", "bytes")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, ids, bytes``: ``encode``, and ``decode`` of its ids, in one pass."""
    rows = _texts(docs).mapInArrow(_over("text", path, pattern, _encoded, _decoded), "doc_id long, c0 array<int>, c1 binary")
    return rows.withColumnsRenamed({"c0": "ids", "c1": "bytes"})


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of ``round_trip``: the hash of the decimal ids with blanks between, and of the decoded bytes."""
    spelled = F.array_join(F.col("ids").cast("array<string>"), " ")
    return round_trip(docs, path, pattern).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(spelled, 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256")
    )
