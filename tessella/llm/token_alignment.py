"""Alignment of two tokenizers over the same texts, and how often their tokens are linked in the corpus.

The tokens of both, as byte ranges of one text, are the sides of a graph whose
edges are overlaps. Its connected components, found by union-find, are the
smallest groups of tokens that cover the same bytes; each token of a group is linked
with all of the other tokenizer.

Many documents are aligned in one pass over arrays; a very long one goes in
blocks, cut before a blank that follows something else than white space, where tokens of
both end. Documents keep their pairs of ids packed; pairs are counted by a
grouping that combines before its shuffle, and the counts, sorted by pair in a
table of the shared folder, are read past the documents slice by slice, so that
no pair of a document is shuffled.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain, pairwise
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
import public_tokenizers
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.byte_bpe import blocks
from tessella.llm.storage import lean, open_fs, shared_dir
from tessella.llm.words import slices

#: Characters of texts that are aligned together; a longer text is taken by itself, in parts of that size.
SLICE_CHARS, SLICE_ROWS = 1 << 20, 1 << 14
#: Different pairs counted in a task before they go on to the shuffle.
COUNTED = 1 << 20
#: Pairs of the table of counts that a task holds, and pairs of documents that meet them at once.
TABLE_SLICE, MEETING = 1 << 22, 1 << 22
#: A pair of ids is one number: the first id times this, plus the second.
_FIRST = 1 << 24

#: Links of a group beyond which its different ids are paired instead of its tokens.
LARGE_GROUP = 1024
#: A run so long that the search for the pattern of pre-tokens might go deep.
_RUN = re.compile(r"\s{5000}")


class Tokens(NamedTuple):
    """Ids of many units of text, one after the other, and how many each has."""

    ids: np.ndarray
    counts: np.ndarray

    def of(self, units: np.ndarray) -> Tokens:
        return Tokens(self.ids[np.repeat(units, self.counts)], self.counts[units])


def _packed(ids: list[list[int]]) -> Tokens:
    counts = np.fromiter(map(len, ids), np.int64, len(ids))
    return Tokens(np.fromiter(chain.from_iterable(ids), np.int64, int(counts.sum())), counts)


def byte_alphabet() -> dict[str, int]:
    """The byte that each letter of byte-level vocabularies stands for: printable Latin letters for themselves, the others from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


def _objects(values: list) -> np.ndarray:
    out = np.empty(len(values), object)
    out[:] = values
    return out


class ByteLevel:
    """A byte-level BPE file of the tokenizers library; special tokens inside texts are plain text.

    Where its merges are in the order of their tokens' ids, a pair merges exactly if the bytes of both are a
    token, and lower ids first; the file is then read as a table of ranks, which encodes faster. Others
    are left to the tokenizers library.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        letters = byte_alphabet()
        names = [self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size(with_added_tokens=True))]
        self.bytes = _objects([bytes(letters[x] for x in name) if all(x in letters for x in name) else name.encode() for name in names])
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        plain = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        vocab, merges = said["model"]["vocab"], [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in said["model"]["merges"]]
        made = [vocab[x + y] for x, y in merges]
        self.ranks = None
        if said["normalizer"] is None and said["pre_tokenizer"] == plain and made == sorted(made) and len({x + y for x, y in merges}) == len(merges) and all(len(x) == 1 for x in vocab.keys() - {x + y for x, y in merges} - {x["content"] for x in said["added_tokens"]}):
            special = {x["content"] for x in said["added_tokens"]}
            ranks = {bytes(letters[c] for c in token): i for token, i in vocab.items() if token not in special}
            self.ranks = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, units: list[str]) -> Tokens:
        if self.ranks is None:
            return _packed([x.ids for x in self.tokenizer.encode_batch_fast(units, add_special_tokens=False)])
        ids = [np.array(self.tokenizer.encode(x, add_special_tokens=False).ids, np.uint32) if _RUN.search(x) else self.ranks.encode_to_numpy(x, disallowed_special=()) for x in units]
        return Tokens(np.concatenate([np.zeros(0, np.uint32), *ids]).astype(np.int64), np.fromiter(map(len, ids), np.int64, len(ids)))


class Pieces:
    """A sentencepiece model, which adds a blank before each text itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = _objects([bytes([int(x[1:-1], 16)]) if self.model.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(names)])
        #: No piece goes from something else to a blank, so that no merge does and texts may be cut there.
        self.cuts = not any(b == "▁" != a for x in names for a, b in pairwise(x))

    def encode(self, units: list[str]) -> Tokens:
        """Ids of units that begin with a blank."""
        return _packed(self.model.encode([x[1:] for x in units], num_threads=1))


def components(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The least node of the component of each of ``n`` nodes: union-find over arrays of edges, all united at once, with paths halved until they are flat."""
    root = np.arange(n)
    while len(u):
        x, y = root[u], root[v]
        apart = x != y
        u, v, x, y = u[apart], v[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
    return root


def _places(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``starts[k], starts[k] + 1, ...``, ``counts[k]`` of them, for each k."""
    return np.repeat(starts - np.append(0, np.cumsum(counts)[:-1]), counts) + np.arange(int(counts.sum()))


class Aligned(NamedTuple):
    """Alignment of a slice of documents: tokens, groups and links of each; its groups as text; its different pairs and how often each is linked."""

    counts: np.ndarray
    groups: list[str]
    pairs: list[bytes]
    times: list[bytes]


class Aligner:
    """Both tokenizers, and the alignment of many documents in one pass over arrays."""

    def __init__(self, first: str, second: str):
        self.first, self.second = ByteLevel(first), Pieces(second)
        self.lengths = [np.array([len(x) for x in t.bytes]) for t in (self.first, self.second)]
        n_a, n_b = len(self.first.bytes), len(self.second.bytes)
        #: Decimal ids with what follows: a comma or a bar for the first tokenizer, a comma or a semicolon for the second.
        self.spelled = _objects([f"{i}{mark}" for n, marks in ((n_a, ",|"), (n_b, ",;")) for mark in marks for i in range(n)])
        self.offsets = np.array([0, n_a, 2 * n_a, 2 * n_a + n_b])

    def units(self, text: str) -> list[str]:
        """The text with a blank before it; a long one in blocks that are cut where tokens of both end."""
        if not text or not self.second.cuts:
            return [" " + text] if text else []
        units = list(blocks(" " + text, SLICE_CHARS))
        if units[-1] == " " and len(units) > 1:  # by itself a blank would be no text for the second tokenizer
            units[-2:] = [units[-2] + " "]
        return units

    def align(self, texts: list[str]) -> Aligned:
        cut = [self.units(x) for x in texts]
        units = list(chain.from_iterable(cut))
        doc = np.repeat(np.arange(len(texts)), [len(x) for x in cut])
        raw = [x.encode() for x in units]
        sides = [self.first.encode(units), self.second.encode(units)]
        right = np.ones(len(texts), bool)
        for tokens, table in zip(sides, (self.first.bytes, self.second.bytes)):
            ends = np.cumsum(tokens.counts)
            for d, lo, hi, x in zip(doc.tolist(), (ends - tokens.counts).tolist(), ends.tolist(), raw):
                right[d] &= b"".join(table[tokens.ids[lo:hi]]) == x
        return self._align(*(x.of(right[doc]) for x in sides), doc[right[doc]], len(texts))

    def _align(self, first: Tokens, second: Tokens, doc: np.ndarray, n_docs: int) -> Aligned:
        """``doc``: the document of each unit, in order."""
        a, b = first.ids, second.ids
        n, m = len(a), len(b)
        if not n:
            return Aligned(np.zeros((n_docs, 4), np.int64), [""] * n_docs, [b""] * n_docs, [b""] * n_docs)
        end_a, end_b = np.cumsum(self.lengths[0][a]), np.cumsum(self.lengths[1][b])
        ends = np.sort(np.concatenate([end_a, end_b]), kind="stable")
        ends = ends[np.append(True, ends[1:] != ends[:-1])]  # between two of them lies one overlap
        root = components(n + m, np.searchsorted(end_a, ends), n + np.searchsorted(end_b, ends))
        heads = np.flatnonzero(root[:n] == np.arange(n))  # the first token of each group: groups are in the order of the text
        number = np.zeros(n, np.int64)
        number[heads] = np.arange(len(heads))
        group_a, group_b = number[root[:n]], number[root[n:]]
        in_a, in_b = np.bincount(group_a, minlength=len(heads)), np.bincount(group_b, minlength=len(heads))
        first_a, first_b = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b
        links = in_a * in_b
        doc_a = np.repeat(doc, first.counts)
        doc_of_group = doc_a[first_a]
        text = np.empty(n + m, np.int64)
        text[np.arange(n) + first_b[group_a]] = a + self.offsets[(np.arange(n) == (first_a + in_a - 1)[group_a]).astype(int)]
        text[np.arange(m) + (first_a + in_a)[group_b]] = b + self.offsets[2 + (np.arange(m) == (first_b + in_b - 1)[group_b]).astype(int)]
        spelled = self.spelled[text].tolist()
        # links of small groups one by one, of large ones by their different ids
        large = links > LARGE_GROUP
        partners = np.where(large[group_a], 0, in_b[group_a])
        pair = np.repeat(a, partners) * _FIRST + b[_places(first_b[group_a], partners)]
        parts = [(np.repeat(doc_a, partners), pair, np.ones(len(pair), np.int64))]
        for g in np.flatnonzero(large):
            ids_a, k_a = np.unique(a[first_a[g] : first_a[g] + in_a[g]], return_counts=True)
            ids_b, k_b = np.unique(b[first_b[g] : first_b[g] + in_b[g]], return_counts=True)
            pair = (ids_a[:, None] * _FIRST + ids_b).ravel()
            parts.append((np.full(len(pair), doc_of_group[g]), pair, (k_a[:, None] * k_b).ravel()))
        doc_of_pair, pair, times = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(doc_of_pair << 48 | pair, kind="stable")  # a slice has fewer documents than 2 ** 15
        doc_of_pair, pair, times = doc_of_pair[order], pair[order], times[order]
        begins = np.flatnonzero(np.append(True, (pair[1:] != pair[:-1]) | (doc_of_pair[1:] != doc_of_pair[:-1])))
        pair, times = pair[begins], np.add.reduceat(times, begins)
        cuts = (8 * np.searchsorted(doc_of_pair[begins], np.arange(n_docs + 1))).tolist()
        raw, raw_times = pair.astype("<i8").tobytes(), times.astype("<i8").tobytes()
        totals = [np.bincount(x, weights=w, minlength=n_docs).astype(np.int64) for x, w in ((doc, first.counts), (doc, second.counts), (doc_of_group, None), (doc_of_group, links))]
        at = np.append(0, np.cumsum(totals[0] + totals[1])).tolist()
        return Aligned(
            np.stack(totals, axis=1),
            ["".join(spelled[lo:hi])[:-1] for lo, hi in pairwise(at)],
            [raw[lo:hi] for lo, hi in pairwise(cuts)],
            [raw_times[lo:hi] for lo, hi in pairwise(cuts)],
        )


_ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, pairs binary, times binary"


@lru_cache(maxsize=1)
def _aligner(first: str, second: str) -> Aligner:
    return Aligner(first, second)


def _align(first: str, second: str, hashed: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(first, second)
        for batch in batches:
            for lo, hi in slices(batch.column("text"), SLICE_CHARS, SLICE_ROWS):
                found = aligner.align([x or "" for x in batch.column("text").slice(lo, hi - lo).to_pylist()])
                groups = [hashlib.sha256(x.encode()).hexdigest() if x else "" for x in found.groups] if hashed else found.groups
                columns = [*(pa.array(x) for x in found.counts.T.copy()), pa.array(groups, pa.string()), pa.array(found.pairs, pa.binary()), pa.array(found.times, pa.binary())]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), *columns], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times"])

    return lean(run)


def aligned(docs: DataFrame, first: str, second: str, hashed: bool = False) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, groups, pairs, times`` of each row of ``docs`` (``doc_id``, ``text``).

    ``groups`` is the text ``a1,a2|b1;a3|b2,b3``, or its SHA-256 where
    ``hashed``; ``pairs`` are the different pairs of ids in order, ``times`` how
    often each is linked, both as packed 64-bit integers. A text that is null, empty, or isn't
    what the tokens of either side spell has no tokens: zeros and empty values.
    Repeated rows each give a row; an empty table gives none; other columns are
    left out, whatever their names.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_align(first, second, hashed), _ALIGNED)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of each pair, of many rows at a time: each row has a pair once."""
    waiting: list[np.ndarray] = []
    pairs, rows = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add() -> tuple[np.ndarray, np.ndarray]:
        pair = np.concatenate([pairs, *waiting])
        n = np.concatenate([rows, np.ones(len(pair) - len(pairs), np.int64)])
        order = np.argsort(pair, kind="stable")
        pair = pair[order]
        begins = np.flatnonzero(np.append(True, pair[1:] != pair[:-1])[: len(pair)])
        return pair[begins], np.add.reduceat(n[order], begins) if len(pair) else n

    size = 0
    for batch in batches:
        for raw in batch.column("pairs").to_pylist():
            waiting.append(np.frombuffer(raw, "<i8"))
            size += len(waiting[-1])
            if size >= MEETING:
                pairs, rows = add()
                waiting, size = [], 0
                if len(pairs) > COUNTED:
                    yield pa.RecordBatch.from_pydict({"pair": pairs, "n": rows})
                    pairs, rows = pairs[:0], rows[:0]
    pairs, rows = add()
    yield pa.RecordBatch.from_pydict({"pair": pairs, "n": rows})


def pair_counts(found: DataFrame) -> DataFrame:
    """``pair, n, best``: rows of ``aligned`` that have each pair, and whether no pair of the same first id has more."""
    counts = found.select("pairs").mapInArrow(lean(_count), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    of_first = Window.partitionBy(F.expr(f"pair div {_FIRST}"))  # as many rows as the second vocabulary has ids, at most
    return counts.select("pair", "n", (F.col("n") == F.max("n").over(of_first)).alias("best"))


def _table(folder: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The table of counts in slices: pairs in order, rows of each, and 1 for the best."""
    fs, base = open_fs(folder)
    for info in sorted(fs.get_file_info(pyarrow.fs.FileSelector(base)), key=lambda x: x.path):
        if info.path.endswith(".parquet"):
            with fs.open_input_file(info.path) as f:
                for part in pq.ParquetFile(f).iter_batches(TABLE_SLICE):
                    if len(part):
                        yield part.column("pair").to_numpy(), part.column("n").to_numpy(), part.column("best").to_numpy(zero_copy_only=False).astype(np.int64)


_SCORED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, n_best long, count_sum long"


@lru_cache(maxsize=1)
def _small_table(folder: str) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]] | None:
    """All of the table where it is one slice, which a worker then keeps."""
    parts, rows = [], 0
    for part in _table(folder):
        parts.append(part)
        rows += len(part[0])
        if rows > TABLE_SLICE:
            return None
    if not parts:
        return []
    pair, n, best = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(pair)
    return [(pair[order], n[order], best[order])]


def _score(folder: str):
    def scored(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(rows)
        raw = table.column("pairs").to_pylist()
        pair = np.frombuffer(b"".join(raw), np.int64)
        size = np.array([len(x) // 8 for x in raw], np.int64)
        times = np.frombuffer(b"".join(table.column("times").to_pylist()), "<i8")
        n_best, count_sum = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
        kept_table = _small_table(folder)
        for keys, n, best in _table(folder) if kept_table is None else kept_table:
            at = np.minimum(np.searchsorted(keys, pair), len(keys) - 1)
            here = keys[at] == pair
            begins = np.append(0, np.cumsum(size)[:-1])[size > 0]
            if len(begins):
                n_best[size > 0] += np.add.reduceat(np.where(here, times * best[at], 0), begins)
                count_sum[size > 0] += np.add.reduceat(np.where(here, times * n[at], 0), begins)
        out = table.drop_columns(["pairs", "times"]).append_column("n_best", pa.array(n_best)).append_column("count_sum", pa.array(count_sum))
        yield from out.combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0
        for batch in batches:
            lengths = batch.column("pairs").nbytes
            waiting.append(batch)
            size += lengths
            if size >= 8 * MEETING:
                yield from scored(waiting)
                waiting, size = [], 0
        if waiting:
            yield from scored(waiting)

    return lean(run)


def alignment(docs: DataFrame, first: str, second: str) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of each row of ``docs``.

    ``count_sum`` adds for each link how many rows have its pair of ids linked,
    ``n_best`` counts the links whose pair no other of the same first id exceeds
    (ties included). Rows without tokens have zeros and an empty string.
    """
    spark = docs.sparkSession
    folder = shared_dir(spark)
    aligned(docs, first, second, hashed=True).write.option("compression", "zstd").parquet(f"{folder}/documents")
    found = spark.read.parquet(f"{folder}/documents")
    pair_counts(found).repartitionByRange("pair").sortWithinPartitions("pair").write.parquet(f"{folder}/counts")
    scored = found.mapInArrow(_score(f"{folder}/counts"), _SCORED)
    return scored.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("groups").alias("groups_sha256"))
