"""Benchmark decontamination by spaced-seed hashing.

A seed is a window of words of which a fixed mask ignores some positions; a
text that differs from a benchmark item in ignored positions only still has the
item's seed. An overlap is cut in four blocks, and there is a mask for each
choice of the blocks that are left if each substituted word spoils another one:
wherever the words are that may differ, a seed inside the overlap is left.
Seeds of both sides are joined by hash, and around each hit the two texts are
compared word by word on the hit's diagonal, where some words may differ.

The training side has a seed for every word and mask, so that it is thinned
before the shuffle by a bitmap of fixed size, made of the benchmark's seeds by
a Spark aggregation: it only says which seeds can't join. What passes carries
its neighbouring words, enough to judge the overlap without the text. Equal
seeds with equal neighbours are judged once for all documents of a slice that
have them, so that a passage which very many documents share is few rows; what
is left of a frequent seed the skew join splits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.storage import lean
from tessella.llm.words import ALNUM_WORDS, U64, find_words, mix, slices, windows_inside

#: An overlap: so many words in a row on one diagonal, of which so many may differ.
OVERLAP, MAX_DIFFERENT = 12, 2
_BLOCKS = 4


def may_differ(size: int) -> int:
    """Words that may differ in an overlap of so many words: one in four, ``MAX_DIFFERENT`` at most."""
    return min(MAX_DIFFERENT, size // _BLOCKS)


def masks(size: int) -> tuple[str, ...]:
    """Positions of an overlap that count, by mask; whichever ``may_differ(size)`` words differ, some mask ignores them all."""
    block = size // _BLOCKS
    if not block:
        return ("1" * size,)
    kept = combinations(range(_BLOCKS), _BLOCKS - may_differ(size))
    return tuple("".join(("1" if b in k else "0") * block for b in range(_BLOCKS)).ljust(size, "0") for k in kept)


#: Masks of a whole overlap, and their length.
MASKS = masks(OVERLAP)
SPAN = len(MASKS[0])
#: What is hashed: masks of all sizes without the ignored ends, as a mask and a shifted one give the same seeds.
SHAPES = tuple(sorted({m.strip("0") for size in range(1, OVERLAP + 1) for m in masks(size)}, key=lambda x: (-len(x), x)))
#: Whether an item of so many words (``OVERLAP`` stands for all longer ones) has seeds of a shape.
_HAS_SHAPE = np.array([[any(m.strip("0") == x for m in masks(size)) for x in SHAPES] if size else [False] * len(SHAPES) for size in range(OVERLAP + 1)])
#: Documents that a row of one seed and its neighbours stands for at most.
OWNERS_PER_ROW = 1000
#: Bits of the bitmap, a power of two: 2 MB.
BITMAP_BITS = 1 << 24

_WORDS_PER_ROW = BITMAP_BITS // 64


def _seed_hashes(words: np.ndarray, shape: int) -> np.ndarray:
    """Seed of each window of the words under a shape."""
    n = len(words) - len(SHAPES[shape]) + 1
    out = np.full(max(n, 0), U64(shape + 1), U64)
    for i, kept in enumerate(SHAPES[shape]):
        if kept == "1" and n > 0:
            out = out * U64(0x9E3779B97F4A7C15) + words[i : i + n]
    return mix(out)


def _seeds(bitmap: np.ndarray | None, shapes: list[int]):
    """Seeds of texts with the words of all overlaps that hold them; of the training side those that the bitmap lets through, of items those of their size."""

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in slices(batch.column("text")):
                part = batch.slice(lo, hi - lo)
                words = find_words(part.column("text"), ALNUM_WORDS)
                doc_of = np.repeat(np.arange(len(part)), words.counts)
                size = np.minimum(words.counts, OVERLAP)
                places, hashes, spans = [], [], []
                for m in shapes:
                    valid = np.flatnonzero(windows_inside(words.first, len(SHAPES[m])))
                    if bitmap is None:
                        at = valid[_HAS_SHAPE[size[doc_of[valid]], m]]
                        own = _seed_hashes(words.hash, m)[at]
                    else:
                        own = _seed_hashes(words.hash, m)[valid]
                        bit = own & U64(BITMAP_BITS - 1)
                        hit = np.flatnonzero((bitmap[(bit >> U64(6)).astype(np.int64)] >> (bit & U64(63))) & U64(1))
                        at, own = valid[hit], own[hit]
                    places.append(at)
                    hashes.append(own)
                    spans.append(np.full(len(at), len(SHAPES[m])))
                if not places:
                    continue
                place, seed, span = np.concatenate(places), np.concatenate(hashes), np.concatenate(spans)
                if not len(place):
                    continue
                doc = doc_of[place]
                start, end = words.first[doc], words.first[doc + 1]
                a, b = np.maximum(place + span - OVERLAP, start), np.minimum(place + OVERLAP, end)
                raw = words.hash.tobytes()
                near = [raw[8 * x : 8 * y] for x, y in zip(a.tolist(), b.tolist())]
                if bitmap is None:
                    yield pa.RecordBatch.from_arrays(
                        [part.column("id").take(pa.array(doc)), pa.array(seed.view(np.int64)), pa.array(place - start, pa.int64()), pa.array(place - a, pa.int32()), pa.array(near, pa.binary()), pa.array(end - start, pa.int64())], names=_ITEM_NAMES
                    )
                    continue
                rows: dict[tuple, list[int]] = {}
                for i, key in enumerate(zip(seed.view(np.int64).tolist(), (place - a).tolist(), near)):
                    rows.setdefault(key, []).append(i)
                groups = [(*key, at[lo : lo + OWNERS_PER_ROW]) for key, at in rows.items() for lo in range(0, len(at), OWNERS_PER_ROW)]
                flat = np.concatenate([g[3] for g in groups])
                owners = pa.StructArray.from_arrays(
                    [part.column("id").take(pa.array(doc[flat])), part.column("text_hash").take(pa.array(doc[flat])), pa.array((place - start)[flat], pa.int64())], names=["doc_id", "text_hash", "place"]
                )
                ends = pa.array(np.concatenate([[0], np.cumsum([len(g[3]) for g in groups])]), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([g[0] for g in groups], pa.int64()), pa.array([g[1] for g in groups], pa.int32()), pa.array([g[2] for g in groups], pa.binary()), pa.ListArray.from_arrays(ends, owners)], names=["seed", "before", "near", "owners"]
                )

    return seeds


_ITEM_NAMES = ["id", "seed", "place", "before", "near", "n_words"]
_ITEM_SEEDS = "id long, seed long, place long, before int, near binary, n_words long"
_OWNERS = "array<struct<doc_id: bigint, text_hash: bigint, place: bigint>>"
_SEEDS = f"seed long, before int, near binary, owners {_OWNERS}"


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hits with the best overlap around each: words in a row that hold the seed's window."""
    for batch in batches:
        got = batch.to_pydict()
        matched = []
        for b1, n1, b2, n2, size in zip(got["before"], got["near"], got["item_before"], got["item_near"], got["item_words"]):
            x, y = np.frombuffer(n1, U64), np.frombuffer(n2, U64)
            left = min(b1, b2)
            x, y = x[b1 - left :], y[b2 - left :]
            n = min(len(x), len(y))
            same = (x[:n] == y[:n]).astype(np.int32)
            need = min(OVERLAP, size)
            sums = np.concatenate([[0], np.cumsum(same)])
            best = int((sums[need:] - sums[:-need]).max()) if n >= need else 0
            matched.append(best if n >= need and best >= need - may_differ(need) else None)
        kept = pa.array(matched, pa.int32())
        yield pa.RecordBatch.from_arrays([batch.column("owners"), batch.column("item_id"), batch.column("item_place"), kept], names=["owners", "item_id", "item_place", "matched"]).filter(kept.is_valid())


def _texts(df: DataFrame, key: str) -> DataFrame:
    return df.select(F.col(key).cast("long").alias("id"), F.xxhash64(F.coalesce("text", F.lit("\0null"))).alias("text_hash"), F.lower("text").alias("text"))


def find_overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents of ``docs`` (``doc_id``, ``text``) that hold passages of ``benchmark`` (``item_id``, ``text``).

    Returns ``doc_id, text_hash, item_id, n_places, matched``: a row for each
    document and item that share ``OVERLAP`` words in a row (all words of an
    item that has fewer) of which ``MAX_DIFFERENT`` may be different words, one
    in items of 4 to 7 words and none in shorter ones; every such row has a
    seed. ``n_places`` counts the diagonals, ``matched`` is the largest number
    of equal words in such a row. Words are lower-cased runs of ASCII letters,
    digits and non-ASCII characters. Texts without a word, null texts and empty
    tables give no rows; equal rows count once.
    """
    items = _texts(benchmark, "item_id").mapInArrow(_seeds(None, list(range(len(SHAPES)))), _ITEM_SEEDS)
    items = items.groupBy("id", "seed", "place").agg(F.first(F.struct("before", "near", "n_words")).alias("i"))
    items = items.select(F.col("id").alias("item_id"), "seed", F.col("place").alias("item_place"), F.col("i.before").alias("item_before"), F.col("i.near").alias("item_near"), F.col("i.n_words").alias("item_words"))
    bit = F.col("seed").bitwiseAND(F.lit(BITMAP_BITS - 1))
    set_bits = items.groupBy(F.shiftright(bit, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(seed & 63 as int))")).alias("bits"), F.bit_or(F.expr(f"shiftleft(1L, cast(least(item_words, {OVERLAP}) as int))")).alias("sizes"))  # noqa: F541
    bitmap, sizes = np.zeros(_WORDS_PER_ROW, np.int64), 0
    for row in set_bits.collect():  # one row per word of the bitmap at most
        bitmap[row["word"]] = row["bits"]
        sizes |= row["sizes"]
    shapes = np.flatnonzero(_HAS_SHAPE[[size for size in range(OVERLAP + 1) if sizes >> size & 1]].any(axis=0)).tolist()
    seeds = _texts(docs, "doc_id").mapInArrow(lean(_seeds(bitmap.view(U64), shapes)), _SEEDS)
    checked = seeds.join(items, "seed").select("owners", "item_id", "item_place", "before", "near", "item_before", "item_near", "item_words").mapInArrow(lean(_verify), f"owners {_OWNERS}, item_id long, item_place long, matched int")
    checked = checked.select(F.explode("owners").alias("o"), "item_id", "item_place", "matched")
    checked = checked.select("o.doc_id", "o.text_hash", "item_id", (F.col("o.place") - F.col("item_place")).alias("diagonal"), "matched")
    found = checked.groupBy("doc_id", "text_hash", "item_id", "diagonal").agg(F.max("matched").alias("matched"))
    return found.groupBy("doc_id", "text_hash", "item_id").agg(F.count("*").alias("n_places"), F.max("matched").alias("matched"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows that overlap an item of ``benchmark``; all columns stay, whatever their names."""
    found = find_overlaps(docs, benchmark).select(F.col("doc_id").alias("_found_id"), F.col("text_hash").alias("_found_hash")).distinct()
    own = F.xxhash64(F.coalesce(docs["text"], F.lit("\0null")))
    return docs.join(found.hint("merge"), docs["doc_id"].cast("long").eqNullSafe(found["_found_id"]) & (own == found["_found_hash"]), "left_anti")
