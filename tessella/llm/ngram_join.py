"""N-gram Jaccard self-join of documents: MinHash banding, then exact verification.

1. Each text becomes its set of word 5-grams (words: lower-cased runs of ASCII
   letters, digits and non-ASCII characters; a text of one to four words is one
   gram). Texts with equal sets form a class at once.
2. Every class gets a MinHash signature, cut in bands; classes that share a
   band hash form a bucket. Band and row counts follow from a target recall at
   the threshold (``choose_bands``).
3. Buckets are joined into candidate groups. A group of bounded size is
   verified in one task on full n-gram sets; a larger one bucket by bucket, and
   a large bucket in tiles of bounded size, where each pair counts only in the
   first bucket that both share. Only counts and a spanning forest leave a task,
   never all pairs of a group.
4. Classes linked directly or through others share a ``class_id``.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.components import connected_components
from tessella.llm.storage import lean, materialize, small_batches
from tessella.llm.words import ALNUM_WORDS, U64, find_words, mix, slices, window_hashes, windows_inside

NGRAM = 5
THRESHOLD = 0.8
#: Classes and n-grams that one verification task takes at most.
UNIT_DOCS, UNIT_GRAMS = 2048, 500_000
#: Text that is hashed at once.
SLICE_BYTES = 1 << 18


def choose_bands(threshold: float, target_recall: float, rows: int = 5) -> tuple[int, int]:
    """Bands of ``rows`` rows so that a pair at ``threshold`` meets in a band with ``target_recall``."""
    bands = 1
    while 1 - (1 - threshold**rows) ** bands < target_recall:
        bands += 1
    return bands, rows


def _grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-gram sets of texts, text after text, and the number of each."""
    words = find_words(texts, ALNUM_WORDS)
    grams = window_hashes(words.hash, NGRAM)[windows_inside(words.first, NGRAM)]
    counts = words.counts
    many = np.maximum(counts - NGRAM + 1, 0)
    starts = np.concatenate([[0], np.cumsum(many)])
    sets = []
    for d in range(len(counts)):
        if many[d]:
            sets.append(np.unique(grams[starts[d] : starts[d + 1]]))
        elif counts[d]:
            own = words.hash[words.first[d] : words.first[d + 1]]
            sets.append(window_hashes(own, len(own)))
        else:
            sets.append(np.zeros(0, U64))
    return np.concatenate(sets) if sets else np.zeros(0, U64), np.array([len(s) for s in sets], np.int64)


def _set_ids(grams: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that identify each non-empty set, whatever the order."""
    at = np.concatenate([[0], np.cumsum(counts)[:-1]])[counts > 0]
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    one, two = np.add.reduceat(mix(grams), at), np.add.reduceat(mix(grams ^ U64(0xD6E8FEB86659FD93)), at)
    return mix(one).view(np.int64), mix(two).view(np.int64)


def _signer(bands: int, rows: int):
    rng = np.random.default_rng(7)
    xors = rng.integers(0, 2**63, bands * rows, dtype=np.uint64) * U64(2)
    odd = rng.integers(0, 2**63, bands * rows, dtype=np.uint64) * U64(2) + U64(1)
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("n_grams", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in slices(batch.column("text"), SLICE_BYTES):
                part = batch.slice(lo, hi - lo)
                grams, counts = _grams(part.column("text"))
                full = counts > 0
                f1, f2 = _set_ids(grams, counts)
                at = np.concatenate([[0], np.cumsum(counts)[:-1]])[full]
                hashes = np.zeros((len(at), bands), U64)
                for b in range(bands if len(at) else 0):
                    band = np.full(len(at), U64(b + 1))
                    for k in range(b * rows, (b + 1) * rows):
                        band = mix(band * U64(0x9E3779B97F4A7C15) + (np.minimum.reduceat((grams ^ xors[k]) * odd[k], at) >> U64(16)))
                    hashes[:, b] = band
                where = np.flatnonzero(full)
                back = np.full(len(counts), -1)
                back[where] = np.arange(len(where))
                take = pa.array(back, mask=~full)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(where) + 1) * bands, pa.int32()), pa.array(hashes.reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("text_hash"), pa.array(f1).take(take), pa.array(f2).take(take), pa.array(counts), lists.take(take)], schema=schema
                )

    return sign


_SIGNED = "doc_id long, text_hash long, f1 long, f2 long, n_grams long, bands array<long>"


def _narrow(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit("\0null"))).alias("text_hash"), F.lower("text").alias("text"))


def _gram_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi in slices(batch.column("text"), SLICE_BYTES):
            part = batch.slice(lo, hi - lo)
            grams, counts = _grams(part.column("text"))
            f1, f2 = _set_ids(grams, counts)
            full = counts > 0
            raw, ends = grams.tobytes(), np.concatenate([[0], np.cumsum(counts)]) * 8
            found = [raw[ends[d] : ends[d + 1]] for d in np.flatnonzero(full)]
            part = part.filter(pa.array(full))
            same = (part.column("f1").to_numpy() == f1) & (part.column("f2").to_numpy() == f2)
            yield pa.RecordBatch.from_arrays([pa.array(f1), pa.array(f2), pa.array(found, pa.binary())], names=["f1", "f2", "grams"]).filter(pa.array(same))


def _shared_counts(values: np.ndarray, of: np.ndarray, m: int) -> np.ndarray:
    """How many values each pair of the ``m`` sets has in common."""
    out = np.zeros((m, m), np.float32)
    if not len(values):
        return out
    order = np.argsort(values, kind="stable")
    values, of = values[order], of[order]
    first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    sizes = np.diff(np.append(first, len(values)))
    many = np.repeat(sizes, sizes)
    few = (many > 1) & (many <= 16)
    v, o = values[few], of[few]
    flat = out.reshape(-1)
    for step in range(1, 16):
        same = np.flatnonzero(v[:-step] == v[step:]) if len(v) > step else np.zeros(0, np.int64)
        if not len(same):
            break
        a, b = o[same], o[same + step]
        keys, n = np.unique(np.concatenate([a * m + b, b * m + a]), return_counts=True)
        flat[keys] += n
    often = many > 16
    column = np.cumsum(np.concatenate([[0], (values[often][1:] != values[often][:-1]).astype(np.int64)])) if often.any() else np.zeros(0, np.int64)
    rows = of[often]
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, 2048):
        a, b = np.searchsorted(column, [lo, lo + 2048])
        dense = np.zeros((m, 2048), np.float32)
        dense[rows[a:b], column[a:b] - lo] = 1
        out += dense @ dense.T
    return out


def _verifier(threshold: float):
    share = Fraction(threshold).limit_denominator(1000)
    num, den = share.numerator, share.denominator

    def verify(group: pa.Table) -> pa.Table:
        ids = np.stack([group.column("f1").to_numpy(), group.column("f2").to_numpy()], 1)
        _, keep = np.unique(ids, axis=0, return_index=True)  # a repeated row of the input counts once
        group = group.take(pa.array(keep))
        m = len(keep)
        f1 = group.column("f1").to_numpy()
        copies = group.column("copies").to_numpy().astype(np.float64)
        sets = [np.frombuffer(x, U64) for x in group.column("grams").to_pylist()]
        sizes = np.array([len(s) for s in sets])
        shared = _shared_counts(np.concatenate(sets), np.repeat(np.arange(m), sizes), m)
        linked = np.zeros((m, m), bool)
        for a in range(0, m, 512):
            linked[a : a + 512] = shared[a : a + 512] * (den + num) >= num * (sizes[a : a + 512, None] + sizes[None, :])
        np.fill_diagonal(linked, False)
        counted = linked.copy()
        side = group.column("side").to_numpy()
        if group.column("crossing")[0].as_py():
            counted &= side[:, None] != side[None, :]
        bucket = group.column("unit")[0].as_py()
        earlier = [np.array([b for b in x or [] if b < bucket], np.int64) for x in group.column("buckets").to_pylist()]
        if any(map(len, earlier)):
            counted &= _shared_counts(np.concatenate(earlier), np.repeat(np.arange(m), [len(x) for x in earlier]), m) == 0
        links = np.array([copies[row].sum() for row in counted], np.float64).astype(np.int64)
        root = np.full(m, -1)
        for s in np.argsort(f1, kind="stable"):
            if root[s] < 0:
                reached, edge = np.zeros(m, bool), np.array([s])
                reached[s] = True
                while len(edge):
                    new = np.zeros(m, bool)
                    for e in edge:
                        new |= linked[e]
                    edge = np.flatnonzero(new & ~reached)
                    reached |= new
                root[reached] = s
        return pa.table({"f1": f1, "f2": group.column("f2"), "links": links, "root": f1[root], "crossing": group.column("final").to_numpy(zero_copy_only=False)})

    return verify


def ngram_classes(docs: DataFrame, threshold: float = THRESHOLD, target_recall: float = 0.9999) -> DataFrame:
    """Class and links of each row of ``docs`` (``doc_id``, ``text``; other columns are ignored).

    Returns ``doc_id, text_hash, label, class_id, n_links``, a row for each input
    row. ``label`` names the class also where it has no ID (null without words).
    ``class_id`` is the least ``doc_id`` of the class (null if all are null) and
    ``n_links`` the number of other rows whose n-gram set has at least
    ``threshold`` in common. A null text or one without words is alone in its
    class, without links. A row that occurs twice is a copy of itself.
    """
    bands, rows = choose_bands(threshold, target_recall)
    narrow = _narrow(docs)
    with small_batches(docs.sparkSession):
        signed = materialize(narrow.mapInArrow(lean(_signer(bands, rows)), _SIGNED))
    classes = materialize(
        signed.where("f1 IS NOT NULL")
        .groupBy("f1", "f2")
        .agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("rep"), F.count("*").alias("copies"), F.first("n_grams").alias("n_grams"), F.first("bands").alias("bands"))
        .withColumns({"rep": F.col("rep.doc_id"), "rep_hash": F.col("rep.text_hash")})
    )
    in_bucket = classes.select("f1", "f2", "n_grams", F.explode("bands").alias("bucket"))
    buckets = (
        in_bucket.groupBy("bucket")
        .agg(F.count("*").alias("n"), F.sum("n_grams").alias("weight"), F.bit_xor(F.xxhash64("f1", "f2")).alias("members"), F.min("f1").alias("head"))
        .where("n > 1")
        .groupBy("n", "members", "weight", "head")  # buckets of the same classes count as one
        .agg(F.min("bucket").alias("bucket"))
    )
    member = materialize(in_bucket.join(buckets.select("bucket", "n", "weight", "head"), "bucket").select("bucket", "f1", "f2", "n_grams", "n", "weight", "head"))
    per_class = member.groupBy("f1", "f2", "n_grams").agg(  # one bucket per band at most
        F.sort_array(F.collect_list("bucket")).alias("buckets"), F.sort_array(F.collect_set("head")).alias("heads")
    )
    per_class = materialize(per_class)
    # a class is tied to its least head, and its heads to each other, which are few different pairs in a large group
    to_head = per_class.select(F.col("f1").alias("u"), F.element_at("heads", 1).alias("v"))
    pairs = F.arrays_zip(F.col("heads").alias("u"), F.slice("heads", F.lit(2), F.size("heads")).alias("v"))
    between = per_class.where("size(heads) > 1").select(F.inline(pairs)).where("v IS NOT NULL").distinct()
    groups = connected_components(to_head.union(between))
    candidates = (
        per_class.drop("heads")
        .join(groups.select(F.col("node").alias("f1"), F.col("label").alias("group")), "f1")
        .join(classes.select("f1", "f2", "rep", "rep_hash", "copies"), ["f1", "f2"])
    )
    candidates = materialize(candidates)
    sizes = candidates.groupBy("group").agg(F.count("*").alias("size"), F.sum("n_grams").alias("total"))
    candidates = candidates.join(sizes, "group").withColumn("whole", (F.col("size") <= UNIT_DOCS) & (F.col("total") <= UNIT_GRAMS))
    texts = candidates.select("f1", "f2", "rep", "rep_hash")
    grams = (
        narrow.select("doc_id", "text_hash", "text")
        .join(texts.hint("merge"), F.col("doc_id").eqNullSafe(F.col("rep")) & (F.col("text_hash") == F.col("rep_hash")))  # the candidates grow with the corpus: never broadcast
        .select("text", "f1", "f2")
        .mapInArrow(lean(_gram_rows), "f1 long, f2 long, grams binary")
    )
    with small_batches(docs.sparkSession):
        wide = materialize(
            candidates.select("f1", "f2", "copies", "group", "whole", F.when(F.col("whole"), F.array().cast("array<long>")).otherwise(F.col("buckets")).alias("buckets"))
            .join(grams, ["f1", "f2"])
        )
    columns = ["unit", "part", "other", "side", "crossing", "final", "f1", "f2", "copies", "buckets", "grams"]
    whole = wide.where("whole").select(
        F.col("group").alias("unit"), F.lit(-1).alias("part"), F.lit(-1).alias("other"), F.lit(0).alias("side"), F.lit(False).alias("crossing"), F.lit(True).alias("final"), "f1", "f2", "copies", "buckets", "grams"
    )
    parts = F.greatest(F.ceil(F.col("n") / (UNIT_DOCS // 4)), F.ceil(F.col("weight") / (UNIT_GRAMS // 4))).cast("int")
    tiled = (
        wide.where("NOT whole").select("f1", "f2", "copies", "buckets", "grams")
        .join(member.select("f1", "f2", "bucket", parts.alias("parts")), ["f1", "f2"])
        .withColumn("side", F.pmod(F.xxhash64("f1", "f2", "bucket"), F.col("parts")).cast("int"))
        .withColumn("beside", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select(
            F.col("bucket").alias("unit"), F.least("side", "beside").alias("part"), F.greatest("side", "beside").alias("other"), "side",
            (F.col("side") != F.col("beside")).alias("crossing"), F.lit(False).alias("final"), "f1", "f2", "copies", "buckets", "grams",
        )
    )
    verify = _verifier(threshold)
    found = materialize(
        whole.select(columns).unionByName(tiled.select(columns))
        .groupBy("unit", "part", "other")
        .applyInArrow(verify, "f1 long, f2 long, links long, root long, crossing boolean")
    )
    links = found.groupBy("f1", "f2").agg(F.sum("links").alias("links"), F.min(F.when(F.col("crossing"), F.col("root"))).alias("root"))
    spread = connected_components(found.where("NOT crossing").select(F.col("f1").alias("u"), F.col("root").alias("v")))
    labels = links.join(spread.withColumnRenamed("node", "f1"), "f1", "left").select("f1", "f2", "links", F.coalesce("root", "label").alias("label"))
    labelled = classes.select("f1", "f2", "rep", "copies").join(labels, ["f1", "f2"], "left")
    labelled = labelled.select("f1", "f2", "rep", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("label", "f1").alias("label"))
    labelled = materialize(labelled)
    heads = labelled.groupBy("label").agg(F.min("rep").alias("class_id"))
    result = labelled.join(heads, "label").select("f1", "f2", "label", "class_id", "n_links")
    out = signed.select("doc_id", "text_hash", "f1", "f2").join(result, ["f1", "f2"], "left")
    return out.select(
        "doc_id", "text_hash", "label",
        F.when(F.col("f1").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
    )


def keep_one_of_each(docs: DataFrame, threshold: float = THRESHOLD, target_recall: float = 0.9999) -> DataFrame:
    """``docs`` with one row of each near-duplicate class: the one of least ``doc_id``, then least text hash.

    Repeated rows leave one; rows with a null ``doc_id`` are kept only where the
    whole class has none. All columns of ``docs`` are returned.
    """
    classes = ngram_classes(docs, threshold, target_recall)
    words_less = classes.where("n_links = 0").select("doc_id", "text_hash")
    groups = classes.where("n_links > 0").groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("first"))
    keep = groups.select("first.doc_id", "first.text_hash").union(words_less).distinct()
    keep = keep.select(F.col("doc_id").alias("_keep_id"), F.col("text_hash").alias("_keep_hash"))
    # the row travels as one struct, beside which helper columns have no names to clash with
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.coalesce("text", F.lit("\0null"))).alias("hash"))
    joined = rows.join(keep, rows["id"].eqNullSafe(keep["_keep_id"]) & (rows["hash"] == keep["_keep_hash"]), "left_semi")
    return joined.dropDuplicates(["id", "hash"]).select("row.*")
