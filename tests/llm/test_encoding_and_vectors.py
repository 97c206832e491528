"""Byte-level BPE against tiktoken, alignment of two tokenizers and hard negatives against brute force, and odd inputs."""

import base64
import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from tessella.llm import byte_bpe, hard_negatives, language_id, token_alignment
from tessella.llm.queries import queries
from tests.oracle import DATA

RANKS, JSON, PIECES = (public_tokenizers.path(x) for x in ("byte_bpe_50k.tiktoken", "byte_bpe_50k.json", "piece_bpe_32k.model"))
ODD = [*"ab  \n\t.'s1é中\x1c\x85\xa0 🙂tlÄ-²Ⅷ \r\0", "hello", "  ", "<|endoftext|>", " the", "<s>", "<0x41>", "</s>", "it's"]


def odd_texts(n, letters=ODD, seed=1):
    r = random.Random(seed)
    return ["".join(r.choice(letters) for _ in range(r.randint(0, 60))) for _ in range(n)]


def known_ranks():
    with open(RANKS, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@pytest.fixture(scope="module")
def codec():
    with open(RANKS, "rb") as f:
        return byte_bpe.Codec(f.read(), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=known_ranks(), special_tokens={})


def ids_of(raw):
    return np.frombuffer(raw, np.int32).tolist()


def test_every_character_as_the_library(codec, library):
    """Each code point beside letters, digits, blanks and marks."""
    texts = ["".join(f"a{c}b 1{c}2 {c} x{c}{c}.{c}" for c in map(chr, range(lo, lo + 64)) if not 0xD800 <= ord(c) < 0xE000) for lo in [*range(0, 0x3400, 64), *range(0xF900, 0x11000, 64), *range(0x1F300, 0x1F700, 64)]]
    got = codec.encode(texts)
    for t, x in zip(texts, got):
        assert ids_of(x) == library.encode_ordinary(t)
        assert codec.decode(ids_of(x)) == t.encode()


@pytest.mark.parametrize("size", [1, 17, byte_bpe.BLOCK_CHARS])
def test_blocks_of_a_text(monkeypatch, codec, library, size):
    monkeypatch.setattr(byte_bpe, "BLOCK_CHARS", size)
    monkeypatch.setattr(byte_bpe.blocks, "__defaults__", (size,))
    monkeypatch.setattr(byte_bpe, "REMEMBERED", 50)
    texts = odd_texts(500) + ["a" * 5000, "ab" * 3000 + "!", " " * 3000, "", "x\n\n y"]
    assert list(map(ids_of, codec.encode(texts))) == [library.encode_ordinary(t) for t in texts]


@given(st.binary(min_size=1, max_size=60))
@settings(max_examples=300, deadline=None)
def test_trees_merge_as_a_plain_loop(piece):
    """One tree in lists, many in arrays, and a search over all pairs for each merge."""
    ranks = _RANKS
    parts = [bytes([x]) for x in piece]
    while True:
        found = [(ranks[parts[i] + parts[i + 1]], i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in ranks]
        if not found:
            break
        _, i = min(found)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    want = [ranks[x] for x in parts]
    ids = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
    assert ids_of(byte_bpe.merge_many([piece, b"z", piece], 64, ids, _PAIRS)[2]) == want
    if piece not in ranks:
        assert list(byte_bpe.merge(piece, ranks)) == want


_RANKS = known_ranks()
_PAIRS = byte_bpe.PairRanks(_RANKS)


def test_encoding_of_a_table(spark, library):
    """The query's digests from real ids; null and empty texts, repeated rows, null ids and columns of the same names."""
    rows = [(1, "one two"), (1, "one two"), (2, None), (3, ""), (None, "é 中"), (4, " ".join(f"w{i}" for i in range(50_000)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash")).withColumn("bytes", F.lit(1)).withColumn("c0", F.lit(1))
    args = RANKS, public_tokenizers.PATTERN
    want = sorted(((i, len(e), hashlib.sha256(" ".join(map(str, e)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows for e in [library.encode_ordinary(t or "")]), key=repr)
    assert sorted(map(tuple, byte_bpe.digests(docs, *args).collect()), key=repr) == want
    encoded = byte_bpe.encode(docs, *args)
    assert sorted((r["ids"] for r in encoded.collect()), key=repr) == sorted((library.encode_ordinary(t or "") for _, t in rows), key=repr)
    assert sorted(bytes(r["bytes"]) for r in byte_bpe.decode(encoded, *args).collect()) == sorted((t or "").encode() for _, t in rows)
    assert byte_bpe.digests(docs.limit(0), *args).count() == 0


def test_op11_against_the_library(spark, library):
    got = {r["doc_id"]: tuple(r)[1:] for r in queries()["op11_byte_bpe"](spark, DATA).collect()}
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for r in docs:
        e = library.encode_ordinary(r["text"] or "")
        assert got[r["doc_id"]] == (len(e), hashlib.sha256(" ".join(map(str, e)).encode()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest())


def brute_alignment(rows):
    """Both libraries on whole texts, common ends, and counts over all links."""
    a, b = Tokenizer.from_file(JSON), SentencePieceProcessor(model_file=PIECES)
    a.encode_special_tokens = True
    letters = token_alignment.byte_alphabet()
    docs, rows_with = [], Counter()
    for d, t in rows:
        groups = []
        if t:
            ids_a, ids_b = a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)
            raw_a = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids_a]
            raw_b = [bytes([int(b.id_to_piece(i)[1:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
            if b"".join(raw_a) == (" " + t).encode() == b"".join(raw_b):
                ends_a, ends_b = np.cumsum(list(map(len, raw_a))).tolist(), np.cumsum(list(map(len, raw_b))).tolist()
                i = j = 0
                for cut in sorted(set(ends_a) & set(ends_b)):
                    k, m = ends_a.index(cut, i) + 1, ends_b.index(cut, j) + 1
                    groups.append((ids_a[i:k], ids_b[j:m]))
                    i, j = k, m
        links = [(x, y) for ga, gb in groups for x in ga for y in gb]
        rows_with.update(set(links))
        docs.append((d, groups, links))
    best = defaultdict(int)
    for (x, _), n in rows_with.items():
        best[x] = max(best[x], n)
    text = lambda groups: ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
    return sorted(
        (
            (d, sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), len(links), sum(rows_with[p] == best[p[0]] for p in links), sum(rows_with[p] for p in links), hashlib.sha256(text(g).encode()).hexdigest() if g else "")
            for d, g, links in docs
        ),
        key=repr,
    )


@pytest.mark.parametrize(("large", "chars", "table"), [(token_alignment.LARGE_GROUP, 1 << 20, 1 << 22), (0, 40, 7)])
def test_alignment_of_odd_texts(spark, monkeypatch, large, chars, table):
    """Marks, blanks, bytes, special tokens, literal U+2581, long runs; groups by their different ids, texts in blocks, counts in several slices."""
    texts = odd_texts(300) + odd_texts(100, [*ODD, "▁"], 2) + [None, "", " ", "a" * 3000, "中" * 500 + "!" * 500, "trailing ", "x" + " " * 6000 + "y"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(7, texts[7]), (None, "a b c")]
    monkeypatch.setattr(token_alignment, "LARGE_GROUP", large)
    aligner = token_alignment.Aligner(JSON, PIECES)
    monkeypatch.setattr(token_alignment, "SLICE_CHARS", chars)
    monkeypatch.setattr(token_alignment, "TABLE_SLICE", table)
    found = aligner.align([t or "" for _, t in rows])
    want = brute_alignment(rows)
    got = sorted(((d, *c.tolist(), hashlib.sha256(g.encode()).hexdigest() if g else "") for (d, _), c, g in zip(rows, found.counts, found.groups)), key=repr)
    assert got == [(*x[:5], x[7]) for x in want]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("pairs", F.lit("clash")).withColumn("n_a", F.lit(1))
    assert sorted(map(tuple, token_alignment.alignment(docs, JSON, PIECES).collect()), key=repr) == want


def test_counts_in_several_slices(spark, tmp_path, monkeypatch):
    """A table that is more than one slice is read past the documents, with the same sums."""
    rows = [(i, t) for i, t in enumerate(odd_texts(60, seed=5))]
    found = token_alignment.aligned(spark.createDataFrame(rows, "doc_id long, text string"), JSON, PIECES, hashed=True)
    token_alignment.pair_counts(found).repartitionByRange(3, "pair").sortWithinPartitions("pair").write.parquet(f"file://{tmp_path}/counts")
    batches = found.toArrow().to_batches()
    whole = [r for b in token_alignment._score(f"file://{tmp_path}/counts")(iter(batches)) for r in b.to_pylist()]
    monkeypatch.setattr(token_alignment, "TABLE_SLICE", 7)
    token_alignment._small_table.cache_clear()
    assert [r for b in token_alignment._score(f"file://{tmp_path}/counts")(iter(batches)) for r in b.to_pylist()] == whole
    token_alignment._small_table.cache_clear()
    assert sorted((r["doc_id"], r["n_best"], r["count_sum"]) for r in whole) == sorted((x[0], x[5], x[6]) for x in brute_alignment(rows))


def test_rank_table_is_the_tokenizer(spark):
    """Every token by itself merges to itself, so that merging by ranks is merging by the list of merges; and texts agree."""
    side = token_alignment.ByteLevel(JSON)
    assert side.ranks is not None
    bare = Tokenizer(side.tokenizer.model)
    names = [side.tokenizer.id_to_token(i) for i in range(side.ranks.n_vocab)]
    assert [e.ids for e in bare.encode_batch(names, add_special_tokens=False)] == [[i] for i in range(len(names))]
    texts = [" " + r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").select("text").collect() if r["text"]]
    assert side.encode(texts).ids.tolist() == [i for t in texts for i in side.tokenizer.encode(t, add_special_tokens=False).ids]


def test_op13_against_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    assert sorted(map(tuple, queries()["op13_token_alignment"](spark, DATA).collect()), key=repr) == brute_alignment([tuple(r) for r in docs.collect()])
    assert token_alignment.alignment(docs.limit(0), JSON, PIECES).count() == 0


@given(st.integers(2, 12), st.integers(0, 40), st.randoms())
@settings(max_examples=100, deadline=None)
def test_components(n, m, r):
    edges = [(r.randrange(n), r.randrange(n)) for _ in range(m)]
    label = list(range(n))
    for _ in range(n):
        for u, v in edges:
            label[u] = label[v] = min(label[u], label[v])
    u, v = (np.array([e[k] for e in edges], int) for k in (0, 1))
    assert token_alignment.components(n, u, v).tolist() == label


def brute_negatives(rows):
    """Integer products of all pairs; the rows that take part, each by itself."""
    used = []
    for i, x, label in rows:
        if label is not None and x is not None and all(v is not None and np.isfinite(v) for v in x):
            q = [max(-(1 << 24), min(1 << 24, int(np.floor(256 * float(v))))) for v in x]
            used.append((i, (label + 1) % 10 if i is not None and i % 7 == 0 else label, q))
    order = lambda p: (-p[0], p[1] is None, p[1] or 0)
    out, anchors = [], []
    for a in used:
        if a[0] is not None and a[0] % 50 == 0 and a not in anchors:
            anchors.append(a)
    for i, label, q in anchors:
        others = [(sum(x * y for x, y in zip(q, r)), j, other) for j, other, r in used if j != i and len(r) == len(q)]
        for p, pos, _ in sorted((o for o in others if o[2] == label), key=order)[:5]:
            fits = sorted((o for o in others if o[2] != label and 50 * p <= 100 * o[0] <= 95 * p), key=order)[:3]
            out += [(i, pos, k, neg, p, s) for k, (s, neg, _) in enumerate(fits, 1)]
    return sorted(out, key=repr)


def test_hard_negatives_of_odd_rows(spark):
    """Null and repeated IDs, many copies of a vector, ties, components that are missing or beyond all bounds, other lengths."""
    r = np.random.default_rng(3)
    f = lambda x: [float(np.float32(v)) for v in x]
    hot = f(r.normal(size=6))
    rows = [(i, f(r.normal(size=6)), int(r.integers(0, 3))) for i in range(300)] + [(i, hot, i % 2) for i in range(300, 700)] + [(i, f(r.integers(-1, 2, size=6)), i % 3) for i in range(700, 1000)]
    rows += [(None, f(r.normal(size=6)), 1), (None, hot, 1), (50, f(r.normal(size=6)), 2), (100, rows[100][1], rows[100][2]), (1, None, 1), (2, [1.0, None] * 3, 1), (3, [float("nan")] * 6, 2), (4, [float("inf")] + [0.0] * 5, 2)]
    rows += [(5, hot, None), (1050, [], 1), (1051, [], 1), (1100, [1e30, -1e30, 5.0], 1), (1101, [1e30, 1.0, 5.0], 1), (1102, [2.0, 1.0, 5.0], 2), (1150, [0.0] * 6, 2), (-50, hot, 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("score", F.lit("clash")).withColumn("q", F.lit(1))
    assert sorted(map(tuple, hard_negatives.mine(table).collect()), key=repr) == brute_negatives(rows)
    assert hard_negatives.mine(table.limit(0)).count() == 0


def test_bounds_hold_for_any_rotation():
    """Few rows in a tile, a rotation that leads with the wrong components, large and small numbers: the best are those of integers."""
    r = np.random.default_rng(5)
    for scale in (3, 300, 1 << 24):
        q = r.integers(-scale, scale + 1, (900, 12)).astype(np.int32)
        rotation = np.linalg.qr(r.normal(size=(12, 12)))[0]
        rows = hard_negatives.side(np.arange(900), r.integers(0, 3, 900), q, rotation)
        anchors = rows.take(slice(0, 40))
        low, high = np.sort(r.integers(-scale * scale, scale * scale, (40, 2, 2)), axis=2).transpose(2, 0, 1)
        a, slot, row, score = hard_negatives.best(anchors, rows, False, low, high, 3)
        got = sorted(zip(a.tolist(), slot.tolist(), score.tolist(), row.tolist()))
        exact = q[:40].astype(np.int64) @ q.astype(np.int64).T
        want = []
        for i in range(40):
            for j in range(2):
                fits = [(-exact[i, x], x) for x in range(900) if rows.label[x] != rows.label[i] and low[i, j] <= exact[i, x] <= high[i, j]]
                want += [(i, j, -s, x) for s, x in sorted(fits)[:3]]
        assert got == sorted(want)


def test_languages_with_large_alphabets(spark):
    """64 languages, one of them with thousands of letters, each with a full sample; a language whose texts are all longer has the first part of its shortest."""
    r = random.Random(7)
    letters = [chr(c) for c in range(0x4E00, 0x4E00 + 6000)]
    texts = [("".join(r.choice(letters) for _ in range(16_000)), "zh") for _ in range(2)]
    for k in range(62):
        own = [chr(0x61 + k % 26), *(chr(0x400 + 8 * k + j) for j in range(8))]
        texts += [(" ".join("".join(r.choice(own) for _ in range(5)) for _ in range(2600)), f"l{k}") for _ in range(2)]
    texts.append(("ω" + "ψξ " * 300_000, "long"))
    docs = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate((t, lang) for t, lang in texts for _ in range(3))], "doc_id long, text string, lang string")
    model = language_id.train(docs)
    assert len(model) == 64 and all(len(sample) <= language_id.CHARS_PER_LANGUAGE + language_id.TEXTS_PER_LANGUAGE for _, sample in model)
    probes = spark.createDataFrame([(i, t[:3000], lang) for i, (t, lang) in enumerate(texts)], "doc_id long, text string, lang string")
    got = language_id.identify(probes, model).join(probes.select("doc_id", "lang"), "doc_id").collect()
    assert all(x["lang_pred"] == x["lang"] for x in got) and len(got) == len(texts)
