"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built over a bounded sample of labelled
texts. A text is then parsed greedily against each automaton in phrases, each
the longest match from where the last one ended; a text of a language needs few
and long phrases under its own automaton. The language with the fewest phrases
per character wins.

NumPy steps all blocks of a slice of texts, and all languages, at once. Blocks
are first parsed as if a phrase ended before each; where it doesn't, a block is
parsed again from the state that the block before it ends in, up to where both
parses are in the same state, be it blocks later, so that phrases and counts
are those of one greedy parse of the whole text. Transitions are a hash table in flat arrays,
whose size follows the sample and not the alphabet. Only the sample texts
travel to the executors; each Python worker builds the tables once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.storage import lean
from tessella.llm.words import U64

#: The sample that is learned from: so many languages (those with most rows), so many different texts of each, and of
#: these whole texts up to so many characters in all.
MAX_LANGUAGES, TEXTS_PER_LANGUAGE, CHARS_PER_LANGUAGE = 64, 256, 32_000
#: Characters that one step takes from; it bounds the steps, not the phrases.
BLOCK = 256
#: Characters of the texts, times languages, that are parsed at once.
SLICE = 4_000_000
#: A text is of no language if its rate is so many deviations above the mean of texts of the best one. The deviation is that of
#: pieces of so many characters; shorter texts deviate more, with the root of their length.
DEVIATIONS, PIECE = 6.0, 100

Model = tuple[tuple[str, str], ...]


def train(docs: DataFrame, texts: int = TEXTS_PER_LANGUAGE, chars: int = CHARS_PER_LANGUAGE, languages: int = MAX_LANGUAGES) -> Model:
    """(language, sample text) for each ``lang`` of ``docs`` (``doc_id``, ``text``, ``lang``).

    Learned from are rows with text and ``lang`` whose CRC-32 of ``doc_id`` (as
    text) modulo 4 isn't 2. Of the ``languages`` with most such rows, different
    texts are taken whole, by order of their hash, those left out that would
    make a sample of more than ``chars`` characters; a language all of whose
    texts are longer has its shortest, up to CHARS_PER_LANGUAGE characters (or
    ``chars`` if that is more). So the model is bounded whatever the corpus, and copies of a text count once.
    """
    usable = docs.where("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL").where(~held_out()).select("doc_id", "lang", "text")
    most = usable.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages)
    names = sorted(r["lang"] for r in most.collect())
    if not names:
        return ()
    usable = usable.where(F.col("lang").isin(names))
    different = usable.groupBy("lang", F.xxhash64("text").alias("hash")).agg(F.min("doc_id").alias("doc_id"), F.max(F.length("text")).alias("size"))
    ranked = different.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("hash"))).where(F.col("place") <= texts)
    shortest = different.groupBy("lang").agg(F.min(F.struct("size", "hash", "doc_id")).alias("s")).select("lang", "s.hash", "s.doc_id", "s.size")
    candidates = sorted(tuple(r) for r in ranked.select("lang", "hash", "doc_id", "size").collect())  # texts of each language at most
    chosen: dict[tuple[str, int], int] = {}
    left = dict.fromkeys(names, chars)
    for name, digest, doc_id, size in candidates:
        if size <= left[name]:
            left[name] -= size
            chosen[name, doc_id] = digest
    for name, digest, doc_id, _ in shortest.collect():
        if left[name] == chars:
            chosen[name, doc_id] = digest
    wanted = usable.where(F.col("doc_id").isin(sorted({i for _, i in chosen}))).withColumn("hash", F.xxhash64("text")).where(F.col("hash").isin(sorted(set(chosen.values()))))
    found = wanted.groupBy("lang", "doc_id", "hash").agg(F.min(F.substring("text", 1, max(chars, CHARS_PER_LANGUAGE))).alias("text"))  # a row for each of the texts chosen, however often it repeats
    rows = sorted((r["lang"], r["hash"], r["text"]) for r in found.collect() if chosen.get((r["lang"], r["doc_id"])) == r["hash"])
    return tuple((name, "\n".join(text for lang, _, text in rows if lang == name)) for name in names)


def held_out() -> F.Column:
    """Whether a row is kept out of training; false for a null ``doc_id``."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _letters(text: str) -> str:
    """Lower case, with one space for whatever isn't a letter."""
    return " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())


def _automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of a string of symbols, by state; the usual online construction."""
    step: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols:
        new = len(step)
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(step)
                step.append(step[q].copy())
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return step


class Tables(NamedTuple):
    """All automata in one hash table of ``state * width + symbol`` (state 0 has no transitions and is between phrases).

    An entry is the key and, in its ``bits`` lowest bits, the next state. ``fresh`` is
    where a symbol leads that starts a phrase, at ``language * width + symbol``: it
    does where nothing longer matches, and after state 0, where texts begin and
    where a symbol that the sample lacks leads, being a phrase of its own.
    Symbol 0 is any letter that no sample has; the last symbol is space.
    """

    letters: list[int]
    entries: np.ndarray
    fresh: np.ndarray
    width: int
    bits: int

    def step(self, state: np.ndarray, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Twice the state that a symbol leads to, and one more if it starts a phrase; ``row`` is where the language's part of ``fresh`` begins."""
        key = state * self.width + symbol
        slot = _slots(key, len(self.entries))
        entry = self.entries.take(slot, mode="clip")
        low = np.int64((1 << self.bits) - 1)
        out = (entry & low) << 1
        other = np.flatnonzero(entry >> self.bits != key)
        if len(other):
            start = other
            again = other[entry[other] >= 0]  # taken by another key: look on
            gone = np.zeros(len(key), bool)
            gone[other] = True
            while len(again):
                at = slot[again] + 1 & len(self.entries) - 1
                slot[again] = at
                entry = self.entries[at]
                hit = entry >> self.bits == key[again]
                found = again[hit]
                out[found] = (entry[hit] & low) << 1
                gone[found] = False
                again = again[~hit & (entry >= 0)]
            start = other[gone[other]]
            out[start] = self.fresh[row[start] + symbol[start]]
        return out

    def one(self, state: int, symbol: int, language: int) -> int:
        """``step`` for a single state."""
        key, size = state * self.width + symbol, len(self.entries)
        slot = (key * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) >> 65 - size.bit_length()
        while True:
            entry = self.entries.item(slot)
            if entry < 0:
                return self.fresh.item(language * self.width + symbol)
            if entry >> self.bits == key:
                return (entry & (1 << self.bits) - 1) << 1
            slot = slot + 1 & size - 1


def _slots(key: np.ndarray, size: int) -> np.ndarray:
    return (key.view(U64) * U64(0x9E3779B97F4A7C15) >> U64(65 - size.bit_length())).view(np.int64)


@lru_cache(maxsize=1)
def tables(model: Model) -> Tables:
    samples = [_letters(text) for _, text in model]
    letters = sorted(set("".join(samples)) - {" "})
    code = {c: i + 1 for i, c in enumerate(letters)}
    code[" "] = len(letters) + 1
    width = len(letters) + 2
    fresh = np.zeros((max(1, len(samples)), width), np.int64)
    keys, values, base = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 1
    for k, sample in enumerate(samples):
        step = _automaton([code[c] for c in sample])
        sizes = np.array([len(s) for s in step])
        symbols = np.fromiter((c for s in step for c in s), np.int64, int(sizes.sum()))
        targets = np.fromiter((t for s in step for t in s.values()), np.int64, int(sizes.sum()))
        keys.append((np.repeat(np.arange(len(step)), sizes) + base) * width + symbols)
        values.append(targets + base)
        fresh[k, list(step[0])] = np.array(list(step[0].values()), np.int64) + base
        base += len(step)
        del step
    bits = base.bit_length()
    if (base * width).bit_length() + bits > 63:  # not within the limits of ``train`` and Unicode's letters: 23 + 18 bits of a key, 23 of a state
        raise ValueError("larger samples than the table of transitions has room for")
    key, value = np.concatenate(keys), np.concatenate(values)
    size = 1 << max(4, int(len(key) * 2).bit_length())
    table, slot, left = np.full(size, -1, np.int64), _slots(key, size), np.arange(len(key))
    while len(left):  # linear probing: the first of those that want a free slot gets it
        at = slot[left]
        free = np.flatnonzero(table[at] < 0)
        _, first = np.unique(at[free], return_index=True)
        placed = free[first]
        table[at[placed]] = key[left[placed]] << bits | value[left[placed]]
        left = np.delete(left, placed)
        slot[left] = (slot[left] + 1) & (size - 1)
    return Tables([ord(c) for c in letters], table, fresh.reshape(-1) * 2 + 1, width, bits)


def _symbols(texts: list[str], t: Tables) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts and the text of each, as ``_letters`` has them."""
    joined = "\n".join(x.lower().replace("\n", " ") for x in texts)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    space = t.width - 1
    symbol = np.full(int(points.max(initial=0)) + 1, space, np.int64)
    for p in np.unique(points).tolist():
        if chr(p).isalpha():
            symbol[p] = 0
    for i, p in enumerate(t.letters):
        if p < len(symbol):
            symbol[p] = i + 1
    codes = symbol[points]
    doc = (np.cumsum(points == 10) - (points == 10)).astype(np.int32)  # the separator belongs to the text before it
    letter = codes != space
    keep = letter.copy()
    keep[1:] |= ~letter[1:] & letter[:-1] & (doc[1:] == doc[:-1])  # one space after a word,
    codes, doc = codes[keep], doc[keep]
    last = np.append(doc[1:] != doc[:-1], True)
    inner = ~(last & (codes == space))  # but the last
    return codes[inner], doc[inner]


def phrase_rates(texts: list[str], model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Phrases per character of each text under each language, and the characters (letters and single spaces) of each text."""
    t = tables(model)
    n_languages = len(model)
    rates = np.zeros((len(texts), n_languages))
    codes, doc = _symbols(texts, t) if texts else (np.zeros(0, np.int32), np.zeros(0, np.int32))
    n = np.bincount(doc, minlength=len(texts))
    if not len(codes) or not n_languages:
        return rates, n
    first = np.concatenate([[0], np.cumsum(n)])[:-1]
    in_doc = np.arange(len(codes)) - np.repeat(first, n)
    begins = np.flatnonzero(in_doc % BLOCK == 0)
    sizes = np.diff(np.append(begins, len(codes)))
    blocks = len(begins)
    order = np.argsort(-sizes, kind="stable")
    trail = np.zeros((n_languages, len(codes)), np.int32)
    # every block from between phrases, the longest first, so that those still going on are in front
    start, left = begins[order], sizes[order]
    state = np.zeros(n_languages * blocks, np.int64)
    rows = np.repeat(np.arange(n_languages) * t.width, blocks)
    alive, ends = blocks, np.searchsorted(-left, -np.arange(int(left[0])), side="left")
    for step in range(int(left[0])):
        if ends[step] < alive:
            kept = int(ends[step])
            state, rows = (x.reshape(n_languages, alive)[:, :kept].ravel() for x in (state, rows))
            alive = kept
        at = start[:alive] + step
        now = t.step(state, np.tile(codes[at], n_languages), rows)
        trail[:, at] = now.reshape(n_languages, alive)
        state = now >> 1
    # blocks that don't begin between phrases are parsed again from the state before them, until that parse meets the
    # former one or the block ends
    inner = begins[in_doc[begins] > 0]
    language, at = np.repeat(np.arange(n_languages), len(inner)), np.tile(inner, n_languages)
    state = (trail[language, at - 1] >> 1).astype(np.int64)
    last = np.append(doc[1:] != doc[:-1], True)
    going, unmet = state != 0, []
    for step in range(BLOCK):
        language, at, state = language[going], at[going], state[going]
        if not len(at):
            break
        now = t.step(state, codes[at], language * t.width)
        going = (now >> 1 != trail[language, at] >> 1) & ~last[at]
        trail[language, at] = now
        at, state = at + 1, now >> 1
        if step == BLOCK - 1:
            unmet = sorted(zip(language[going].tolist(), at[going].tolist(), state[going].tolist()))
    # the few that go on into the next blocks, from the first on, so that each place is parsed once more at most
    reached = (-1, -1)
    for k, place, now in unmet:
        if (k, place) < reached:
            continue  # one from further ahead came past here
        while True:
            entry = t.one(now, int(codes[place]), k)
            met = entry >> 1 == int(trail[k, place]) >> 1
            trail[k, place] = entry
            now, place = entry >> 1, place + 1
            if met or last[place - 1]:
                break
        reached = (k, place)
    for k in range(n_languages):
        rates[:, k] = np.bincount(doc, trail[k] & 1, minlength=len(texts))
    return rates / np.maximum(n, 1)[:, None], n


def _judge(column: pa.Array, model: Model) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row, rates and characters of each slice of a column of texts."""
    lo, size, part = 0, 0, []
    limit = SLICE // max(4, len(model))
    for i, value in enumerate(column):
        text = value.as_py() or ""
        if part and size + len(text) > limit:
            yield lo, *phrase_rates(part, model)
            lo, size, part = i, 0, []
        part.append(text)
        size += len(text)
    if part:
        yield lo, *phrase_rates(part, model)


def _predictor(model: Model, schema: pa.Schema):
    names = np.array([lang for lang, _ in model], dtype=object)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, rates, n in _judge(batch.column("text"), model):
                known = (n > 0) & bool(len(names))
                if len(names):
                    best = np.argmin(rates, axis=1)
                    low = rates[np.arange(len(n)), best]
                    others = rates.copy()
                    others[np.arange(len(n)), best] = np.inf
                    score = np.where(known, 1 - low / others.min(axis=1).clip(1e-9), 0.0) if len(names) > 1 else known.astype(float)
                    langs = np.where(known, names[best], "und")
                else:
                    langs, score, low = np.full(len(n), "und", object), np.zeros(len(n)), np.zeros(len(n))
                part = batch.slice(lo, len(n))
                columns = [part.column(i) for i in range(batch.num_columns) if batch.schema.names[i] != "text"]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(langs.tolist(), pa.string()), pa.array(score), pa.array(low, mask=~known)], schema=schema)

    return lean(predict)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, text_hash, held_out, lang_pred, score, rate`` for each row of ``docs`` (``doc_id``, ``text``).

    ``lang_pred`` is ``und`` with score 0 where the text is null or has no
    letter, or where there was nothing to learn from; ties go to the language
    that comes first. ``score`` is how much fewer phrases the winner needs than
    the second (0 to 1), ``rate`` the winner's phrases per character. Whole
    texts count; nothing but the text is looked at.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit("\0null"))).alias("text_hash"), held_out().alias("held_out"), "text")
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64()), ("rate", pa.float64())])
    return rows.mapInArrow(_predictor(model, schema), "doc_id long, text_hash long, held_out boolean, lang_pred string, score double, rate double")


@lru_cache(maxsize=1)
def usual_rates(model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of the rates of pieces of ``PIECE`` characters of each language.

    Each sample is cut in two halves, and pieces of one are parsed under the
    other, which they are no part of.
    """
    means, deviations = np.ones(len(model)), np.zeros(len(model))
    for k, (name, text) in enumerate(model):
        letters, got = _letters(text), []
        middle = len(letters) // 2
        for learned, tried in ((letters[:middle], letters[middle:]), (letters[middle:], letters[:middle])):
            pieces = [tried[i : i + PIECE] for i in range(0, len(tried) - PIECE + 1, PIECE)]
            if pieces:
                got.append(phrase_rates(pieces, ((name, learned),))[0][:, 0])
        rates = np.concatenate(got) if got else np.ones(1)
        means[k], deviations[k] = rates.mean(), rates.std()
    tables.cache_clear()
    return means, deviations


def keep_identified(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """``docs`` without the rows that no language fits: null texts, those without a letter, and those whose rate is more
    than ``DEVIATIONS`` deviations above the mean of the language that fits best, as its labelled texts have it (a
    language of less than two pieces of ``PIECE`` characters rejects nothing). All columns stay, and the order of rows
    within a partition; the text is judged where it is read, without a shuffle."""
    model = train(docs) if model is None else model
    means, deviations = usual_rates(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, rates, n in _judge(batch.column("text"), model):
                good = n > 0
                if len(model):
                    limit = means + DEVIATIONS * deviations * np.sqrt(PIECE / np.clip(n, 1, PIECE))[:, None]
                    good &= (rates <= limit).any(axis=1)
                else:
                    good &= False
                yield batch.slice(lo, len(n)).filter(pa.array(good))

    return docs.mapInArrow(lean(keep), docs.schema)
