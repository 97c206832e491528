"""URL filtering: host and path rules first, else a logistic regression on hashed character n-grams.

The model is fitted from a small labelled URL table and then is one array of
weights; scoring and rule matching are built-in functions only.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (host, path prefix, action); the longest that fits wins, and block wins a tie.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
#: Rules are folded into one expression; larger lists belong in a join.
MAX_RULES = 1000
GRAM = 3
#: Hash values for host n-grams, and as many again for those of paths.
SLOTS = 2048
#: Multipliers of the three code points of an n-gram.
_FACTORS = (961, 31, 1)

# The labelled URL table is made of words that tell what a site is about, of neutral words that sites of both kinds have
# in their names, and of paths. 1 is unwanted.
_UNWANTED = (
    "adclick ads adult bets betting bingo blackjack botnet camgirls casino clickbait cracks cryptodoubler diet escort fakeid gamble hacks jackpot keygen lottery malware nude payday phish pills poker porn replica roulette scam sexy slots spam steroids sweepstakes torrentz viagra warez xxx adserver"
).split()
_WANTED = (
    "academy airport archive atlas bakery biology books bridge calendar chemistry chess city climate college community cooking council cycling data design dictionary docs economics education energy engineering film forum foundation garden geography government guide harbour history hospital hotel institute journal kitchen laboratory language law learning library literature magazine maps market mathematics medicine monitor museum music nature network newspaper observatory ocean open orchestra parks philosophy photo physics planet poetry press project python radio records research review river sailing school science software sport statistics studio teacher theatre times town travel tribune university village weather wiki wildlife woodwork world writing"
).split()
_NEUTRAL = "best big daily direct easy first free global home info live my net new now online plus pro red smart top win zone".split()
_BARE = (
    "abelard bluefin cordoba dunmore elmtree fairfax glasgow hobart ibsen jura kepler lund mercer nilsson orkney perugia quincy rotterdam salford tromso uppsala vilnius wessex xanthi york zermatt "
    "answer avenue canyon castle commons elder falcon forest hub island kernel lantern letter linux meadow mountain number orange overflow purple question shadow silver source square stack stone street summer thunder tower valley window winter yellow"
).split()
_TOPS = ("com", "net", "org", "info", "co.uk", "eu", "github.io", "blogspot.com")
_PATHS = {
    1: ("buy/cheap", "bonus/claim", "click/win", "free/spins", "order/discreet", "join/now", "download/crack.exe", "go/offer"),
    0: ("about", "catalogue/books", "news/2019/05/report", "docs/manual", "abs/1706", "articles/history", "people/staff", "help/contact"),
    None: ("", "index.html", "en/", "a/12", "page/3", "item/4711", "blog/post-7", "x/y/z", "s/query", "2021/"),
}


def _labelled() -> tuple[tuple[str, int], ...]:
    rows: dict[str, int] = {}
    for unwanted, words in ((1, _UNWANTED), (0, _WANTED), (0, _BARE)):
        for i, word in enumerate(words):
            for j, other in enumerate(("", *_NEUTRAL[i % 3 :: 3])):
                for k, name in enumerate(dict.fromkeys((f"{word}{other}", f"{other}{word}", f"{word}-{other}".rstrip("-"), f"{other}-{word}".lstrip("-")))):
                    if other and (i + j + k) % 2:
                        continue
                    at = i + 3 * j + 5 * k
                    own, neutral = _PATHS[unwanted], _PATHS[None]
                    path = own[at // 2 % len(own)] if at % 2 else neutral[at // 2 % len(neutral)]
                    rows[f"{('', 'www.', 'blog.', 'm.')[at % 4]}{name}.{_TOPS[at % len(_TOPS)]}/{path}"] = unwanted
    return tuple(rows.items())


LABELLED = _labelled()
#: One URL in so many is kept out of training.
HELD_OUT_OF = 5


def split_labelled(labelled: Sequence[tuple[str, int]] = LABELLED) -> tuple[tuple[tuple[str, int], ...], tuple[tuple[str, int], ...]]:
    """Rows to train from and rows held out, by CRC-32 of the URL."""
    held = [zlib.crc32(url.encode()) % HELD_OUT_OF == 0 for url, _ in labelled]
    return tuple(r for r, h in zip(labelled, held) if not h), tuple(r for r, h in zip(labelled, held) if h)


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null or without ``://``.

    The host runs from the first ``://`` to ``/``, ``?``, ``#`` or the end, the
    path from there to ``?``, ``#`` or the end.
    """
    rest = F.coalesce(F.substring_index(url, "://", 1), F.lit(""))
    after = F.when(url.contains("://"), F.substring(url, F.length(rest) + 4, F.length(url))).otherwise("")
    host = F.regexp_extract(after, r"^([^/?#]*)", 1)
    path = F.regexp_extract(F.substring(after, F.length(host) + 1, F.length(after)), r"^([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def match_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """The rule that decides, as a struct of ``rule`` and ``action``, or null."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MAX_RULES} fit in an expression")
    chosen = F.lit(None).cast("struct<rule: string, action: string>")
    for h, p, action in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r[2] == "block")):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        chosen = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(action).alias("action"))).otherwise(chosen)
    return chosen


def _slots(text: str, base: int) -> list[int]:
    text = f"^{text}$"
    return [base + sum(ord(c) * f for c, f in zip(text[i : i + GRAM], _FACTORS)) % SLOTS for i in range(len(text) - GRAM + 1)]


@lru_cache
def train(labelled: tuple[tuple[str, int], ...] = split_labelled()[0], rounds: int = 1000, rate: float = 1.0, penalty: float = 1e-3) -> list[float]:
    """Weights by gradient descent over the labelled table: the bias, then one for each slot, to six decimals."""
    x = np.zeros((len(labelled), 2 * SLOTS))
    for i, (url, _) in enumerate(labelled):
        host, _, path = url.partition("/")
        for part, base in ((host, 0), ("/" + path, SLOTS)):
            found = _slots(part, base)
            for s in found:
                x[i, s] += len(found) ** -0.5
    y = np.array([label for _, label in labelled], float)
    used = np.flatnonzero(x.any(axis=0))
    x = x[:, used]
    w, bias = np.zeros(len(used)), 0.0
    for _ in range(rounds):
        off = 1 / (1 + np.exp(-(x @ w + bias))) - y
        w -= rate * (x.T @ off / len(y) * 10 + penalty * w)
        bias -= rate * off.mean()
    weights = np.zeros(2 * SLOTS)
    weights[used] = w
    return [round(float(v), 6) for v in (bias, *weights)]


def _codes(text: Column) -> Column:
    """Code points of ``^text$``."""
    return F.transform(F.split(F.concat(F.lit("^"), text, F.lit("$")), ""), F.ascii)


def _weight(codes: Column, weights: Column, base: int) -> Column:
    """Weights of the n-grams of code points, summed and divided by the root of their number. ``codes`` must be a
    column of its own: an expression would be evaluated again for each n-gram."""
    n = F.size(codes) - GRAM + 1

    def weight(i: Column) -> Column:
        value = F.lit(0)
        for k, factor in enumerate(_FACTORS):
            value = value + F.element_at(codes, i + k) * factor
        return F.element_at(weights, (value % SLOTS + base + 1).cast("int"))

    return F.when(n > 0, F.aggregate(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), weight), F.lit(0.0), lambda a, b: a + b) / F.sqrt(n)).otherwise(0.0)


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, weights: Sequence[float] | None = None) -> DataFrame:
    """``pages`` (``page_id``, ``url``) as ``page_id, host, path, rule, verdict, score``, a row for each input row.

    ``verdict`` is that of the rule, else ``block`` where the model's ``score``
    is 0.5 or more. A URL without a host (null, or without ``://``) has no
    rule and nothing to be judged by: it is allowed, with score 0.
    """
    weights = list(train() if weights is None else weights)
    host, path = split_url(F.col("url"))
    split = pages.select("page_id", host.alias("host"), path.alias("path"))
    array = F.lit(np.array(weights[1:]))
    split = split.withColumns({"host_codes": _codes(F.col("host")), "path_codes": _codes(F.col("path"))})
    logit = F.lit(weights[0]) + _weight(F.col("host_codes"), array, 0) + _weight(F.col("path_codes"), array, SLOTS)
    scored = split.withColumn("logit", logit).withColumn("matched", match_rule(F.col("host"), F.col("path"), rules))
    known = F.col("host") != ""
    modelled = F.when(known & (F.col("logit") >= 0), "block").otherwise("allow")
    return scored.select(
        "page_id", "host", "path", F.col("matched.rule").alias("rule"),
        F.coalesce("matched.action", modelled).alias("verdict"), F.when(known, F.round(1 / (1 + F.exp(-F.col("logit"))), 4)).otherwise(0.0).alias("score"),
    )


def loss(weights: Sequence[float], labelled: Sequence[tuple[str, int]]) -> float:
    """Share of labelled rows that the weights get wrong."""
    wrong = 0
    for url, label in labelled:
        host, _, path = url.partition("/")
        z = weights[0]
        for part, base in ((host, 0), ("/" + path, SLOTS)):
            found = _slots(part, base)
            z += math.fsum(weights[1 + s] for s in found) / max(1, len(found)) ** 0.5
        wrong += (z >= 0) != bool(label)
    return wrong / len(labelled)
