"""Masking of personal data and greetings as built-in expressions, and rules with a running comparison as Arrow functions."""

from __future__ import annotations

import difflib
import re
from collections.abc import Callable

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions.text import FILLERS, GREETINGS, MARKER, THANKS
from tessella.operators.batches import some

# What is masked and how it is written; separators of cards and of phones.
CARD_SEPARATORS = "[ \t.\u00a0-]"
PHONE_SEPARATORS = "[ \t\u00a0()-]"
IBAN = r"(?iuU)\bTJ[ -]?\d{2}(?:[ -]?[A-Z0-9]){16,24}\b"
PASSPORT = r"(?iu)(?<![A-ZА-Я\p{Nd}])[AА][ -]?\p{Nd}{8}(?!\p{Nd})"
TAX = r"(?iu)(ИНН|РМА)(\P{Nd}{0,20}?)(\p{Nd}{9})(?!\p{Nd})"


def digits(least: int, most: int, separators: str) -> str:
    """Pattern of whole groups of digits that have ``least`` to ``most`` digits together, as many as there are."""
    return rf"(?<!\p{{Nd}})\p{{Nd}}(?:{separators}*\p{{Nd}}){{{least - 1},{most - 1}}}(?!\p{{Nd}})"


def _phone() -> str:
    """Twelve digits from 992, else nine; a plus before them belongs to a number that isn't followed by more digits."""
    s = PHONE_SEPARATORS
    abroad = rf"(?<!\p{{Nd}})9{s}*9{s}*2(?:{s}*\p{{Nd}}){{9}}(?!\p{{Nd}})"
    number = f"(?:{abroad}|{digits(9, 9, s)})"
    return rf"(?<!\p{{Nd}})\+{number}(?!{s}*\p{{Nd}})|{number}"


#: In order: a longer number would be taken for several shorter ones.
MASKS = (
    (IBAN, "[IBAN]"), (digits(20, 20, CARD_SEPARATORS), "[ACCOUNT]"), (digits(13, 19, CARD_SEPARATORS), "[CARD]"), (PASSPORT, "[PASSPORT]"), (TAX, "$1$2[INN]"), (_phone(), "[PHONE]")
)


def mask(text: Column) -> Column:
    """IBANs, accounts, cards, passports, tax numbers and phones as labels; null stays null."""
    out = text
    for pattern, label in MASKS:
        out = F.regexp_replace(out, pattern, label)
    return F.when(text.rlike(r"\p{Nd}"), out).otherwise(text)


def greeting_pattern() -> str:
    """Leading greetings, thanks and fillers with what separates them; longer phrases come first."""
    phrases = sorted({*GREETINGS, *THANKS, *FILLERS}, key=lambda p: (-p.count(" "), p))
    between = r"[^\p{L}\p{N}]+"
    return rf"^[^\p{{L}}\p{{N}}]*(?:(?:{'|'.join(p.replace(' ', between) for p in phrases)})(?:{between}|$))+"


def strip_greeting(text: Column) -> Column:
    """The text after leading greetings, thanks and fillers; all of it if no word would be left."""
    rest = F.regexp_replace(text, f"(?iu){greeting_pattern()}", "")
    return F.when(rest.rlike(r"[\p{L}\p{N}]"), rest).otherwise(text)


_WORD = re.compile(r"[^\W_]+")


def is_repeat(answer: str, earlier: list[str], same_question: bool = False, affirmed: bool = False) -> bool:
    """Whether a long answer resembles an earlier one (ratio 0.8); repeating the same question excuses it."""
    flat = lambda s: " ".join(_WORD.findall(s.lower()))
    new = flat(answer)
    if len(new) < 80 or same_question and not affirmed:
        return False
    return any(difflib.SequenceMatcher(None, new, flat(old)).ratio() >= 0.8 for old in earlier)


def collapse_repeats(text: str | None, limit: int = 2) -> str | None:
    """Lines up to the first that has occurred ``limit`` times already, whatever its case."""
    if text is None:
        return None
    seen: dict[str, int] = {}
    out = []
    for line in text.split("\n"):
        key = line.strip().lower()
        seen[key] = seen.get(key, 0) + 1
        if key and seen[key] > limit:
            break
        out.append(line)
    return "\n".join(out).rstrip()


def split_visible(buffer: str) -> tuple[str, str]:
    """``text.split_visible`` for one string, in stateful streams."""
    if MARKER in buffer:
        return buffer.split(MARKER)[0], ""
    for n in range(min(len(MARKER) - 1, len(buffer)), 0, -1):
        if MARKER.startswith(buffer[-n:]):
            return buffer[:-n], buffer[-n:]
    return buffer, ""


def _vectorized(f: Callable[[str | None], str | None]) -> Callable[[Column], Column]:
    def of(texts: pa.Array) -> pa.Array:
        return pa.concat_arrays([pa.array([], pa.string()), *(pa.array(map(f, part.to_pylist()), pa.string()) for part in some(texts, pc.binary_length(texts)))])

    return F.arrow_udf(of, "string")  # type: ignore[call-overload]


def collapse_repeats_column(text: Column) -> Column:
    return _vectorized(collapse_repeats)(text)


def is_repeat_column(answer: Column, earlier: Column) -> Column:
    """``is_repeat`` on columns: a text and an array of texts; null counts as empty."""
    f = lambda a, e: pd.Series([is_repeat(x or "", [y for y in (old if old is not None else []) if y]) for x, old in zip(a, e)])
    return F.pandas_udf(f, "boolean")(answer, earlier)  # type: ignore[call-overload]
