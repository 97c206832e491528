"""Text rules as built-in expressions: normalising, routing, citations, queries for full-text search.

``\\b`` and ``(?i)`` differ between engines outside ASCII; patterns here use
``(?iu)`` and spelled-out boundaries.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Phrases and words that results depend on.
GREETINGS = (
    "салом", "салом алейкум", "ассалом", "ассалому алейкум", "ассалому алайкум", "салам", "салом бародар",
    "привет", "приветствую", "здравствуйте", "здравствуй", "здрасте", "добрый день", "добрый вечер", "доброе утро",
    "hello", "hi", "hey", "start",
)
THANKS = ("раҳмат", "рахмат", "ташаккур", "сипос", "раҳмат калон", "спасибо", "спасибо большое", "благодарю", "мерси")
FAREWELL = ("хайр", "то дидор", "хуш омадед", "пока", "до свидания", "всего доброго", "спокойной ночи")
FILLERS = ("подскажите", "скажите", "пожалуйста", "лутфан", "мархамат", "хотел спросить", "хотела спросить", "хочу спросить", "у меня вопрос")
AFFIRMATIONS = ("бале", "ҳа", "ха", "оре", "албатта", "хуб", "хуб аст", "да", "ага", "конечно", "хорошо", "давай", "давайте", "ok", "okay", "окей", "yes")
TAJIK_ONLY_LETTERS = "ҳӣҷӯқғ"
RUSSIAN_ONLY_LETTERS = "ыщъё"
TAJIK_WORDS = (
    "ман", "шумо", "мо", "аст", "ҳаст", "нест", "чанд", "чӣ", "чи", "ки", "дар", "аз", "ба", "бо", "барои", "оё", "ва", "ё", "мехоҳам",
    "мехоҳед", "метавонам", "метавонед", "кунам", "кунед", "гирам", "гиред", "маълумот", "бештар", "салом", "раҳмат", "бонк", "қарз",
    "корт", "пасандоз", "амонат", "ҳуҷҷат", "ҳуҷҷатҳо", "фоиз", "фоизи", "солона", "мӯҳлат", "чигуна", "дархост", "милли",
    "ассалом", "ташаккур", "сипос", "хайр", "дидор",
)
RUSSIAN_WORDS = (
    "я", "вы", "мы", "не", "это", "и", "в", "на", "для", "что", "как", "по", "или", "если", "можно", "нужно", "хочу", "хотел", "мне",
    "меня", "сколько", "какой", "какая", "какие", "где", "когда", "есть", "ли", "привет", "здравствуйте", "спасибо", "банк", "банка", "счёт",
    "счет", "карта", "карту", "карты", "кредит", "вклад", "депозит", "документы", "годовых", "открыть", "оформить", "получить", "ставка",
    "здравствуй", "здрасте", "приветствую", "добрый", "доброе", "утро", "вечер", "пока", "свидания", "благодарю",
)
REPORT_TAJIK_WORDS = (
    "аст|чанд|чӣ|чи гуна|чигуна|мехоҳам|мехохам|мехоҳед|мехохед|кунам|кунед|кушодан|дорад|доред|медиҳад|медихад|медиҳед|шумо|барои|ҳисоб|хисоб|"
    "салом|раҳмат|рахмат|лутфан|оё|кадом|гирифтан|гирам|ниёз|метавонам|метавонед|бошад|ҳастам|хастам"
)
TAJIK_LETTERS = "ӣӯҳҷғқӢӮҲҶҒҚ"
OPERATOR_WORDS = "оператор|одам|человек|мутахассис"
PII_ALWAYS = "баланс|списал|списан|гирифта шуд|разблокир|заблокир|одобри|отказал|задолженност|остаток на"
PII_PERSONAL = "мо[йяёеюи][\\p{L}\\p{N}_]*|у меня|мне|меня|моих|ман|манро|мани|шахси ман"
PII_ACCOUNT = "баланс|счёт|счет|карт|корт|ҳисоб|амонат|лимит|перевод|интиқол|заявк|дархост|кредит|қарз"
REPORT_WORDS = "отч[её]т|аналитик|статистик|сводк|показател|метрик|дашборд|итог([иа]?)($|[^\\p{L}\\p{N}_])|сколько\\s+(обращен|диалог|вопрос|клиент)|ҳисобот|хисобот|омор|таҳлил|тахлил"
REASONS = ("no_answer", "low_confidence", "user_request", "pii_topic")
MARKER = "[ESCALATE]"

_LEFT, _RIGHT = r"(^|[^\p{L}\p{N}_])", r"($|[^\p{L}\p{N}_])"


def bounded(pattern: str, open_end: bool = False) -> str:
    """Case-insensitive pattern for whole words (or words that start so)."""
    return f"(?iu){_LEFT}({pattern}){'' if open_end else _RIGHT}"


def normalize(text: Column) -> Column:
    """Lower case, everything but letters and digits as one space."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def smalltalk(text: Column) -> Column:
    """``greeting``, ``thanks`` or ``farewell`` where that is the whole message, else null."""
    kinds = {phrase: kind for kind, phrases in (("farewell", FAREWELL), ("thanks", THANKS), ("greeting", GREETINGS)) for phrase in phrases}
    return F.create_map(*[F.lit(v) for pair in kinds.items() for v in pair])[normalize(text)]  # one look, so that the text is normalised once


def is_affirmation(text: Column) -> Column:
    return normalize(text).isin(*AFFIRMATIONS)


def report_language(text: Column) -> Column:
    """Language class of reports: Tajik letters, else Tajik words, else Cyrillic, else other."""
    return F.when(text.rlike(f"[{TAJIK_LETTERS}]"), "tj").when(text.rlike(bounded(REPORT_TAJIK_WORDS)), "tj").when(text.rlike("[А-Яа-я]"), "ru").otherwise("other")


def is_tajik(text: Column) -> Column:
    return F.coalesce(text.rlike(f"[{TAJIK_LETTERS}]"), F.lit(False))


def detect_language(text: Column) -> Column:
    """``tg`` or ``ru`` where one score wins by a point, else null. Score: two for each exclusive letter, one for each known word."""
    lower = F.lower(text)
    words = F.split(normalize(text), " ")

    def score(letters: str, known: tuple[str, ...]) -> Column:
        total = F.size(F.filter(words, lambda w: w.isin(*known)))
        for letter in letters:
            total = total + F.when(lower.contains(letter), 2).otherwise(0)
        return total

    tg, ru = score(TAJIK_ONLY_LETTERS, TAJIK_WORDS), score(RUSSIAN_ONLY_LETTERS, RUSSIAN_WORDS)
    return F.when(tg - ru >= 1, "tg").when(ru - tg >= 1, "ru")


def terms(text: Column) -> Column:
    """Tokens of letters and digits, lower-cased, of more than one character."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)), lambda w: F.length(w) > 1)


def text_query(question: Column) -> Column:
    """Any of the terms, as ``a | b``; empty without terms."""
    return F.array_join(terms(question), " | ")


def wants_operator(text: Column) -> Column:
    return F.coalesce(text.rlike(bounded(OPERATOR_WORDS, open_end=True)), F.lit(False))


def pii_topic(text: Column) -> Column:
    """A client's own money: always telling words, or a personal pronoun with an account word."""
    return F.coalesce(text.rlike(f"(?iu){PII_ALWAYS}") | (text.rlike(bounded(PII_PERSONAL)) & text.rlike(f"(?iu){PII_ACCOUNT}")), F.lit(False))


def is_report_request(text: Column) -> Column:
    return F.coalesce(text.rlike(f"(?iu){REPORT_WORDS}"), F.lit(False))


def normalize_reason(reason: Column) -> Column:
    return F.when(reason.isin(*REASONS), reason).otherwise("no_answer")


def parse_answer(raw: Column) -> tuple[Column, Column]:
    """Visible text without the marker, and whether it was there."""
    return F.trim(F.regexp_replace(F.replace(raw, F.lit(MARKER), F.lit("")), " {2,}", " ")), raw.contains(MARKER)


def split_visible(buffer: Column) -> tuple[Column, Column]:
    """What of a growing answer may be shown, and what is held back as it may become the marker; after the marker nothing is shown."""
    held = F.lit("")
    for n in range(1, len(MARKER)):
        held = F.when(buffer.endswith(MARKER[:n]), MARKER[:n]).otherwise(held)  # the longest is tried first
    held = F.when(buffer.contains(MARKER), "").otherwise(held)
    shown = F.when(buffer.contains(MARKER), F.substring_index(buffer, MARKER, 1)).otherwise(F.substring(buffer, F.lit(1), F.length(buffer) - F.length(held)))
    return shown, held


_CITE = r"\[([0-9][0-9., ]*)\]"


def cited_numbers(text: Column) -> Column:
    """Numbers in ``[1, 2]`` and ``[2.1]`` (the part before the dot), in order of first mention."""
    groups = F.regexp_extract_all(text, F.lit(_CITE), F.lit(1))
    pieces = F.flatten(F.transform(groups, lambda g: F.split(g, r"[, ]+")))
    numbers = F.transform(F.filter(pieces, lambda p: p.rlike("^[0-9]")), lambda p: F.regexp_extract(p, "^([0-9]+)", 1).try_cast("int"))
    return F.array_distinct(numbers)


def cited_ids(text: Column, ids: Column) -> Column:
    """Ids at the cited positions, from 1; what is out of range is dropped."""
    inside = F.filter(cited_numbers(text), lambda n: (n >= 1) & (n <= F.size(ids)))
    return F.array_distinct(F.transform(inside, lambda n: F.element_at(ids, n)))


def strip_citations(text: Column) -> Column:
    """Without citations and the blanks that they leave before punctuation."""
    bare = F.regexp_replace(text, r"\s*" + _CITE, "")
    return F.trim(F.regexp_replace(bare, r"\s+([.,;:!?])", "$1"))


def is_empty_answer(text: Column) -> Column:
    return ~F.coalesce(strip_citations(text).rlike(r"[\p{L}\p{N}]"), F.lit(False))


def fragment(position: Column, title: Column, page: Column, text: Column) -> Column:
    """``[N] (title, стр. p): text``; the page is left out where there is none."""
    where = F.concat(title, F.coalesce(F.concat(F.lit(", стр. "), page.cast("string")), F.lit("")))
    return F.concat(F.lit("["), position.cast("string"), F.lit("] ("), where, F.lit("): "), text)


def offered_topic(answer: Column) -> Column:
    """Last question sentence of an answer, without citations; empty if nothing is asked."""
    bare = F.regexp_replace(answer, _CITE, " ")
    sentence = F.regexp_extract(bare, r"(?s)^(?:.*[.!?\n])?([^.!?\n]*)\?[^?]*$", 1)
    return F.when(bare.contains("?"), F.trim(F.regexp_replace(sentence, r"\s+", " "))).otherwise("")


MAX_CHARS, MAX_WORDS, MAX_UNKNOWN, STEM = 140, 16, 2, 4


def looks_rewritten(candidate: Column, source: Column) -> Column:
    """Short, and with at most two words whose first four letters the source doesn't have."""
    words = F.regexp_extract_all(F.lower(candidate), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
    stems = F.transform(F.regexp_extract_all(F.lower(source), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)), lambda w: F.substring(w, 1, STEM))
    unknown = F.filter(words, lambda w: ~F.array_contains(stems, F.substring(w, 1, STEM)))
    return (F.length(candidate) <= MAX_CHARS) & (F.size(words) <= MAX_WORDS) & (F.size(unknown) <= MAX_UNKNOWN)


def clean_condensed(raw: Column) -> Column:
    """First line with text, without quotes and without a label that ends in the first twelve characters."""
    lines = F.filter(F.transform(F.split(F.coalesce(raw, F.lit("")), r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
    first = F.coalesce(F.try_element_at(lines, F.lit(1)), F.lit(""))
    bare = F.trim(F.regexp_replace(first, "^[\"'«»]+|[\"'«»]+$", ""))
    return F.when(F.locate(":", bare).between(1, 12), F.trim(F.regexp_replace(bare, "^[^:]*:", ""))).otherwise(bare)


def eval_normal(text: Column) -> Column:
    """For comparing answers: lower case, no blanks between digits, comma as decimal sign, single blanks."""
    joined = F.regexp_replace(F.translate(F.lower(text), "\u00a0", " "), "(?<=[0-9]) (?=[0-9])", "")
    return F.trim(F.regexp_replace(F.regexp_replace(joined, r"(?<=[0-9])\.(?=[0-9])", ","), r"\s+", " "))


def heading(html: Column) -> Column:
    """First h1 or h2 whose text, tags stripped, has 4 to 90 characters; empty if none."""
    raw = F.regexp_extract_all(html, F.lit(r"(?is)<h[12][^>]*>(.*?)</h[12]>"), F.lit(1))
    plain = F.transform(raw, lambda h: F.trim(F.regexp_replace(F.regexp_replace(h, "<[^>]+>", ""), r"\s+", " ")))
    return F.coalesce(F.try_element_at(F.filter(plain, lambda t: F.length(t).between(4, 90)), F.lit(1)), F.lit(""))


# Topics of the operator panel, the first that fits wins, and what to do next by reason.
TOPICS = (
    (("комисси", "списал", "удержал", "хазина"), "Переводы → Комиссия"),
    (("перевод", "отправ", "интикол"), "Переводы → Операция"),
    (("карт", "блокир", "корт"), "Карты → Обслуживание"),
    (("кредит", "заём", "қарз", "ипотек", "рассрочк"), "Кредиты → Условия"),
    (("вклад", "депозит", "пасандоз", "ставк", "процент"), "Вклады → Условия"),
    (("счёт", "счет", "остат", "баланс", "суратҳисоб"), "Счета → Остаток"),
    (("приложен", "онлайн", "барнома", "мобильн"), "Приложение → Доступ"),
    (("отделен", "адрес", "график", "работа"), "Отделения → Режим работы"),
)


def intent(last: Column, everything: Column) -> Column:
    """Topic of the last question, else of all of them, else unknown."""

    def topic(text: Column) -> Column:
        found = F.lit(None).cast("string")
        for words, name in reversed(TOPICS):
            hit = F.lit(False)
            for word in words:
                hit = hit | F.lower(text).contains(word)
            found = F.when(hit, name).otherwise(found)
        return found

    return F.coalesce(topic(last), topic(everything), F.lit("Не определено"))


def confidence(hits: Column) -> Column:
    return F.when(hits > 0, F.round(F.least(F.lit(0.72) + hits * 0.07, F.lit(0.95)), 2))


def cut_message(text: Column, limit: int = 1000) -> Column:
    return F.substring(text, 1, limit)


def collapse_lines(text: Column) -> Column:
    """Blanks collapsed in each line, empty lines dropped."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, r"[ \t ]+", " ")))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def chunk_header(title: Column, page: Column) -> Column:
    return F.concat(F.lit("Документ: "), title, F.lit("."), F.coalesce(F.concat(F.lit(" Страница "), page.cast("string"), F.lit(".")), F.lit("")))


def estimate_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), (F.length(text) / 3.5).cast("int"))


def used_chunks(turns: Column) -> Column:
    """Chunks of the last assistant turn of an array of ``role, text, chunks``."""
    return F.try_element_at(F.filter(turns, lambda t: t["role"] == "assistant"), F.lit(-1))["chunks"]


def dialogue(turns: Column) -> Column:
    """``role: text`` lines without citations."""
    return F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit(": "), strip_citations(t["text"]))), "\n")


def sse_frames(stream: Column) -> Column:
    """Event frames of a server-sent stream as ``event, data``; comment frames are skipped."""
    frames = F.filter(F.split(stream, "\n\n"), lambda f: (f != "") & ~f.startswith(":"))
    return F.transform(frames, lambda f: F.struct(F.regexp_extract(f, "(?m)^event: (.*)$", 1).alias("event"), F.regexp_extract(f, "(?m)^data: (.*)$", 1).alias("data")))
