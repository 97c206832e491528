"""Queries of the text rules, over the chat texts and over fixed rows in the languages that the rules are about."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions import period, rules
from tessella.functions import text as x
from tessella.functions import urls as u
from tessella.plans.registry import query
from tessella.sources import standin as t
from tessella.sources.standin import with_tables

PHRASES = (
    "Салом!!!", "салом 😊", "Здравствуйте, подскажите, пожалуйста, курс", "раҳмат калон", "До свидания", "Бале", "да", "ok", "пластиковая карта", "участие в акции",
    "Чанд фоиз аст?", "хочу карту visa", "Соединить с оператором", "поговорить с человеком", "какой у меня баланс", "Мой кредит одобрили?", "открыть вклад",
    "дай отчёт за неделю", "сколько клиентов вчера", "чигуна корти милли дархост кунам", "Ояндасоз чанд аст?", "кредит и карта", "", "12345", "Ман мехоҳам қарз гирам", "ҳисоби ман",
)
ANSWERS = (
    "Ставка 15 % [1]. Срок год [2, 3].", "Не знаю. [ESCALATE]", "[ESCALATE]  Передаю  оператору", "Да [2.1] , можно [9] !", "Хотите узнать больше о вкладе? [1]", "[1]",
    "Первое. Второе предложение! Какой срок вас интересует?", "Комиссия 5 % [1][3]. Хотите?\nДа.", "... [1] ...", "",
)


def _values(rows: tuple[str, ...], column: str = "text") -> str:
    quoted = ", ".join("(" + str(i) + ", '" + r.replace("'", "''") + "')" for i, r in enumerate(rows))
    return f"fixed(id, {column}) AS (VALUES {quoted})"


_TEXTS = with_tables("chat") + ", " + _values(PHRASES) + ", texts AS (SELECT 'chat' AS kind, id, text FROM chat UNION ALL SELECT 'fixed', id, text FROM fixed)\n"


def _dealt(phrases: tuple[str, ...], joined: str = "coalesce(text, '') || ' ' || phrase") -> str:
    """``fixed``: the chat's messages, each with a phrase dealt to it."""
    return with_tables("chat") + ", " + _values(phrases, "phrase").replace("fixed(id, ", "phrases(k, ") + f", fixed AS (SELECT id, {joined} AS text FROM chat JOIN phrases ON k = id % {len(phrases)})\n"


_ANSWERS = _dealt(ANSWERS)


def _texts(spark: SparkSession, d: str) -> DataFrame:
    fixed = spark.createDataFrame([("fixed", i, r) for i, r in enumerate(PHRASES)], "kind string, id long, text string")
    return t.chat(spark, d).select(F.lit("chat").alias("kind"), "id", "text").union(fixed)


def _phrase(phrases: tuple[str, ...]) -> Column:
    """The phrase dealt to a message."""
    return F.element_at(F.array(*map(F.lit, phrases)), (F.col("id") % len(phrases) + 1).cast("int"))


def _answers(spark: SparkSession, d: str, phrases: tuple[str, ...] = ANSWERS) -> DataFrame:
    """The chat's messages, each with a phrase dealt to it."""
    return t.chat(spark, d).select("id", F.concat(F.coalesce("text", F.lit("")), F.lit(" "), _phrase(phrases)).alias("text"))


def _list(words: tuple[str, ...]) -> str:
    return ", ".join(f"'{w}'" for w in words)


_NORMAL = r"trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g'))"
_L, _R = r"(^|[^\p{L}\p{N}_])", r"($|[^\p{L}\p{N}_])"


@query("x02_normalize", _TEXTS + f"SELECT kind, id, {_NORMAL} AS plain FROM texts")
def normalize(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d).select("kind", "id", x.normalize(F.col("text")).alias("plain"))


@query("x03_smalltalk", _TEXTS + f"SELECT kind, id, CASE WHEN {_NORMAL} IN ({_list(x.GREETINGS)}) THEN 'greeting' WHEN {_NORMAL} IN ({_list(x.THANKS)}) THEN 'thanks' WHEN {_NORMAL} IN ({_list(x.FAREWELL)}) THEN 'farewell' END AS smalltalk, {_NORMAL} IN ({_list(x.AFFIRMATIONS)}) AS affirmed FROM texts")
def smalltalk(spark: SparkSession, d: str) -> DataFrame:
    """Also X04."""
    return _texts(spark, d).select("kind", "id", x.smalltalk(F.col("text")).alias("smalltalk"), x.is_affirmation(F.col("text")).alias("affirmed"))


@query("a06_language_classes", _TEXTS + rf"""
SELECT CASE WHEN regexp_matches(text, '[{x.TAJIK_LETTERS}]') THEN 'tj' WHEN regexp_matches(text, '(?i){_L}({x.REPORT_TAJIK_WORDS}){_R}') THEN 'tj' WHEN regexp_matches(text, '[А-Яа-я]') THEN 'ru' ELSE 'other' END AS lang, count(*) AS n
FROM texts GROUP BY 1""")
def language_classes(spark: SparkSession, d: str) -> DataFrame:
    """Also F07 and F14."""
    return _texts(spark, d).groupBy(x.report_language(F.col("text")).alias("lang")).agg(F.count("*").alias("n"))


def _score(letters: str, words: tuple[str, ...]) -> str:
    hits = f"len(list_filter(string_split({_NORMAL}, ' '), lambda w: w IN ({_list(words)})))"
    return hits + "".join(f" + CASE WHEN contains(lower(text), '{c}') THEN 2 ELSE 0 END" for c in letters)


@query("x06_detect_language", _TEXTS + f", scored AS (SELECT kind, id, text, {_score(x.TAJIK_ONLY_LETTERS, x.TAJIK_WORDS)} AS tg, {_score(x.RUSSIAN_ONLY_LETTERS, x.RUSSIAN_WORDS)} AS ru FROM texts)\nSELECT kind, id, CASE WHEN tg - ru >= 1 THEN 'tg' WHEN ru - tg >= 1 THEN 'ru' END AS lang, regexp_matches(text, '[{x.TAJIK_LETTERS}]') AS tajik FROM scored")
def detect_language(spark: SparkSession, d: str) -> DataFrame:
    """Also X07."""
    return _texts(spark, d).select("kind", "id", x.detect_language(F.col("text")).alias("lang"), x.is_tajik(F.col("text")).alias("tajik"))


_TERMS = r"list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), lambda w: length(w) > 1)"


@query("x08_text_query", _TEXTS + f"SELECT kind, id, coalesce(array_to_string({_TERMS}, ' | '), '') AS q FROM texts")
def text_query(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d).select("kind", "id", x.text_query(F.col("text")).alias("q"))


@query("x09_term_counts", _TEXTS + f"SELECT kind, id, term, count(*) AS tf FROM (SELECT kind, id, unnest({_TERMS}) AS term FROM texts) GROUP BY 1, 2, 3")
def term_counts(spark: SparkSession, d: str) -> DataFrame:
    """The posting table that full-text search joins."""
    return _texts(spark, d).select("kind", "id", F.explode(x.terms(F.col("text"))).alias("term")).groupBy("kind", "id", "term").agg(F.count("*").alias("tf"))


@query("x11_routing", _TEXTS + rf"""
SELECT kind, id, regexp_matches(text, '(?i){_L}({x.OPERATOR_WORDS})') AS operator,
       regexp_matches(text, '(?i){x.PII_ALWAYS}') OR (regexp_matches(text, '(?i){_L}({x.PII_PERSONAL}){_R}') AND regexp_matches(text, '(?i){x.PII_ACCOUNT}')) AS pii,
       regexp_matches(text, '(?i){x.REPORT_WORDS}') AS report FROM texts""")
def routing(spark: SparkSession, d: str) -> DataFrame:
    """Also X12 and X40."""
    c = F.col("text")
    return _texts(spark, d).select("kind", "id", x.wants_operator(c).alias("operator"), x.pii_topic(c).alias("pii"), x.is_report_request(c).alias("report"))


@query("x13_parse_answer", _ANSWERS + "SELECT id, trim(regexp_replace(replace(text, '[ESCALATE]', ''), ' {2,}', ' ', 'g')) AS visible, contains(text, '[ESCALATE]') AS escalate FROM fixed")
def parse_answer(spark: SparkSession, d: str) -> DataFrame:
    visible, escalate = x.parse_answer(F.col("text"))
    return _answers(spark, d).select("id", visible.alias("visible"), escalate.alias("escalate"))


_PIECES = r"list_filter(flatten(list_transform(regexp_extract_all(text, '\[([0-9][0-9., ]*)\]', 1), lambda g: string_split_regex(g, '[, ]+'))), lambda p: regexp_matches(p, '^[0-9]'))"


@query("x14_citations", _ANSWERS + f"""
, numbered AS (SELECT id, generate_subscripts(n, 1) AS i, unnest(n) AS n FROM (SELECT id, list_transform({_PIECES}, lambda p: CAST(regexp_extract(p, '^([0-9]+)', 1) AS INT)) AS n FROM fixed))
SELECT id, n, min(i) AS first_at FROM numbered WHERE n BETWEEN 1 AND 3 GROUP BY 1, 2""".replace("min(i) AS first_at", "CAST(row_number() OVER (PARTITION BY id ORDER BY min(i)) AS INT) AS place"))
def citations(spark: SparkSession, d: str) -> DataFrame:
    """Also U05 and J11: cited positions, unique, in the order of the answer, against three fragments."""
    cited = x.cited_ids(F.col("text"), F.array(F.lit(1), F.lit(2), F.lit(3)))
    return _answers(spark, d).select("id", F.posexplode(cited).alias("at", "n")).select("id", "n", (F.col("at") + 1).alias("place"))


_BARE = r"trim(regexp_replace(regexp_replace(text, '\s*\[([0-9][0-9., ]*)\]', '', 'g'), '\s+([.,;:!?])', '\1', 'g'))"


@query("x15_strip_citations", _ANSWERS + rf"SELECT id, {_BARE} AS bare, NOT regexp_matches({_BARE}, '[\p{{L}}\p{{N}}]') AS empty FROM fixed")
def strip_citations(spark: SparkSession, d: str) -> DataFrame:
    """Also X17."""
    return _answers(spark, d).select("id", x.strip_citations(F.col("text")).alias("bare"), x.is_empty_answer(F.col("text")).alias("empty"))


@query("x18_fragments", "SELECT doc_id, '[' || row_number() OVER (PARTITION BY doc_id // 3 ORDER BY doc_id) || '] (' || source || CASE WHEN doc_id % 3 = 0 THEN '' ELSE ', стр. ' || (doc_id % 7) END || '): ' || text AS fragment FROM documents")
def fragments(spark: SparkSession, d: str) -> DataFrame:
    answer = Window.partitionBy(F.floor(F.col("doc_id") / 3)).orderBy("doc_id")  # three fragments make an answer's context
    docs = t.table(spark, d, "documents").withColumn("n", F.row_number().over(answer))
    page = F.when(F.col("doc_id") % 3 != 0, F.col("doc_id") % 7)
    return docs.select("doc_id", x.fragment(F.col("n"), F.col("source"), page, F.col("text")).alias("fragment"))


@query("x20_offered_topic", _ANSWERS + r"""
SELECT id, CASE WHEN contains(text, '?') THEN trim(regexp_replace(regexp_extract(regexp_replace(text, '\[([0-9][0-9., ]*)\]', ' ', 'g'), '(?s)^(?:.*[.!?\n])?([^.!?\n]*)\?[^?]*$', 1), '\s+', ' ', 'g')) ELSE '' END AS topic FROM fixed""")
def offered_topic(spark: SparkSession, d: str) -> DataFrame:
    return _answers(spark, d).select("id", x.offered_topic(F.col("text")).alias("topic"))


_WORDS = lambda c: rf"regexp_extract_all(lower({c}), '[\p{{L}}\p{{N}}]+')"


@query("x22_looks_rewritten", with_tables("chat") + f"""
, pairs AS (SELECT a.id, a.text AS candidate, b.text AS source FROM chat a JOIN chat b ON b.conversation_id = a.conversation_id AND b.turn = a.turn - 1)
SELECT id, length(candidate) <= 140 AND len({_WORDS("candidate")}) <= 16 AND
  len(list_filter({_WORDS("candidate")}, lambda w: NOT list_contains(list_transform({_WORDS("source")}, lambda v: left(v, 4)), left(w, 4)))) <= 2 AS rewritten FROM pairs""")
def looks_rewritten(spark: SparkSession, d: str) -> DataFrame:
    """Also U06: words whose stem the message before doesn't have."""
    c = t.chat(spark, d)
    before = c.select("conversation_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("source"))
    return c.join(before, ["conversation_id", "turn"]).select("id", x.looks_rewritten(F.col("text"), F.col("source")).alias("rewritten"))


CONDENSED = ("«Ставка по вкладу»", "Ответ: ставка по вкладу", "\n\n  \"Срок: год\" \nпояснение", "", "Длинное начало строки: остальное", "'просто'")


@query("x23_clean_condensed", _dealt(CONDENSED, "phrase || ' ' || coalesce(text, '')") + r"""
, lines AS (SELECT id, coalesce(list_filter(list_transform(string_split_regex(text, '\r?\n'), lambda l: trim(l)), lambda l: l <> '')[1], '') AS l FROM fixed),
bare AS (SELECT id, trim(trim(l, '"''«»')) AS b FROM lines)
SELECT id, CASE WHEN strpos(b, ':') BETWEEN 1 AND 12 THEN trim(regexp_replace(b, '^[^:]*:', '')) ELSE b END AS question FROM bare""")
def clean_condensed(spark: SparkSession, d: str) -> DataFrame:
    rows = t.chat(spark, d).select("id", F.concat(_phrase(CONDENSED), F.lit(" "), F.coalesce("text", F.lit(""))).alias("text"))
    return rows.select("id", x.clean_condensed(F.col("text")).alias("question"))


AMOUNTS = ("Сумма 35 000 сомони", "15.5 % годовых", "35 000 и 12.75", "до  10 000  000.50", "v1.2.3 beta")


@query("x27_eval_normal", _dealt(AMOUNTS) + r"""
SELECT id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(lower(text), chr(160), ' '), '([0-9]) ([0-9])', '\1\2', 'g'), '([0-9]) ([0-9])', '\1\2', 'g'),
  '([0-9])\.([0-9])', '\1,\2', 'g'), '([0-9])\.([0-9])', '\1,\2', 'g'), '\s+', ' ', 'g')) AS plain FROM fixed""")
def eval_normal(spark: SparkSession, d: str) -> DataFrame:
    return _answers(spark, d, AMOUNTS).select("id", x.eval_normal(F.col("text")).alias("plain"))


@query("x28_message_limits", with_tables("chat") + "SELECT id, left(text, 1000) AS cut, greatest(1, CAST(trunc(length(text) / 3.5::DOUBLE) AS INT)) AS tokens FROM chat")
def message_limits(spark: SparkSession, d: str) -> DataFrame:
    """Also X31 and M05."""
    return t.chat(spark, d).select("id", x.cut_message(F.col("text")).alias("cut"), x.estimate_tokens(F.col("text")).alias("tokens"))


@query("x29_clean_lines", r"SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda l: trim(regexp_replace(l, '[ \t]+', ' ', 'g'))), lambda l: l <> ''), chr(10)) AS clean FROM documents")
def clean_lines(spark: SparkSession, d: str) -> DataFrame:
    return t.table(spark, d, "documents").select("doc_id", x.collapse_lines(F.col("text")).alias("clean"))


@query("x30_chunk_header", "SELECT doc_id, 'Документ: ' || source || '.' || CASE WHEN doc_id % 2 = 0 THEN '' ELSE ' Страница ' || doc_id % 9 || '.' END AS header FROM documents")
def chunk_header(spark: SparkSession, d: str) -> DataFrame:
    return t.table(spark, d, "documents").select("doc_id", x.chunk_header(F.col("source"), F.when(F.col("doc_id") % 2 != 0, F.col("doc_id") % 9)).alias("header"))


URLS = (
    "HTTP://Site.TJ:80/a?b=2&a=1&utm_source=x#top", "https://site.tj", "https://site.tj:443/x/", "https://site.tj/p?PAGEN_1=2&PAGEN_3=4", "https://site.tj/%d0%b0", "https://site.tj/news/2024/x", "https://site.tj/newsletter",
    "https://site.tj/file.PDF?x=1", "https://blog.site.tj/vacancies", "https://site.tj/a?_gap=1&_ga=2&gclid=3", "https://site.tj:8443/y//", "https://site.tj/a/?x=/b/",
)
_PAGES = "WITH " + _values(URLS, "url") + r""", urls AS (SELECT 'page' AS kind, page_id AS id, url FROM pages UNION ALL SELECT 'fixed', id, url FROM fixed),
split AS (SELECT kind, id, lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS scheme, lower(regexp_extract(u, '://(?:[^/?#@]*@)?([^/?#]*)', 1)) AS host, regexp_extract(u, '://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(u, '\?(.*)$', 1) AS query
  FROM (SELECT kind, id, regexp_replace(trim(url), '#.*$', '') AS u FROM urls)),
kept AS (SELECT *, CASE scheme WHEN 'http' THEN regexp_replace(host, ':80$', '') WHEN 'https' THEN regexp_replace(host, ':443$', '') ELSE host END AS site,
  array_to_string(list_sort(list_filter(string_split(query, '&'), lambda p: p <> '' AND NOT list_contains([""" + _list(u.DROPPED_PARAMS) + r"""], lower(string_split(p, '=')[1])) AND NOT starts_with(lower(string_split(p, '=')[1]), 'utm_') AND NOT starts_with(lower(string_split(p, '=')[1]), 'pagen_'))), '&') AS params FROM split),
clean AS (SELECT kind, id, scheme, site, path, scheme || '://' || site || CASE path WHEN '' THEN '/' ELSE path END || CASE params WHEN '' THEN '' ELSE '?' || params END AS raw FROM kept),
final AS (SELECT kind, id, path, site, array_to_string(list_transform(string_split(raw, '%'), lambda s, i: CASE WHEN i > 1 AND regexp_matches(s, '^[0-9A-Fa-f]{2}') THEN upper(left(s, 2)) || substring(s, 3) ELSE s END), '%') AS clean FROM clean)
"""


def _urls(spark: SparkSession, d: str) -> DataFrame:
    fixed = spark.createDataFrame([("fixed", i, r) for i, r in enumerate(URLS)], "kind string, id long, url string")
    return t.table(spark, d, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), "url").union(fixed)


@query("x32_clean_url", _PAGES + "SELECT kind, id, clean FROM final")
def clean_url(spark: SparkSession, d: str) -> DataFrame:
    return _urls(spark, d).select("kind", "id", u.clean_url(F.col("url")).alias("clean"))


@query("x33_url_key", _PAGES + r"SELECT kind, id, regexp_replace(clean, '^([^:]*://[^/?]*/[^?]*[^/?])/+(\?|$)', '\1\2') AS key FROM final")
def url_key(spark: SparkSession, d: str) -> DataFrame:
    return _urls(spark, d).select("kind", "id", u.url_key(F.col("url")).alias("key"))


@query("f20_url_predicates", _PAGES + rf"""
SELECT kind, id, regexp_matches(lower(path), '\.({"|".join(u.ASSET_SUFFIXES)})$') AS asset,
       regexp_matches(regexp_replace(lower(path), '/+$', '') || '/', '^/(events|news|vacancies|press)/') AS skipped, site = 'site.tj' AS same,
       CASE regexp_extract(regexp_replace(path, '/+$', ''), '([^/]*)$', 1) WHEN '' THEN site ELSE regexp_extract(regexp_replace(path, '/+$', ''), '([^/]*)$', 1) END AS title FROM final""")
def url_predicates(spark: SparkSession, d: str) -> DataFrame:
    """Also F21, F22 and X36."""
    c = F.col("url")
    title = F.coalesce(F.nullif(F.regexp_extract(F.regexp_replace(u.path(c), "/+$", ""), "([^/]*)$", 1), F.lit("")), u.authority(u.clean_url(c)))
    return _urls(spark, d).select("kind", "id", u.is_asset(c).alias("asset"), u.is_skipped(c).alias("skipped"), u.same_domain(c, F.lit("https://site.tj/")).alias("same"), title.alias("title"))


@query("u03_url_dedup", _PAGES + r", keys AS (SELECT id, regexp_replace(clean, '^([^:]*://[^/?]*/[^?]*[^/?])/+(\?|$)', '\1\2') AS key FROM final WHERE kind = 'page') SELECT key, min(id) AS first_id, count(*) AS n FROM keys GROUP BY 1")
def url_dedup(spark: SparkSession, d: str) -> DataFrame:
    return t.table(spark, d, "pages").groupBy(u.url_key(F.col("url")).alias("key")).agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))


@query("x37_heading", r"""
WITH found AS (SELECT page_id, list_filter(list_transform(regexp_extract_all(html, '(?is)<h[12][^>]*>(.*?)</h[12]>', 1), lambda h: trim(regexp_replace(regexp_replace(h, '<[^>]+>', '', 'g'), '\s+', ' ', 'g'))), lambda t: length(t) BETWEEN 4 AND 90) AS h FROM pages)
SELECT page_id, coalesce(h[1], '') AS heading FROM found""")
def headings(spark: SparkSession, d: str) -> DataFrame:
    return t.table(spark, d, "pages").select("page_id", x.heading(F.col("html")).alias("heading"))


@query("x38_operator_panel", _TEXTS + ", topics(place, word, intent) AS (VALUES " + ", ".join(f"({i}, '{w}', '{n}')" for i, (ws, n) in enumerate(x.TOPICS) for w in ws) + """)
SELECT kind, id, coalesce((SELECT arg_min(intent, place) FROM topics WHERE contains(lower(text), word)), 'Не определено') AS intent, CASE WHEN id % 5 > 0 THEN round(least(0.72::DOUBLE + (id % 5) * 0.07::DOUBLE, 0.95), 2) END AS confidence FROM texts""")
def operator_panel(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d).select("kind", "id", x.intent(F.col("text"), F.col("text")).alias("intent"), x.confidence(F.col("id") % 5).alias("confidence"))


@query("x42_reasons", "SELECT event_id, CASE WHEN event_type IN ('no_answer', 'low_confidence', 'user_request', 'pii_topic') THEN event_type ELSE 'no_answer' END AS reason FROM events")
def reasons(spark: SparkSession, d: str) -> DataFrame:
    return t.table(spark, d, "events").select("event_id", x.normalize_reason(F.col("event_type")).alias("reason"))


@query("x43_used_chunks", with_tables("chat") + ", answers AS (SELECT conversation_id, arg_max(id, turn) AS last_id FROM chat WHERE role = 'assistant' GROUP BY 1) SELECT conversation_id, CAST(last_id % 7 AS BIGINT) AS first_chunk FROM answers")
def used_chunks(spark: SparkSession, d: str) -> DataFrame:
    turn = F.struct("turn", "role", F.array(F.col("id") % 7).alias("chunks"))
    turns = t.chat(spark, d).groupBy("conversation_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))  # a conversation's turns
    return turns.select("conversation_id", x.used_chunks(F.col("turns"))[0].alias("first_chunk")).where("first_chunk IS NOT NULL")


@query("x19_dialogue", with_tables("chat") + r"SELECT conversation_id, string_agg(role || ': ' || trim(regexp_replace(regexp_replace(text, '\s*\[([0-9][0-9., ]*)\]', '', 'g'), '\s+([.,;:!?])', '\1', 'g')), chr(10) ORDER BY turn, role, text) AS dialogue FROM chat GROUP BY 1")
def dialogue(spark: SparkSession, d: str) -> DataFrame:
    turns = t.chat(spark, d).groupBy("conversation_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    return turns.select("conversation_id", x.dialogue(F.col("turns")).alias("dialogue"))


@query("x26_reply_choice", _TEXTS + f"""
, scored AS (SELECT kind, id, {_score(x.TAJIK_ONLY_LETTERS, x.TAJIK_WORDS)} AS tg, {_score(x.RUSSIAN_ONLY_LETTERS, x.RUSSIAN_WORDS)} AS ru FROM texts)
SELECT kind, id, CASE WHEN tg - ru >= 1 THEN 'Салом!' WHEN ru - tg >= 1 THEN 'Здравствуйте!' ELSE 'Салом! / Здравствуйте!' END AS reply FROM scored""")
def reply_choice(spark: SparkSession, d: str) -> DataFrame:
    lang = x.detect_language(F.col("text"))
    return _texts(spark, d).select("kind", "id", F.when(lang == "tg", "Салом!").when(lang == "ru", "Здравствуйте!").otherwise("Салом! / Здравствуйте!").alias("reply"))


FRAMES = ("event: delta\ndata: {\"t\": 1}\n\n: keep-alive\n\nevent: final\ndata: done\n\n", "data: x\n\n", ": ping\n\n")


@query("x46_sse_frames", with_tables("chat") + r""", fixed AS (SELECT id, e'event: delta\ndata: ' || replace(coalesce(text, ''), chr(10), ' ') || e'\n\n'
  || CASE id % 3 WHEN 0 THEN e'event: delta\ndata: {"t": 1}\n\n: keep-alive\n\nevent: final\ndata: done\n\n' WHEN 1 THEN e'data: x\n\n' ELSE e': ping\n\n' END AS text FROM chat),
frames AS (SELECT id, unnest(list_filter(string_split(text, chr(10) || chr(10)), lambda f: f <> '' AND NOT starts_with(f, ':'))) AS f FROM fixed)
SELECT id, regexp_extract(f, '(?m)^event: (.*)$', 1) AS event, regexp_extract(f, '(?m)^data: (.*)$', 1) AS data FROM frames""")
def sse_frames(spark: SparkSession, d: str) -> DataFrame:
    """The chat's messages as the first frame of a stream that goes on in three ways."""
    first = F.concat(F.lit("event: delta\ndata: "), F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(" ")), F.lit("\n\n"))
    rows = t.chat(spark, d).select("id", F.concat(first, _phrase(FRAMES)).alias("text"))
    return rows.select("id", F.explode(x.sse_frames(F.col("text"))).alias("f")).select("id", "f.event", "f.data")


@query("m08_hashes", "SELECT doc_id, sha1(text) AS content, left(sha256('model|' || text), 32) AS cache_key FROM documents")
def hashes(spark: SparkSession, d: str) -> DataFrame:
    return t.table(spark, d, "documents").select("doc_id", F.sha1("text").alias("content"), F.left(F.sha2(F.concat(F.lit("model|"), "text"), 256), F.lit(32)).alias("cache_key"))


@query("u02_content_dedup", "SELECT doc_id, text_hash FROM (SELECT doc_id, sha1(text) AS text_hash, row_number() OVER (PARTITION BY sha1(text) ORDER BY doc_id) AS n FROM documents) WHERE n = 1")
def content_dedup(spark: SparkSession, d: str) -> DataFrame:
    """First document of each content. An aggregation, so that copies combine before the shuffle."""
    return t.table(spark, d, "documents").groupBy(F.sha1("text").alias("text_hash")).agg(F.min("doc_id").alias("doc_id"))


@query("u07_turn_jaccard", with_tables("chat") + f"""
, pairs AS (SELECT a.id, list_distinct({_WORDS("a.text")}) AS x, list_distinct({_WORDS("b.text")}) AS y FROM chat a JOIN chat b ON b.conversation_id = a.conversation_id AND b.turn = a.turn - 1)
SELECT id, round(len(list_intersect(x, y)) / CAST(greatest(len(x) + len(y) - len(list_intersect(x, y)), 1) AS DOUBLE), 6) AS jaccard FROM pairs""")
def turn_jaccard(spark: SparkSession, d: str) -> DataFrame:
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)))
    c = t.chat(spark, d)
    before = c.select("conversation_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("source"))
    both = c.join(before, ["conversation_id", "turn"]).select("id", words(F.col("text")).alias("x"), words(F.col("source")).alias("y"))
    return both.select("id", F.round(F.size(F.array_intersect("x", "y")) / F.greatest(F.size(F.array_union("x", "y")), F.lit(1)), 6).alias("jaccard"))


@query("m04_sparkline", "SELECT day, round(26 - (n - min(n) OVER ()) * 22.0::DOUBLE / greatest(max(n) OVER () - min(n) OVER (), 1), 6) AS y FROM (SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n FROM events GROUP BY 1)")
def sparkline(spark: SparkSession, d: str) -> DataFrame:
    daily = t.table(spark, d, "events").groupBy(F.to_date("ts").cast("string").alias("day")).agg(F.count("*").alias("n"))
    low, high = F.min("n").over(Window.partitionBy()), F.max("n").over(Window.partitionBy())  # one row a day
    return daily.select("day", F.round(26 - (F.col("n") - low) * 22.0 / F.greatest(high - low, F.lit(1)), 6).alias("y"))


@query("x01_mask")
def mask(spark: SparkSession, d: str) -> DataFrame:
    return t.table(spark, d, "documents").select("doc_id", rules.mask(F.col("text")).alias("masked"))


@query("x05_strip_greeting", _TEXTS + f"SELECT kind, id, CASE WHEN regexp_matches(rest, '[\\p{{L}}\\p{{N}}]') THEN rest ELSE text END AS question FROM (SELECT *, regexp_replace(text, '(?i){rules.greeting_pattern()}', '') AS rest FROM texts)")
def strip_greeting(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d).select("kind", "id", rules.strip_greeting(F.col("text")).alias("question"))


@query("x24_collapse_repeats", r"""
WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
keyed AS (SELECT *, lower(regexp_replace(line, '^\s+|\s+$', '', 'g')) AS key FROM lines),
counted AS (SELECT *, row_number() OVER (PARTITION BY doc_id, key ORDER BY i) AS times FROM keyed),
stops AS (SELECT doc_id, min(i) FILTER (times > 2 AND key <> '') AS stop FROM counted GROUP BY 1),
kept AS (SELECT doc_id, regexp_replace(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (stop IS NULL OR i < stop), ''), '\s+$', '') AS collapsed FROM counted JOIN stops USING (doc_id) GROUP BY 1)
SELECT doc_id, CASE WHEN text IS NOT NULL THEN collapsed END AS collapsed FROM documents LEFT JOIN kept USING (doc_id)""")
def collapse_repeats(spark: SparkSession, d: str) -> DataFrame:
    return t.table(spark, d, "documents").select("doc_id", rules.collapse_repeats_column(F.col("text")).alias("collapsed"))


_BUFFER = f"SELECT id, coalesce(text, '') || left('{x.MARKER}', CAST(id % {len(x.MARKER) + 1} AS INT)) AS b FROM chat"
_HELD = " ".join(f"WHEN ends_with(b, '{x.MARKER[:n]}') THEN {n}" for n in range(len(x.MARKER) - 1, 0, -1))


@query("x16_hold_back", with_tables("chat") + f"""
, buffers AS ({_BUFFER}), cut AS (SELECT *, CASE WHEN contains(b, '{x.MARKER}') THEN 0 {_HELD} ELSE 0 END AS n FROM buffers)
SELECT id, CASE WHEN contains(b, '{x.MARKER}') THEN split_part(b, '{x.MARKER}', 1) ELSE left(b, length(b) - n) END AS shown, right(b, n) AS held FROM cut""")
def hold_back(spark: SparkSession, d: str) -> DataFrame:
    """Also E08: each turn as a buffer that ends in some of the marker's letters."""
    i = F.col("id")
    buffer = F.concat(F.coalesce("text", F.lit("")), F.substring(F.lit(x.MARKER), F.lit(1), (i % (len(x.MARKER) + 1)).cast("int")))
    buffers = t.chat(spark, d).select("id", buffer.alias("b"))
    shown, held = x.split_visible(F.col("b"))
    return buffers.select("id", shown.alias("shown"), held.alias("held"))


@query("x21_repeats")
def repeats(spark: SparkSession, d: str) -> DataFrame:
    """Answers that repeat one of the five answers before them, in conversations; the ratio of matching blocks has no SQL."""
    before = Window.partitionBy("conversation_id").orderBy("turn").rowsBetween(-5, -1)
    answers = t.chat(spark, d).where("role = 'assistant'").withColumn("earlier", F.collect_list("text").over(before))
    return answers.select("id", rules.is_repeat_column(F.col("text"), F.col("earlier")).alias("repeated"))


PERIODS = (
    "за сегодня", "имрӯз чӣ хел?", "вчера", "дирӯз", "прошлая неделя", "за неделю прошлую", "ҳафта гузашта", "эта неделя", "на текущей неделе", "за прошлый месяц", "мохи гузашта", "этот месяц", "за июнь", "в декабре", "июнь 2023",
    "мая 2022 года", "маркетинг", "за 3 дня", "за две недели", "три месяца", "за 5000 дней", "за 99999999999 дней", "за полгода", "за год", "солона", "за неделю", "месяц", "как дела", "", "30 рӯз", "отчёт за янв", "за ноя", "0 дней",
)


def _re2(pattern: str) -> str:
    """A pattern for DuckDB, whose word boundaries and classes are of ASCII."""
    pattern = pattern.replace(r"\w", r"[\p{L}\p{N}_]")
    pattern = re.sub(r"\\b(?=[\w(])", lambda _: r"(?:^|[^\p{L}\p{N}_])", pattern)
    return pattern.replace(r"\b", r"(?:$|[^\p{L}\p{N}_])")


def _periods_sql() -> str:
    fits = lambda pattern: f"regexp_matches(p, '{_re2(pattern)}')"
    beside = lambda word, unit: fits(rf"({word.replace(chr(92) + 'b', '')})\s+({unit})|({unit})\s+({word})")
    month = " ".join(f"WHEN {fits(pattern)} THEN {number}" for number, pattern in period.MONTH_PATTERNS)
    number = lambda unit: f"regexp_extract(p, '{_re2(rf'({period.COUNT})' + chr(92) + rf's*({unit})')}', 1)"
    value = lambda n: "CASE {n} {words} ELSE least(coalesce(TRY_CAST({n} AS HUGEINT), 366), 366) END".format(n=n, words=" ".join(f"WHEN '{w}' THEN {v}" for w, v in period.NUMBERS.items()))
    span = " ".join([f"WHEN {number(unit)} <> '' THEN ({value(number(unit))}) * {days}" for unit, days in period.COUNTED] + [f"WHEN {fits(pattern)} THEN {days}" for pattern, days in period.SPANS])
    listed = lambda names: "[" + ", ".join(f"'{n}'" for n in names) + "]"
    word = lambda t: f"{listed(period.GENITIVE)}[month({t})]"
    named = lambda t: f"{listed(period.NOMINATIVE)}[month({t})] || ' ' || year({t})"
    return "WITH " + _values(PERIODS, "phrase") + rf"""
, asked AS (SELECT event_id, lower(phrase) AS p, ts + INTERVAL 5 HOUR AS now FROM events JOIN fixed ON fixed.id = event_id % {len(PERIODS)}),
said AS (
  SELECT *, date_trunc('day', now) AS d, date_trunc('week', now) AS w, date_trunc('month', now) AS m, CASE {month} END AS number,
         regexp_extract(p, '{_re2(r"\b(20[0-9]{2})\b")}', 1) AS y, CASE {span} END AS days FROM asked),
dated AS (SELECT *, CASE WHEN days IS NOT NULL THEN least(greatest(days, 1), 366) END AS span, CAST(make_date(CASE WHEN y <> '' THEN CAST(y AS INT) ELSE CAST(year(now) AS INT) - CAST(number > month(now) AS INT) END, number, 1) AS TIMESTAMP) AS named FROM said),
ruled AS (
  SELECT *, CASE WHEN {fits(period.TODAY)} THEN 1 WHEN {fits(period.YESTERDAY)} THEN 2 WHEN {beside(period.LAST, period.WEEK)} THEN 3 WHEN {beside(period.THIS, period.WEEK)} THEN 4
                 WHEN {beside(period.LAST, period.MONTH)} THEN 5 WHEN {beside(period.THIS, period.MONTH)} THEN 6 WHEN number IS NOT NULL THEN 7 WHEN span IS NOT NULL THEN 8 ELSE 9 END AS rule FROM dated),
bounded AS (
  SELECT event_id, rule = 9 AS assumed,
         CASE rule WHEN 1 THEN 'сегодня' WHEN 2 THEN 'вчера' WHEN 3 THEN 'прошлая неделя' WHEN 4 THEN 'эта неделя' WHEN 5 THEN {named("(m - INTERVAL 1 MONTH)")} WHEN 6 THEN {named("m")} || ', с начала месяца'
                   WHEN 7 THEN {named("named")} ELSE 'последние ' || coalesce(CASE WHEN rule = 8 THEN span END, 7) || ' дней' END AS name,
         CASE rule WHEN 1 THEN d WHEN 2 THEN d - INTERVAL 1 DAY WHEN 3 THEN w - INTERVAL 7 DAY WHEN 4 THEN w WHEN 5 THEN m - INTERVAL 1 MONTH WHEN 6 THEN m WHEN 7 THEN named
                   WHEN 8 THEN now - to_days(CAST(span AS INT)) ELSE now - INTERVAL 7 DAY END AS since,
         CASE rule WHEN 2 THEN d WHEN 3 THEN w WHEN 5 THEN m WHEN 7 THEN named + INTERVAL 1 MONTH ELSE now END AS until FROM ruled),
worded AS (
  SELECT *, until - INTERVAL 1 SECOND AS last, CAST(since AS DATE) = CAST(until - INTERVAL 1 SECOND AS DATE) AS one_day, year(since) = year(until - INTERVAL 1 SECOND) AS one_year FROM bounded),
dates AS (
  SELECT *, CASE WHEN one_day THEN day(since) || ' ' || {word("since")} || ' ' || year(since)
                 WHEN one_year AND month(since) = month(last) THEN day(since) || '–' || day(last) || ' ' || {word("since")} || ' ' || year(since)
                 WHEN one_year THEN day(since) || ' ' || {word("since")} || ' — ' || day(last) || ' ' || {word("last")} || ' ' || year(since)
                 ELSE day(since) || ' ' || {word("since")} || ' ' || year(since) || ' — ' || day(last) || ' ' || {word("last")} || ' ' || year(last) END AS dates FROM worded)
SELECT event_id, strftime(since, '%Y-%m-%d %H:%M:%S') AS since, strftime(until, '%Y-%m-%d %H:%M:%S') AS until, assumed,
       CAST(greatest(1, ceil(datediff('second', since, until) / 86400.0)) AS INT) AS days, CASE WHEN dates = name THEN dates ELSE name || ' · ' || dates END AS title FROM dates"""


@query("t01_periods", _periods_sql())
def periods(spark: SparkSession, d: str) -> DataFrame:
    """Also T02, T03: each event asks for a period, at its local time."""
    asked = F.element_at(F.array(*map(F.lit, PERIODS)), (F.col("event_id") % len(PERIODS) + 1).cast("int"))
    now = F.col("ts").cast("timestamp_ntz") + F.make_dt_interval(hours=F.lit(5))
    found = period.parse_periods(t.table(spark, d, "events").select("event_id", asked.alias("phrase"), now.alias("now")))
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return found.select("event_id", text("since"), text("until"), "assumed", "days", "title")
