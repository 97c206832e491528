"""Reports, the overview and the inbox: several figures of the period together, and their wording."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import analytics as a
from tessella.plans import analytics as figures
from tessella.plans import state, texts
from tessella.plans.registry import ORACLES, query
from tessella.sources import standin as t
from tessella.sources.standin import with_tables

# How channels and languages are called in reports.
CHANNEL_NAMES = {"telegram": "Telegram", "widget": "веб-виджет", "whatsapp": "WhatsApp"}
LANGUAGE_NAMES = {"tj": "таджикский", "ru": "русский", "other": "другой"}
PERIOD_TITLE = "последние 7 дней"


def _sql(name: str) -> str:
    return f"({ORACLES[name]})"


def _columns(df: DataFrame, section: str, *names: str) -> DataFrame:
    """Columns of one row as rows ``section, key, value``."""
    return df.select(F.lit(section).alias("section"), F.inline(F.array(*[F.struct(F.lit(n).alias("key"), F.col(n).cast("double").alias("value")) for n in names])))


def _rows(df: DataFrame, section: str, key: str, value: str) -> DataFrame:
    return df.select(F.lit(section).alias("section"), F.col(key).alias("key"), F.col(value).cast("double").alias("value"))


_FIGURES = " UNION ALL ".join((
    *(f"SELECT 'conversations' AS section, '{c}' AS key, CAST({c} AS DOUBLE) AS value FROM {_sql('a01_outcomes')}" for c in ("total", "by_bot", "by_operator", "bot_share", "hours_saved")),
    f"SELECT 'latency', 'median_ms', CAST(latency_ms AS DOUBLE) FROM {_sql('a02_median_latency')}",
    f"SELECT 'channels', channel, CAST(conversations AS DOUBLE) FROM {_sql('a04_by_first_channel')}",
    f"SELECT 'questions', question, CAST(n AS DOUBLE) FROM {_sql('a05_top_questions')}",
    f"SELECT 'languages', lang, CAST(n AS DOUBLE) FROM {_sql('a06_language_classes')}",
    *(f"SELECT 'rating', '{c}', CAST({c} AS DOUBLE) FROM {_sql('a07_ratings')}" for c in ("n", "average")),
    f"SELECT 'attention', 'no_answer', CAST(coalesce(sum(n), 0) AS DOUBLE) FROM {_sql('a08_no_answer')}",
))


@query("r10_report", _FIGURES)
def report(spark: SparkSession, d: str) -> DataFrame:
    """The seven aggregates of a report as ``section, key, value``; each is one row or a bounded list."""
    parts = (
        _columns(figures.outcomes(spark, d), "conversations", "total", "by_bot", "by_operator", "bot_share", "hours_saved"),
        _rows(figures.median_latency(spark, d).withColumn("key", F.lit("median_ms")), "latency", "key", "latency_ms"),
        _rows(figures.by_channel(spark, d), "channels", "channel", "conversations"), _rows(figures.top_questions(spark, d), "questions", "question", "n"),
        _rows(texts.language_classes(spark, d), "languages", "lang", "n"), _columns(figures.ratings(spark, d), "rating", "n", "average"),
        _columns(figures.no_answer(spark, d).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("no_answer")), "attention", "no_answer"),
    )
    return reduce(DataFrame.unionByName, parts)


def number(value: Column) -> Column:
    """A comma as decimal sign, one decimal, none for whole numbers."""
    return F.when(value == F.floor(value), value.cast("long").cast("string")).otherwise(F.replace(F.format_string("%.1f", value), F.lit("."), F.lit(",")))


def _number(value: str) -> str:
    return f"CASE WHEN {value} = floor({value}) THEN CAST(CAST({value} AS BIGINT) AS VARCHAR) ELSE replace(format('{{:.1f}}', {value}), '.', ',') END"


def _listed(section: str, names: dict[str, str], between: str, entry: str, most: int = 1000) -> str:
    case = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in names.items())
    named = f"CASE key {case} ELSE key END" if names else "key"
    text = entry.replace("NAME", f"' || {named} || '").replace("VALUE", f"' || {_number('value')} || '")
    return f"(SELECT string_agg('{text}', '{between}' ORDER BY place) FROM (SELECT *, row_number() OVER (ORDER BY value DESC, key) AS place FROM f WHERE section = '{section}') WHERE place <= {most})"


def _value(section: str, key: str) -> str:
    return f"(SELECT value FROM f WHERE section = '{section}' AND key = '{key}')"


@query("x25_facts", f"""WITH f AS ({_FIGURES})
SELECT concat_ws(chr(10), 'Период: {PERIOD_TITLE}', 'Обращений всего: ' || {_number(_value("conversations", "total"))},
  CASE WHEN {_value("conversations", "total")} > 0 THEN 'Бот закрыл сам, без оператора: ' || {_number(_value("conversations", "by_bot"))} || ' (' || {_number(_value("conversations", "bot_share"))} || '% обращений)' || chr(10)
    || 'Дошло до оператора: ' || {_number(_value("conversations", "by_operator"))} || chr(10) || 'Сэкономлено времени колл-центра: ' || {_number(_value("conversations", "hours_saved"))} || ' ч (по 4,5 мин на разговор)' END,
  'Медиана времени ответа бота: ' || {_number("round_even(" + _value("latency", "median_ms") + " / 1000, 1)")} || ' с (норматив приёмки — меньше 6 с)',
  'Обращения по каналам: ' || {_listed("channels", CHANNEL_NAMES, ", ", "NAME — VALUE")}, 'Язык вопросов клиентов (сообщений): ' || {_listed("languages", LANGUAGE_NAMES, ", ", "NAME — VALUE")},
  'Оценка клиентов: ' || {_number(_value("rating", "average"))} || ' из 5 (оценок: ' || {_number(_value("rating", "n"))} || ')', 'Эскалаций с причиной «ответа нет в документах»: ' || {_number(_value("attention", "no_answer"))},
  'Частые вопросы: ' || {_listed("questions", {}, "; ", "«NAME» — VALUE", 5)}) AS facts""")
def facts(spark: SparkSession, d: str) -> DataFrame:
    """The figures in words, lines without a figure left out. Also X44's empty period: then two lines and the escalations are left."""
    rows = report(spark, d).groupBy("section").agg(F.sort_array(F.collect_list(F.struct((-F.col("value")).alias("order"), "key", "value"))).alias("rows"))
    f = rows.agg(F.map_from_entries(F.collect_list(F.struct("section", "rows"))).alias("f"))  # sections are a fixed few

    def value(section: str, key: str) -> Column:
        return F.try_element_at(F.filter(F.col("f")[section], lambda r: r["key"] == key), F.lit(1))["value"]

    def listed(section: str, names: dict[str, str], between: str, wrap: tuple[str, str] = ("", ""), most: int = 1000) -> Column:
        named = lambda r: F.coalesce(F.create_map(*[F.lit(x) for pair in names.items() for x in pair])[r["key"]], r["key"]) if names else r["key"]
        parts = F.transform(F.slice(F.col("f")[section], 1, most), lambda r: F.concat(F.lit(wrap[0]), named(r), F.lit(wrap[1]), F.lit(" — "), number(r["value"])))
        return F.when(F.size(parts) > 0, F.array_join(parts, between))

    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    say = lambda section, key: number(value(section, key))
    c = "conversations"
    lines = (
        F.lit(f"Период: {PERIOD_TITLE}"), text("Обращений всего: ", say(c, "total")),
        F.when(value(c, "total") > 0, text("Бот закрыл сам, без оператора: ", say(c, "by_bot"), " (", say(c, "bot_share"), "% обращений)")),
        F.when(value(c, "total") > 0, text("Дошло до оператора: ", say(c, "by_operator"))),
        F.when(value(c, "total") > 0, text("Сэкономлено времени колл-центра: ", say(c, "hours_saved"), " ч (по 4,5 мин на разговор)")),
        text("Медиана времени ответа бота: ", number(F.bround(value("latency", "median_ms") / 1000, 1)), " с (норматив приёмки — меньше 6 с)"),
        text("Обращения по каналам: ", listed("channels", CHANNEL_NAMES, ", ")), text("Язык вопросов клиентов (сообщений): ", listed("languages", LANGUAGE_NAMES, ", ")),
        text("Оценка клиентов: ", say("rating", "average"), " из 5 (оценок: ", say("rating", "n"), ")"), text("Эскалаций с причиной «ответа нет в документах»: ", say("attention", "no_answer")),
        text("Частые вопросы: ", listed("questions", {}, "; ", ("«", "»"), 5)),
    )
    return f.select(F.concat_ws("\n", *lines).alias("facts"))


@query("r11_overview", f"""
WITH days AS (SELECT * FROM {_sql("a09_daily_outcomes")}), answers AS (SELECT * FROM {_sql("a10_daily_answers")}), channels AS (SELECT * FROM {_sql("a12_channels")})
SELECT o.total, o.by_bot, o.bot_share, o.hours_saved, m.latency_ms AS median_ms, p.latency_ms AS p95_ms, CAST((SELECT sum(total) FROM days) AS BIGINT) AS week_total, CAST((SELECT sum(answers) FROM answers) AS BIGINT) AS week_answers,
       c.answers, c.cited, c.share AS cited_share, (SELECT string_agg(channel, ',' ORDER BY channel) FROM channels) AS channels, r.ready, r.total AS documents, r.chunks,
       r.ready > 0 AS has_documents, (SELECT count(*) FROM channels) > 1 AS has_channels, c.answers > 0 AS has_answers
FROM {_sql("a01_outcomes")} o, {_sql("a02_median_latency")} m, {_sql("a03_p95_latency")} p, {_sql("a11_cited_share")} c, {_sql("a13_documents_ready")} r""")
def overview(spark: SparkSession, d: str) -> DataFrame:
    """Eight queries of one row each, side by side, and the readiness checklist."""
    one = (
        figures.outcomes(spark, d).select("total", "by_bot", "bot_share", "hours_saved"), figures.median_latency(spark, d).withColumnRenamed("latency_ms", "median_ms"),
        figures.p95_latency(spark, d).withColumnRenamed("latency_ms", "p95_ms"), figures.daily_outcomes(spark, d).agg(F.sum("total").alias("week_total")),
        figures.daily_answers(spark, d).agg(F.sum("answers").alias("week_answers")), figures.cited_share(spark, d).withColumnRenamed("share", "cited_share"),
        figures.channels(spark, d).agg(F.array_join(F.sort_array(F.collect_set("channel")), ",").alias("channels")),
        figures.documents_ready(spark, d).withColumnRenamed("total", "documents"),
    )
    side = reduce(DataFrame.join, one)  # one row each
    return side.withColumns({"has_documents": F.col("ready") > 0, "has_channels": F.contains("channels", F.lit(",")), "has_answers": F.col("answers") > 0})


@query("r12_inbox_cards", with_tables("messages", "threads", "escalations") + """
, last AS (SELECT conversation_id, count(*) AS n_messages, max(id) AS last_id, arg_max(channel, id) AS channel, count(DISTINCT channel) AS channels FROM messages GROUP BY 1)
SELECT e.id, CASE WHEN taken_at IS NOT NULL THEN 'active' ELSE 'waiting' END AS state, e.reason, th.contact_id, last_id, channel, n_messages, channels > 1 AS omnichannel
FROM escalations e JOIN threads th USING (conversation_id) JOIN last USING (conversation_id) WHERE resolved_at IS NULL""")
def inbox_cards(spark: SparkSession, d: str) -> DataFrame:
    """Unresolved escalations with the state, the contact and the last message of their conversation."""
    last = t.messages(spark, d).groupBy("conversation_id").agg(F.count("*").alias("n_messages"), F.max("id").alias("last_id"), F.max_by("channel", "id").alias("channel"), F.count_distinct("channel").alias("channels"))
    unresolved = t.escalations(spark, d).withColumn("state", a.inbox_state()).where("state <> 'resolved'").drop("workspace_id")
    joined = unresolved.join(t.threads(spark, d), "conversation_id").join(last, "conversation_id")
    return joined.select("id", "state", "reason", "contact_id", "last_id", "channel", "n_messages", (F.col("channels") > 1).alias("omnichannel"))


@query("a33_acceptance", f"""
WITH steps(step, value, budget, ok) AS (
  SELECT 'answer', CAST(latency_ms AS DOUBLE), 6000.0::DOUBLE, latency_ms < 6000 FROM {_sql("a02_median_latency")}
  UNION ALL SELECT 'index', CAST(total - ready AS DOUBLE), 0.0::DOUBLE, total = ready FROM {_sql("a13_documents_ready")}
  UNION ALL SELECT 'escalation', CAST(coalesce(sum(n), 0) AS DOUBLE), 1.0::DOUBLE, coalesce(sum(n), 0) >= 1 FROM {_sql("a08_no_answer")}
  UNION ALL SELECT 'link', CAST(count(*) FILTER (WHERE ok) AS DOUBLE), 1.0::DOUBLE, count(*) FILTER (WHERE ok) >= 1 FROM {_sql("u34_link_tokens")})
SELECT * FROM steps""")
def acceptance(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts of the acceptance steps: the answer's time below its budget, nothing left to index, an escalation seen, a link taken."""
    step = lambda df, name, value, budget, ok: df.select(F.lit(name).alias("step"), value.cast("double").alias("value"), F.lit(float(budget)).alias("budget"), ok.alias("ok"))
    c = F.col
    return reduce(DataFrame.unionByName, (
        step(figures.median_latency(spark, d), "answer", c("latency_ms"), 6000, c("latency_ms") < 6000), step(figures.documents_ready(spark, d), "index", c("total") - c("ready"), 0, c("total") == c("ready")),
        step(figures.no_answer(spark, d).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")), "escalation", c("n"), 1, c("n") >= 1), step(state.link_tokens(spark, d).agg(F.count_if("ok").alias("n")), "link", c("n"), 1, c("n") >= 1),
    ))
