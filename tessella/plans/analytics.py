"""Queries of dialog analytics, filters, joins and windows over the timed messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.operators import analytics as a
from tessella.plans.registry import query
from tessella.sources import standin as t
from tessella.sources.standin import NOW, with_tables

SINCE = "2024-01-24 00:00:00"
_PERIOD = f"TIMESTAMP '{SINCE}' AND {{c}} < TIMESTAMP '{NOW}'"


def _in(c: str) -> str:
    return f"{c} >= TIMESTAMP '{SINCE}' AND {c} < TIMESTAMP '{NOW}'"


_PERCENT = "CAST(coalesce(round_even(100.0::DOUBLE * {p} / nullif({w}, 0), 0), 0) AS INT)"


def _percent(part: str, whole: str) -> str:
    return _PERCENT.format(p=part, w=whole)


@query("a01_outcomes", with_tables("messages", "threads", "escalations") + f"""
, judged AS (SELECT *, NOT EXISTS (SELECT 1 FROM escalations e WHERE e.conversation_id = th.conversation_id) AS by_bot FROM threads th WHERE {_in("started_at")}),
counted AS (SELECT count(*) AS total, count(*) FILTER (WHERE by_bot) AS by_bot FROM judged)
SELECT total, by_bot, total - by_bot AS by_operator, {_percent("by_bot", "total")} AS bot_share, round_even(by_bot * 4.5::DOUBLE / 60, 1) AS hours_saved FROM counted""")
def outcomes(spark: SparkSession, d: str) -> DataFrame:
    return a.outcomes(t.threads(spark, d), t.escalations(spark, d), SINCE, NOW)


@query("a02_median_latency", with_tables("messages") + f"SELECT CAST(trunc(quantile_cont(latency_ms, 0.5)) AS INT) AS latency_ms FROM messages WHERE role = 'assistant' AND {_in('created_at')}")
def median_latency(spark: SparkSession, d: str) -> DataFrame:
    return a.latency_quantile(t.messages(spark, d), 0.5, SINCE, NOW)


@query("a03_p95_latency", with_tables("messages") + f"SELECT CAST(trunc(quantile_cont(latency_ms, 0.95)) AS INT) AS latency_ms FROM messages WHERE role = 'assistant' AND created_at > TIMESTAMP '{SINCE}'")
def p95_latency(spark: SparkSession, d: str) -> DataFrame:
    return a.latency_quantile(t.messages(spark, d), 0.95, SINCE)


_FIRST = with_tables("messages") + ", firsts AS (SELECT conversation_id, arg_min(channel, id) AS channel, arg_min(created_at, id) AS created_at FROM messages GROUP BY 1)\n"


@query("a04_by_first_channel", _FIRST + f"""
, counted AS (SELECT channel, count(*) AS conversations FROM firsts WHERE {_in("created_at")} GROUP BY 1)
SELECT channel, conversations, {_percent("conversations", "sum(conversations) OVER ()")} AS share FROM counted""")
def by_channel(spark: SparkSession, d: str) -> DataFrame:
    return a.by_channel(t.messages(spark, d), SINCE, NOW)


@query("a05_top_questions", with_tables("chat") + "SELECT left(text, 60) AS question, count(*) AS n FROM chat WHERE role = 'user' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def top_questions(spark: SparkSession, d: str) -> DataFrame:
    return a.top_questions(t.chat(spark, d))


@query("a07_ratings", with_tables("messages", "ratings") + f"SELECT count(*) AS n, CAST(CAST(avg(score) AS DECIMAL(3,1)) AS DOUBLE) AS average FROM ratings WHERE {_in('created_at')}")
def ratings(spark: SparkSession, d: str) -> DataFrame:
    return a.rating_summary(t.ratings(spark, d), SINCE, NOW)


@query("a08_no_answer", with_tables("messages", "threads", "escalations") + f"""
SELECT th.workspace_id, count(*) AS n FROM escalations e JOIN threads th USING (conversation_id)
WHERE reason = 'no_answer' AND {_in("e.created_at")} GROUP BY 1""")
def no_answer(spark: SparkSession, d: str) -> DataFrame:
    return a.escalations_by_reason(t.escalations(spark, d), t.threads(spark, d), "no_answer", SINCE, NOW)


_CALENDAR = f", calendar AS (SELECT unnest(generate_series(DATE '2024-01-25', DATE '2024-01-31', INTERVAL 1 DAY))::DATE AS day)\n"  # noqa: F541


@query("a09_daily_outcomes", with_tables("messages", "threads", "escalations") + _CALENDAR + """
SELECT CAST(c.day AS VARCHAR) AS day, count(th.conversation_id) AS total,
       count(th.conversation_id) FILTER (WHERE NOT EXISTS (SELECT 1 FROM escalations e WHERE e.conversation_id = th.conversation_id)) AS by_bot
FROM calendar c LEFT JOIN threads th ON th.started_at >= c.day AND th.started_at < c.day + INTERVAL 1 DAY GROUP BY 1""")
def daily_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return a.daily_outcomes(t.threads(spark, d), t.escalations(spark, d), NOW)


_CITED = """, cited AS (SELECT *, CASE k % 3 WHEN 1 THEN [] WHEN 2 THEN [k, k + 1] END AS chunks_used FROM messages)
"""


@query("a10_daily_answers", with_tables("messages") + _CITED + _CALENDAR + """
SELECT CAST(c.day AS VARCHAR) AS day, count(m.id) AS answers, count(m.id) FILTER (WHERE len(chunks_used) > 0) AS cited,
       coalesce(CAST(trunc(quantile_cont(latency_ms, 0.5)) AS INT), 0) AS median_ms
FROM calendar c LEFT JOIN cited m ON CAST(m.created_at AS DATE) = c.day AND m.role = 'assistant' GROUP BY 1""")
def daily_answers(spark: SparkSession, d: str) -> DataFrame:
    return a.daily_answers(a.with_citations(t.messages(spark, d)), NOW)


@query("a11_cited_share", with_tables("messages") + _CITED + f"""
SELECT count(*) AS answers, count(*) FILTER (WHERE len(chunks_used) > 0) AS cited, {_percent("count(*) FILTER (WHERE len(chunks_used) > 0)", "count(*)")} AS share
FROM cited WHERE role = 'assistant' AND created_at > TIMESTAMP '{SINCE}'""")
def cited_share(spark: SparkSession, d: str) -> DataFrame:
    return a.cited_share(a.with_citations(t.messages(spark, d)), SINCE)


@query("a12_channels", with_tables("messages") + f"SELECT DISTINCT channel FROM messages WHERE created_at > TIMESTAMP '{SINCE}'")
def channels(spark: SparkSession, d: str) -> DataFrame:
    return t.messages(spark, d).where(F.col("created_at") > a.moment(SINCE)).select("channel").distinct()


@query("a13_documents_ready", """SELECT count(*) AS total, count(*) FILTER (WHERE n_chars >= 40) AS ready, CAST(sum(ceil(n_chars / 1400.0::DOUBLE)) AS BIGINT) AS chunks FROM documents""")
def documents_ready(spark: SparkSession, d: str) -> DataFrame:
    return t.table(spark, d, "documents").agg(F.count("*").alias("total"), F.count_if(F.col("n_chars") >= 40).alias("ready"), F.sum(F.ceil(F.col("n_chars") / 1400.0)).cast("long").alias("chunks"))


@query("a14_richest_conversation", with_tables("messages") + "SELECT conversation_id, count(DISTINCT channel) AS channels, max(id) AS last_id FROM messages GROUP BY 1 ORDER BY 2 DESC, 3 DESC LIMIT 1")
def richest(spark: SparkSession, d: str) -> DataFrame:
    return a.richest_conversation(t.messages(spark, d))


@query("a15_inbox_counters", with_tables("messages", "escalations") + """
SELECT workspace_id, count(*) FILTER (WHERE resolved_at IS NULL AND taken_at IS NULL) AS waiting, count(*) FILTER (WHERE resolved_at IS NULL AND taken_at IS NOT NULL) AS active
FROM escalations GROUP BY 1""")
def inbox_counters(spark: SparkSession, d: str) -> DataFrame:
    return a.inbox_counters(t.escalations(spark, d))


_SITES = r""", sites AS (
  SELECT regexp_extract(lower(url), '://([^/?#]*)', 1) AS host, 1 + page_id % 5 AS chunks, page_id % 11 AS done, 10 AS total,
         CASE WHEN page_id % 97 = 0 THEN 'indexing' WHEN page_id % 13 = 0 THEN 'failed' ELSE 'ready' END AS status FROM pages)
"""


@query("a17_site_rollup", ("WITH" + _SITES[1:]) + f"""
SELECT host, count(*) AS documents, CAST(sum(chunks) AS BIGINT) AS chunks, CAST(sum(done) AS BIGINT) AS done, CAST(sum(total) AS BIGINT) AS total,
       CASE WHEN bool_or(status IN ('queued', 'indexing')) THEN 'in_progress' WHEN bool_or(status = 'failed') THEN 'failed' ELSE 'ready' END AS status,
       {_percent("sum(done)", "sum(total)")} AS progress FROM sites GROUP BY 1""")
def site_rollup(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("page_id")
    sites = t.table(spark, d, "pages").select(
        F.regexp_extract(F.lower("url"), "://([^/?#]*)", 1).alias("host"), (1 + p % 5).alias("chunks"), (p % 11).alias("done"), F.lit(10).cast("long").alias("total"),
        F.when(p % 97 == 0, "indexing").when(p % 13 == 0, "failed").otherwise("ready").alias("status"),
    )
    return a.site_rollup(sites)


@query("a18_reason_shares", with_tables("messages", "escalations") + f"""
SELECT reason, count(*) AS n, {_percent("count(*)", "sum(count(*)) OVER ()")} AS share FROM escalations GROUP BY 1""")
def reason_shares(spark: SparkSession, d: str) -> DataFrame:
    counted = t.escalations(spark, d).groupBy("reason").agg(F.count("*").alias("n"))
    return counted.withColumn("share", a.percent(F.col("n"), F.sum("n").over(Window.partitionBy())))


@query("a22_nearest_rank", with_tables("messages") + """
, placed AS (SELECT channel, latency_ms, row_number() OVER (PARTITION BY channel ORDER BY latency_ms, id) - 1 AS i, count(*) OVER (PARTITION BY channel) AS n FROM messages WHERE latency_ms IS NOT NULL)
SELECT channel, max(latency_ms) FILTER (WHERE i = least(CAST(trunc(n * 0.5) AS INT), n - 1)) AS median, max(latency_ms) FILTER (WHERE i = least(CAST(trunc(n * 0.95) AS INT), n - 1)) AS high, max(latency_ms) AS worst
FROM placed GROUP BY 1""")
def nearest_rank(spark: SparkSession, d: str) -> DataFrame:
    return a.nearest_rank(t.messages(spark, d).where("latency_ms IS NOT NULL"), "channel", "latency_ms", 0.95)


@query("a25_outcome_deltas", with_tables("messages", "threads", "escalations") + f"""
, judged AS (SELECT started_at, NOT EXISTS (SELECT 1 FROM escalations e WHERE e.conversation_id = th.conversation_id) AS by_bot FROM threads th)
SELECT count(*) FILTER (WHERE {_in("started_at")}) - count(*) FILTER (WHERE started_at >= TIMESTAMP '2024-01-17' AND started_at < TIMESTAMP '{SINCE}') AS total_delta,
       count(*) FILTER (WHERE by_bot AND {_in("started_at")}) - count(*) FILTER (WHERE by_bot AND started_at >= TIMESTAMP '2024-01-17' AND started_at < TIMESTAMP '{SINCE}') AS by_bot_delta
FROM judged""")
def outcome_deltas(spark: SparkSession, d: str) -> DataFrame:
    th, es = t.threads(spark, d), t.escalations(spark, d)
    after = a.outcomes(th, es, SINCE, NOW).select(F.col("total").alias("t1"), F.col("by_bot").alias("b1"))
    before = a.outcomes(th, es, "2024-01-17 00:00:00", SINCE).select(F.col("total").alias("t0"), F.col("by_bot").alias("b0"))
    return after.join(before).select((F.col("t1") - F.col("t0")).alias("total_delta"), (F.col("b1") - F.col("b0")).alias("by_bot_delta"))  # one row each


@query("a27_index_projection", "SELECT lang, round(sum(n_chars) / sum(ceil(n_chars / 1400.0::DOUBLE)), 6) AS chars_per_chunk, CAST(greatest(40, round_even(sum(n_chars) / count(*) * 40 / 1400.0::DOUBLE, 0)) AS INT) AS chunks_for_40 FROM documents GROUP BY 1")
def index_projection(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n_chars")
    return t.table(spark, d, "documents").groupBy("lang").agg(
        F.round(F.sum(n) / F.sum(F.ceil(n / 1400.0)), 6).alias("chars_per_chunk"), F.greatest(F.lit(40), F.bround(F.sum(n) / F.count("*") * 40 / 1400.0, 0)).cast("int").alias("chunks_for_40")
    )


@query("a28_audit_quality", "SELECT event_type, count(*) AS n, count(*) FILTER (WHERE CAST(json_extract(props, '$.k') AS INT) IS NOT NULL) AS with_key, CAST(sum(CAST(json_extract(props, '$.k') AS INT)) AS BIGINT) AS total FROM events GROUP BY 1")
def audit_quality(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return t.table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count(k).alias("with_key"), F.sum(k).alias("total"))


@query("a30_channel_cards", _FIRST + f"""
, settings(channel, configured, hook, error) AS (VALUES ('telegram', true, 'https://x', NULL), ('widget', true, NULL, NULL), ('whatsapp', false, NULL, NULL)),
recent AS (SELECT channel, count(*) AS n FROM firsts WHERE created_at > TIMESTAMP '{SINCE}' GROUP BY 1)
SELECT channel, coalesce(n, 0) AS conversations, CASE WHEN NOT configured THEN 'off' WHEN hook IS NULL THEN 'unknown' WHEN error IS NOT NULL OR hook = '' THEN 'wait' ELSE 'live' END AS state
FROM settings LEFT JOIN recent USING (channel)""")
def channel_cards(spark: SparkSession, d: str) -> DataFrame:
    settings = spark.createDataFrame([("telegram", True, "https://x", None), ("widget", True, None, None), ("whatsapp", False, None, None)], "channel string, configured boolean, hook string, error string")
    return a.channel_cards(t.messages(spark, d), settings, SINCE)


@query("a31_health", with_tables("messages") + """
, checks AS (SELECT channel AS name, channel = 'telegram' AS critical, arg_max(role, (created_at, id)) <> 'system' AS ok FROM messages WHERE workspace_id = 1 GROUP BY 1
  UNION ALL SELECT 'channel ' || channel || ' of 2', false, arg_max(role, (created_at, id)) <> 'system' FROM messages WHERE workspace_id = 2 GROUP BY channel)
SELECT CASE WHEN bool_or(NOT ok AND critical) THEN 'fail' WHEN bool_or(NOT ok) THEN 'degraded' ELSE 'ok' END AS status, coalesce(string_agg(name, ',' ORDER BY name) FILTER (WHERE NOT ok), '') AS broken FROM checks""")
def health(spark: SparkSession, d: str) -> DataFrame:
    """A channel is well if the last that was said on it isn't an error; the first workspace's telegram is critical."""
    last = t.messages(spark, d).groupBy("workspace_id", "channel").agg(F.max_by("role", F.struct("created_at", "id")).alias("role"))
    first = F.col("workspace_id") == 1
    name = F.when(first, F.col("channel")).otherwise(F.concat(F.lit("channel "), "channel", F.lit(" of 2")))
    return a.health(last.select(name.alias("name"), (first & (F.col("channel") == "telegram")).alias("critical"), (F.col("role") != "system").alias("ok")))


@query("a32_load_rounds", with_tables("messages") + f"""
, outcomes AS (SELECT channel, CASE WHEN latency_ms IS NULL THEN 'empty' WHEN latency_ms > 400 THEN 'timeout' ELSE 'ok' END AS outcome FROM messages WHERE role IN ('assistant', 'system'))
SELECT channel, outcome, count(*) AS n, {_percent("count(*)", "sum(count(*)) OVER (PARTITION BY channel)")} AS share FROM outcomes GROUP BY 1, 2""")
def load_rounds(spark: SparkSession, d: str) -> DataFrame:
    outcome = F.when(F.col("latency_ms").isNull(), "empty").when(F.col("latency_ms") > 400, "timeout").otherwise("ok")
    counted = t.messages(spark, d).where("role IN ('assistant', 'system')").groupBy("channel", outcome.alias("outcome")).agg(F.count("*").alias("n"))
    return counted.withColumn("share", a.percent(F.col("n"), F.sum("n").over(Window.partitionBy("channel"))))


@query("s01_tenant_scan", with_tables("messages") + f"SELECT id, channel, role FROM messages WHERE workspace_id = 1 AND {_in('created_at')}")
def tenant_scan(spark: SparkSession, d: str) -> DataFrame:
    """Also F01: the time range reaches the Parquet scan."""
    return t.messages(spark, d).where((F.col("workspace_id") == 1) & a.in_period("created_at", SINCE, NOW)).select("id", "channel", "role")


@query("f03_inbox_states", with_tables("messages", "escalations") + """
SELECT CASE WHEN resolved_at IS NOT NULL THEN 'resolved' WHEN taken_at IS NOT NULL THEN 'active' ELSE 'waiting' END AS state, reason, count(*) AS n FROM escalations GROUP BY 1, 2""")
def inbox_states(spark: SparkSession, d: str) -> DataFrame:
    return t.escalations(spark, d).groupBy(a.inbox_state().alias("state"), "reason").agg(F.count("*").alias("n"))


@query("f04_exclusion_list", "SELECT doc_id FROM documents WHERE doc_id NOT IN (1, 2, 3, 5, 8, 13)")
def exclusion_list(spark: SparkSession, d: str) -> DataFrame:
    """An anti join: an empty list excludes nothing, a null in it excludes nothing either."""
    excluded = spark.createDataFrame([(i,) for i in (1, 2, 3, 5, 8, 13, None)], "doc_id long")
    return t.table(spark, d, "documents").select("doc_id").join(excluded, "doc_id", "left_anti")


@query("f08_not_like", "SELECT page_id FROM pages WHERE url NOT LIKE '%utm_source=%'")
def not_like(spark: SparkSession, d: str) -> DataFrame:
    return t.table(spark, d, "pages").where(~F.col("url").like("%utm_source=%")).select("page_id")


@query("f09_leak_check", "SELECT doc_id FROM documents WHERE contains(text, '@example')")
def leak_check(spark: SparkSession, d: str) -> DataFrame:
    return t.table(spark, d, "documents").where(F.col("text").contains("@example")).select("doc_id")


@query("f10_no_system_turns", with_tables("chat") + "SELECT id, role FROM chat WHERE role <> 'system'")
def no_system_turns(spark: SparkSession, d: str) -> DataFrame:
    return t.chat(spark, d).where("role <> 'system'").select("id", "role")


@query("f11_keyset_page", with_tables("chat") + "SELECT conversation_id, id FROM chat WHERE turn < 5 QUALIFY row_number() OVER (PARTITION BY conversation_id ORDER BY id DESC) <= 3")
def keyset_page(spark: SparkSession, d: str) -> DataFrame:
    """The three messages before a key, for every conversation at once."""
    newest = Window.partitionBy("conversation_id").orderBy(F.desc("id"))
    return t.chat(spark, d).where("turn < 5").withColumn("at", F.row_number().over(newest)).where("at <= 3").select("conversation_id", "id")


@query("f12_host_match", "SELECT page_id FROM pages WHERE regexp_extract(lower(url), '://([^/?#]*)', 1) IN (SELECT min(regexp_extract(lower(url), '://([^/?#]*)', 1)) FROM pages)")
def host_match(spark: SparkSession, d: str) -> DataFrame:
    pages = t.table(spark, d, "pages").withColumn("host", F.lower(F.expr("try_parse_url(url, 'AUTHORITY')")))
    return pages.join(F.broadcast(pages.agg(F.min("host").alias("host"))), "host", "left_semi").select("page_id")  # one row


@query("f13_search_titles", r"SELECT page_id FROM pages WHERE contains(lower(url), 'blog') OR contains(lower(regexp_extract(html, '<title>([^<]*)', 1)), 'the')")
def search_titles(spark: SparkSession, d: str) -> DataFrame:
    title = F.regexp_extract("html", "<title>([^<]*)", 1)
    return t.table(spark, d, "pages").where(F.lower("url").contains("blog") | F.lower(title).contains("the")).select("page_id")


@query("f15_previews", with_tables("chat") + "SELECT id, left(text, 60) AS question, left(text, 80) AS preview FROM chat")
def previews(spark: SparkSession, d: str) -> DataFrame:
    return t.chat(spark, d).select("id", F.left("text", F.lit(60)).alias("question"), F.left("text", F.lit(80)).alias("preview"))


@query("f16_masked_or_text", with_tables("chat") + "SELECT id, coalesce(nullif(CASE turn % 3 WHEN 0 THEN '' WHEN 1 THEN 'masked' END, ''), text) AS shown FROM chat")
def masked_or_text(spark: SparkSession, d: str) -> DataFrame:
    masked = F.when(F.col("turn") % 3 == 0, "").when(F.col("turn") % 3 == 1, "masked")
    return t.chat(spark, d).select("id", F.coalesce(F.nullif(masked, F.lit("")), F.col("text")).alias("shown"))


@query("f17_json_defaults", "SELECT event_id, coalesce(CAST(json_extract(props, '$.k') AS INT) > 50, true) AS flag, coalesce(CAST(json_extract(props, '$.done') AS INT), 0) AS done FROM events")
def json_defaults(spark: SparkSession, d: str) -> DataFrame:
    get = lambda path: F.get_json_object("props", path).cast("int")
    return t.table(spark, d, "events").select("event_id", F.coalesce(get("$.k") > 50, F.lit(True)).alias("flag"), F.coalesce(get("$.done"), F.lit(0)).alias("done"))


@query("f24_size_cap", "SELECT page_id, strlen(html) AS n_bytes FROM pages WHERE strlen(html) <= 5242880")
def size_cap(spark: SparkSession, d: str) -> DataFrame:
    return t.table(spark, d, "pages").select("page_id", F.octet_length("html").cast("long").alias("n_bytes")).where(f"n_bytes <= {5 * 1024 * 1024}")


@query("j04_escalations_with_tenant", with_tables("messages", "threads", "escalations") + "SELECT e.id, th.workspace_id, th.status FROM escalations e JOIN threads th USING (conversation_id)")
def escalations_with_tenant(spark: SparkSession, d: str) -> DataFrame:
    return t.escalations(spark, d).drop("workspace_id").join(t.threads(spark, d), "conversation_id").select("id", "workspace_id", "status")


@query("j06_never_escalated", with_tables("messages", "threads", "escalations") + "SELECT conversation_id FROM threads th WHERE NOT EXISTS (SELECT 1 FROM escalations e WHERE e.conversation_id = th.conversation_id)")
def never_escalated(spark: SparkSession, d: str) -> DataFrame:
    return t.threads(spark, d).select("conversation_id").join(t.escalations(spark, d), "conversation_id", "left_anti")


@query("j09_counts_per_tenant", with_tables("messages", "threads", "escalations") + """
SELECT w AS workspace_id, (SELECT count(*) FROM threads WHERE workspace_id = w) AS threads, (SELECT count(*) FROM escalations WHERE workspace_id = w AND reason = 'pii_topic') AS pii
FROM (VALUES (1), (2), (3)) AS ws(w)""")
def counts_per_tenant(spark: SparkSession, d: str) -> DataFrame:
    spaces = spark.createDataFrame([(1,), (2,), (3,)], "workspace_id long")
    th = t.threads(spark, d).groupBy("workspace_id").agg(F.count("*").alias("threads"))
    es = t.escalations(spark, d).where("reason = 'pii_topic'").groupBy("workspace_id").agg(F.count("*").alias("pii"))
    return spaces.join(th, "workspace_id", "left").join(es, "workspace_id", "left").na.fill(0)


@query("j10_latest_message", with_tables("chat") + "SELECT conversation_id, arg_max(role, id) AS role, left(arg_max(text, id), 80) AS preview FROM chat GROUP BY 1")
def latest_message(spark: SparkSession, d: str) -> DataFrame:
    return t.chat(spark, d).groupBy("conversation_id").agg(F.max_by("role", "id").alias("role"), F.left(F.max_by("text", "id"), F.lit(80)).alias("preview"))


@query("j12_chunk_counts", with_tables("chunks") + "SELECT l.label AS document_id, coalesce(n, 0) AS n FROM (SELECT DISTINCT label FROM embeddings) l LEFT JOIN (SELECT document_id, count(*) AS n FROM chunks GROUP BY 1) c ON c.document_id = l.label")
def chunk_counts(spark: SparkSession, d: str) -> DataFrame:
    """Also A29: chunks of each document in one pass, none as zero."""
    documents = t.table(spark, d, "embeddings").select(F.col("label").alias("document_id")).distinct()
    counted = t.chunks(spark, d).groupBy("document_id").agg(F.count("*").alias("n"))
    return documents.join(counted, "document_id", "left").na.fill(0)


@query("j13_identity_lookup", with_tables("messages") + """
, identities AS (SELECT workspace_id, channel, contact_id, min(id) AS first_id FROM messages GROUP BY 1, 2, 3)
SELECT m.channel, count(DISTINCT i.first_id) AS identities, count(*) AS n FROM messages m JOIN identities i USING (workspace_id, channel, contact_id) GROUP BY 1""")
def identity_lookup(spark: SparkSession, d: str) -> DataFrame:
    m, key = t.messages(spark, d), ["workspace_id", "channel", "contact_id"]
    identities = m.groupBy(*key).agg(F.min("id").alias("first_id"))
    return m.join(identities, key).groupBy("channel").agg(F.count_distinct("first_id").alias("identities"), F.count("*").alias("n"))


@query("w06_state_changes", with_tables("messages") + """
, probes AS (SELECT contact_id, id, event_type = 'error' AS broken, lag(event_type = 'error') OVER (PARTITION BY contact_id ORDER BY created_at, id) AS was FROM messages)
SELECT contact_id, id, broken FROM probes WHERE was IS NOT NULL AND broken <> was""")
def state_changes(spark: SparkSession, d: str) -> DataFrame:
    """Alerts only where a probe's state changed; the first observation is silent."""
    seen = Window.partitionBy("contact_id").orderBy("created_at", "id")
    probes = t.messages(spark, d).withColumn("broken", F.col("event_type") == "error").withColumn("was", F.lag("broken").over(seen))
    return probes.where("was IS NOT NULL AND broken <> was").select("contact_id", "id", "broken")


@query("o06_newest_chronological", with_tables("chat") + "SELECT conversation_id, id, row_number() OVER (PARTITION BY conversation_id ORDER BY id) AS place FROM (SELECT * FROM chat QUALIFY row_number() OVER (PARTITION BY conversation_id ORDER BY id DESC) <= 4)")
def newest_chronological(spark: SparkSession, d: str) -> DataFrame:
    newest, back = Window.partitionBy("conversation_id").orderBy(F.desc("id")), Window.partitionBy("conversation_id").orderBy("id")
    kept = t.chat(spark, d).withColumn("at", F.row_number().over(newest)).where("at <= 4")
    return kept.select("conversation_id", "id", F.row_number().over(back).alias("place"))


@query("o09_open_conversation", with_tables("messages", "threads") + "SELECT contact_id, arg_max(conversation_id, (last_msg_at, conversation_id)) AS conversation_id FROM threads WHERE status <> 'closed' GROUP BY 1")
def open_conversation(spark: SparkSession, d: str) -> DataFrame:
    return t.threads(spark, d).where("status <> 'closed'").groupBy("contact_id").agg(F.max_by("conversation_id", F.struct("last_msg_at", "conversation_id")).alias("conversation_id"))


@query("o10_oldest_contact", with_tables("messages", "threads") + "SELECT workspace_id, arg_min(contact_id, (started_at, contact_id)) AS contact_id FROM threads GROUP BY 1")
def oldest_contact(spark: SparkSession, d: str) -> DataFrame:
    return t.threads(spark, d).groupBy("workspace_id").agg(F.min_by("contact_id", F.struct("started_at", "contact_id")).alias("contact_id"))


@query("r13_omni_latest", with_tables("messages") + """
, best AS (SELECT conversation_id FROM messages GROUP BY 1 ORDER BY count(DISTINCT channel) DESC, max(id) DESC LIMIT 1)
SELECT id, channel, role FROM messages JOIN best USING (conversation_id) WHERE role <> 'system' ORDER BY id DESC LIMIT 40""")
def omni_latest(spark: SparkSession, d: str) -> DataFrame:
    m = t.messages(spark, d)
    best = a.richest_conversation(m).select("conversation_id")
    return m.join(F.broadcast(best), "conversation_id").where("role <> 'system'").select("id", "channel", "role").orderBy(F.desc("id")).limit(40)  # best is one row


@query("t05_calendar", """WITH days AS (SELECT CAST(unnest(generate_series(DATE '2024-01-25', DATE '2024-01-31', INTERVAL 1 DAY)) AS DATE) AS day)
SELECT CAST(day AS VARCHAR) AS day, count(event_id) AS n FROM days LEFT JOIN events ON CAST(ts AS DATE) = day GROUP BY 1""")
def calendar(spark: SparkSession, d: str) -> DataFrame:
    """Events of each of the last seven days, zero where there are none."""
    found = t.table(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("event_id").alias("n"))
    return a.calendar(NOW, 7).select(F.col("day").cast("date").alias("day")).join(found, "day", "left").select(F.col("day").cast("string").alias("day"), F.coalesce("n", F.lit(0).cast("long")).alias("n"))


@query("t04_local_days", "SELECT CAST(CAST(ts + INTERVAL 5 HOUR AS DATE) AS VARCHAR) AS day, count(*) AS n FROM events GROUP BY 1")
def local_days(spark: SparkSession, d: str) -> DataFrame:
    """Days of the fixed UTC+5 calendar that reports use."""
    return t.table(spark, d, "events").groupBy(F.to_date(F.col("ts") + F.expr("INTERVAL '5' HOUR")).cast("string").alias("day")).agg(F.count("*").alias("n"))


@query("t07_retention", "SELECT count(*) AS kept FROM events WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 20 DAY")
def retention(spark: SparkSession, d: str) -> DataFrame:
    """Also U30: rows that an age limit leaves."""
    return t.table(spark, d, "events").where(F.col("ts") >= a.moment(NOW) - F.expr("INTERVAL '20' DAY")).agg(F.count("*").alias("kept"))
