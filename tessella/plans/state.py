"""Queries of state changes over the timed messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import text as x
from tessella.operators import state as s
from tessella.operators import work_queue
from tessella.plans.registry import query
from tessella.session import shared_folder
from tessella.sources import standin as t
from tessella.sources.standin import with_tables
from tessella.streaming.tables import KeyedTable


@query("u20_new_identities", with_tables("messages") + """
, known AS (SELECT DISTINCT workspace_id, channel, contact_id FROM messages WHERE created_at < TIMESTAMP '2024-01-03')
SELECT workspace_id, channel, contact_id, min(id) AS first_id FROM messages m WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.workspace_id = m.workspace_id AND k.channel = m.channel AND k.contact_id = m.contact_id) GROUP BY 1, 2, 3""")
def new_identities(spark: SparkSession, d: str) -> DataFrame:
    m = t.messages(spark, d)
    return s.new_identities(m, m.where(F.col("created_at") < F.to_timestamp_ntz(F.lit("2024-01-03"))))


@query("u21_sessions", with_tables("messages") + """
SELECT id, CAST(coalesce(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY contact_id ORDER BY created_at, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS session FROM messages""")
def sessions(spark: SparkSession, d: str) -> DataFrame:
    return s.split_at_close(t.messages(spark, d)).select("id", "session")


def _merges(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("c_custkey")
    return t.table(spark, d, "customer").where(c % 5 == 0).where(c > 5).select(c.alias("contact_id"), F.when(c % 10 == 0, c - 5).otherwise(F.lit(1)).alias("merged_into"))


@query("u22_merge_contacts", """
WITH RECURSIVE merges AS (SELECT c_custkey AS contact_id, CASE WHEN c_custkey % 10 = 0 THEN c_custkey - 5 ELSE 1 END AS merged_into FROM customer WHERE c_custkey % 5 = 0 AND c_custkey > 5),
walk(contact_id, final_id, step) AS (SELECT contact_id, merged_into, 1 FROM merges UNION ALL SELECT w.contact_id, m.merged_into, step + 1 FROM walk w JOIN merges m ON m.contact_id = w.final_id),
final AS (SELECT contact_id, arg_max(final_id, step) AS final_id FROM walk GROUP BY 1)
SELECT coalesce(f.final_id, o_custkey) AS contact_id, count(*) AS n FROM orders o LEFT JOIN final f ON f.contact_id = o_custkey GROUP BY 1""")
def merge_contacts(spark: SparkSession, d: str) -> DataFrame:
    """Also J13: orders play what moves with a contact."""
    from tessella.sources.standin import table

    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("contact_id"))
    return s.rewrite_contacts(orders, s.resolve_merges(_merges(spark, d))).groupBy("contact_id").agg(F.count("*").alias("n"))


_ACTIONS = """
, acts AS (SELECT conversation_id, created_at AS t, id, CASE event_type WHEN 'error' THEN 'escalate' WHEN 'view' THEN 'take' WHEN 'purchase' THEN 'resolve' ELSE 'close' END AS action, channel AS actor FROM messages WHERE event_type IN ('error', 'view', 'purchase', 'signup')),
ends AS (SELECT conversation_id, max((t, id)) AS e, arg_max(action, (t, id)) AS ended FROM acts WHERE action IN ('resolve', 'close') GROUP BY 1),
live AS (SELECT a.* FROM acts a LEFT JOIN ends USING (conversation_id) WHERE e IS NULL OR (a.t, a.id) > e),
open AS (SELECT conversation_id, min((t, id)) AS s FROM live WHERE action = 'escalate' GROUP BY 1),
taken AS (SELECT conversation_id, arg_min(actor, (t, id)) AS taken_by FROM live JOIN open USING (conversation_id) WHERE action = 'take' AND (t, id) > s GROUP BY 1)
"""


@query("u23_escalation_states", with_tables("messages") + _ACTIONS + """
SELECT c.conversation_id, CASE WHEN s IS NOT NULL AND taken_by IS NOT NULL THEN 'taken' WHEN s IS NOT NULL THEN 'waiting' WHEN ended = 'close' THEN 'closed' ELSE 'bot' END AS state, taken_by
FROM (SELECT DISTINCT conversation_id FROM acts) c LEFT JOIN ends USING (conversation_id) LEFT JOIN open USING (conversation_id) LEFT JOIN taken USING (conversation_id)""")
def escalation_states(spark: SparkSession, d: str) -> DataFrame:
    """Also E09 and E13."""
    kind = F.col("event_type")
    action = F.when(kind == "error", "escalate").when(kind == "view", "take").when(kind == "purchase", "resolve").otherwise("close")
    acts = t.messages(spark, d).where("event_type IN ('error', 'view', 'purchase', 'signup')").select("conversation_id", F.col("created_at").alias("at"), "id", action.alias("action"), F.col("channel").alias("actor"))
    return s.fold_escalations(acts)


@query("u24_latest_ratings", "SELECT user_id AS message_id, arg_max(event_id % 7, (ts, event_id)) AS score FROM events WHERE event_id % 7 BETWEEN 1 AND 5 GROUP BY 1")
def latest_ratings(spark: SparkSession, d: str) -> DataFrame:
    rows = t.table(spark, d, "events").select(F.col("user_id").alias("message_id"), (F.col("event_id") % 7).alias("score"), F.col("ts").alias("at"), F.col("event_id").alias("id"))
    return s.latest_ratings(rows)


@query("u24_rating_sink", "SELECT user_id AS message_id, arg_max(event_id % 7, (ts, event_id)) AS score FROM events WHERE event_id % 7 BETWEEN 1 AND 5 GROUP BY 1")
def rating_sink(spark: SparkSession, d: str) -> DataFrame:
    """Ratings that arrive in batches, of which one runs again after the last and one stops before its commit and then runs again."""
    schema = "message_id long, score long, at timestamp_ntz, id long"
    e = t.table(spark, d, "events").where("event_id % 7 BETWEEN 1 AND 5")
    rows = e.select(F.col("user_id").alias("message_id"), (F.col("event_id") % 7).alias("score"), F.col("ts").cast("timestamp_ntz").alias("at"), F.col("event_id").alias("id"))
    kept = KeyedTable(spark, shared_folder(spark), schema, ["message_id"], ["at", "id"], buckets=8)

    def stop() -> None:
        raise InterruptedError

    for batch in (0, 1, 2, 1):
        some = rows.where(F.col("id") % 3 == batch)
        try:
            kept.apply(some, batch, stop if batch == 2 else None)
        except InterruptedError:
            kept.apply(some, batch)
    return kept.read().select("message_id", "score")


@query("u25_delete_site", "SELECT workspace, count(*) AS n FROM (SELECT lang AS workspace, doc_id FROM documents WHERE NOT (source = 'src1' AND lang = 'en')) GROUP BY 1")
def delete_site(spark: SparkSession, d: str) -> DataFrame:
    """Also U29: an anti join on tenant and document."""
    docs = t.table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), F.col("lang").alias("workspace"), "source")
    doomed = docs.where("source = 'src1' AND workspace = 'en'").select("document_id", "workspace")
    kept, _ = s.delete_documents(docs, docs, doomed)
    return kept.groupBy("workspace").agg(F.count("*").alias("n"))


@query("u26_scale_migration", "SELECT event_id, CASE WHEN s = 1 THEN 5 WHEN s = -1 THEN 1 ELSE s END AS stars, CASE WHEN n >= 4 THEN 1 ELSE -1 END AS thumb FROM (SELECT event_id, CAST(CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END AS INT) AS s, event_id % 5 + 1 AS n FROM events)")
def scale_migration(spark: SparkSession, d: str) -> DataFrame:
    thumb, stars = F.when(F.col("event_id") % 2 == 0, 1).otherwise(-1), F.col("event_id") % 5 + 1
    return t.table(spark, d, "events").select("event_id", s.migrate_scale(thumb).alias("stars"), s.migrate_scale(stars, back=True).alias("thumb"))


@query("u27_security_flags", """WITH settings AS (SELECT n_nationkey AS workspace_id, unnest(['mask', 'audit', 'kb_only']) AS flag, n_regionkey % 2 = 0 OR n_nationkey % 3 = 0 AS enabled FROM nation),
changes AS (SELECT c_nationkey AS workspace_id, CASE c_custkey % 3 WHEN 0 THEN 'mask' WHEN 1 THEN 'audit' ELSE 'kb_only' END AS flag, arg_max(c_acctbal > 0, c_custkey) AS changed FROM customer WHERE c_mktsegment = 'BUILDING' GROUP BY 1, 2)
SELECT workspace_id, flag, CASE WHEN flag = 'kb_only' THEN true ELSE coalesce(changed, enabled) END AS enabled FROM settings FULL OUTER JOIN changes USING (workspace_id, flag)""")
def security_flags(spark: SparkSession, d: str) -> DataFrame:
    """Nations are workspaces; the last customer of each flag changes it."""
    flags = ("mask", "audit", "kb_only")
    before = t.table(spark, d, "nation").select(F.col("n_nationkey").alias("workspace_id"), F.explode(F.array(*map(F.lit, flags))).alias("flag"), ((F.col("n_regionkey") % 2 == 0) | (F.col("n_nationkey") % 3 == 0)).alias("enabled"))
    asked = t.table(spark, d, "customer").where("c_mktsegment = 'BUILDING'")
    flag = F.element_at(F.array(*map(F.lit, flags)), (F.col("c_custkey") % 3 + 1).cast("int"))
    changes = asked.groupBy(F.col("c_nationkey").alias("workspace_id"), flag.alias("flag")).agg(F.max_by(F.col("c_acctbal") > 0, "c_custkey").alias("enabled"))
    return s.merge_flags(before, changes)


@query("u28_new_workspaces", """WITH asked AS (SELECT n_nationkey AS id, lower(n_name) AS slug, n_name AS name FROM nation)
SELECT slug, arg_min(name, id) AS name FROM asked WHERE regexp_matches(slug, '^[a-z0-9]([a-z0-9-]{0,62}[a-z0-9])?$') AND slug NOT IN (SELECT lower(n_name) FROM nation WHERE n_regionkey = 1) GROUP BY 1""")
def new_workspaces(spark: SparkSession, d: str) -> DataFrame:
    """Also X40's slug rule and U35: natural keys that exist already are left out."""
    nation = t.table(spark, d, "nation")
    asked = nation.select(F.col("n_nationkey").alias("id"), F.lower("n_name").alias("slug"), F.col("n_name").alias("name"))
    return s.new_workspaces(asked, nation.where("n_regionkey = 1").select(F.lower("n_name").alias("slug")))


@query("u32_reply_channels", with_tables("messages") + "SELECT conversation_id, arg_max(channel, id) AS channel, max(id) AS answer_to FROM messages WHERE role = 'user' GROUP BY 1")
def reply_channels(spark: SparkSession, d: str) -> DataFrame:
    return s.reply_channels(t.messages(spark, d))


@query("u33_owned_ratings", with_tables("messages") + ", rated AS (SELECT id AS message_id, CASE WHEN id % 3 = 0 THEN contact_id + 1 ELSE contact_id END AS contact_id, 1 + id % 5 AS score FROM messages WHERE role = 'assistant') SELECT r.message_id, r.contact_id, r.score FROM rated r JOIN messages m ON m.id = r.message_id AND m.contact_id = r.contact_id")
def owned_ratings(spark: SparkSession, d: str) -> DataFrame:
    m = t.messages(spark, d)
    by = F.when(F.col("id") % 3 == 0, F.col("contact_id") + 1).otherwise(F.col("contact_id"))
    rated = m.where("role = 'assistant'").select(F.col("id").alias("message_id"), by.alias("contact_id"), (1 + F.col("id") % 5).alias("score"))
    return s.owned_ratings(rated, m)


@query("u34_link_tokens", """
WITH ev AS (SELECT 'u' || user_id AS token, CASE WHEN event_type = 'signup' THEN 'issue' ELSE 'take' END AS action, ts AS t, event_id AS id FROM events WHERE event_type IN ('signup', 'click')),
issued AS (SELECT token, min(t) AS issued FROM ev WHERE action = 'issue' GROUP BY 1),
takes AS (SELECT token, id, t, issued, row_number() OVER (PARTITION BY token ORDER BY t, id) AS n FROM ev LEFT JOIN issued USING (token) WHERE action = 'take' AND (issued IS NULL OR t >= issued))
SELECT token, id, coalesce(n = 1 AND t < issued + INTERVAL 900000 SECOND, false) AS ok FROM takes""")
def link_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Also E02. The test events are sparse, so that the time to live is long here."""
    e = t.table(spark, d, "events").where("event_type IN ('signup', 'click')")
    rows = e.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("token"), F.when(F.col("event_type") == "signup", "issue").otherwise("take").alias("action"), F.col("ts").alias("at"), F.col("event_id").alias("id"))
    return s.take_tokens(rows, 900_000)


@query("u36_workspace_precedence", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'arg' WHEN event_id % 2 = 0 THEN 'header' ELSE 'main' END AS workspace FROM events")
def workspace_precedence(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    return t.table(spark, d, "events").select("event_id", s.resolve_workspace(F.when(i % 3 == 0, "arg"), F.when(i % 2 == 0, "header").otherwise(""), F.lit("main")).alias("workspace"))


@query("u37_create_documents", "SELECT page_id, 'queued' AS status, 'doc_add' AS event FROM pages WHERE regexp_matches(url, '^https?://')")
def create_documents(spark: SparkSession, d: str) -> DataFrame:
    """Also E10 and S12: accepted uploads as queued rows with their audit event."""
    return t.table(spark, d, "pages").where(F.col("url").rlike("^https?://")).select("page_id", F.lit("queued").alias("status"), F.lit("doc_add").alias("event"))


@query("w05_trimmed_history", with_tables("chat") + r"""
, turns AS (SELECT conversation_id, turn, length(regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g')) AS size, row_number() OVER (PARTITION BY conversation_id ORDER BY turn DESC) AS n, count(*) OVER (PARTITION BY conversation_id) AS n_turns FROM chat)
SELECT conversation_id, CAST(n_turns AS INT) AS n_turns, CAST(list(turn ORDER BY turn) FILTER (taken) AS VARCHAR) AS kept_turns FROM (
  SELECT t.*, f.taken FROM turns t LEFT JOIN (
    WITH RECURSIVE fold(conversation_id, n, remaining, taken) AS (
      SELECT conversation_id, 0::BIGINT, 1500::BIGINT, false FROM turns WHERE n = 1 UNION ALL
      SELECT f.conversation_id, t.n, CASE WHEN t.size BETWEEN 1 AND f.remaining THEN f.remaining - t.size ELSE f.remaining END, t.size BETWEEN 1 AND f.remaining
      FROM fold f JOIN turns t ON t.conversation_id = f.conversation_id AND t.n = f.n + 1 WHERE t.n <= 10)
    SELECT * FROM fold WHERE n > 0) f ON f.conversation_id = t.conversation_id AND f.n = t.n) GROUP BY conversation_id, n_turns""")
def trimmed_history(spark: SparkSession, d: str) -> DataFrame:
    turns = t.chat(spark, d).groupBy("conversation_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    kept = turns.select("conversation_id", F.size("turns").alias("n_turns"), s.trim_history(F.col("turns")).alias("kept"))
    return kept.select("conversation_id", "n_turns", F.transform("kept", lambda k: k["turn"]).cast("string").alias("kept_turns"))


_RATE = """hits AS (SELECT 'u' || user_id AS key, event_id AS id, ts AS t FROM events)"""


@query("e01_rate_limit", """
WITH RECURSIVE hits AS (SELECT 'u' || user_id AS key, event_id AS id, ts AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
fold(key, n, id, start, used) AS (
  SELECT key, n, id, t, 1 FROM hits WHERE n = 1 UNION ALL
  SELECT h.key, h.n, h.id, CASE WHEN h.t - f.start >= INTERVAL 3600 SECOND THEN h.t ELSE f.start END, CASE WHEN h.t - f.start >= INTERVAL 3600 SECOND THEN 1 ELSE f.used + 1 END
  FROM fold f JOIN hits h ON h.key = f.key AND h.n = f.n + 1)
SELECT key, id, CAST(used AS INT) AS used, used <= 1 AS allowed FROM fold""")
def rate_limit(spark: SparkSession, d: str) -> DataFrame:
    """Batch twin of the stream: windows anchored at the first hit; an hour here, as the test events are sparse."""
    hits = t.table(spark, d, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("key"), F.col("event_id").alias("id"), F.col("ts").alias("at"))
    return s.anchored_window_hits(hits, limit=1, seconds=3600)


@query("e03_cache_outcomes", """
WITH RECURSIVE asked AS (SELECT 'u' || user_id AS key, event_id AS id, ts AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
fold(key, n, id, stored, outcome) AS (
  SELECT key, n, id, t, 'miss' FROM asked WHERE n = 1 UNION ALL
  SELECT a.key, a.n, a.id, CASE WHEN a.t - f.stored >= INTERVAL 86400 SECOND THEN a.t ELSE f.stored END, CASE WHEN a.t - f.stored >= INTERVAL 86400 SECOND THEN 'expired' ELSE 'hit' END
  FROM fold f JOIN asked a ON a.key = f.key AND a.n = f.n + 1)
SELECT key, id, outcome FROM fold""")
def cache_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """A user's events as one question asked again and again: found in the cache, new, or gone after 24 hours."""
    asked = t.table(spark, d, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("key"), F.col("event_id").alias("id"), F.col("ts").alias("at"))
    return s.cache_outcomes(asked)


_QUEUE = """
WITH RECURSIVE ev AS (SELECT 'u' || user_id % 50 AS task, event_id AS id, ts AS t, concat('w', event_id % 2) AS worker, CASE event_type WHEN 'signup' THEN 'enqueue' WHEN 'view' THEN 'claim' WHEN 'click' THEN 'done' WHEN 'error' THEN 'fail' ELSE 'claim' END AS action FROM events),
numbered AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY t, id) AS n FROM ev),
fold(task, n, id, accepted, status, attempts, until, worker) AS (
  SELECT DISTINCT task, 0::BIGINT, NULL::BIGINT, false, 'unknown', 0, NULL::TIMESTAMP, '' FROM ev UNION ALL
  SELECT task, n, id, ok, CASE WHEN NOT ok THEN now WHEN action = 'enqueue' THEN 'queued' WHEN action = 'claim' THEN 'leased' WHEN action = 'done' THEN 'done' WHEN attempts >= 3 THEN 'failed' ELSE 'queued' END,
    CASE WHEN ok AND action = 'enqueue' THEN 0 WHEN ok AND action = 'claim' THEN attempts + 1 ELSE attempts END, CASE WHEN ok AND action = 'claim' THEN t + INTERVAL 6 HOUR ELSE until END, CASE WHEN ok AND action = 'claim' THEN reporter ELSE worker END
  FROM (SELECT *, CASE action WHEN 'enqueue' THEN now IN ('unknown', 'done', 'failed') WHEN 'claim' THEN now = 'queued' ELSE now = 'leased' AND worker = reporter END AS ok FROM (
    SELECT e.task, e.n, e.id, e.t, e.action, e.worker AS reporter, f.attempts, f.until, f.worker, CASE WHEN f.status = 'leased' AND e.t >= f.until THEN CASE WHEN f.attempts >= 3 THEN 'failed' ELSE 'queued' END ELSE f.status END AS now
    FROM fold f JOIN numbered e ON e.task = f.task AND e.n = f.n + 1)))
"""


def _queue_events(spark: SparkSession, d: str) -> DataFrame:
    """Events as those of a queue, fifty tasks with two workers; leases last six hours, as the test events are sparse."""
    kind, i = F.col("event_type"), F.col("event_id")
    action = F.when(kind == "signup", "enqueue").when(kind == "click", "done").when(kind == "error", "fail").otherwise("claim")
    task = F.concat(F.lit("u"), (F.col("user_id") % 50).cast("string"))
    return t.table(spark, d, "events").select(task.alias("task"), action.alias("action"), F.concat(F.lit("w"), (i % 2).cast("string")).alias("worker"), F.col("ts").alias("at"), i.alias("id"))


@query("e11_leased_tasks", _QUEUE + "SELECT task, id, accepted, status, attempts FROM fold WHERE n > 0")
def leased_tasks(spark: SparkSession, d: str) -> DataFrame:
    """Also E10 and E12. Each event of a queue with leases and attempts: whether it counts, and how the task stands then."""
    return work_queue.follow_tasks(_queue_events(spark, d), 6 * 3600)


@query("e12_standing_tasks", _QUEUE + """
SELECT task, CASE WHEN status = 'leased' AND TIMESTAMP '2024-02-15' >= until THEN CASE WHEN attempts >= 3 THEN 'failed' ELSE 'queued' END ELSE status END AS status, attempts
FROM (SELECT * FROM fold f LEFT JOIN ev e USING (task, id) WHERE n = 0 OR e.t < TIMESTAMP '2024-02-15' QUALIFY row_number() OVER (PARTITION BY task ORDER BY n DESC) = 1)""")
def standing_tasks(spark: SparkSession, d: str) -> DataFrame:
    """How each task stands at one moment, with leases that have run out by then given back."""
    return work_queue.standing(_queue_events(spark, d), "2024-02-15", 6 * 3600)


@query("e04_idle_threads", """
WITH gaps AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
numbered AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS thread FROM gaps)
SELECT user_id, count(*) AS turns, CAST(epoch_us(min(ts)) AS BIGINT) AS start_us FROM numbered GROUP BY user_id, thread""")
def idle_threads(spark: SparkSession, d: str) -> DataFrame:
    e = t.table(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp"))
    return e.groupBy("user_id", F.session_window("at", "30 minutes").alias("w")).agg(F.count("*").alias("turns")).select("user_id", "turns", F.unix_micros("w.start").alias("start_us"))


@query("e06_fanout_cap", with_tables("messages") + "SELECT contact_id, id FROM messages QUALIFY row_number() OVER (PARTITION BY contact_id, CAST(created_at AS DATE) ORDER BY id) <= 100")
def fanout_cap(spark: SparkSession, d: str) -> DataFrame:
    """A subscriber's queue holds 100 events of a batch (here a day); new ones are dropped when it is full."""
    from pyspark.sql import Window

    at = F.row_number().over(Window.partitionBy("contact_id", F.to_date("created_at")).orderBy("id"))
    return t.messages(spark, d).withColumn("at", at).where("at <= 100").select("contact_id", "id")


_NORMAL = r"trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g'))"
_SOCIAL = ", ".join(f"'{w}'" for w in (*x.GREETINGS, *x.THANKS, *x.FAREWELL))
_WANTS = rf"regexp_matches(text, '(?i)(^|[^\p{{L}}\p{{N}}_])({x.OPERATOR_WORDS})')"


@query("r09_message_routes", with_tables("messages", "threads", "escalations", "chunks") + rf"""
, held AS (SELECT DISTINCT conversation_id FROM escalations WHERE resolved_at IS NULL AND taken_at IS NOT NULL),
known AS (SELECT DISTINCT unnest(list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+'), lambda w: length(w) > 1)) AS term FROM chunks),
asked AS (SELECT conv_id * 1000 + turn AS id, conv_id, turn, text, {_NORMAL} AS plain FROM conversations WHERE role = 'user'),
terms AS (SELECT DISTINCT id, unnest(list_filter(string_split(plain, ' '), lambda w: length(w) > 1)) AS term FROM asked),
found AS (SELECT id, count(*) AS n, count(known.term) AS hits FROM terms LEFT JOIN known USING (term) GROUP BY 1),
before AS (SELECT id, lag(plain) OVER (PARTITION BY conv_id ORDER BY turn) AS last FROM asked)
SELECT a.id, CASE WHEN EXISTS (SELECT 1 FROM held h WHERE h.conversation_id % 97 = a.conv_id % 97) THEN 'silent' WHEN {_WANTS} THEN 'operator' WHEN plain IN ({_SOCIAL}) THEN 'smalltalk'
            WHEN coalesce(hits, 0) * 2 < coalesce(n, 1) THEN 'no_answer' WHEN last = plain THEN 'repeat' ELSE 'answer' END AS route
FROM asked a LEFT JOIN found USING (id) LEFT JOIN before USING (id)""")
def message_routes(spark: SparkSession, d: str) -> DataFrame:
    """Also R16. The order of the rules decides: a conversation that an operator has taken is silent for the bot, then a
    wish for an operator, small talk, a question that the knowledge base doesn't cover, a repeated question, an answer.
    Held conversations are matched by their remainder modulo 97, as the two stand-in tables have no common ids; the
    share of a question's terms that the chunks have stands in for the search's threshold."""
    from pyspark.sql import Window

    held = t.escalations(spark, d).where(F.col("resolved_at").isNull() & F.col("taken_at").isNotNull()).select((F.col("conversation_id") % 97).alias("slot")).distinct()
    asked = t.chat(spark, d).where("role = 'user'").select("id", "conversation_id", "turn", "text", x.normalize(F.col("text")).alias("plain"))
    asked = asked.withColumn("last", F.lag("plain").over(Window.partitionBy("conversation_id").orderBy("turn")))
    known = t.chunks(spark, d).select(F.explode(x.terms(F.col("text"))).alias("term")).distinct().withColumn("hit", F.lit(1))
    terms = asked.select("id", F.explode(F.array_distinct(x.terms(F.col("plain")))).alias("term")).join(known, "term", "left").groupBy("id").agg(F.count("*").alias("n"), F.count("hit").alias("hits"))
    judged = asked.join(terms, "id", "left").withColumn("slot", F.col("conversation_id") % 97).join(held.withColumn("held", F.lit(True)), "slot", "left")
    route = (
        F.when(F.col("held"), "silent").when(x.wants_operator(F.col("text")), "operator").when(x.smalltalk(F.col("text")).isNotNull(), "smalltalk")
        .when(F.coalesce("hits", F.lit(0)) * 2 < F.coalesce("n", F.lit(1)), "no_answer").when(F.col("last") == F.col("plain"), "repeat").otherwise("answer")
    )
    return judged.select("id", route.alias("route"))
