"""Sinks that write: messages, audit rows, snapshots; and bounded queues. What a query returns is read back from what was written."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions.rules import mask
from tessella.operators import analytics as a
from tessella.operators import snapshots
from tessella.plans.registry import query
from tessella.session import shared_folder
from tessella.sources import standin as t
from tessella.sources.standin import NOW, with_tables

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
SNAPSHOT = ("nation", "customer", "events", "documents", "conversations")
THREADS_KEPT = 50


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


@query("a24_row_counts", " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS n FROM {n}" for n in TABLES))
def row_counts(spark: SparkSession, d: str) -> DataFrame:
    return _union([t.table(spark, d, n).agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n") for n in TABLES])


def save_messages(messages: DataFrame, folder: str) -> None:
    """Append messages with their masked text; the original stays beside it."""
    messages.withColumn("text_masked", mask(F.col("text"))).write.mode("append").parquet(folder)


@query("s20_message_sink", "SELECT conv_id AS conversation_id, count(*) AS n, count(text) AS masked, max(conv_id * 1000 + turn) AS last_id FROM conversations GROUP BY 1")
def message_sink(spark: SparkSession, d: str) -> DataFrame:
    """Messages as saved, and what saving leaves on each conversation: the last message."""
    folder = shared_folder(spark)
    save_messages(t.chat(spark, d), folder)
    saved = spark.read.parquet(folder)
    return saved.groupBy("conversation_id").agg(F.count("*").alias("n"), F.count("text_masked").alias("masked"), F.max("id").alias("last_id"))


def save_audit(events: DataFrame, settings: DataFrame, folder: str) -> None:
    """Append ``event`` and ``payload`` (JSON) of tenants whose settings allow it; without a setting it is allowed."""
    allowed = F.coalesce(F.get_json_object("settings", "$.audit").cast("boolean"), F.lit(True))
    events.join(settings, "tenant", "left").where(allowed).select("tenant", "event", "payload").write.mode("append").parquet(folder)


@query("s21_audit_sink", "SELECT event_type AS event, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events WHERE user_id % 3 <> 0 GROUP BY 1")
def audit_sink(spark: SparkSession, d: str) -> DataFrame:
    payload = F.to_json(F.struct("event_id", "value"))
    events = t.table(spark, d, "events").select((F.col("user_id") % 3).cast("int").alias("tenant"), F.col("event_type").alias("event"), payload.alias("payload"))
    folder = shared_folder(spark)
    save_audit(events, spark.createDataFrame([(0, '{"audit": false}'), (1, "{}")], "tenant int, settings string"), folder)
    return spark.read.parquet(folder).groupBy("event").agg(F.count("*").alias("n"), F.sum(F.get_json_object("payload", "$.event_id").cast("long")).alias("ids"))


def snapshot(spark: SparkSession, sf_dir: str, folder: str, tables: tuple[str, ...] = SNAPSHOT) -> None:
    for name in tables:
        t.table(spark, sf_dir, name).write.parquet(f"{folder}/{name}")


@query("s23_restore_check", " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS live, count(*) AS kept, true AS same FROM {n}" for n in SNAPSHOT))
def restore_check(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a snapshot against the tables that it was taken of: counts, and an order-free digest of all values."""
    folder = shared_folder(spark)
    snapshot(spark, d, folder)

    def checked(name: str) -> DataFrame:
        live, kept = t.table(spark, d, name), spark.read.parquet(f"{folder}/{name}")
        sides = live.select(F.lit(0).alias("side"), F.xxhash64(*live.columns).alias("h")).union(kept.select(F.lit(1), F.xxhash64(*live.columns)))
        side = lambda k: F.count_if(F.col("side") == k)
        digest = lambda k: F.coalesce(F.bit_xor(F.when(F.col("side") == k, F.col("h"))), F.lit(0))
        return sides.agg(side(0).alias("live"), side(1).alias("kept"), ((side(0) == side(1)) & (digest(0) == digest(1))).alias("same")).select(F.lit(name).alias("name"), "live", "kept", "same")

    return _union([checked(n) for n in SNAPSHOT])


@query("o11_kept_threads", with_tables("messages", "threads") + f"SELECT workspace_id, conversation_id FROM threads QUALIFY row_number() OVER (PARTITION BY workspace_id ORDER BY last_msg_at DESC, conversation_id) <= {THREADS_KEPT}")
def kept_threads(spark: SparkSession, d: str) -> DataFrame:
    """The threads of a workspace that were touched last; the others are evicted."""
    touched = Window.partitionBy("workspace_id").orderBy(F.desc("last_msg_at"), "conversation_id")
    return t.threads(spark, d).withColumn("place", F.row_number().over(touched)).where(F.col("place") <= THREADS_KEPT).select("workspace_id", "conversation_id")


@query("t06_lookback", with_tables("messages") + f"SELECT id % 7 + 1 AS days, count(*) AS n FROM messages WHERE created_at > TIMESTAMP '{NOW}' - to_days(CAST(id % 7 + 1 AS INT)) GROUP BY 1")
def lookback(spark: SparkSession, d: str) -> DataFrame:
    """Messages within a number of days that each row names itself."""
    days = (F.col("id") % 7 + 1).cast("int")
    recent = t.messages(spark, d).where(F.col("created_at") > a.moment(NOW) - F.make_interval(days=days))
    return recent.groupBy((F.col("id") % 7 + 1).alias("days")).agg(F.count("*").alias("n"))


# What may be uploaded.
SUFFIXES = ("pdf", "docx", "xlsx", "html", "htm")
MOST_BYTES = 25 * 1024 * 1024


@query("s12_uploads", f"""
WITH named AS (SELECT page_id, regexp_extract(lower(regexp_replace(url, '[?#].*$', '')), '[.]([a-z0-9]+)$', 1) AS suffix, octet_length(encode(html)) AS size FROM pages)
SELECT page_id, CASE WHEN suffix NOT IN ('{"', '".join(SUFFIXES)}') THEN 415 WHEN coalesce(size, 0) = 0 THEN 400 WHEN size > {MOST_BYTES} THEN 413 ELSE 201 END AS status FROM named WHERE suffix IS NOT NULL""")
def uploads(spark: SparkSession, d: str) -> DataFrame:
    """Verdict on each upload: suffix, emptiness, size, in this order; pages play the files, their path the name."""
    suffix = F.regexp_extract(F.lower(F.regexp_replace("url", "[?#].*$", "")), r"[.]([a-z0-9]+)$", 1)
    named = t.table(spark, d, "pages").select("page_id", suffix.alias("suffix"), F.octet_length("html").alias("size")).where("suffix IS NOT NULL")
    status = F.when(~F.col("suffix").isin(*SUFFIXES), 415).when(F.coalesce("size", F.lit(0)) == 0, 400).when(F.col("size") > MOST_BYTES, 413).otherwise(201)
    return named.select("page_id", status.alias("status"))


@query("e10_index_queue", """
WITH steps AS (SELECT user_id AS document_id, event_id, ts, CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'indexing' WHEN 'click' THEN 'ready' WHEN 'error' THEN 'failed' END AS status FROM events WHERE event_type <> 'purchase'),
queued AS (SELECT document_id, max((ts, event_id)) AS q FROM steps WHERE status = 'queued' GROUP BY 1)
SELECT document_id, arg_max(status, (ts, event_id)) AS status, count(*) AS steps FROM steps LEFT JOIN queued USING (document_id) WHERE q IS NULL OR (ts, event_id) >= q GROUP BY 1""")
def index_queue(spark: SparkSession, d: str) -> DataFrame:
    """Also E13. Where each document stands since it was queued last, and in how many steps; what came before is void. Events play the steps."""
    status = F.when(F.col("event_type") == "signup", "queued").when(F.col("event_type") == "view", "indexing").when(F.col("event_type") == "click", "ready").otherwise("failed")
    steps = t.table(spark, d, "events").where("event_type <> 'purchase'").select(F.col("user_id").alias("document_id"), status.alias("status"), F.struct("ts", "event_id").alias("at"))
    queued = F.max(F.when(F.col("status") == "queued", F.col("at"))).over(Window.partitionBy("document_id"))
    live = steps.withColumn("q", queued).where("q IS NULL OR at >= q")
    return live.groupBy("document_id").agg(F.max_by("status", "at").alias("status"), F.count("*").alias("steps"))


@query("e09_escalation_changes", with_tables("messages", "escalations") + """
, changes AS (
  SELECT id, conversation_id, 'new_escalation' AS event, created_at AS t FROM escalations UNION ALL
  SELECT id, conversation_id, 'taken', taken_at FROM escalations WHERE taken_at IS NOT NULL UNION ALL
  SELECT id, conversation_id, 'resolved', resolved_at FROM escalations WHERE resolved_at IS NOT NULL)
SELECT id, event, CAST(epoch_us(t) AS BIGINT) AS at_us, row_number() OVER (PARTITION BY conversation_id ORDER BY t, id, event) AS seq FROM changes""")
def escalation_changes(spark: SparkSession, d: str) -> DataFrame:
    """The change stream of escalations, in order within each conversation."""
    change = lambda name, at: F.struct(F.lit(name).alias("event"), F.col(at).alias("at"))
    changes = t.escalations(spark, d).select("id", "conversation_id", F.inline(F.array(change("new_escalation", "created_at"), change("taken", "taken_at"), change("resolved", "resolved_at")))).where("at IS NOT NULL")
    seq = F.row_number().over(Window.partitionBy("conversation_id").orderBy("at", "id", "event"))
    return changes.select("id", "event", F.unix_micros(F.col("at").cast("timestamp")).alias("at_us"), seq.cast("long").alias("seq"))


_DUMPED = ("channel", "contact_id", "conversation_id", "day", "event_type", "id", "k", "latency_ms", "role", "workspace_id")


def _dumped_text(columns: tuple[str, ...]) -> str:
    return "concat_ws(chr(31), " + ", ".join(f"coalesce(CAST({c} AS VARCHAR), chr(0))" for c in columns) + ")"


@query("s23_snapshot_catalogue", with_tables("messages") + f"""
, dumped AS (SELECT strftime(created_at, '%Y-%m-%d') AS day, CAST(CAST('0x' || substr(md5({_dumped_text(_DUMPED)}), 1, 13) AS BIGINT) AS HUGEINT) AS bits FROM messages)
SELECT day, count(*) AS n, count(*) AS mirrored, CAST(sum(bits) AS VARCHAR) AS digest, true AS same FROM dumped WHERE CAST(day AS DATE) > (SELECT max(CAST(day AS DATE)) FROM dumped) - {snapshots.KEEP_DAYS} GROUP BY 1""")
def snapshot_catalogue(spark: SparkSession, d: str) -> DataFrame:
    """Messages dumped by day, rotated, and the rest mirrored: what both sides have.
    A row that a dump changes, loses or repeats changes the digest, which the SQL takes from the live table."""
    folder = shared_folder(spark)
    root, mirror = f"{folder}/dumps", f"{folder}/mirror"
    m = t.messages(spark, d).withColumn("day", F.date_format("created_at", "yyyy-MM-dd"))
    snapshots.take_days(m.select(*_DUMPED), F.col("day"), root)
    snapshots.rotate(spark, root)
    snapshots.bring_up(spark, root, mirror)
    return snapshots.compare(spark, root, mirror).join(snapshots.catalogue(spark, mirror).select("day", "digest"), "day")
