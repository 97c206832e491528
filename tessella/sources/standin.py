"""The support-desk tables, made from the test tables.

``events`` play timed messages: a dialog is one user's day, a view is an answer
(its value the latency), an error an escalation, a purchase a rating. The
``conversations`` table has the texts, ``documents`` with ``embeddings`` the
knowledge base. ``SQL`` has the same tables for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Queries look back from here; never from the clock.
NOW = "2024-01-31 00:00:00"

SQL = {
    "messages": """messages AS (
  SELECT event_id AS id, 1 + user_id % 2 AS workspace_id, user_id AS contact_id, user_id * 1000 + dayofyear(ts) AS conversation_id,
         CASE event_id % 3 WHEN 0 THEN 'telegram' WHEN 1 THEN 'widget' ELSE 'whatsapp' END AS channel,
         CASE event_type WHEN 'view' THEN 'assistant' WHEN 'error' THEN 'system' ELSE 'user' END AS role,
         event_type, CASE WHEN event_type = 'view' THEN CAST(trunc(value) AS INT) END AS latency_ms,
         CAST(json_extract(props, '$.k') AS INT) AS k, ts AS created_at FROM events)""",
    "threads": """threads AS (
  SELECT conversation_id, min(workspace_id) AS workspace_id, min(contact_id) AS contact_id, min(created_at) AS started_at, max(created_at) AS last_msg_at,
         CASE WHEN bool_or(event_type = 'purchase') THEN 'closed' WHEN bool_or(event_type = 'error') THEN 'operator' ELSE 'bot' END AS status
  FROM messages GROUP BY 1)""",
    "escalations": """escalations AS (
  SELECT id, conversation_id, workspace_id, CASE id % 4 WHEN 0 THEN 'no_answer' WHEN 1 THEN 'low_confidence' WHEN 2 THEN 'user_request' ELSE 'pii_topic' END AS reason, created_at,
         CASE WHEN id % 2 = 0 THEN created_at + INTERVAL 5 MINUTE END AS taken_at, CASE WHEN id % 4 = 0 THEN created_at + INTERVAL 1 HOUR END AS resolved_at
  FROM messages WHERE event_type = 'error')""",
    "ratings": "ratings AS (SELECT id AS message_id, workspace_id, 1 + id % 5 AS score, created_at FROM messages WHERE event_type = 'purchase')",
    "chat": "chat AS (SELECT conv_id * 1000 + turn AS id, conv_id AS conversation_id, turn, role, text FROM conversations)",
    "chunks": "chunks AS (SELECT d.doc_id AS chunk_id, e.label AS document_id, d.lang AS workspace, d.source AS title, d.text, e.embedding FROM documents d JOIN embeddings e ON d.doc_id = e.vec_id)",
}


def with_tables(*names: str) -> str:
    """A WITH clause that defines the named tables; ends with a line break, ready for more or for SELECT."""
    return "WITH " + ",\n".join(SQL[n] for n in names) + "\n"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts, kind = F.col("ts"), F.col("event_type")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), (1 + F.col("user_id") % 2).alias("workspace_id"), F.col("user_id").alias("contact_id"),
        (F.col("user_id") * 1000 + F.dayofyear(ts)).alias("conversation_id"),
        F.element_at(F.array(F.lit("telegram"), F.lit("widget"), F.lit("whatsapp")), (F.col("event_id") % 3 + 1).cast("int")).alias("channel"),
        F.when(kind == "view", "assistant").when(kind == "error", "system").otherwise("user").alias("role"),
        "event_type", F.when(kind == "view", F.col("value").cast("int")).alias("latency_ms"),
        F.get_json_object("props", "$.k").cast("int").alias("k"), ts.alias("created_at"),
    )


def threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    return messages(spark, sf_dir).groupBy("conversation_id").agg(
        F.min("workspace_id").alias("workspace_id"), F.min("contact_id").alias("contact_id"), F.min("created_at").alias("started_at"), F.max("created_at").alias("last_msg_at"),
        F.when(F.bool_or(kind == "purchase"), "closed").when(F.bool_or(kind == "error"), "operator").otherwise("bot").alias("status"),
    )


def escalations(spark: SparkSession, sf_dir: str) -> DataFrame:
    reason = F.element_at(F.array(*map(F.lit, ("no_answer", "low_confidence", "user_request", "pii_topic"))), (F.col("id") % 4 + 1).cast("int"))
    return messages(spark, sf_dir).where("event_type = 'error'").select(
        "id", "conversation_id", "workspace_id", reason.alias("reason"), "created_at",
        F.expr("CASE WHEN id % 2 = 0 THEN created_at + INTERVAL '5' MINUTE END").alias("taken_at"),
        F.expr("CASE WHEN id % 4 = 0 THEN created_at + INTERVAL '1' HOUR END").alias("resolved_at"),
    )


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages(spark, sf_dir).where("event_type = 'purchase'").select(F.col("id").alias("message_id"), "workspace_id", (1 + F.col("id") % 5).alias("score"), "created_at")


def chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("conv_id").alias("conversation_id"), "turn", "role", "text")


def chunks(spark: SparkSession, sf_dir: str, read: int | None = None) -> DataFrame:
    """Chunks with text and vector; ``label`` plays the document. With ``read`` the beginning of the text, cut before the join."""
    docs, vectors = table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings")
    docs = docs.withColumn("text", F.substring("text", 1, read)) if read else docs
    return docs.join(vectors, docs["doc_id"] == vectors["vec_id"]).select(
        F.col("doc_id").alias("chunk_id"), F.col("label").alias("document_id"), F.col("lang").alias("workspace"), F.col("source").alias("title"), "text", "embedding"
    )


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items with a vector, as questions."""
    items, vectors = table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "embeddings")
    return items.join(vectors, items["item_id"] == vectors["vec_id"]).select(F.col("item_id").alias("query_id"), F.col("text").alias("question"), "embedding")
