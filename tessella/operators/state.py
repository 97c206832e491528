"""Changes of state as folds over event tables: identities, conversations, escalations, ratings, settings."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLUG = "^[a-z0-9]([a-z0-9-]{0,62}[a-z0-9])?$"
GREATEST_SCORE = 5


def new_identities(messages: DataFrame, known: DataFrame, key: tuple[str, ...] = ("workspace_id", "channel", "contact_id")) -> DataFrame:
    """Identities that messages name and ``known`` lacks, with their first message."""
    return messages.groupBy(*key).agg(F.min("id").alias("first_id")).join(known.select(*key).distinct(), list(key), "left_anti")


def split_at_close(messages: DataFrame) -> DataFrame:
    """Messages with ``session``: a new one after each message that closes the conversation."""
    before = Window.partitionBy("contact_id").orderBy("created_at", "id").rowsBetween(Window.unboundedPreceding, -1)
    closed = F.sum((F.col("event_type") == "purchase").cast("int")).over(before)
    return messages.withColumn("session", F.coalesce(closed, F.lit(0)))


def fold_escalations(events: DataFrame) -> DataFrame:
    """State of each conversation after its events (``conversation_id, at, id, action, actor``), in order.

    Escalating is idempotent while one is open, the first take wins, resolving
    gives the conversation back to the bot, closing ends it. The fold is an
    aggregation: what matters are the last ends and what follows them.
    """
    ends = F.col("action").isin("resolve", "close")
    order = F.struct("at", "id")
    last_end = F.max(F.when(ends, order)).over(Window.partitionBy("conversation_id"))
    fresh = events.withColumn("last_end", last_end).withColumn("live", F.col("last_end").isNull() | (order > F.col("last_end")))
    opened = F.min(F.when(F.col("live") & (F.col("action") == "escalate"), order)).over(Window.partitionBy("conversation_id"))
    fresh = fresh.withColumn("opened", opened)
    takes = F.col("live") & (F.col("action") == "take") & (order > F.col("opened"))
    folded = fresh.groupBy("conversation_id").agg(
        F.max_by(F.when(ends, F.col("action")), F.when(ends, order)).alias("ended"),
        F.min(F.when(F.col("live") & (F.col("action") == "escalate"), order)).alias("escalated"),
        F.min_by(F.when(takes, F.col("actor")), F.when(takes, order)).alias("first"),
    )
    first = F.col("first")
    state = F.when(F.col("escalated").isNotNull() & first.isNotNull(), "taken").when(F.col("escalated").isNotNull(), "waiting").when(F.col("ended") == "close", "closed").otherwise("bot")
    return folded.select("conversation_id", state.alias("state"), F.when(F.col("escalated").isNotNull(), first).alias("taken_by"))


def resolve_merges(merges: DataFrame, rounds: int = 40) -> DataFrame:
    """``contact_id, final_id`` along ``merged_into`` to the end, by doubling: each round a contact takes its target's target."""
    links = merges.select(F.col("contact_id"), F.col("merged_into").alias("final_id"))
    for _ in range(rounds):
        on = links.select(F.col("contact_id").alias("final_id"), F.col("final_id").alias("next_id"))
        jumped = links.join(on, "final_id", "left").select("contact_id", F.coalesce("next_id", "final_id").alias("final_id"), F.col("next_id").isNotNull().alias("moved")).checkpoint()
        links = jumped.drop("moved")
        if jumped.where("moved").isEmpty():
            return links
    raise ValueError("merged_into has a cycle")


def rewrite_contacts(rows: DataFrame, resolved: DataFrame) -> DataFrame:
    """Rows with merged contacts replaced by those that took them over."""
    return rows.join(resolved, "contact_id", "left").withColumn("contact_id", F.coalesce("final_id", "contact_id")).drop("final_id")


def latest_ratings(ratings: DataFrame) -> DataFrame:
    """The last valid rating (1 to 5) of each message."""
    valid = ratings.where(F.col("score").between(1, GREATEST_SCORE))
    return valid.groupBy("message_id").agg(F.max_by("score", F.struct("at", "id")).alias("score"))


def migrate_scale(score: Column, back: bool = False) -> Column:
    """Thumbs to stars (1 to 5, -1 to 1), or stars to thumbs (4 and more up, else down)."""
    return F.when(score >= 4, 1).otherwise(-1) if back else F.when(score == 1, 5).when(score == -1, 1).otherwise(score)


def delete_documents(documents: DataFrame, chunks: DataFrame, doomed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents and chunks that stay; ``doomed`` names ``document_id, workspace``, so that another tenant's stay too."""
    key = ["document_id", "workspace"]
    return documents.join(doomed, key, "left_anti"), chunks.join(doomed, key, "left_anti")


def merge_flags(settings: DataFrame, changes: DataFrame) -> DataFrame:
    """Flags (``workspace_id, flag, enabled``) after changes; ``kb_only`` stays on."""
    changed = changes.select("workspace_id", "flag", F.col("enabled").alias("changed"))
    merged = settings.join(changed, ["workspace_id", "flag"], "full_outer")
    return merged.select("workspace_id", "flag", F.when(F.col("flag") == "kb_only", True).otherwise(F.coalesce("changed", "enabled")).alias("enabled"))


def new_workspaces(requested: DataFrame, existing: DataFrame) -> DataFrame:
    """Requests with a valid slug that is free; of several for one slug the first."""
    valid = requested.where(F.col("slug").rlike(SLUG)).groupBy("slug").agg(F.min_by("name", "id").alias("name"))
    return valid.join(existing.select("slug"), "slug", "left_anti")


def reply_channels(messages: DataFrame) -> DataFrame:
    """Where an operator's reply goes: the channel of the client's last message."""
    return messages.where("role = 'user'").groupBy("conversation_id").agg(F.max_by("channel", "id").alias("channel"), F.max("id").alias("answer_to"))


def owned_ratings(ratings: DataFrame, messages: DataFrame) -> DataFrame:
    """Ratings by contacts who own the rated message's conversation."""
    owner = messages.select(F.col("id").alias("message_id"), F.col("contact_id").alias("owner_id"))
    return ratings.join(owner, "message_id").where("contact_id = owner_id").drop("owner_id")


def take_tokens(events: DataFrame, ttl_seconds: int = 900) -> DataFrame:
    """Takes of one-shot tokens (``token, action, at, id``) with ``ok``: the first take within the time to live after its issue."""
    issued = events.where("action = 'issue'").groupBy("token").agg(F.min("at").alias("issued"))
    takes = events.where("action = 'take'").join(issued, "token", "left").where("issued IS NULL OR at >= issued")
    first = F.row_number().over(Window.partitionBy("token").orderBy("at", "id")) == 1
    inside = F.col("at").cast("timestamp") < F.col("issued").cast("timestamp") + F.make_dt_interval(secs=F.lit(ttl_seconds))
    return takes.select("token", "id", F.coalesce(first & inside, F.lit(False)).alias("ok"))


def resolve_workspace(argument: Column, header: Column, default: Column) -> Column:
    return F.coalesce(F.nullif(argument, F.lit("")), F.nullif(header, F.lit("")), default)


def cache_outcomes(asked: DataFrame, seconds: int = 86_400) -> DataFrame:
    """``key, id, outcome`` of each question of ``asked`` (``key, id, at``) to a cache whose entries live ``seconds`` from when they were stored.

    ``miss`` stores the first entry of a key, ``expired`` a new one after it has
    gone, ``hit`` finds one and doesn't lengthen its life. A null key is never stored and has no row.
    """
    first = asked.groupBy("key").agg(F.min(F.struct(F.unix_micros(F.col("at").cast("timestamp")).alias("at"), "id"))["id"].alias("first_id"))
    within = anchored_window_hits(asked, 0, seconds).join(first, "key")
    outcome = F.when(F.col("used") > 1, "hit").when(F.col("id") == F.col("first_id"), "miss").otherwise("expired")
    return within.select("key", "id", outcome.alias("outcome"))


def anchored_window_hits(hits: DataFrame, limit: int = 20, seconds: int = 60) -> DataFrame:
    """Rate limit with windows that start at a key's first hit: ``key, id, used, allowed``.

    Where a window starts depends on the one before, so each key's hits are
    folded in order. They stream past sorted, and a key of any number of hits
    takes no more memory than its current window.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, start, used = None, 0, 0
        for batch in batches:
            out = []
            for own, at in zip(batch.column("key").to_pylist(), batch.column("micros").to_pylist()):
                if own != key or at - start >= seconds * 1_000_000:
                    key, start, used = own, at, 0
                used += 1
                out.append(used)
            allowed = pa.array([limit <= 0 or u <= limit for u in out])
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("id"), pa.array(out, pa.int32()), allowed], names=["key", "id", "used", "allowed"])

    rows = hits.select("key", "id", F.unix_micros(F.col("at").cast("timestamp")).alias("micros")).where("key IS NOT NULL")
    return rows.repartition("key").sortWithinPartitions("key", "micros", "id").mapInArrow(fold, "key string, id long, used int, allowed boolean")


def trim_history(turns: Column, last: int = 10, budget: int = 1500) -> Column:
    """Of the last turns, newest first, those whose stripped text fits in the characters left; a longer one is skipped
    and costs nothing. Turns with a null or blank text go."""
    newest = F.reverse(F.slice(turns, F.greatest(F.size(turns) - last + 1, F.lit(1)), F.lit(last)))
    newest = F.transform(newest, lambda t: t.withField("text", F.regexp_replace(t["text"], r"(?U)^\s+|\s+$", "")))
    start = F.struct(F.lit(budget).alias("left"), F.slice(newest, F.lit(1), F.lit(0)).alias("kept"))

    def step(acc: Column, turn: Column) -> Column:
        fits = F.length(turn["text"]).between(1, acc["left"])
        return F.struct(
            F.when(fits, acc["left"] - F.length(turn["text"])).otherwise(acc["left"]).alias("left"), F.when(fits, F.concat(F.array(turn), acc["kept"])).otherwise(acc["kept"]).alias("kept")
        )

    return F.aggregate(newest, start, step)["kept"]
