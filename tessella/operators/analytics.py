"""Dialog analytics: figures of a period, daily series, breakdowns.

Periods are half open, ``since <= t < until``, where both bounds are given;
windows that look back from now take ``t > since`` and have no upper bound.
Counts are combined before their shuffle; joins are on keys of facts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.rules import mask

MINUTES_PER_DIALOG = 4.5
PREFIX = 60


def moment(text: str) -> Column:
    return F.to_timestamp_ntz(F.lit(text))


def in_period(column: str, since: str, until: str) -> Column:
    return (F.col(column) >= moment(since)) & (F.col(column) < moment(until))


def percent(part: Column, whole: Column) -> Column:
    """Half-even rounded percentage; 0 of nothing."""
    return F.coalesce(F.bround(F.try_divide(part * 100.0, whole)), F.lit(0)).cast("int")


def _resolved_alone(threads: DataFrame, escalations: DataFrame) -> DataFrame:
    """Threads with ``by_bot``: never escalated, not even after the period."""
    ever = escalations.select(F.col("conversation_id").alias("escalated_id")).distinct()
    joined = threads.join(ever, threads["conversation_id"] == ever["escalated_id"], "left")
    return joined.withColumn("by_bot", F.col("escalated_id").isNull()).drop("escalated_id")


def outcomes(threads: DataFrame, escalations: DataFrame, since: str, until: str) -> DataFrame:
    """Dialogs of the period: all, settled by the bot, by operators, the bot's share and the hours it saved."""
    counted = _resolved_alone(threads.where(in_period("started_at", since, until)), escalations).agg(F.count("*").alias("total"), F.count_if("by_bot").alias("by_bot"))
    return counted.select(
        "total", "by_bot", (F.col("total") - F.col("by_bot")).alias("by_operator"), percent(F.col("by_bot"), F.col("total")).alias("bot_share"),
        F.bround(F.col("by_bot") * MINUTES_PER_DIALOG / 60, 1).alias("hours_saved"),
    )


def latency_quantile(messages: DataFrame, share: float, since: str, until: str | None = None) -> DataFrame:
    """Continuous quantile of answer latencies, whole milliseconds; null without answers."""
    inside = in_period("created_at", since, until) if until else F.col("created_at") > moment(since)
    answers = messages.where(inside & (F.col("role") == "assistant") & F.col("latency_ms").isNotNull())
    return answers.agg(F.percentile("latency_ms", share).cast("int").alias("latency_ms"))


def first_messages(messages: DataFrame) -> DataFrame:
    """First message of each conversation: channel and time."""
    return messages.groupBy("conversation_id").agg(F.min_by(F.struct("channel", "created_at"), "id").alias("first")).select("conversation_id", "first.channel", "first.created_at")


def by_channel(messages: DataFrame, since: str, until: str) -> DataFrame:
    """Conversations per channel of their first message, which must lie in the period; with shares of all."""
    counted = first_messages(messages).where(in_period("created_at", since, until)).groupBy("channel").agg(F.count("*").alias("conversations"))
    return counted.withColumn("share", percent(F.col("conversations"), F.sum("conversations").over(Window.partitionBy())))


def top_questions(messages: DataFrame, n: int = 10) -> DataFrame:
    """Most frequent user texts, masked, by their first 60 characters; ties by text."""
    asked = messages.where("role = 'user'").groupBy(F.left(mask(F.col("text")), F.lit(PREFIX)).alias("question")).agg(F.count("*").alias("n"))
    return asked.orderBy(F.desc("n"), "question").limit(n)


def rating_summary(ratings: DataFrame, since: str, until: str) -> DataFrame:
    rated = ratings.where(in_period("created_at", since, until))
    return rated.agg(F.count("*").alias("n"), F.avg("score").cast("decimal(3,1)").cast("double").alias("average"))


def escalations_by_reason(escalations: DataFrame, threads: DataFrame, reason: str, since: str, until: str) -> DataFrame:
    """Escalations of a reason by their own date, tenant taken from the conversation."""
    found = escalations.where((F.col("reason") == reason) & in_period("created_at", since, until)).drop("workspace_id")
    return found.join(threads.select("conversation_id", "workspace_id"), "conversation_id").groupBy("workspace_id").agg(F.count("*").alias("n"))


def calendar(now: str, days: int) -> DataFrame:
    from pyspark.sql import SparkSession

    spark = SparkSession.active()
    day = F.to_date(moment(now))
    return spark.range(1).select(F.explode(F.sequence(F.date_sub(day, days - 1), day)).alias("day"))


def daily_outcomes(threads: DataFrame, escalations: DataFrame, now: str, days: int = 7) -> DataFrame:
    """Dialogs and those settled by the bot for each day to now, quiet days as zero.

    Grouped by day before the calendar joins it, so that the join is on equal
    days of a few rows and not on ranges of all.
    """
    day = F.to_date("started_at")
    since = F.date_sub(F.to_date(moment(now)), days - 1)
    facts = _resolved_alone(threads.where((day >= since) & (day <= F.to_date(moment(now)))), escalations)
    grouped = facts.groupBy(day.alias("day")).agg(F.count("*").alias("total"), F.count_if("by_bot").alias("by_bot"))
    return calendar(now, days).join(grouped, "day", "left").select(F.col("day").cast("string").alias("day"), F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("by_bot", F.lit(0)).alias("by_bot"))


def daily_answers(messages: DataFrame, now: str, days: int = 7) -> DataFrame:
    """Answers, answers with citations and median latency for each day to now."""
    day = F.to_date("created_at")
    since = F.date_sub(F.to_date(moment(now)), days - 1)
    facts = messages.where((F.col("role") == "assistant") & (day >= since) & (day <= F.to_date(moment(now))))
    grouped = facts.groupBy(day.alias("day")).agg(F.count("*").alias("answers"), F.count_if(F.size("chunks_used") > 0).alias("cited"), F.percentile("latency_ms", 0.5).cast("int").alias("median_ms"))
    return calendar(now, days).join(grouped, "day", "left").select(F.col("day").cast("string").alias("day"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("answers", "cited", "median_ms")])


def with_citations(messages: DataFrame) -> DataFrame:
    """Stand-in for cited chunks: null, none or two by ``k``."""
    k = F.col("k")
    return messages.withColumn("chunks_used", F.when(k % 3 == 1, F.array().cast("array<int>")).when(k % 3 == 2, F.array(k, k + 1)))


def cited_share(messages: DataFrame, since: str) -> DataFrame:
    answers = messages.where((F.col("role") == "assistant") & (F.col("created_at") > moment(since)))
    counted = answers.agg(F.count("*").alias("answers"), F.count_if(F.size("chunks_used") > 0).alias("cited"))
    return counted.withColumn("share", percent(F.col("cited"), F.col("answers")))


def richest_conversation(messages: DataFrame) -> DataFrame:
    """Conversation over the most channels, the latest of them."""
    counted = messages.groupBy("conversation_id").agg(F.count_distinct("channel").alias("channels"), F.max("id").alias("last_id"))
    return counted.orderBy(F.desc("channels"), F.desc("last_id")).limit(1)


def inbox_state() -> Column:
    return F.when(F.col("resolved_at").isNotNull(), "resolved").when(F.col("taken_at").isNotNull(), "active").otherwise("waiting")


def inbox_counters(escalations: DataFrame) -> DataFrame:
    return escalations.groupBy("workspace_id").agg(F.count_if(inbox_state() == "waiting").alias("waiting"), F.count_if(inbox_state() == "active").alias("active"))


def nearest_rank(values: DataFrame, key: str, value: str, share: float) -> DataFrame:
    """Percentile by index ``int(n * share)`` of the sorted values, with median and worst.

    Equal values are counted before the shuffle, and running sums go over the
    different values only, so that a key of very many rows costs no more.
    """
    counted = values.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("times"))
    mine = Window.partitionBy(key)
    placed = counted.withColumns({"upto": F.sum("times").over(mine.orderBy(value)), "n": F.sum("times").over(mine)})
    rank = lambda p: F.min(F.when(F.col("upto") > F.least((F.col("n") * p).cast("long"), F.col("n") - 1), F.col(value)))
    return placed.groupBy(key).agg(rank(0.5).alias("median"), rank(share).alias("high"), F.max(value).alias("worst"))


def site_rollup(documents: DataFrame) -> DataFrame:
    """Documents by host: chunks and progress summed, the status that matters most first (``host, chunks, done, total, status``)."""
    s = F.col("status")
    rolled = documents.groupBy("host").agg(
        F.count("*").alias("documents"), F.sum("chunks").alias("chunks"), F.sum("done").alias("done"), F.sum("total").alias("total"),
        F.when(F.bool_or(s.isin("queued", "indexing")), "in_progress").when(F.bool_or(s == "failed"), "failed").otherwise("ready").alias("status"),
    )
    return rolled.withColumn("progress", percent(F.col("done"), F.col("total")))


def channel_cards(messages: DataFrame, settings: DataFrame, since: str) -> DataFrame:
    """One card per configured channel: conversations since, and a state by precedence: off, unknown, wait, live."""
    recent = first_messages(messages).where(F.col("created_at") > moment(since)).groupBy("channel").agg(F.count("*").alias("conversations"))
    state = F.when(~F.col("configured"), "off").when(F.col("hook").isNull(), "unknown").when(F.col("error").isNotNull() | (F.col("hook") == ""), "wait").otherwise("live")
    return settings.join(recent, "channel", "left").select("channel", F.coalesce("conversations", F.lit(0)).alias("conversations"), state.alias("state"))


def health(checks: DataFrame) -> DataFrame:
    """Roll-up of checks (``name, critical, ok``): fail if a critical one is broken, degraded if any other."""
    bad = ~F.col("ok")
    return checks.agg(
        F.when(F.bool_or(bad & F.col("critical")), "fail").when(F.bool_or(bad), "degraded").otherwise("ok").alias("status"),
        F.array_join(F.sort_array(F.collect_list(F.when(bad, F.col("name")))), ",").alias("broken"),
    )
