"""The way of clients' messages: commands, an operator's silence, wishes, small talk, search, answer, repeats; and what is saved of it.

What a message would do by itself is decided for all rows at once. The one thing
that depends on what came before, a conversation that is with an operator from
its first escalation on, is then a minimum for each conversation, so that no
conversation is walked message by message. Only the guard against repeated
answers looks at rows before, and at no more than ``HISTORY`` of those that the
first escalation leaves.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import text as x
from tessella.functions.rules import mask
from tessella.session import shared_folder

#: Pairs of question and answer that the guard against repeats looks back on.
HISTORY = 5
#: Shorter answers may be given again.
REPEATABLE = 80
#: Routes after which an operator has the conversation.
ESCALATING = ("operator", "no_answer", "unsure", "repeat")
#: Commands of a messenger; they are neither saved nor held back by an operator.
COMMANDS = ("non_text", "start", "report", "report_denied")

Finder = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Outcome:
    """Tables of one batch of messages; all come from one written table of decisions.

    ``decisions``: ``id, conversation_id, channel, external_id, text, text_masked, route, reason, reply, chunk_ids, argument``, a row
    for each incoming row. ``route`` is one of ``COMMANDS``, ``silent``, ``operator``, ``smalltalk``, ``no_answer``,
    ``unsure``, ``repeat``, ``answer``; ``argument`` what follows a command.
    """

    decisions: DataFrame

    @property
    def replies(self) -> DataFrame:
        """``id, channel, external_id, text`` of what is sent; nothing while an operator has the conversation."""
        return self.decisions.where("route <> 'silent'").select("id", "channel", "external_id", F.col("reply").alias("text"))

    @property
    def messages(self) -> DataFrame:
        """``conversation_id, answer_to, role, text, text_masked, chunk_ids`` to append: each message that is no command, and its reply."""
        saved = self.decisions.where(~F.col("route").isin(*COMMANDS))
        none = F.array().cast("array<long>")
        both = saved.withColumn("role", F.explode(F.when(F.col("route") == "silent", F.array(F.lit("user"))).otherwise(F.array(F.lit("user"), F.lit("assistant")))))
        of = lambda asked, sent: F.when(F.col("role") == "user", asked).otherwise(sent)
        text, masked, chunks = of(F.col("text"), F.col("reply")), of(F.col("text_masked"), mask(F.col("reply"))), of(none, F.coalesce("chunk_ids", none))
        return both.select("conversation_id", F.col("id").alias("answer_to"), "role", text.alias("text"), masked.alias("text_masked"), chunks.alias("chunk_ids"))

    @property
    def escalations(self) -> DataFrame:
        """``conversation_id, message_id, reason``: one for each conversation that goes to an operator in this batch."""
        return self.decisions.where(F.col("route").isin(*ESCALATING)).select("conversation_id", F.col("id").alias("message_id"), "reason")

    @property
    def audit(self) -> DataFrame:
        """``id, event, payload`` (JSON): calls of the model whose answer was used, and escalations."""
        call = F.when(
            F.col("route").isin("answer", "unsure"),
            F.struct(F.lit("llm_call").alias("event"), F.to_json(F.struct(F.col("text_masked").alias("question"), "chunk_ids", (F.col("route") == "unsure").alias("escalated"))).alias("payload")),
        )
        handed = F.when(F.col("route").isin(*ESCALATING), F.struct(F.lit("escalation").alias("event"), F.to_json(F.struct("conversation_id", "reason")).alias("payload")))
        return self.decisions.select("id", F.inline(F.array_compact(F.array(call, handed))))

    @property
    def links(self) -> DataFrame:
        """``id, external_id, token`` of messenger accounts that come with a one-time token."""
        return self.decisions.where("route = 'start' AND argument <> ''").select("id", "external_id", F.col("argument").alias("token"))


def _command(owner: Column) -> Column:
    """Route of a messenger's command, or null."""
    text = F.col("text")
    command = F.when(text.isNull(), "non_text").when(text.startswith("/start"), "start")
    command = command.when(text.startswith("/report"), F.when(owner, "report").otherwise("report_denied")).when(owner & x.is_report_request(text), "report")
    return F.when(F.col("channel") == "telegram", command)


def _flat(text: Column) -> Column:
    return F.when(F.length(x.normalize(text)) >= REPEATABLE, x.normalize(text))


def handle_messages(
    incoming: DataFrame, held: DataFrame, owners: DataFrame, find: Finder, answer: Callable[[Column, Column], Column], canned: Mapping[str, str], cite: bool = True
) -> Outcome:
    """What becomes of ``incoming`` (``id, conversation_id, channel, external_id, text``), a batch in the order of ``id``.

    ``held`` has the ``conversation_id`` that are with an operator already, ``owners`` the ``external_id`` that may ask for reports.
    ``find(query_id, question)`` gives ``query_id, chunk_ids, context`` for questions that have an answer, and no row for
    others. ``answer(question, context)`` is the model: its text may have the marker, which hands the conversation over.
    ``canned`` has the reply of each route without a text of its own (null where it has none); without ``cite`` citations
    are cut and no chunks are kept.

    A null text on a channel without commands is an empty question, which nothing answers. Repeated ids are each a
    message of its own; the order of messages with one id is open, but none comes after another. Rows with a null
    ``conversation_id`` belong to no conversation: none is silent. An empty batch has no rows.
    """
    spark = incoming.sparkSession

    def written(df: DataFrame) -> DataFrame:
        folder = shared_folder(spark)
        df.write.parquet(folder)
        return spark.read.schema(df.schema).parquet(folder)

    is_owner, is_held = owners.select("external_id").distinct().withColumn("owner", F.lit(True)), held.select("conversation_id").distinct().withColumn("held", F.lit(True))
    wish = F.when(x.wants_operator(F.col("text")), "operator").when(x.smalltalk(F.col("text")).isNotNull(), "smalltalk")
    rows = incoming.select("id", "conversation_id", "channel", "external_id", "text", mask(F.coalesce("text", F.lit(""))).alias("text_masked"), wish.alias("wish"))  # where the rows are read, in many tasks
    rows = rows.join(is_owner, "external_id", "left").join(is_held, "conversation_id", "left")
    route = F.coalesce(_command(F.coalesce("owner", F.lit(False))), F.when(F.col("held"), "silent"), "wish")
    rows = written(rows.withColumn("route", route).drop("owner", "held", "wish"))

    found = find(rows.where("route IS NULL").select(F.col("id").alias("query_id"), F.col("text_masked").alias("question")).distinct())
    found = found.select(F.col("query_id").alias("id"), "chunk_ids", "context")
    judged = rows.join(found, "id", "left")
    open_ = F.col("route").isNull()
    raw = F.when(open_ & F.col("context").isNotNull(), answer(F.col("text_masked"), F.col("context")))
    visible, marked = x.parse_answer(F.col("raw"))
    judged = judged.withColumn("raw", raw).withColumn("route", F.coalesce("route", F.when(F.col("raw").isNull(), "no_answer").when(marked, "unsure").otherwise("answer")))
    judged = judged.withColumn("visible", F.when(F.col("route").isin("answer", "unsure"), visible if cite else x.strip_citations(visible)))
    judged = written(judged.drop("raw", "context"))

    def until(df: DataFrame, route: Column) -> DataFrame:
        """First message of each conversation with such a route."""
        return df.where(route & F.col("conversation_id").isNotNull()).groupBy("conversation_id").agg(F.min("id").alias("until"))

    first = until(judged, F.col("route").isin(*ESCALATING))
    live = judged.where(~F.col("route").isin("silent", *COMMANDS)).join(first, "conversation_id", "left").where("until IS NULL OR id <= until")
    before = Window.partitionBy("conversation_id").orderBy("id").rowsBetween(-HISTORY, -1)
    own, same = F.col("flat"), F.col("plain")
    earlier = F.collect_list(F.when(F.col("route") == "answer", F.struct("flat", "plain"))).over(before)
    live = live.where("conversation_id IS NOT NULL").select("id", "conversation_id", "route", _flat(F.col("visible")).alias("flat"), x.normalize(F.col("text_masked")).alias("plain"))
    again = live.withColumn("earlier", earlier).where((F.col("route") == "answer") & F.exists("earlier", lambda e: (e["flat"] == own) & (e["plain"] != same)))
    repeats = again.groupBy("conversation_id").agg(F.min("id").alias("repeated"))

    at = F.least("until", "repeated")
    decided = judged.join(first, "conversation_id", "left").join(repeats, "conversation_id", "left")
    route = F.when(F.col("route").isin(*COMMANDS), F.col("route")).when(F.col("id") > at, "silent").when(F.col("id") == F.col("repeated"), "repeat").otherwise(F.col("route"))
    decided = decided.withColumn("route", route)
    reason = F.when(F.col("route") == "operator", "user_request").when((F.col("route") == "no_answer") & x.pii_topic(F.col("text_masked")), "pii_topic")
    reason = reason.when(F.col("route").isin(*ESCALATING), "no_answer")
    fixed = F.create_map(*[F.lit(v) for pair in canned.items() for v in pair])[F.col("route")] if canned else F.lit(None).cast("string")
    argument = F.when(F.col("route").isin("start", "report"), F.trim(F.regexp_replace("text", "^/(start|report)", "")))
    shown = F.col("route").isin("answer", "unsure")
    return Outcome(written(decided.select(
        "id", "conversation_id", "channel", "external_id", "text", "text_masked", "route", reason.alias("reason"), F.when(shown, F.col("visible")).otherwise(fixed).alias("reply"),
        F.when(shown & F.lit(cite), F.col("chunk_ids")).alias("chunk_ids"), argument.alias("argument"),
    )))
