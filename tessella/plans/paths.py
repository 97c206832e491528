"""Queries of the message path, one for each table that it leaves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import text as x
from tessella.operators import message_path as p
from tessella.operators import retrieval as r
from tessella.plans.registry import query
from tessella.plans.retrieval import _TERMS
from tessella.plans.state import _NORMAL, _SOCIAL, _WANTS
from tessella.plans.texts import _L, _R
from tessella.sources import standin as t
from tessella.sources.standin import with_tables

#: Best text score from which a question has an answer, and hits that an answer may use.
MIN_SCORE, HITS = 0.03, 3
#: Characters of the best fragment that the stand-in for the model reads; no more of it is shuffled.
READ = 300
OWNERS = ("u2", "u4")
CANNED = {
    "non_text": "Пришлите вопрос текстом.", "start": "Здравствуйте!", "report": "Отчёт готовится.", "report_denied": "Отчёты открыты только владельцу.",
    "operator": "Передаю диалог оператору.", "smalltalk": "Рады помочь.", "no_answer": "Ответит оператор.", "repeat": "Позову оператора.",
}
#: Phrases of the rules, dealt to some of the chat's rows, whose own texts are in invented languages.
_DEALT = {0: f"'{x.THANKS[0]}'", 1: "'позовите оператора'", 2: "concat('/start t', conv_id)", 3: "'/report за неделю'", 4: "NULL", 5: "'какой у меня баланс'", 6: "'отчёт за неделю'"}
_TEXT = "CASE (conv_id * 7 + turn) % 23 " + " ".join(f"WHEN {k} THEN {v}" for k, v in _DEALT.items()) + " ELSE text END"
_INCOMING = f"SELECT conv_id * 1000 + turn AS id, conv_id AS conversation_id, CASE conv_id % 2 WHEN 0 THEN 'telegram' ELSE 'widget' END AS channel, concat('u', conv_id % 20) AS external_id, {_TEXT} AS text FROM conversations WHERE role = 'user'"
_COMMANDS = ", ".join(f"'{c}'" for c in p.COMMANDS)
_HANDED = ", ".join(f"'{c}'" for c in p.ESCALATING)
_OWNERS = ", ".join(f"'{o}'" for o in OWNERS)
_REPORT = f"regexp_matches(text, '(?i){x.REPORT_WORDS}')"
_PII = rf"(regexp_matches(t, '(?i){x.PII_ALWAYS}') OR (regexp_matches(t, '(?i){_L}({x.PII_PERSONAL}){_R}') AND regexp_matches(t, '(?i){x.PII_ACCOUNT}')))"

_PATH = with_tables("chunks") + rf"""
, incoming AS ({_INCOMING}),
begun AS (SELECT *, coalesce(text, '') AS t, {_NORMAL} AS plain, external_id IN ({_OWNERS}) AS owner, conversation_id IN (SELECT conv_id FROM conversations WHERE role = 'system') AS held FROM incoming),
ruled AS (SELECT *, CASE WHEN channel = 'telegram' AND text IS NULL THEN 'non_text' WHEN channel = 'telegram' AND starts_with(text, '/start') THEN 'start'
    WHEN channel = 'telegram' AND starts_with(text, '/report') THEN CASE WHEN owner THEN 'report' ELSE 'report_denied' END WHEN channel = 'telegram' AND owner AND {_REPORT} THEN 'report'
    WHEN held THEN 'silent' WHEN coalesce({_WANTS}, false) THEN 'operator' WHEN plain IN ({_SOCIAL}) THEN 'smalltalk' END AS rule FROM begun),
asked AS (SELECT id AS query_id, len(list_distinct({_TERMS.format(c="t")})) AS n_terms, unnest(list_distinct({_TERMS.format(c="t")})) AS term FROM ruled WHERE rule IS NULL),
postings AS (SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, unnest({_TERMS.format(c="text")}) AS term FROM chunks) GROUP BY 1, 2),
matched AS (SELECT query_id, chunk_id, round(sum(0.1::DOUBLE * list_sum(list_transform(range(1, tf + 1), lambda j: 1.0::DOUBLE / (j * j))) / n_terms) / 1.64493406685, 6) AS score
  FROM postings JOIN asked USING (term) WHERE chunk_id <> query_id GROUP BY 1, 2),
best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM matched QUALIFY rank <= {HITS}),
found AS (SELECT query_id AS id, list(chunk_id ORDER BY rank) AS chunk_ids, arg_min(c.text, rank) AS context FROM best JOIN chunks c USING (chunk_id) WHERE score >= {MIN_SCORE} GROUP BY 1),
judged AS (SELECT r.*, chunk_ids, trim(regexp_replace(substr(context, 1, 300) || ' [1]', ' {{2,}}', ' ', 'g')) AS visible,
    coalesce(rule, CASE WHEN context IS NULL THEN 'no_answer' WHEN length(context) < 200 THEN 'unsure' ELSE 'answer' END) AS by_itself FROM ruled r LEFT JOIN found USING (id)),
first AS (SELECT conversation_id, min(id) AS until FROM judged WHERE by_itself IN ({_HANDED}) GROUP BY 1),
live AS (SELECT j.*, CASE WHEN length({_NORMAL.replace("text", "visible")}) >= {p.REPEATABLE} THEN {_NORMAL.replace("text", "visible")} END AS flat, row_number() OVER (PARTITION BY conversation_id ORDER BY id) AS n
  FROM judged j LEFT JOIN first USING (conversation_id) WHERE by_itself NOT IN ('silent', {_COMMANDS}) AND (until IS NULL OR id <= until)),
again AS (SELECT a.conversation_id, min(a.id) AS repeated FROM live a JOIN live b ON a.conversation_id = b.conversation_id AND b.n BETWEEN a.n - {p.HISTORY} AND a.n - 1 AND a.flat = b.flat AND a.plain <> b.plain
  WHERE a.by_itself = 'answer' AND b.by_itself = 'answer' GROUP BY 1),
decided AS (SELECT j.*, CASE WHEN by_itself IN ({_COMMANDS}) THEN by_itself WHEN id > least(until, repeated) THEN 'silent' WHEN id = repeated THEN 'repeat' ELSE by_itself END AS route
  FROM judged j LEFT JOIN first USING (conversation_id) LEFT JOIN again USING (conversation_id)),
path AS (SELECT *, CASE WHEN route = 'operator' THEN 'user_request' WHEN route = 'no_answer' AND {_PII} THEN 'pii_topic' WHEN route IN ({_HANDED}) THEN 'no_answer' END AS reason,
    CASE WHEN route IN ('answer', 'unsure') THEN visible {" ".join(f"WHEN route = '{k}' THEN '{v}'" for k, v in CANNED.items())} END AS reply FROM decided)
"""


def _find(chunks: DataFrame, heads: DataFrame):
    def find(questions: DataFrame) -> DataFrame:
        hits = r.text_top(questions, chunks, HITS, MIN_SCORE)
        hits = hits.join(heads.select("chunk_id", F.col("text").alias("found")), "chunk_id")
        ids = F.transform(F.sort_array(F.collect_list(F.struct("rank", "chunk_id"))), lambda h: h["chunk_id"])
        return hits.groupBy("query_id").agg(ids.alias("chunk_ids"), F.min_by("found", "rank").alias("context"))

    return find


def _answer(question: Column, context: Column) -> Column:
    """Plays the model: the beginning of the best fragment; it isn't sure of a short one."""
    return F.concat(F.substring(context, 1, READ), F.lit(" [1]"), F.when(F.length(context) < 200, x.MARKER).otherwise(""))


def _path(spark: SparkSession, d: str) -> p.Outcome:
    """The chat's client turns as one batch; a system turn plays an operator who has taken the conversation."""
    turns = t.table(spark, d, "conversations")
    incoming = turns.where("role = 'user'").selectExpr(
        "conv_id * 1000 + turn AS id", "conv_id AS conversation_id", "CASE conv_id % 2 WHEN 0 THEN 'telegram' ELSE 'widget' END AS channel", "concat('u', conv_id % 20) AS external_id", f"{_TEXT} AS text"
    )
    held = turns.where("role = 'system'").select(F.col("conv_id").alias("conversation_id"))
    owners = incoming.where(F.col("external_id").isin(*OWNERS)).select("external_id")
    return p.handle_messages(incoming, held, owners, _find(t.chunks(spark, d), t.chunks(spark, d, READ)), _answer, CANNED)


@query("r09_path_replies", _PATH + "SELECT id, channel, external_id, reply AS text FROM path WHERE route <> 'silent'")
def path_replies(spark: SparkSession, d: str) -> DataFrame:
    """What is sent; the whole path behind it, as for the other tables. Its search masks the question; no test question has anything to mask, so that the SQL needn't."""
    return _path(spark, d).replies


@query("r09_path_messages", _PATH + f"""
SELECT conversation_id, id AS answer_to, 'user' AS role, text, '[]' AS chunk_ids FROM path WHERE route NOT IN ({_COMMANDS}) UNION ALL
SELECT conversation_id, id, 'assistant', reply, CASE WHEN route IN ('answer', 'unsure') THEN CAST(chunk_ids AS VARCHAR) ELSE '[]' END FROM path WHERE route NOT IN ('silent', {_COMMANDS})""")
def path_messages(spark: SparkSession, d: str) -> DataFrame:
    """What is appended to the conversations: also what a client writes to an operator, but no commands."""
    return _path(spark, d).messages.select("conversation_id", "answer_to", "role", "text", F.col("chunk_ids").cast("string").alias("chunk_ids"))


@query("r09_path_escalations", _PATH + f"SELECT conversation_id, id AS message_id, reason FROM path WHERE route IN ({_HANDED})")
def path_escalations(spark: SparkSession, d: str) -> DataFrame:
    """Also E13: one for each conversation, however many of its messages would escalate."""
    return _path(spark, d).escalations


@query("r09_path_audit", _PATH + f"""
SELECT id, 'llm_call' AS event, CASE WHEN route = 'unsure' THEN 'true' ELSE 'false' END AS detail, CAST(len(chunk_ids) AS INT) AS n_chunks FROM path WHERE route IN ('answer', 'unsure') UNION ALL
SELECT id, 'escalation', reason, 0 FROM path WHERE route IN ({_HANDED})""")
def path_audit(spark: SparkSession, d: str) -> DataFrame:
    """Also A28: calls of the model with the chunks that it was given, and escalations with their reason."""
    read = lambda name: F.get_json_object("payload", f"$.{name}")
    return _path(spark, d).audit.select("id", "event", F.coalesce(read("escalated"), read("reason")).alias("detail"), F.coalesce(F.size(F.from_json(read("chunk_ids"), "array<long>")), F.lit(0)).alias("n_chunks"))


@query("r16_path_commands", _PATH + f"SELECT id, external_id, route, CASE WHEN route IN ('start', 'report') THEN trim(regexp_replace(text, '^/(start|report)', '')) END AS argument FROM path WHERE route IN ({_COMMANDS})")
def path_commands(spark: SparkSession, d: str) -> DataFrame:
    """A messenger's commands: non-text, start with a token to link, reports for owners and denials for others."""
    return _path(spark, d).decisions.where(F.col("route").isin(*p.COMMANDS)).select("id", "external_id", "route", "argument")
