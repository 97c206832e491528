"""The message path on small batches, and its guard against repeats row by row."""

from pyspark.sql import functions as F

from tessella.operators import message_path as p
from tessella.plans.paths import CANNED
from tessella.sources import standin

INCOMING = "id long, conversation_id long, channel string, external_id string, text string"
STORY = "Вклад открывают в отделении или в приложении, ставка двенадцать процентов годовых, срок от трёх месяцев, досрочно без потери"


def _run(spark, rows, held=(), owners=("boss",), context=None, cite=True):
    """``context`` by question; questions without one have no answer."""
    known = spark.createDataFrame([(q, [7, 8], c) for q, c in (context or {}).items()], "question string, chunk_ids array<long>, context string")
    find = lambda questions: questions.join(known, "question").select("query_id", "chunk_ids", "context")
    return p.handle_messages(
        spark.createDataFrame(rows, INCOMING), spark.createDataFrame([(h,) for h in held], "conversation_id long"), spark.createDataFrame([(o,) for o in owners], "external_id string"),
        find, lambda question, context: context, CANNED, cite,
    )


def _routes(outcome):
    return {r["id"]: r["route"] for r in outcome.decisions.collect()}


def test_first_escalation_silences_the_rest(spark):
    rows = [(1, 1, "widget", "a", "какой процент"), (2, 1, "widget", "a", "позовите оператора"), (3, 1, "widget", "a", "спасибо"), (4, 1, "widget", "a", "позовите оператора"), (5, 2, "widget", "b", "спасибо"), (6, 3, "widget", "c", "какой процент")]
    out = _run(spark, rows, held=[3], context={"какой процент": STORY + " [1]"})
    assert _routes(out) == {1: "answer", 2: "operator", 3: "silent", 4: "silent", 5: "smalltalk", 6: "silent"}
    assert [tuple(r) for r in out.escalations.collect()] == [(1, 2, "user_request")]
    assert {r["id"] for r in out.replies.collect()} == {1, 2, 5}
    saved = [(r["answer_to"], r["role"]) for r in out.messages.collect()]
    assert sorted(saved) == sorted([(i, "user") for i in range(1, 7)] + [(i, "assistant") for i in (1, 2, 5)])
    assert sorted((r["id"], r["event"]) for r in out.audit.collect()) == [(1, "llm_call"), (2, "escalation")]


def test_repeated_answer_calls_an_operator(spark):
    """The same long answer to another question within the last pairs; not to the same question, not if short, not from further back."""
    questions = [f"вопрос {i}" for i in range(8)]
    context = dict.fromkeys(questions, STORY) | {"вопрос 3": "да", "вопрос 4": "да"} | {f"иной {i}": f"{STORY} {i}" for i in range(9)}
    def batch(*texts):  # noqa: E306
        return _routes(_run(spark, [(i, 1, "widget", "a", t) for i, t in enumerate(texts)], context=context))

    assert batch("вопрос 0", "вопрос 1", "спасибо") == {0: "answer", 1: "repeat", 2: "silent"}
    assert set(batch("вопрос 0", "вопрос 0", "вопрос 3", "вопрос 4").values()) == {"answer"}
    far = ["вопрос 0", *(f"иной {i}" for i in range(p.HISTORY)), "вопрос 1"]
    assert set(batch(*far).values()) == {"answer"}
    assert batch(*far[:1], *far[2:])[p.HISTORY] == "repeat"


def test_model_hands_over(spark):
    out = _run(spark, [(1, 1, "widget", "a", "q"), (2, 1, "widget", "a", "q"), (3, None, "widget", "a", "x"), (4, None, "widget", "a", "q")], context={"q": "Не знаю [1] [ESCALATE]."}, cite=False)
    assert _routes(out) == {1: "unsure", 2: "silent", 3: "no_answer", 4: "unsure"}  # without a conversation none is silent
    first = out.decisions.where("id = 1").first()
    assert "[" not in first["reply"] and first["chunk_ids"] is None and first["reason"] == "no_answer"


def test_commands_and_masks(spark):
    rows = [
        (1, 1, "telegram", "a", None), (2, 1, "telegram", "a", "/start  t77 "), (3, 1, "telegram", "a", "/start"), (4, 1, "telegram", "a", "/report"), (5, 2, "telegram", "boss", "/report за вчера"),
        (6, 2, "widget", "boss", "/report"), (7, 2, "widget", "b", None), (8, 3, "widget", "b", "мой номер 992 90 123 45 67"), (9, 9, "telegram", "a", "/start x"),
    ]
    out = _run(spark, rows, held=[9])
    assert _routes(out) == {1: "non_text", 2: "start", 3: "start", 4: "report_denied", 5: "report", 6: "no_answer", 7: "silent", 8: "no_answer", 9: "start"}
    assert sorted(tuple(r) for r in out.links.collect()) == [(2, "a", "t77"), (9, "a", "x")]
    assert out.decisions.where("id = 5").first()["argument"] == "за вчера"
    assert {r["answer_to"] for r in out.messages.collect()} == {6, 7, 8}
    masked = out.messages.where("answer_to = 8 AND role = 'user'").first()
    assert "123" in masked["text"] and "123" not in masked["text_masked"]
    assert out.audit.where(F.col("payload").contains("123")).count() == 0


def test_empty_batch(spark):
    out = _run(spark, [])
    assert [t.count() for t in (out.replies, out.messages, out.escalations, out.audit, out.links)] == [0] * 5


def test_only_what_is_asked_for_is_made(spark):
    """Messages without their masked texts mask no reply; beginnings of chunks are cut before the join that deals them."""
    out = _run(spark, [(1, 1, "widget", "a", "q"), (2, 1, "widget", "a", "спасибо"), (3, 2, "widget", "b", "Спасибо!"), (4, 2, "widget", "b", None)], held=[2], context={"q": STORY})
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" in plan(out.messages) and "regexp_replace" not in plan(out.messages.select("conversation_id", "answer_to", "role", "text", "chunk_ids"))
    assert sorted((m["answer_to"], m["role"], m["text"], m["chunk_ids"]) for m in out.messages.collect()) == [
        (1, "assistant", STORY, [7, 8]), (1, "user", "q", []), (2, "assistant", CANNED["smalltalk"], []), (2, "user", "спасибо", []), (3, "user", "Спасибо!", []), (4, "user", None, [])
    ]
    lines = plan(standin.chunks(spark, "/root/testdata/sf0.001", 20)).splitlines()
    assert min(i for i, line in enumerate(lines) if "substring" in line) > min(i for i, line in enumerate(lines) if "Join" in line)
