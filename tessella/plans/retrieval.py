"""Queries of retrieval and of its evaluation: benchmark items ask, documents with vectors answer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import retrieval as r
from tessella.operators import search_index as ix
from tessella.plans.registry import query
from tessella.sources import standin as t
from tessella.session import shared_folder
from tessella.sources.standin import with_tables

_TERMS = r"list_filter(regexp_extract_all(lower({c}), '[\p{{L}}\p{{N}}]+'), lambda w: length(w) > 1)"
_COSINE = "round(list_cosine_similarity({a}::DOUBLE[], {b}::DOUBLE[]), 6)"

_QUESTIONS = "SELECT b.item_id AS query_id, b.text AS question, e.embedding AS q FROM benchmark b JOIN embeddings e ON b.item_id = e.vec_id"


def _base(questions: str = _QUESTIONS, exclude: str = "") -> str:
    return with_tables("chunks") + f"""
, questions AS ({questions}),
vec AS (SELECT query_id, chunk_id, {_COSINE.format(a="embedding", b="q")} AS score, row_number() OVER (PARTITION BY query_id ORDER BY {_COSINE.format(a="embedding", b="q")} DESC, chunk_id) AS rank
  FROM questions, chunks WHERE chunk_id <> query_id {exclude} QUALIFY rank <= 12),
asked AS (SELECT query_id, len(list_distinct({_TERMS.format(c="question")})) AS n_terms, unnest(list_distinct({_TERMS.format(c="question")})) AS term FROM questions),
postings AS (SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, unnest({_TERMS.format(c="text")}) AS term FROM chunks) GROUP BY 1, 2),
matched AS (SELECT query_id, chunk_id, round(sum(0.1::DOUBLE * list_sum(list_transform(range(1, tf + 1), lambda j: 1.0::DOUBLE / (j * j))) / n_terms) / 1.64493406685, 6) AS text_score
  FROM postings JOIN asked USING (term) WHERE chunk_id <> query_id {exclude} GROUP BY 1, 2),
txt AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY text_score DESC, chunk_id) AS rank FROM matched QUALIFY rank <= 12),
merged AS (SELECT coalesce(v.query_id, x.query_id) AS query_id, coalesce(v.chunk_id, x.chunk_id) AS chunk_id, round(coalesce(1.0::DOUBLE / (60 + v.rank), 0) + coalesce(1.0::DOUBLE / (60 + x.rank), 0), 9) AS rrf
  FROM vec v FULL OUTER JOIN txt x ON v.query_id = x.query_id AND v.chunk_id = x.chunk_id),
ranked AS (SELECT m.query_id, m.chunk_id, document_id, title, {_COSINE.format(a="embedding", b="q")} AS score, rrf FROM merged m JOIN chunks USING (chunk_id) JOIN questions USING (query_id)),
hits AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, score DESC, chunk_id) AS place FROM ranked QUALIFY place <= 3),
cases AS (SELECT query_id, max(score) AS best_score, CASE WHEN query_id % 3 = 0 THEN 'escalate' ELSE 'answer' END AS expect, bool_or(document_id % 2 = query_id % 2) AS found FROM hits GROUP BY 1)
"""


_BASE = _base()


@query("r01_vector_top", _BASE + "SELECT query_id, chunk_id, score, rank FROM vec")
def vector_top(spark: SparkSession, d: str) -> DataFrame:
    """Also W01, O01 and M01."""
    return r.vector_top(t.questions(spark, d), t.chunks(spark, d))


@query("r02_text_top", _BASE + "SELECT query_id, chunk_id, text_score, rank FROM txt")
def text_top(spark: SparkSession, d: str) -> DataFrame:
    """Also W02, O02, F05, F06 and X10."""
    return r.text_top(t.questions(spark, d), t.chunks(spark, d))


@query("r03_fusion", _BASE + "SELECT query_id, chunk_id, rrf FROM merged")
def fusion(spark: SparkSession, d: str) -> DataFrame:
    """Also J02, U01 and M02."""
    q, c = t.questions(spark, d), t.chunks(spark, d)
    return r.fuse(r.vector_top(q, c), r.text_top(q, c))


@query("r05_search", _BASE + "SELECT query_id, chunk_id, document_id, title, score, rrf, place, max(score) OVER (PARTITION BY query_id) >= 0.6 AS has_answer FROM hits")
def search(spark: SparkSession, d: str) -> DataFrame:
    """Also R04, J01 and O03."""
    return r.search(t.questions(spark, d), t.chunks(spark, d))


@query("o01_vector_index")
def vector_index(spark: SparkSession, d: str) -> DataFrame:
    """Nearest chunks from the index of cells; tests hold their recall against the exact way."""
    return ix.build_vector_index(t.chunks(spark, d), shared_folder(spark)).top(t.questions(spark, d))


@query("o01_index_recall")
def index_recall(spark: SparkSession, d: str) -> DataFrame:
    """Of the exact nearest chunks of all questions those that the index finds, cells looked into and cells there are."""
    q, c = t.questions(spark, d), t.chunks(spark, d)
    index = ix.build_vector_index(c, shared_folder(spark))
    both = r.vector_top(q, c).select("query_id", "chunk_id").join(index.top(q).select("query_id", "chunk_id", F.lit(1).alias("found")), ["query_id", "chunk_id"], "left")
    return both.agg(F.count("*").alias("wanted"), F.count("found").alias("found")).withColumns({"recall": F.col("found") / F.col("wanted"), "probes": F.lit(index.probes), "cells": F.lit(len(index.centres))})


@query("f05_indexed_text", _BASE + "SELECT query_id, chunk_id, text_score, rank FROM txt")
def indexed_text(spark: SparkSession, d: str) -> DataFrame:
    """From postings written in two batches."""
    c, path = t.chunks(spark, d), shared_folder(spark)
    ix.append_postings(c.where("chunk_id % 2 = 0"), path, 0)
    ix.append_postings(c.where("chunk_id % 2 <> 0"), path, 1)
    return ix.indexed_text_top(t.questions(spark, d), path)


@query("r05_indexed_search", _BASE + "SELECT query_id, chunk_id, document_id, title, score, rrf, place, max(score) OVER (PARTITION BY query_id) >= 0.6 AS has_answer FROM hits")
def indexed_search(spark: SparkSession, d: str) -> DataFrame:
    """The whole search on both indexes; as exact as its SQL, as it looks into every cell."""
    q, c, path = t.questions(spark, d), t.chunks(spark, d), shared_folder(spark)
    vectors = ix.build_vector_index(c, f"{path}/vectors")
    ix.append_postings(c, f"{path}/postings")
    return r.search(q, c, by_vector=lambda asked, k: vectors.top(asked, k, probes=len(vectors.centres)), by_text=lambda asked, k: ix.indexed_text_top(asked, f"{path}/postings", k))


@query("a26_best_score", _BASE + "SELECT query_id, coalesce(max(score), 0) AS best_score FROM questions LEFT JOIN hits USING (query_id) GROUP BY 1")
def best_score(spark: SparkSession, d: str) -> DataFrame:
    q = t.questions(spark, d)
    hits = r.search(q, t.chunks(spark, d)).groupBy("query_id").agg(F.max("score").alias("best"))
    return q.select("query_id").join(hits, "query_id", "left").select("query_id", F.coalesce("best", F.lit(0.0)).alias("best_score"))


@query("r07_more_from_documents", _BASE + f"""
, seen AS (SELECT query_id, chunk_id FROM hits), cited AS (SELECT DISTINCT query_id, document_id FROM hits)
SELECT query_id, chunk_id, document_id, {_COSINE.format(a="embedding", b="q")} AS score, row_number() OVER (PARTITION BY query_id ORDER BY {_COSINE.format(a="embedding", b="q")} DESC, chunk_id) AS rank
FROM cited JOIN chunks USING (document_id) JOIN questions USING (query_id) WHERE NOT EXISTS (SELECT 1 FROM seen s WHERE s.query_id = cited.query_id AND s.chunk_id = chunks.chunk_id) QUALIFY rank <= 3""")
def more_from_documents(spark: SparkSession, d: str) -> DataFrame:
    """Also J07."""
    q, c = t.questions(spark, d), t.chunks(spark, d)
    return r.more_from_documents(r.search(q, c).select("query_id", "chunk_id"), c, q)


def _cases(spark: SparkSession, d: str) -> DataFrame:
    hits = r.search(t.questions(spark, d), t.chunks(spark, d), min_score=0.0)
    own = F.col("query_id")
    return hits.groupBy("query_id").agg(F.max("score").alias("best_score"), F.bool_or(F.col("document_id") % 2 == own % 2).alias("found")).withColumn("expect", F.when(own % 3 == 0, "escalate").otherwise("answer"))


@query("a19_recall", _BASE + "SELECT count(*) FILTER (WHERE found) AS found, count(*) AS total FROM cases WHERE expect = 'answer'")
def recall(spark: SparkSession, d: str) -> DataFrame:
    return _cases(spark, d).where("expect = 'answer'").agg(F.count_if("found").alias("found"), F.count("*").alias("total"))


THRESHOLDS = [0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5, 0.6]
_SWEEP = _BASE + f"""
, sweep AS (SELECT threshold, count(*) FILTER (WHERE expect = 'escalate' AND best_score >= threshold) AS invented, count(*) FILTER (WHERE expect = 'answer' AND found AND best_score < threshold) AS false_escalations,
  count(*) FILTER (WHERE expect = 'answer' AND found AND best_score >= threshold) AS answered_right FROM cases, (SELECT unnest({THRESHOLDS}::DOUBLE[]) AS threshold) GROUP BY 1)
"""


@query("a20_threshold_sweep", _SWEEP + "SELECT * FROM sweep")
def sweep(spark: SparkSession, d: str) -> DataFrame:
    """Also R14."""
    return r.threshold_sweep(_cases(spark, d), THRESHOLDS)


@query("a21_recommended_threshold", _SWEEP + "SELECT * FROM sweep WHERE invented = 0 ORDER BY answered_right DESC, threshold LIMIT 1")
def recommended(spark: SparkSession, d: str) -> DataFrame:
    return r.recommend(r.threshold_sweep(_cases(spark, d), THRESHOLDS))


@query("m01_cosine", "SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def cosine(spark: SparkSession, d: str) -> DataFrame:
    e = t.table(spark, d, "embeddings")
    after = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    return e.join(after, "vec_id").select("vec_id", r.cosine(F.col("embedding"), F.col("b")).alias("cosine"))


@query("s14_query_cache", "SELECT left(sha256('model|' || text), 32) AS key, count(*) AS uses, min(item_id) AS first_id FROM benchmark GROUP BY 1")
def query_cache(spark: SparkSession, d: str) -> DataFrame:
    """Also E03: questions with one key are embedded once."""
    return t.table(spark, d, "benchmark").groupBy(F.left(F.sha2(F.concat(F.lit("model|"), "text"), 256), F.lit(32)).alias("key")).agg(F.count("*").alias("uses"), F.min("item_id").alias("first_id"))


@query("r06_rerank")
def rerank(spark: SparkSession, d: str) -> DataFrame:
    """Also S15 and O04: shared terms stand in for the cross-encoder."""
    from tessella.functions.text import terms

    q, c = t.questions(spark, d), t.chunks(spark, d)
    hits = r.search(q, c, return_k=r.RERANKED).join(c.select("chunk_id", "text"), "chunk_id").join(q.select("query_id", "question"), "query_id")
    shared = lambda a, b: F.size(F.array_intersect(terms(a), terms(b))) / F.greatest(F.size(F.array_distinct(terms(a))), F.lit(1))
    return r.rerank(hits, shared).select("query_id", "chunk_id", F.round("rerank", 6).alias("rerank"), "place", "has_answer")


#: A lower threshold than in use, as the test vectors are random.
LOW = 0.32
_OTHER = "SELECT b.item_id AS query_id, o.text AS question, e.embedding AS q FROM benchmark b JOIN benchmark o ON o.item_id = (b.item_id + {step}) % (SELECT count(*) FROM benchmark) JOIN embeddings e ON e.vec_id = o.item_id WHERE b.item_id % 4 {which}"
_SEEN = "seen AS (SELECT item_id AS query_id, item_id + unnest([1, 2, 3]) AS chunk_id FROM benchmark WHERE item_id % 4 = 1)"
_NOT_SEEN = "AND NOT EXISTS (SELECT 1 FROM (SELECT item_id AS s_query, item_id + unnest([1, 2, 3]) AS s_chunk FROM benchmark WHERE item_id % 4 = 1) WHERE s_query = query_id AND s_chunk = chunk_id)"


@query("r08_contextual_search", with_tables("chunks") + f"""
, {_SEEN}, {"all_questions AS (" + _QUESTIONS + ")"},
first AS ({_BASE} SELECT query_id, chunk_id, place, max(score) OVER (PARTITION BY query_id) >= {LOW} AS ok FROM hits),
unresolved AS (SELECT query_id FROM all_questions WHERE query_id NOT IN (SELECT query_id FROM first WHERE ok)),
by_topic AS ({_base(_OTHER.format(step=1, which="= 1"), _NOT_SEEN)} SELECT query_id, chunk_id, place, max(score) OVER (PARTITION BY query_id) >= {LOW} AS ok FROM hits),
topic AS (SELECT * FROM by_topic WHERE ok AND query_id IN (SELECT query_id FROM unresolved)),
unread AS (SELECT * FROM ({_OTHER.format(step=1, which="= 1")}) WHERE query_id IN (SELECT query_id FROM unresolved) AND query_id NOT IN (SELECT query_id FROM topic)),
cited AS (SELECT DISTINCT u.query_id, c.document_id, u.q FROM unread u JOIN seen USING (query_id) JOIN chunks c USING (chunk_id)),
continued AS (
  SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY {_COSINE.format(a="embedding", b="q")} DESC, chunk_id) AS place
  FROM cited JOIN chunks USING (document_id) WHERE (query_id, chunk_id) NOT IN (SELECT query_id, chunk_id FROM seen) QUALIFY place <= 3),
by_form AS ({_base(_OTHER.format(step=2, which="IN (2, 3)"))} SELECT query_id, chunk_id, place, max(score) OVER (PARTITION BY query_id) >= {LOW} AS ok FROM hits),
rewritten AS (SELECT * FROM by_form WHERE ok AND query_id IN (SELECT query_id FROM unresolved)),
second AS (SELECT query_id, 'topic' AS stage, chunk_id, place FROM topic UNION ALL SELECT query_id, 'continued', chunk_id, place FROM continued UNION ALL SELECT query_id, 'rewritten', chunk_id, place FROM rewritten)
SELECT * FROM second UNION ALL SELECT query_id, 'as_is', chunk_id, place FROM first WHERE query_id NOT IN (SELECT query_id FROM second)""")
def contextual_search(spark: SparkSession, d: str) -> DataFrame:
    """Also X45's rule that a question without a history, or that rewriting leaves as it is, is searched once. The next
    item plays an affirmation's topic, the one after next a rewritten question; the three chunks after the item's own
    were seen."""
    q, c = t.questions(spark, d), t.chunks(spark, d)
    count = q.count()
    i = F.col("query_id")
    other = lambda name: q.select(F.col("query_id").alias(f"{name}_id"), F.col("question").alias(name), F.col("embedding").alias(f"{name}_embedding"))
    asked = q.withColumns({"topic_id": F.when(i % 4 == 1, (i + 1) % count), "standalone_id": F.when((i % 4).isin(2, 3), (i + 2) % count)})
    asked = asked.join(other("topic"), "topic_id", "left").join(other("standalone"), "standalone_id", "left")
    seen = q.where(i % 4 == 1).select("query_id", F.explode(F.array(i + 1, i + 2, i + 3)).alias("chunk_id"))
    return r.search_in_context(asked, c, seen, min_score=LOW)
