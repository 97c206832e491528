"""Hybrid retrieval for many questions at once: vectors, full text, rank fusion, decision.

Ranking is exact. Questions and chunks are packed in tables of blocks of bounded
size, which meet in a join; nothing of them passes through the driver, and only
the best of each meeting are shuffled. Texts meet in the same way, as tables of their terms. Wide text joins the hits last.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.text import terms
from tessella.session import written

TOP_K, RETURN_K, RRF_K = 12, 3, 60
COSINE_THRESHOLD, RERANK_THRESHOLD = 0.60, 0.20
RERANKED, RERANK_CHARS = 6, 400
#: Question vectors of a block, and chunk vectors of a pack.
BLOCK, PACK = 1024, 4096
#: Characters of terms of questions in a block, and of chunks in a pack; questions of a block that are scored at a time, and cells of a matrix at most.
BLOCK_CHARS, PACK_CHARS, SLICE, CELLS = 4_000_000, 4_000_000, 2048, 4_000_000
#: Share of the pairs of a meeting from which a term goes into the product of matrices, terms there at most, and pairs of other terms summed up at a time.
DENSE, MOST_DENSE, AT_ONCE = 0.004, 512, 200_000
DIGITS = 6


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two arrays as a built-in expression, rounded."""
    d = lambda c: c.cast("array<double>")
    dot = lambda x, y: F.aggregate(F.zip_with(d(x), d(y), lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    return F.round(dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), DIGITS)


def ranked(hits: DataFrame, score: str, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc(score), "chunk_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _packs(rows: DataFrame, id_column: str, name: str, per_pack: int) -> tuple[DataFrame, int]:
    """Rows with vectors in packs of about ``per_pack``, dealt by hash: ``name`` (number of the pack), ``ids``, ``vectors``; and how many packs."""
    rows = rows.where(F.col("embedding").isNotNull() & F.col(id_column).isNotNull()).select(F.col(id_column).cast("long").alias("id"), "embedding")
    count = max(1, -(-rows.count() // per_pack))
    packed = rows.withColumn(name, F.pmod(F.xxhash64("id"), F.lit(count)).cast("int")).groupBy(name).agg(F.collect_list(F.struct("id", "embedding")).alias("r"))
    return packed.select(name, F.col("r.id").alias(f"{name}_ids"), F.col("r.embedding").alias(f"{name}_vectors")), count


def _unit(vectors: pa.Array) -> np.ndarray:
    """Vectors of a list array as rows of length one."""
    x = np.asarray(vectors.flatten(), np.float64).reshape(len(vectors), -1) if len(vectors) else np.zeros((0, 1))
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)


def nearest(k: int):
    """The ``k`` best chunks of a pack for each question of a block, ties by chunk, a question's own left out."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                query_ids, chunk_ids = (batch.column(f"{n}_ids")[i].values.to_numpy() for n in ("block", "pack"))
                scores = np.round(_unit(batch.column("block_vectors")[i].values) @ _unit(batch.column("pack_vectors")[i].values).T, DIGITS)
                scores[query_ids[:, None] == chunk_ids[None, :]] = -np.inf
                least = -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k] if scores.shape[1] > k else np.full((len(query_ids), 1), -np.inf)
                q, c = np.nonzero((scores >= least) & np.isfinite(scores))
                order = np.lexsort((chunk_ids[c], -scores[q, c], q))
                q, c = q[order], c[order]
                first = np.searchsorted(q, np.arange(len(query_ids)))
                kept = np.arange(len(q)) - first[q] < k
                q, c = q[kept], c[kept]
                yield pa.RecordBatch.from_arrays([pa.array(query_ids[q]), pa.array(chunk_ids[c]), pa.array(scores[q, c])], names=["query_id", "chunk_id", "score"])

    return near


def vector_top(questions: DataFrame, chunks: DataFrame, k: int = TOP_K) -> DataFrame:
    """``query_id, chunk_id, score, rank``: the ``k`` nearest chunks of each question, its own id left out; ties by chunk.

    Each pack of chunks meets each block of questions once: a join on the
    block, whose side of questions Spark broadcasts where its size allows. Only
    the best of each meeting are shuffled.
    """
    blocks, n_blocks = _packs(questions, "query_id", "block", BLOCK)
    packs, _ = _packs(chunks, "chunk_id", "pack", PACK)
    meetings = packs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))).join(blocks, "block")
    found = meetings.select("block_ids", "block_vectors", "pack_ids", "pack_vectors").mapInArrow(nearest(k), "query_id long, chunk_id long, score double")
    return ranked(found, "score", k)


def _bags(rows: DataFrame, id_column: str, text: str, name: str, chars: int) -> tuple[DataFrame, int]:
    """Terms of rows in packs of about ``chars`` of terms, dealt by hash: ``name`` (number of the pack), ``{name}_ids`` in order, ``{name}_terms``, and for each term where its entries start, the rows that have it, how often, and a share;
    and how many packs.

    Rows of one id are in one pack and count as one text; the share is the sum of 1 / (different terms) over its rows that have the term. All but the ids and terms are arrays as bytes, which pass
    to a worker as they are. Texts are cut into terms once, after the joins that made ``rows``: a condition on
    the terms would be taken before them, on texts that they leave out, and once more behind them. They are dealt before that,
    as a join may leave them where they were read, most of them in one task.
    """
    rows = rows.where(F.col(id_column).isNotNull() & F.col(text).isNotNull())
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select(F.col(id_column).cast("long").alias("id"), text, F.xxhash64(id_column).alias("deal")).repartition(tasks, "deal")
    words = written(dealt.select("id", F.array_join(terms(F.col(text)), " ").alias("words")))
    count = max(1, -(-(words.agg(F.sum(F.length("words"))).first()[0] or 0) // chars))
    dealt = words.where("words <> ''").withColumn("pack", F.pmod(F.xxhash64("id"), F.lit(count)).cast("int"))
    return written(dealt.repartitionById(count, "pack").groupBy("pack").applyInArrow(_bag(name), ", ".join([f"{name} int", *(f"{name}_{n} {kind}" for n, kind in _BAG.items())]))), count


_BAG = {"ids": "binary", "terms": "string", "starts": "binary", "rows": "binary", "tf": "binary", "share": "binary"}


def _bag(name: str):
    def bag(table: pa.Table) -> pa.Table:
        ids, row = np.unique(table.column("id").to_numpy(), return_inverse=True)
        words = pc.split_pattern(table.column("words").combine_chunks(), " ")
        coded = words.flatten().dictionary_encode()
        given = np.repeat(np.arange(len(row)), pc.list_value_length(words).to_numpy())
        n = len(row)
        key, times = np.unique(coded.indices.to_numpy().astype(np.int64) * n + given, return_counts=True)  # by term, then by row as given
        term, given = np.divmod(key, n)
        share = 1.0 / np.bincount(given, minlength=n)[given]
        if len(ids) < n:
            key, place = np.unique(term * len(ids) + row[given], return_inverse=True)
            times, share = np.bincount(place, times).astype(np.int64), np.bincount(place, share)
            term, at = np.divmod(key, len(ids))
        else:
            at = row[given]
        starts = np.searchsorted(term, np.arange(len(coded.dictionary) + 1))
        arrays = (ids, starts.astype(np.int32), at.astype(np.int32), times.astype(np.int32), share)
        ids, starts, at, times, share = (pa.array([x.tobytes()], pa.binary()) for x in arrays)
        number = table.column("pack").combine_chunks()[:1]
        return pa.table([number, ids, pa.array([" ".join(coded.dictionary.to_pylist())]), starts, at, times, share], names=[name, *(f"{name}_{n}" for n in _BAG)])

    return bag


def _entries(starts: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the entries of the ``chosen`` terms, and how many each has."""
    count = starts[chosen + 1] - starts[chosen]
    return np.repeat(starts[chosen] - (np.cumsum(count) - count), count) + np.arange(count.sum()), count


def _weights(tf: np.ndarray) -> np.ndarray:
    """0.1 (1 + 1/4 + .. + 1/tf^2)."""
    return (np.cumsum(1.0 / np.arange(1, max(2, tf.max(initial=0) + 1), dtype=np.float64) ** 2) * 0.1)[tf - 1]


def _meet(row: dict) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For at most SLICE questions of a meeting at a time their ids, those of the chunks and the sums of their shared terms; frequent terms by a product of matrices, the others term by term."""
    part = lambda side, name, kind: np.frombuffer(row[f"{side}_{name}"], kind)
    asked, found = part("block", "ids", np.int64), part("pack", "ids", np.int64)
    place = pc.index_in(pa.array(row["block_terms"].split(" ")), pa.array(row["pack_terms"].split(" ")))
    q_term = np.flatnonzero(place.is_valid().to_numpy(zero_copy_only=False))
    c_term = place.drop_null().to_numpy().astype(np.int64)
    c_starts, c_rows, weight = part("pack", "starts", np.int32).astype(np.int64), part("pack", "rows", np.int32), _weights(part("pack", "tf", np.int32))
    starts, rows, shares = part("block", "starts", np.int32), part("block", "rows", np.int32), part("block", "share", np.float64)
    size = max(1, min(SLICE, CELLS // max(1, len(found))))
    for begin in range(0, len(asked), size):
        mine = (rows >= begin) & (rows < begin + size)
        q_starts = np.concatenate([[0], np.cumsum(mine)])[starts]
        scores = _sums(q_starts, rows[mine] - begin, shares[mine], q_term, c_starts, c_rows, weight, c_term, (len(asked[begin : begin + size]), len(found)))
        _, q, c = np.intersect1d(asked[begin : begin + size], found, assume_unique=True, return_indices=True)
        scores[q, c] = 0.0
        yield asked[begin : begin + size], found, scores


def _sums(q_starts, q_rows, share, q_term, c_starts, c_rows, weight, c_term, shape: tuple[int, int]) -> np.ndarray:
    """Sums of share times weight over the terms ``q_term`` of questions, which are ``c_term`` of chunks."""
    pairs = (q_starts[q_term + 1] - q_starts[q_term]) * (c_starts[c_term + 1] - c_starts[c_term])
    q_term, c_term, pairs = q_term[pairs > 0], c_term[pairs > 0], pairs[pairs > 0]
    by_matrix = pairs > DENSE * shape[0] * shape[1]
    if (order := np.argsort(-pairs[by_matrix]))[(most := min(MOST_DENSE, CELLS // max(shape))) :].size:
        by_matrix[np.flatnonzero(by_matrix)[order[most:]]] = False

    def matrix(n: int, starts: np.ndarray, rows: np.ndarray, values: np.ndarray, chosen: np.ndarray) -> np.ndarray:
        at, count = _entries(starts, chosen)
        out = np.zeros((len(chosen), n))
        out[np.repeat(np.arange(len(chosen)), count), rows[at]] = values[at]
        return out

    scores = matrix(shape[0], q_starts, q_rows, share, q_term[by_matrix]).T @ matrix(shape[1], c_starts, c_rows, weight, c_term[by_matrix])
    rest, flat = np.flatnonzero(~by_matrix), scores.reshape(-1)
    for some in np.split(rest, np.flatnonzero(np.diff(np.cumsum(pairs[rest]) // AT_ONCE)) + 1):
        at, count = _entries(q_starts, q_term[some])
        each = np.repeat(c_starts[c_term[some] + 1] - c_starts[c_term[some]], count)  # chunks that each of these entries meets
        first = np.repeat(c_starts[c_term[some]], count)
        c = np.repeat(first - (np.cumsum(each) - each), each) + np.arange(each.sum())
        np.add.at(flat, np.repeat(q_rows[at].astype(np.int64) * shape[1], each) + c_rows[c], np.repeat(share[at], each) * weight[c])
    return scores


def _reaching(scores: np.ndarray, k: int, bound: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Places of the scores that reach the bound for the ``k`` best of their row; only groups of columns whose best reaches it are looked through.

    The bests of the groups are taken in one pass, and the k-th of them is no better than the k-th best.
    """
    n = scores.shape[1]
    width = min(n, max(2 * k, 64))
    whole = n // width * width
    bests = scores[:, :whole].reshape(len(scores), -1, width).max(axis=1)  # column c is in group c % width
    np.maximum(bests[:, : n - whole], scores[:, whole:], out=bests[:, : n - whole])
    least = bound(-np.partition(-bests, k - 1, axis=1)[:, k - 1] if width >= k else np.zeros(len(scores)))
    q, group = np.nonzero(bests >= least[:, None])
    c = group[:, None] + np.arange(0, n, width)
    reach = (c < n) & (scores[q[:, None], np.minimum(c, n - 1)] >= least[q, None])
    return np.repeat(q, reach.sum(axis=1)), c[reach]


def best_by_terms(k: int, least: float):
    """The ``k`` best chunks of a pack for each question of a block by their rounded scores, ties by chunk, a question's own left out; none below ``least``."""
    unit, whole = 10.0**DIGITS, 1.64493406685

    def bound(kth: np.ndarray) -> np.ndarray:
        """Of sums, so low that rounding takes none of the best away; above 0."""
        return np.maximum(np.maximum((np.floor(kth / whole * unit + 0.5) - 0.75) / unit, least - 1 / unit) * whole, 1e-12)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                for asked, chunks, scores in _meet({n: batch.column(n)[i].as_py() for n in batch.schema.names}):
                    q, c = _reaching(scores, k, bound)
                    rounded = np.floor(scores[q, c] / whole * unit + 0.5) / unit
                    enough = rounded >= least
                    q, c, rounded = q[enough], c[enough], rounded[enough]
                    order = np.lexsort((c, -rounded, q))  # ids are in order
                    q, c, rounded = q[order], c[order], rounded[order]
                    kept = np.arange(len(q)) - np.searchsorted(q, np.arange(len(asked)))[q] < k
                    yield pa.RecordBatch.from_arrays([pa.array(asked[q[kept]]), pa.array(chunks[c[kept]]), pa.array(rounded[kept])], names=["query_id", "chunk_id", "text_score"])

    return best


def text_top(questions: DataFrame, chunks: DataFrame, k: int = TOP_K, least: float = 0.0) -> DataFrame:
    """``query_id, chunk_id, text_score, rank`` by the sum over shared terms of 0.1 (1 + 1/4 + .. + 1/tf^2) / (1.644934 terms), of those that have ``least``.

    Each pack of chunks meets each block of questions once, as tables of their terms in a worker, so that pairs that share a term are
    summed up in place and only the best of each meeting are shuffled. A pack is a task, so that none waits for another's.
    """
    sides = (questions, "query_id", "question", "block", BLOCK_CHARS), (chunks, "chunk_id", "text", "pack", PACK_CHARS)
    with ThreadPoolExecutor(2) as pool:  # neither needs the other's tables
        (blocks, _), (packs, count) = pool.map(inheritable_thread_target(questions.sparkSession)(lambda side: _bags(*side)), sides)
    found = packs.repartitionById(count, "pack").drop("pack").crossJoin(blocks.drop("block")).mapInArrow(best_by_terms(k, least), "query_id long, chunk_id long, text_score double")
    return ranked(found, "text_score", k)


def text_scores(matched: DataFrame) -> DataFrame:
    """``query_id, chunk_id, text_score`` over rows of a term that a question (of ``n_terms``) and a chunk (``tf`` times) share."""
    weight = F.aggregate(F.sequence(F.lit(1), F.col("tf").cast("int")), F.lit(0.0), lambda s, j: s + 1.0 / (j * j)) * 0.1
    return matched.where("chunk_id <> query_id").groupBy("query_id", "chunk_id").agg(F.round(F.sum(weight / F.col("n_terms")) / 1.64493406685, DIGITS).alias("text_score"))


def fuse(vector: DataFrame, text: DataFrame) -> DataFrame:
    """Reciprocal rank fusion: a full outer join of the two lists, of which a chunk may miss one. (A union and a sum would
    do, but Spark 4.1 takes a union of two lists by question for one that is dealt by question, and adaptive execution may
    then coalesce its sides differently.)"""
    part = lambda df, name: df.select("query_id", "chunk_id", (1.0 / (RRF_K + F.col("rank"))).alias(name))
    both = part(vector, "v").join(part(text, "t"), ["query_id", "chunk_id"], "full_outer")
    return both.select("query_id", "chunk_id", F.round(F.coalesce("v", F.lit(0.0)) + F.coalesce("t", F.lit(0.0)), 9).alias("rrf"))


def _without(hits: DataFrame, exclude: DataFrame, score: str, k: int) -> DataFrame:
    return ranked(hits.drop("rank").join(exclude, ["query_id", "chunk_id"], "left_anti"), score, k)


Finder = Callable[[DataFrame, int], DataFrame]


def search(
    questions: DataFrame, chunks: DataFrame, return_k: int = RETURN_K, min_score: float = COSINE_THRESHOLD, top_k: int = TOP_K,
    exclude: DataFrame | None = None, by_vector: Finder | None = None, by_text: Finder | None = None,
) -> DataFrame:
    """Hits of each question: ``query_id, chunk_id, document_id, title, score, rrf, place, has_answer``.

    Ordered by fused rank, then cosine, then chunk. The decision compares the
    best cosine of the returned hits with the threshold, never the fused rank.
    ``exclude`` (``query_id, chunk_id``, a few of each question) are no hits.
    ``by_vector`` and ``by_text`` find the nearest of questions in an index (see ``search_index``) instead of in ``chunks``.
    """
    by_vector = by_vector or (lambda q, k: vector_top(q, chunks, k))
    by_text = by_text or (lambda q, k: text_top(q, chunks, k))
    more = 0 if exclude is None else exclude.groupBy("query_id").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    vector_hits, text_hits = by_vector(questions, top_k + more), by_text(questions, top_k + more)
    if more:
        vector_hits, text_hits = _without(vector_hits, exclude, "score", top_k), _without(text_hits, exclude, "text_score", top_k)
    merged = fuse(vector_hits, text_hits)
    wide = merged.join(chunks.select("chunk_id", "document_id", "title", F.col("embedding").alias("c")), "chunk_id").join(questions.select("query_id", F.col("embedding").alias("q")), "query_id")
    scored = wide.select("query_id", "chunk_id", "document_id", "title", cosine(F.col("c"), F.col("q")).alias("score"), "rrf")
    order = Window.partitionBy("query_id").orderBy(F.desc("rrf"), F.desc("score"), "chunk_id")
    hits = scored.withColumn("place", F.row_number().over(order)).where(F.col("place") <= return_k)
    return hits.withColumn("has_answer", F.max("score").over(Window.partitionBy("query_id")) >= min_score)


def more_from_documents(seen: DataFrame, chunks: DataFrame, questions: DataFrame, limit: int = RETURN_K) -> DataFrame:
    """Other chunks of documents that were cited (``query_id, chunk_id``), nearest first, without a threshold."""
    cited = seen.join(chunks.select("chunk_id", "document_id"), "chunk_id").select("query_id", "document_id").distinct()
    others = chunks.select("chunk_id", "document_id", F.col("embedding").alias("c")).join(cited, "document_id").join(seen.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
    scored = others.join(questions.select("query_id", F.col("embedding").alias("q")), "query_id").select("query_id", "chunk_id", "document_id", cosine(F.col("c"), F.col("q")).alias("score"))
    return ranked(scored, "score", limit)


def search_in_context(asked: DataFrame, chunks: DataFrame, seen: DataFrame, return_k: int = RETURN_K, min_score: float = COSINE_THRESHOLD) -> DataFrame:
    """Search as asked; what has no answer but a history is tried once more: ``query_id, stage, chunk_id, place``.

    ``asked`` has ``query_id, question, embedding`` and, where the history gives them, ``topic, topic_embedding`` (of an
    affirmation) or ``standalone, standalone_embedding`` (the question rewritten). An affirmation searches the topic
    without the chunks ``seen`` (stage ``topic``), else goes on in the documents of these (``continued``); any other
    question searches its rewritten form if that is another (``rewritten``). Where that finds nothing either the first
    hits stay (``as_is``). Each stage takes only the questions that the one before left.
    """
    form = lambda df, name: df.select("query_id", F.col(name).alias("question"), F.col(f"{name}_embedding").alias("embedding"))
    hits = lambda df, stage, place="place": df.select("query_id", F.lit(stage).alias("stage"), "chunk_id", F.col(place).alias("place"))
    first = written(search(asked.select("query_id", "question", "embedding"), chunks, return_k, min_score))
    left = asked.join(first.where("has_answer").select("query_id").distinct(), "query_id", "left_anti")
    agreed = form(left.where("topic IS NOT NULL"), "topic")
    by_topic = written(search(agreed, chunks, return_k, min_score, exclude=seen).where("has_answer"))
    unread = agreed.join(by_topic.select("query_id").distinct(), "query_id", "left_anti")
    continued = written(more_from_documents(seen.join(unread.select("query_id"), "query_id", "left_semi"), chunks, unread, return_k))
    changed = F.lower(F.trim("standalone")) != F.lower(F.trim("question"))
    rewritten = written(search(form(left.where("topic IS NULL").where(changed), "standalone"), chunks, return_k, min_score).where("has_answer"))
    stay = first
    for second in (by_topic, continued, rewritten):
        stay = stay.join(second.select("query_id").distinct(), "query_id", "left_anti")
    return hits(by_topic, "topic").unionByName(hits(continued, "continued", "rank")).unionByName(hits(rewritten, "rewritten")).unionByName(hits(stay, "as_is"))


def rerank(hits: DataFrame, scorer, threshold: float = RERANK_THRESHOLD) -> DataFrame:
    """Hits reordered by ``scorer(question, text)``, a column function that may give null.

    The first six hits, their text cut to 400 characters, are scored. Where the
    scorer gives nothing for a question its cosine order and scale stay.
    """
    best = hits.where(F.col("place") <= RERANKED).withColumn("rerank", scorer(F.col("question"), F.substring("text", 1, RERANK_CHARS)))
    mine = Window.partitionBy("query_id")
    best = best.withColumn("works", F.count("rerank").over(mine) > 0).where("rerank IS NOT NULL OR NOT works")
    order = mine.orderBy(F.col("rerank").desc_nulls_last(), "place")
    placed = best.withColumn("place", F.row_number().over(order)).where(F.col("place") <= RETURN_K)
    top = F.max(F.when(F.col("works"), F.col("rerank")).otherwise(F.col("score"))).over(mine)
    return placed.withColumn("has_answer", top >= F.when(F.col("works"), threshold).otherwise(COSINE_THRESHOLD))


def threshold_sweep(cases: DataFrame, thresholds: list[float]) -> DataFrame:
    """Counts of answers at each threshold over ``expect, found, best_score``: invented, false escalations, right answers."""
    at = cases.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds))))
    over = F.col("best_score") >= F.col("threshold")
    answer = (F.col("expect") == "answer") & F.col("found")
    return at.groupBy("threshold").agg(
        F.count_if((F.col("expect") == "escalate") & over).alias("invented"), F.count_if(answer & ~over).alias("false_escalations"), F.count_if(answer & over).alias("answered_right")
    )


def recommend(sweep: DataFrame) -> DataFrame:
    """The threshold without inventions that answers most; the lowest of equals."""
    return sweep.where("invented = 0").orderBy(F.desc("answered_right"), "threshold").limit(1)
