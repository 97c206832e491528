"""Indexes for retrieval: vectors in cells around centres, and a table of postings. Both are written once, appended to, and searched without the chunks.

The vector index is approximate: a question meets the chunks of the cells
nearest to it. How many cells that takes is measured on a sample when the index
is built. The postings give exactly what ``retrieval.text_top`` gives from the texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.text import terms
from tessella.operators.retrieval import BLOCK, PACK, TOP_K, nearest, ranked, text_scores
from tessella.session import written

#: Rows that centres are fitted on, by order of the hash of their ID, and rows of these that measure how many cells a question needs.
SAMPLE, MEASURED = 16_384, 256
#: Cells are about the square root of the rows, this many at most.
MOST_CELLS = 4096
#: Share of the nearest chunks that the cells probed shall hold on the sample.
TARGET = 0.95
#: Postings of a term in a row, and folders that terms are dealt to by hash.
POSTINGS, BUCKETS = 4096, 64
#: Characters of texts, and pairs of a term or a question with a chunk, that a task takes; there are more tasks where there is more.
TASK_CHARS, TASK_PAIRS = 4_000_000, 500_000


def _usable(rows: DataFrame, id_column: str) -> DataFrame:
    return rows.where(F.col("embedding").isNotNull() & F.col(id_column).isNotNull()).select(F.col(id_column).cast("long").alias("id"), F.col("embedding").cast("array<float>").alias("embedding"))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)


def probes_needed(vectors: np.ndarray, centres: np.ndarray, k: int, target: float) -> int:
    """Cells that questions like ``vectors`` must look into to find ``target`` of their ``k`` nearest."""
    x, c = _unit(vectors), _unit(centres)
    near = x @ c.T
    own, asked = near.argmax(axis=1), np.arange(min(MEASURED, len(x)))
    scores = x[asked] @ x.T
    scores[asked, asked] = -np.inf
    best = np.argsort(-scores, axis=1)[:, : min(k, len(x) - 1)]
    place = np.argsort(np.argsort(-near[asked], axis=1), axis=1)
    needed = np.sort(np.take_along_axis(place, own[best], axis=1).ravel()) + 1
    return int(needed[min(len(needed) - 1, int(np.ceil(target * len(needed))) - 1)]) if len(needed) else 1


@dataclass(frozen=True)
class VectorIndex:
    """Packs of chunk vectors by cell, below a folder; ``probes`` is how many cells a question looks into."""

    path: str
    centres: np.ndarray
    probes: int

    def _packed(self, rows: DataFrame, name: str, per_pack: int, cells: int) -> DataFrame:
        """Rows with their nearest cells, packed by cell; a cell with many rows has several packs, dealt by hash."""
        spread = rows.mapInArrow(_near_cells(self.centres, cells), "id long, embedding array<float>, cell int")
        packs = spread.groupBy("cell").agg(F.ceil(F.count("*") / per_pack).cast("int").alias("packs"))  # as many rows as cells
        dealt = spread.join(F.broadcast(packs), "cell").withColumn("pack", F.pmod(F.xxhash64("id"), "packs").cast("int"))
        grouped = dealt.groupBy("cell", "pack").agg(F.collect_list(F.struct("id", "embedding")).alias("r"))
        return grouped.select("cell", F.col("r.id").alias(f"{name}_ids"), F.col("r.embedding").alias(f"{name}_vectors"))

    def append(self, chunks: DataFrame) -> None:
        """Add ``chunks`` (``chunk_id``, ``embedding``), each to the cell of the nearest centre."""
        self._packed(_usable(chunks, "chunk_id"), "pack", PACK, 1).sortWithinPartitions("cell").write.mode("append").parquet(f"{self.path}/packs")

    def top(self, questions: DataFrame, k: int = TOP_K, probes: int | None = None) -> DataFrame:
        """``query_id, chunk_id, score, rank`` as ``retrieval.vector_top``, of the chunks in the ``probes`` cells nearest to each question.

        Packs of a cell meet the questions that look into it, in blocks; only the best of each meeting are shuffled.
        With as many probes as cells the result is exact.
        """
        spark = questions.sparkSession
        asked = self._packed(_usable(questions, "query_id"), "block", BLOCK, min(probes or self.probes, len(self.centres)))
        packs = spark.read.schema("cell int, pack_ids array<bigint>, pack_vectors array<array<float>>").parquet(f"{self.path}/packs")
        found = packs.join(asked, "cell").select("block_ids", "block_vectors", "pack_ids", "pack_vectors").mapInArrow(nearest(k), "query_id long, chunk_id long, score double")
        return ranked(found, "score", k)


def _near_cells(centres: np.ndarray, n: int):
    unit = _unit(centres)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("embedding")
            if len(unit) == 1:
                yield batch.append_column("cell", pa.array(np.zeros(len(lists), np.int32)))
                continue
            vectors = _unit(np.asarray(lists.flatten().fill_null(0.0), np.float64).reshape(len(lists), -1)) if len(lists) else np.zeros((0, unit.shape[1]))
            cells = np.argsort(-(vectors @ unit.T), axis=1, kind="stable")[:, :n]
            at = pa.array(np.repeat(np.arange(len(lists)), cells.shape[1]))
            yield pa.RecordBatch.from_arrays([batch.column("id").take(at), lists.take(at), pa.array(cells.ravel().astype(np.int32))], ["id", "embedding", "cell"])

    return near


def build_vector_index(chunks: DataFrame, path: str, cells: int | None = None, target: float = TARGET, k: int = TOP_K) -> VectorIndex:
    """An index of ``chunks`` (``chunk_id``, ``embedding``) below ``path``.

    Centres are fitted on SAMPLE rows; every row with an ID and a vector is in
    the index, in one cell. Vectors have one length. A table without vectors
    gives an index that finds nothing.
    """
    rows = _usable(chunks, "chunk_id")
    count = rows.count()
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select(array_to_vector("embedding").alias("features"), "embedding")
    vectors = np.array([r["embedding"] for r in sample.select("embedding").collect()], np.float64)  # SAMPLE rows at most
    nonzero = sample.where(F.exists("embedding", lambda v: v != 0))  # a cosine needs a direction
    n = min(MOST_CELLS, cells or max(1, round(count**0.5)), max(1, len(vectors) // 4))
    if n > 1:
        centres = np.array(KMeans(k=n, seed=20240229, distanceMeasure="cosine", maxIter=10).fit(nonzero).clusterCenters())
    else:
        centres = np.ones((1, vectors.shape[1] if len(vectors) else 1))
    index = VectorIndex(path, centres, probes_needed(vectors, centres, k, target) if len(vectors) else 1)
    spark = chunks.sparkSession
    spark.createDataFrame([(i, c.tolist(), index.probes) for i, c in enumerate(centres)], "cell int, centre array<double>, probes int").coalesce(1).write.parquet(f"{path}/centres")
    index.append(chunks)
    return index


def open_vector_index(spark: SparkSession, path: str) -> VectorIndex:
    """The index that was built below ``path``."""
    rows = spark.read.parquet(f"{path}/centres").orderBy("cell").collect()  # MOST_CELLS at most
    return VectorIndex(path, np.array([r["centre"] for r in rows]), rows[0]["probes"])


def _parts(size: int, of_a_task: int) -> int:
    return max(1, -(-size // of_a_task))


def _bucket(term: str) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


_POSTING_SCHEMA = "term string, n int, postings array<struct<chunk_id:bigint,tf:bigint>>, batch long, bucket int"


def append_postings(chunks: DataFrame, path: str, batch: int = 0) -> None:
    """Write the postings of ``chunks`` (``chunk_id``, ``text``) as ``batch`` of the index below ``path``; a batch written again replaces itself.

    A row has up to about POSTINGS chunks of one term, ``n`` says how many; a term that more chunks have is dealt to
    several rows by hash, so that no term is collected as a whole.
    """
    texts = chunks.where("chunk_id IS NOT NULL").select(F.col("chunk_id").cast("long").alias("chunk_id"), "text")
    size = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    counts = texts.repartition(_parts(size, TASK_CHARS), "chunk_id").select("chunk_id", F.explode(terms(F.col("text"))).alias("term"))
    counts = written(counts.groupBy("chunk_id", "term").agg(F.count("*").alias("tf")))
    parts = _parts(counts.count(), TASK_PAIRS)
    often = written(counts.groupBy("term").agg(F.ceil(F.count("*") / POSTINGS).cast("int").alias("parts")).where("parts > 1"))  # its size is known to the join, which needn't sort counts
    dealt = counts.join(often, "term", "left").withColumn("part", F.pmod(F.xxhash64("chunk_id"), F.coalesce("parts", F.lit(1))))
    rows = dealt.repartition(parts, "term", "part").groupBy("term", "part").agg(F.sort_array(F.collect_list(F.struct("chunk_id", "tf"))).alias("postings"))
    rows = rows.select("term", F.size("postings").alias("n"), "postings", _bucket("term").alias("bucket")).repartition(min(parts, BUCKETS * 8), "bucket", F.pmod(F.xxhash64("term", "part"), F.lit(8)))
    rows.sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/batch={batch}")


def indexed_text_top(questions: DataFrame, path: str, k: int = TOP_K) -> DataFrame:
    """``query_id, chunk_id, text_score, rank`` as ``retrieval.text_top``, from the postings below ``path``: of the folders of the questions' terms only those rows whose term is asked."""
    asked = questions.select("query_id", F.array_distinct(terms(F.col("question"))).alias("t")).where("size(t) > 0")
    asked = asked.select("query_id", F.size("t").alias("n_terms"), F.explode("t").alias("term")).withColumn("bucket", _bucket("term"))
    postings = questions.sparkSession.read.schema(_POSTING_SCHEMA).parquet(path)
    pairs = postings.join(asked, ["bucket", "term"]).agg(F.sum("n")).first()[0] or 0
    parts = _parts(postings.agg(F.sum("n")).first()[0] or 0, TASK_PAIRS)
    matched = postings.repartition(parts, "bucket", "term").join(asked.repartition(parts, "bucket", "term"), ["bucket", "term"])
    dealt = matched.select("query_id", "n_terms", F.inline("postings")).repartition(_parts(pairs, TASK_PAIRS), "query_id", "chunk_id")
    return ranked(text_scores(dealt), "text_score", k)
