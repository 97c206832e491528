"""Re-indexing in place: of a new snapshot of documents only those that have changed are cut into chunks again.

The index is a table with a row for each document: its id, the hash of its content, the
version that wrote it, its chunks, and whether it is gone. A snapshot is
compared with it by a join on the address and the hash; documents without a change are
neither cut nor written, those that are gone keep a row without chunks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators.chunking import CHUNKS, cut_documents
from tessella.session import shared_folder, written
from tessella.streaming.tables import KeyedTable

SCHEMA = "url string, document_id long, title string, hash string, version long, live boolean, chunks array<struct<ord:int,page:int,text:string>>"


def document_index(spark: SparkSession, path: str, buckets: int = 64) -> KeyedTable:
    """The table of an index below ``path``, new or as it is."""
    return KeyedTable(spark, path, SCHEMA, ["url"], ["version"], buckets)


def content_hash(title, text):
    """Of what a document's chunks are made of."""
    return F.sha1(F.concat_ws("\n", F.coalesce(title, F.lit("")), F.coalesce(text, F.lit(""))))


def pages_of(snapshot: DataFrame) -> DataFrame:
    """``url, title, text, given`` of each address of a snapshot; of several rows of one the least. Only rows of repeated addresses are shuffled with their texts."""
    own = F.col("document_id").cast("long") if "document_id" in snapshot.columns else F.lit(None).cast("long")
    rows = snapshot.where("url IS NOT NULL").select("url", "title", "text", own.alias("given"))
    repeated = written(rows.groupBy("url").count().where("count > 1").select("url"))
    least = rows.join(repeated, "url", "left_semi").groupBy("url").agg(F.min(F.struct("title", "text", "given")).alias("page")).select("url", "page.*")
    return rows.join(repeated, "url", "left_anti").unionByName(least)


def compare(index: DataFrame, pages: DataFrame, whole: bool = True) -> DataFrame:
    """``url, document_id, hash, status`` of each document of either side: added, changed, unchanged, or gone.

    ``pages`` are those of a snapshot (see ``pages_of``), with the id that it gives in ``given`` or null (the start
    document that a site's first page takes over). A document keeps the id it
    has in the index, gone ones that come back too. Where the snapshot isn't
    the ``whole`` site nothing is gone. Of several rows of one address the one
    of the least content counts; a null address is none. Texts are hashed where they are read.
    """
    new = pages.select("url", "given", content_hash(F.col("title"), F.col("text")).alias("new_hash"))
    old = index.select("url", "document_id", F.col("hash").alias("old_hash"), "live")
    both = old.join(new, "url", "full_outer")
    status = (
        F.when(F.col("new_hash").isNull(), F.when(F.lit(whole) & F.col("live"), "gone"))
        .when(F.col("old_hash").isNull() | ~F.col("live"), "added")
        .when(F.col("old_hash") != F.col("new_hash"), "changed")
        .otherwise("unchanged")
    )
    document = F.coalesce("document_id", "given", F.xxhash64("url"))
    return both.select("url", document.alias("document_id"), F.coalesce("new_hash", "old_hash").alias("hash"), status.alias("status")).where("status IS NOT NULL")


def reindex(index: KeyedTable, snapshot: DataFrame, version: int, whole: bool = True) -> DataFrame:
    """Bring ``index`` up to ``snapshot``: ``status, documents, chunks`` that were touched or left. A version that was applied before changes nothing.

    Texts are shuffled once, to meet what is to be done, and not at all where nothing is; they are cut where they arrive.
    """
    if version <= index.commit().batch:
        return index.spark.createDataFrame([], "status string, documents long, chunks long")
    pages = pages_of(snapshot)
    found = written(compare(index.read(), pages, whole))
    todo = found.where("status IN ('added', 'changed')")
    row = lambda df, live, *more: df.select("url", "document_id", "title", "hash", F.lit(version).cast("long").alias("version"), F.lit(live).alias("live"), *more, "status")
    none = F.array().cast(CHUNKS)
    rows = row(found.where("status = 'gone'").withColumn("title", F.lit(None).cast("string")), False, none.alias("chunks"))
    if not todo.isEmpty():
        named = pages.drop("given").join(todo, "url")
        one = F.array(F.struct(F.lit(None).cast("int").alias("page"), F.coalesce("text", F.lit("")).alias("text")))
        cut = cut_documents(named.select("url", "document_id", F.col("title").alias("own_title"), "hash", "status", F.coalesce("title", F.lit("")).alias("title"), one.alias("pages")))
        rows = row(cut.withColumn("title", F.col("own_title")), True, "chunks").unionByName(rows)
    folder = shared_folder(index.spark)
    rows.write.parquet(folder)
    index.apply(None, version, staged=folder)
    rows = index.spark.read.schema(rows.schema).parquet(folder)
    touched = rows.groupBy("status").agg(F.count("*").alias("documents"), F.sum(F.size("chunks")).cast("long").alias("chunks"))
    left = found.where("status = 'unchanged'").groupBy("status").agg(F.count("*").alias("documents"), F.lit(0).cast("long").alias("chunks"))
    return touched.unionByName(left)


def live_chunks(index: KeyedTable) -> DataFrame:
    """``document_id, url, title, ord, page, text`` of the chunks in use."""
    return index.read().where("live").select("document_id", "url", "title", F.inline("chunks"))
