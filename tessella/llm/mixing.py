"""Mixing sources to target weights.

Each document gets a hash-random key. Within each source the documents are
ranged by key: the leading hex digits of the key cut each source in buckets of
like size, whose token counts are summed before the shuffle and added up along
the key range, and inside a bucket a running sum orders the documents. Together
that is the prefix sum of every document in its source, without a task that
sees a whole source. A source is taken in whole epochs and then up to the
document, and the token, at which its budget is used up.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in code-point order, repeating.
WEIGHTS = (1, 2, 3)
#: A source gives at most so many times its size.
MAX_EPOCHS = 3
#: Leading hex digits of the key that make a bucket: 4096 for each source.
BUCKET_DIGITS = 3


def _count_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``source, source_size`` with the ``target`` of each source.

    Sources in code-point order, null last, get the weights in turn and share
    the whole size by them. No target exceeds ``max_epochs`` times its source;
    what is above goes to the others by weight until none is above. With
    sources in the order of their caps per weight, the shares settle at the
    largest of the levels (rest of the total) / (rest of the weights).
    One row per source: this is the only step that isn't spread by document.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    place = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    weighted = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (place + 1).cast("int")))
    weighted = weighted.withColumn("cap", F.col("source_size") * max_epochs)
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total, weight = F.sum("source_size").over(everything), F.sum("weight").over(everything)
    left = total - F.coalesce(F.sum("cap").over(before), F.lit(0))
    level = left.cast("double") / (weight - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    levelled = weighted.withColumn("level", level)
    top = F.max("level").over(everything)
    return levelled.select("source", "source_size", F.least(F.col("cap").cast("double"), top * F.col("weight")).alias("target"))


def mix_sources(docs: DataFrame, weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """What the mix takes of each row of ``docs`` (``doc_id``, ``text``, ``source``).

    Returns ``doc_id, source, text_hash, size, source_size, target, taken,
    copies``, a row for each input row. ``taken`` are the words taken, repeats
    counted: of a source the sum is its target rounded to whole words, cut
    inside the document where the budget ends. ``copies`` is the number of
    whole copies that comes nearest. The key is the MD5 of ``doc_id`` (ties:
    ``doc_id``, text hash), so reruns agree. A null text has size 0 and takes 0;
    a null source is a source of its own; equal rows are taken one by one.
    """
    sized = docs.select(
        "doc_id", "source", F.xxhash64(F.coalesce("text", F.lit("\0null"))).alias("text_hash"),
        _count_words(F.col("text")).alias("size"), F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("key"),
    )
    sized = sized.withColumn("bucket", F.substring("key", 1, BUCKET_DIGITS))
    buckets = sized.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    along = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.withColumn("ahead", F.coalesce(F.sum("bucket_size").over(along), F.lit(0)))
    targets = source_targets(buckets.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights, max_epochs)
    whole_words = F.round("target").cast("long")
    plan = targets.select(
        F.col("source").alias("s"), "source_size", "target",
        F.when(F.col("source_size") > 0, F.floor(whole_words / F.col("source_size"))).otherwise(0).cast("long").alias("epochs"),
    ).withColumn("rest", F.round("target").cast("long") - F.col("epochs") * F.col("source_size"))
    buckets = buckets.join(plan, F.col("source").eqNullSafe(F.col("s"))).select(
        F.col("source").alias("bs"), F.col("bucket").alias("bb"), "ahead", "source_size", "target", "epochs", "rest"
    )
    inside = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "text_hash").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.join(buckets, F.col("source").eqNullSafe(F.col("bs")) & (F.col("bucket") == F.col("bb")))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("ahead") - F.col("inside")))
    return placed.select(
        "doc_id", "source", "text_hash", "size", "source_size", "target",
        (F.col("epochs") * F.col("size") + part).cast("long").alias("taken"),
        (F.col("epochs") + F.when((F.col("size") > 0) & (part * 2 >= F.col("size")), 1).otherwise(0)).cast("int").alias("copies"),
    )


def repeat_by_mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``docs`` with each row as often as the mix takes it, to the nearest whole copy; the columns stay, whatever their names.

    Rows of one ``doc_id``, text and source share what the mix takes of them,
    the first ones one copy more where it doesn't divide.
    """

    def keyed(rows: DataFrame, text_hash: Column, *columns: Column) -> DataFrame:
        """Keys without nulls, by which the rows are shuffled once, for the join and for numbering."""
        return rows.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("\0")).alias("k1"), F.coalesce("source", F.lit("\0")).alias("k2"), text_hash.alias("k3"), *columns)

    keys = ["k1", "k2", "k3"]
    taken = keyed(mix_sources(docs, weights, max_epochs), F.col("text_hash"), F.col("copies"))
    taken = taken.groupBy(*keys).agg(F.sum("copies").alias("copies"), F.count("*").alias("rows")).where("copies > 0")
    rows = keyed(docs, F.xxhash64(F.coalesce("text", F.lit("\0null"))), F.struct(*docs.columns).alias("row"))
    joined = rows.join(taken.hint("merge"), keys).withColumn("number", F.row_number().over(Window.partitionBy(*keys).orderBy("rows")))
    own = F.floor(F.col("copies") / F.col("rows")) + (F.col("number") <= F.col("copies") % F.col("rows")).cast("int")
    return joined.select("row", own.cast("int").alias("own")).where("own > 0").select("row", F.explode(F.sequence(F.lit(1), "own"))).select("row.*")
