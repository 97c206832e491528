"""Daily snapshots of a table in a folder, their catalogue, a mirror, and rotation.

A snapshot is a folder ``day=YYYY-MM-DD`` below a root. Its catalogue row, the
number of rows and an order-free digest of their values, is computed from what is
read back, so that a changed, missing or repeated row shows.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEEP_DAYS = 14
_DAY = "_snapshot_day"
_SEPARATOR, _NULL = "\x1f", "\x00"


def row_digest(columns: Sequence[str]) -> Column:
    """52 bits of the MD5 of a row's values as text; null differs from the empty text."""
    values = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(_NULL)) for c in columns]
    return F.conv(F.substring(F.md5(F.concat_ws(_SEPARATOR, *values)), 1, 13), 16, 10).cast("long")


def digest(columns: Sequence[str]) -> Column:
    """Sum of the rows' digests as text: the same in any order, and another if a row occurs twice; empty tables have 0."""
    return F.coalesce(F.sum(row_digest(columns).cast("decimal(38,0)")), F.lit(0)).cast("string")


def _files(spark: SparkSession, root: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def days(spark: SparkSession, root: str) -> list[str]:
    """Days that have a whole snapshot below ``root``, oldest first; a folder for each, so they are few."""
    fs, path = _files(spark, root)
    if not fs.exists(path):
        return []
    parts = [s.getPath() for s in fs.listStatus(path) if s.getPath().getName().startswith("day=")]
    return sorted(p.getName().removeprefix("day=") for p in parts if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def take(df: DataFrame, day: str, root: str) -> None:
    """Write ``df`` as the snapshot of ``day``; one taken again replaces itself. One that stops half way isn't in the catalogue."""
    df.write.mode("overwrite").parquet(f"{root}/day={day}")


def take_days(df: DataFrame, day: Column, root: str) -> None:
    """Write the rows of each ``day`` (text, never null) as its snapshot, all days in one job; each replaces the one before when it is whole."""
    spark, staged = df.sparkSession, f"{root}/.staged-{uuid.uuid4().hex}"
    df.withColumn(_DAY, F.coalesce(day, F.raise_error(F.lit("a row without a day")))).write.partitionBy(_DAY).parquet(staged)
    fs, path = _files(spark, staged)
    for part in [s.getPath() for s in fs.listStatus(path) if s.getPath().getName().startswith(f"{_DAY}=")]:
        target = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/day={part.getName().removeprefix(_DAY + '=')}")
        fs.delete(target, True)
        if not fs.rename(part, target):
            raise OSError(f"{part} could not be moved")
        fs.create(spark._jvm.org.apache.hadoop.fs.Path(target, "_SUCCESS"), True).close()
    fs.delete(path, True)


def _read(spark: SparkSession, root: str, some: Sequence[str]) -> DataFrame:
    """Rows of some days' snapshots, with the day in a column of its own."""
    day = F.regexp_extract(F.col("_metadata.file_path"), "/day=([^/]+)/[^/]+$", 1)
    return spark.read.parquet(*[f"{root}/day={d}" for d in some]).withColumn(_DAY, day)


def catalogue(spark: SparkSession, root: str) -> DataFrame:
    """``day, n, digest`` of the snapshots below ``root``, which must have the same columns."""
    kept = days(spark, root)
    if not kept:
        return spark.createDataFrame([], "day string, n long, digest string")
    rows = _read(spark, root, kept)
    found = rows.groupBy(F.col(_DAY).alias("day")).agg(F.count("*").alias("n"), digest(sorted(c for c in rows.columns if c != _DAY)).alias("digest"))
    every = spark.createDataFrame([(d,) for d in kept], "day string")  # also those of an empty table
    return every.join(found, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("digest", F.lit("0")).alias("digest"))


def rotate(spark: SparkSession, root: str, keep_days: int = KEEP_DAYS) -> list[str]:
    """Remove snapshots that are ``keep_days`` or more older than the newest; which ones."""
    kept = days(spark, root)
    if not kept:
        return []
    old = [r["day"] for r in spark.createDataFrame([(d,) for d in kept], "day string").where(F.datediff(F.lit(kept[-1]).cast("date"), F.col("day").cast("date")) >= keep_days).collect()]
    fs, _ = _files(spark, root)
    for day in old:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/day={day}"), True)
    return sorted(old)


def compare(spark: SparkSession, root: str, mirror: str) -> DataFrame:
    """``day, n, mirrored, same`` of all snapshots on either side; null counts where a side has none."""
    there = catalogue(spark, mirror).select("day", F.col("n").alias("mirrored"), F.col("digest").alias("other"))
    both = catalogue(spark, root).join(there, "day", "full_outer")
    return both.select("day", "n", "mirrored", (F.col("n").eqNullSafe(F.col("mirrored")) & F.col("digest").eqNullSafe(F.col("other"))).alias("same"))


def bring_up(spark: SparkSession, root: str, mirror: str) -> list[str]:
    """Copy to ``mirror`` the snapshots that it lacks or has otherwise, and remove what ``root`` has no more; the days touched."""
    stale = {r["day"]: r["n"] for r in compare(spark, root, mirror).where("NOT same").select("day", "n").collect()}
    full = [day for day, n in stale.items() if n]
    if full:
        rows = _read(spark, root, full)
        take_days(rows, F.col(_DAY), mirror)
    fs, _ = _files(spark, mirror)
    for day, n in stale.items():
        if n is None:
            fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{mirror}/day={day}"), True)
        elif not n:
            take(spark.read.parquet(f"{root}/day={day}"), day, mirror)
    return sorted(stale)
