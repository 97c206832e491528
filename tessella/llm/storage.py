"""Where the operators keep intermediate tables and files.

Everything goes to the folder that ``spark.checkpoint.dir`` names, which all
executors share; only where it is unset and Spark runs on one machine (tests) a
folder of the driver's own is made and set.
"""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """A new, unused path below the session's shared folder."""
    base = spark.conf.get(_SETTING, None) or spark.sparkContext.getConf().get(_SETTING) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError(f"set {_SETTING} to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tessella-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/tessella-{uuid.uuid4().hex}"


def materialize(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet to ``path``, or a new one in the shared folder, and read it back.

    Cuts the lineage: a lost executor costs only what read the table, and two
    uses of the result can't see two different evaluations.
    """
    spark = df.sparkSession
    path = path or shared_dir(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Fewer rows in each Arrow batch for the jobs that run inside, as texts may be long; the session's setting comes back."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, min(rows, int(before)) if int(before) > 0 else rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def open_fs(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """File system and path of a URI, for tasks that write or read own file formats."""
    if "://" not in uri and uri.startswith("file:"):
        uri = "file://" + uri.removeprefix("file:")
    return pyarrow.fs.FileSystem.from_uri(uri)


@functools.cache
def _libc() -> ctypes.CDLL | None:
    try:
        return ctypes.CDLL("libc.so.6")
    except OSError:
        return None


_kept: dict[str, dict] = {}


def kept(name: str) -> dict:
    """A table that outlives a task in its Python worker, until a task of another operator ends there."""
    return _kept.setdefault(name, {})


def release_memory(keep: str | None = None) -> None:
    """Give free memory of this process back: Python workers live on after a task, and several wait beside those that work."""
    for name in [n for n in _kept if n != keep]:
        del _kept[name]
    pa.default_memory_pool().release_unused()
    if _libc() and hasattr(_libc(), "malloc_trim"):
        _libc().malloc_trim(0)


Batches = Iterator[pa.RecordBatch]


def lean(function: Callable[[Batches], Batches], keep: str | None = None) -> Callable[[Batches], Batches]:
    """``function`` over the batches of a task, after which the worker is left without its free memory and without tables but ``keep``."""

    @functools.wraps(function)
    def run(batches: Batches) -> Batches:
        try:
            yield from function(batches)
        finally:
            release_memory(keep)

    return run
