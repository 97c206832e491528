"""Tables that a stream keeps up to date by key, so that a batch that runs twice, or stops half way, changes nothing twice.

A table is a folder with data in buckets of the key's hash and a row of commits. A
batch writes new folders for the buckets that it touches and then
one commit file that lists the folders of all buckets and the batch's
number; the file appears by a rename, whole or not at all. What a stopped batch
has written is in no commit, is never read, and ``vacuum`` removes it. A batch whose number isn't above
that of the last commit has run before and is left out.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A commit's file lists so many folders at most.
BUCKETS = 64
#: Bytes of files that a task merges.
TASK_BYTES = 16_000_000
_BUCKET = "bucket_of_key"


@dataclass(frozen=True)
class Commit:
    """What the table consists of: version, number of the last batch, folder of each bucket that has rows."""

    version: int = 0
    batch: int = -1
    folders: dict[str, str] = field(default_factory=dict)


class KeyedTable:
    """A table at ``path`` with one row for each ``key``: the one that ``order`` puts last, ties by the whole row."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: list[str], order: list[str], buckets: int = BUCKETS):
        self.spark, self.path, self.schema, self.key, self.order, self.buckets = spark, path.rstrip("/"), schema, key, order, buckets
        self._jvm = spark._jvm
        self._fs = self._hadoop(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _hadoop(self, path: str) -> Any:
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def commit(self, version: int | None = None) -> Commit:
        """The last commit, or that of a version; an empty one where there is none yet."""
        folder = self._hadoop(f"{self.path}/commits")
        if not self._fs.exists(folder):
            return Commit()
        names = sorted(x.getPath().getName() for x in self._fs.listStatus(folder) if x.getPath().getName().endswith(".json"))
        names = [n for n in names if version is None or int(n.split(".")[0]) <= version]
        if not names:
            return Commit()
        said = json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(self._fs.open(self._hadoop(f"{self.path}/commits/{names[-1]}")), "UTF-8"))
        return Commit(int(names[-1].split(".")[0]), said["batch"], said["folders"])

    def _publish(self, commit: Commit) -> None:
        """Make ``commit`` the last one. Of two writers that try the same version one fails, before anything of the other is lost."""
        draft, final = (self._hadoop(f"{self.path}/commits/{x}") for x in (f".{uuid.uuid4().hex}", f"{commit.version:012d}.json"))
        stream = self._fs.create(draft, False)
        stream.write(bytearray(json.dumps({"batch": commit.batch, "folders": commit.folders}).encode()))
        stream.close()
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            self._fs.delete(draft, False)
            raise RuntimeError(f"version {commit.version} of {self.path} has been written meanwhile")

    def _read(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/data/{x}" for x in folders))

    def read(self, version: int | None = None) -> DataFrame:
        """The table as of the last commit, or of a version that ``vacuum`` has left."""
        return self._read(list(self.commit(version).folders.values()))

    def _bucket(self) -> Any:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def _size(self, path: str) -> int:
        return self._fs.getContentSummary(self._hadoop(path)).getLength()

    def apply(self, rows: DataFrame | None, batch: int, before_commit: Callable[[], None] | None = None, staged: str | None = None) -> bool:
        """Merge ``rows`` as number ``batch``; whether they were new. Rows with a null in the key belong to the key that has it.

        Rows of a key combine before the shuffle, so that a key with a third of all rows is no
        larger than others. Only buckets with a changed key are written anew, by as many tasks as their size asks for.
        ``staged`` is a folder in which the caller has written ``rows`` as Parquet, with one row for each key; it stays.
        """
        last = self.commit()
        if batch <= last.batch:
            return False
        columns = self._read([]).columns
        latest = F.max_by(F.struct(*columns), F.struct(*self.order, *columns))
        name = f"{last.version + 1:012d}-{uuid.uuid4().hex}"
        if not (own := staged):
            own = f"{self.path}/staged/{name}"
            rows.select(*columns).groupBy(*self.key).agg(latest.alias("r")).select("r.*").write.parquet(own)  # read twice: for its buckets, and to be merged
        new = self.spark.read.schema(self.schema).parquet(own).withColumn(_BUCKET, self._bucket())
        touched = sorted(str(r[_BUCKET]) for r in new.select(_BUCKET).distinct().collect())  # as many as buckets
        if touched:
            folders = [last.folders[b] for b in touched if b in last.folders]
            tasks = -(-(self._size(own) + sum(self._size(f"{self.path}/data/{f}") for f in folders)) // TASK_BYTES)
            # each side has a key once at most, so that rows can be dealt by bucket before they are merged, and aren't shuffled again
            piece = F.pmod(F.xxhash64(F.lit(1), *self.key), F.lit(-(-tasks // len(touched)))).alias("piece")
            both = self._read(folders).unionByName(new.select(*columns)).select("*", self._bucket().alias(_BUCKET), piece).repartition(tasks, _BUCKET, "piece")
            merged = both.groupBy(_BUCKET, "piece", *self.key).agg(latest.alias("r")).select("r.*", _BUCKET) if folders else both.drop("piece")
            merged.write.partitionBy(_BUCKET).parquet(f"{self.path}/data/{name}")
        if not staged:
            self._fs.delete(self._hadoop(own), True)
        if before_commit:
            before_commit()
        self._publish(Commit(last.version + 1, batch, last.folders | {b: f"{name}/{_BUCKET}={b}" for b in touched}))
        return True

    def vacuum(self, keep: int = 1) -> int:
        """Remove folders that none of the last ``keep`` versions has, and their commits; how many folders. Not while a batch runs."""
        last = self.commit()
        used = {f for v in range(max(1, last.version - keep + 1), last.version + 1) for f in self.commit(v).folders.values()}
        gone = 0
        for top in ("data", "staged"):
            if not self._fs.exists(self._hadoop(f"{self.path}/{top}")):
                continue
            for written in self._fs.listStatus(self._hadoop(f"{self.path}/{top}")):
                name = written.getPath().getName()
                for bucket in self._fs.listStatus(written.getPath()) if top == "data" else [written]:
                    inner = bucket.getPath().getName()
                    if f"{name}/{inner}" not in used and (inner.startswith(f"{_BUCKET}=") or top == "staged"):
                        gone += bool(self._fs.delete(bucket.getPath(), True))
        for v in range(1, last.version - keep + 1):
            self._fs.delete(self._hadoop(f"{self.path}/commits/{v:012d}.json"), False)
        return gone

    def follow(self, stream: DataFrame, checkpoint: str) -> Any:
        """A writer of a stream whose batches are merged in turn; start it with a trigger. A batch that the stream runs again after a stop is left out if it was committed."""
        return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda rows, batch: self.apply(rows, batch) and None)
