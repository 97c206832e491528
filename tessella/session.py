"""Session settings that the library's results rely on, and that scale with the cluster."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "tessella", master: str | None = None, **settings: str) -> SparkSession:
    """A session in UTC with adaptive execution; ``settings`` override (``.`` written as ``__``)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    base |= {k.replace("__", "."): v for k, v in settings.items()}
    for key, value in base.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """A new, unused path below the folder that ``spark.checkpoint.dir`` names; on one machine a folder of the driver's own where it is unset."""
    key = "spark.checkpoint.dir"
    base = spark.conf.get(key, None) or spark.sparkContext.getConf().get(key) or spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError(f"set {key} to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tessella-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/tessella-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again: what several later steps use is computed once."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
