"""Vectors of texts from an embedder that the caller passes: batches of bounded size, and a check of every vector's dimension."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BATCH = 32
Encoder = Callable[[list[str]], Sequence[Sequence[float]]]


def embed(texts: DataFrame, make_encoder: Callable[[], Encoder], dimension: int, batch: int = BATCH) -> DataFrame:
    """``id, embedding`` for each row of ``texts`` (``id``, ``text``).

    ``make_encoder`` is called once in each task, so that a model is loaded
    where it works; the encoder gets up to ``batch`` texts at a time. A null or
    blank text has a null vector and isn't sent. A wrong number of vectors, or a
    vector of another dimension, is an error: the index would be unusable.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for rows in batches:
            for lo in range(0, rows.num_rows, batch):
                part = rows.slice(lo, batch)
                given = part.column("text").to_pylist()
                sent = [t for t in given if t and not t.isspace()]
                encoder = encoder or make_encoder()
                vectors = [list(map(float, v)) for v in encoder(sent)] if sent else []
                if len(vectors) != len(sent) or any(len(v) != dimension for v in vectors):
                    raise ValueError(f"the embedder gave {len(vectors)} vectors of {sorted({len(v) for v in vectors})} dimensions for {len(sent)} texts; {dimension} dimensions are expected")
                found = iter(vectors)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([next(found) if t and not t.isspace() else None for t in given], pa.list_(pa.float32()))], names=["id", "embedding"])

    return texts.select(F.col("id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).mapInArrow(encode, "id long, embedding array<float>")
