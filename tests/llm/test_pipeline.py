"""The stages of the pipeline, each on its own input against SQL or the tokenizer itself, and the whole run on odd rows."""

import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tessella.llm import oracles
from tessella.llm.storage import materialize
from tests.oracle import DATA, connect


def _sql(docs, sql):
    con = connect()
    con.execute("DROP VIEW documents")
    con.register("documents", docs.toPandas())
    return con.execute(sql).df()


def test_stages_by_sql(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert [name.split()[0] for name, _ in corpus_pipeline.STAGES] == ["language", "n-gram", "benchmark", "mixing", "token-ID"]
    kept = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, DATA))
        assert docs.columns == before.columns
        kept.append((before, docs))
    ids = lambda df: sorted(r[0] for r in df.select("doc_id").collect())
    identified, unique, clean, mixed = (d for _, d in kept)
    assert ids(identified) == ids(kept[0][0].where("text RLIKE '\\\\p{L}'"))  # all documents with letters stay
    classes = _sql(identified, oracles.OP1)
    assert ids(unique) == sorted(set(classes.class_id)) and len(classes) > len(set(classes.class_id))
    found = set(_sql(unique, oracles.OP8).doc_id)
    assert found and ids(clean) == sorted(set(ids(unique)) - found)
    plan = _sql(clean, oracles.OP5)
    copies = {r.doc_id: int(r.taken // r.size + (2 * (r.taken % r.size) >= r.size)) for r in plan.itertuples() if r.size}
    assert {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()} == {i: n for i, n in copies.items() if n}
    from tokenizers import Tokenizer

    tokenizer, start, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0, []
    for r in sorted(mixed.select("doc_id", "text").collect()):
        encoded = [*tokenizer.encode(r["text"], add_special_tokens=False).ids, 1]
        want.append((r["doc_id"], start, len(encoded), zlib.crc32(np.array(encoded, "<u4").tobytes())))
        start += len(encoded)
    assert sorted(tuple(r) for r in corpus_pipeline.STAGES[-1][1](spark, mixed, DATA).collect()) == want


def test_odd_rows(spark):
    """Nulls in every column, empty and very long texts, repeated rows, through all stages."""
    long = " ".join(f"word{i % 977} the of and" for i in range(8000))
    rows = [(1, "the text of one document and more of it", "en", "a", 9, "x"), (1, "the text of one document and more of it", "en", "a", 9, "x"), (None, "the text of another document, of which nothing is known", None, None, None, None)]
    rows += [(2, None, "en", "a", 0, "x"), (3, "", None, "b", 0, "x"), (4, "12 !!", "en", None, 5, "x"), (5, long, "en", "b", len(long), "x"), (6, long, "en", "b", len(long), "x"), (None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row string")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, DATA))
        assert docs.columns == before.columns
    got = docs.select("doc_id", F.left("text", F.lit(8)).alias("t")).collect()
    assert {(r["doc_id"], r["t"]) for r in got} <= {(1, "the text"), (None, "the text"), (5, "word0 th")} and got
    records = corpus_pipeline.STAGES[-1][1](spark, docs, DATA).collect()
    assert len(records) == len(got) and all(r["n_tokens"] > 1 for r in records)


def test_empty(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, DATA))
    assert docs.count() == 0
