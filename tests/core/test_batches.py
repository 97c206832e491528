"""Python functions over Arrow batches hold a slice of a batch at a time, whatever its size."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessella.functions import rules
from tessella.operators import batches, chunking
from tessella.sources import web

SIZES = [30, 0, 500, 10, 10, 10, None, 40, 260]


@pytest.mark.parametrize("at_once", [1, 100, 10_000])
def test_slices_are_all_rows(monkeypatch, at_once):
    monkeypatch.setattr(batches, "AT_ONCE", at_once)
    parts = list(batches.some(pa.array(SIZES), pa.array(SIZES)))
    assert [x for p in parts for x in p.to_pylist()] == SIZES
    assert all(sum(x or 0 for x in p.to_pylist()[1:]) < at_once for p in parts)
    assert list(batches.some(pa.array([], pa.int64()), pa.array([], pa.int64()))) == []


def test_pages_are_parsed_in_slices(monkeypatch):
    monkeypatch.setattr(batches, "AT_ONCE", 200)
    html = [None, "", *(f"<title>t{i}</title><body>text {i} <a href='/{i}'>x</a></body>" for i in range(50))]
    batch = pa.RecordBatch.from_pydict({"page_id": list(range(52)), "url": [None, *["https://a.test/"] * 51], "html": html})
    out = list(web._pages(iter([batch])))
    assert len(out) > 5 and max(b.num_rows for b in out) < 20 and [x for b in out for x in b.column("page_id").to_pylist()] == list(range(52))
    last = out[-1].to_pylist()[-1]
    assert last["title"] == "t49" and last["links"] == ["https://a.test/49"] and last["canonical"] is None


def test_columns_in_slices(spark):
    """More than a slice in one batch; null and empty texts; pages without a number; documents without pages."""
    line = "a line that comes again " * 2000
    texts = [None, "", "x\nX\nx\ny", *(f"{i}\n{line}\n{line}\n{line}\nafter" for i in range(40))]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string").coalesce(1)
    got = {r["id"]: r["c"] for r in rows.select("id", rules.collapse_repeats_column(F.col("text")).alias("c")).collect()}
    assert got == {i: rules.collapse_repeats(x) for i, x in enumerate(texts)}
    pages = F.when(F.col("id") != 1, F.array(F.struct(F.lit(None).cast("int").alias("page"), "text"), F.struct(F.lit(2).alias("page"), F.lit("second").alias("text"))))
    cut = chunking.chunk_documents(rows.select(F.col("id").alias("doc_id"), F.lit("T").alias("title"), pages.alias("pages"))).collect()
    want = [(i, p, n, x) for i, t in enumerate(texts) if i != 1 for n, (p, x) in enumerate([*((None, x) for x in chunking.chunk_page(t or "", "Документ: T.")), *((2, x) for x in chunking.chunk_page("second", "Документ: T. Страница 2."))], 1)]
    assert sorted(map(tuple, cut), key=repr) == sorted(want, key=repr)
