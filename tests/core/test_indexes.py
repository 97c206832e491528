"""Indexes of vectors and texts against the exact ways, tables kept by key through stops and replays, and re-indexing."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessella.operators import reindex as ri
from tessella.operators import retrieval as r
from tessella.operators import search_index as ix
from tessella.plans import all_queries
from tessella.sources import standin as t
from tessella.streaming.tables import KeyedTable
from tests.oracle import DATA

MORE = DATA.replace("0.001", "0.01")


def found(df):
    return {(x["query_id"], x["chunk_id"]) for x in df.select("query_id", "chunk_id").collect()}


@pytest.mark.parametrize("path", [DATA, MORE])
def test_recall_of_the_vector_index(spark, path):
    got = all_queries()["o01_index_recall"](spark, path).first()
    assert got["recall"] >= 0.9 and got["probes"] < got["cells"] and got["wanted"] > 0


def clustered(spark, n=3000, groups=40, seed=3):
    g = np.random.default_rng(seed)
    centres = g.normal(size=(groups, 16))
    own = g.integers(0, groups, n)
    own[: n // 3] = 0  # a third of all rows in one cell
    x = centres[own] + 0.1 * g.normal(size=(n, 16))
    chunks = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "chunk_id long, embedding array<float>")
    asked = spark.createDataFrame([(100_000 + i, (v + 0.02 * g.normal(size=16)).tolist()) for i, v in enumerate(x[::50])], "query_id long, embedding array<float>")
    return chunks, asked


def test_vectors_in_clusters_need_few_cells(spark, tmp_path, monkeypatch):
    """A hot cell has several packs; an index that is opened again and appended to finds the same as the exact way; repeated, null and empty rows."""
    monkeypatch.setattr(ix, "PACK", 200)
    chunks, asked = clustered(spark)
    path = f"file://{tmp_path}/index"
    built = ix.build_vector_index(chunks.where("chunk_id < 2500"), path)
    assert built.probes <= len(built.centres) // 4
    index = ix.open_vector_index(spark, path)
    index.append(chunks.where("chunk_id >= 2500").unionByName(spark.createDataFrame([(None, [1.0] * 16), (7, None)], "chunk_id long, embedding array<float>")))
    packs = spark.read.parquet(f"{path}/packs")
    assert packs.agg(F.sum(F.size("pack_ids"))).first()[0] == 3000 and packs.groupBy("cell").count().agg(F.max("count")).first()[0] >= 3
    assert packs.agg(F.max(F.size("pack_ids"))).first()[0] < 400
    exact = found(r.vector_top(asked, chunks))
    assert len(exact & found(index.top(asked))) >= 0.9 * len(exact)
    every = index.top(asked, probes=len(index.centres))
    assert sorted(map(tuple, every.collect())) == sorted(map(tuple, r.vector_top(asked, chunks).collect()))


def test_index_of_nothing(spark, tmp_path):
    chunks, asked = clustered(spark, 60, 2)
    none = ix.build_vector_index(chunks.limit(0), f"file://{tmp_path}/none")
    assert none.top(asked).count() == 0
    one = ix.build_vector_index(chunks.limit(1), f"file://{tmp_path}/one")
    assert one.top(asked).count() == asked.count() and one.top(asked.limit(0)).count() == 0
    ix.append_postings(chunks.limit(0).withColumn("text", F.lit("x")), f"file://{tmp_path}/text")
    assert ix.indexed_text_top(asked.withColumn("question", F.lit("some words")), f"file://{tmp_path}/text").count() == 0


def test_postings_are_the_texts(spark, tmp_path, monkeypatch):
    """Frequent terms in several rows, batches of which one is written twice: the hits of the scan."""
    monkeypatch.setattr(ix, "POSTINGS", 20)
    c, q, path = t.chunks(spark, DATA), t.questions(spark, DATA), f"file://{tmp_path}/postings"
    for batch in (0, 1, 2, 1):
        ix.append_postings(c.where(F.col("chunk_id") % 3 == batch), path, batch)
    rows = spark.read.parquet(path)
    assert rows.agg(F.max(F.size("postings"))).first()[0] < 80 and rows.groupBy("batch", "term").count().agg(F.max("count")).first()[0] > 1
    assert sorted(map(tuple, ix.indexed_text_top(q, path).collect())) == sorted(map(tuple, r.text_top(q, c).collect()))
    plan = ix.indexed_text_top(q, path)._jdf.queryExecution().toString()
    assert "documents.parquet" not in plan


SCHEMA = "k string, v long, at long"


def rows(spark, *values):
    return spark.createDataFrame(list(values), SCHEMA)


def content(table, version=None):
    return sorted(map(tuple, table.read(version).collect()), key=repr)


def test_a_batch_counts_once(spark, tmp_path):
    """A replay, a stop before the commit, late rows, ties, null keys, repeated rows, an empty batch, old versions and what vacuum leaves."""
    table = KeyedTable(spark, f"file://{tmp_path}/t", SCHEMA, ["k"], ["at"], buckets=4)
    assert content(table) == [] and table.apply(rows(spark, ("a", 1, 1), ("a", 2, 3), ("b", 5, 1), ("b", 5, 1), (None, 1, 1)), 0)
    first = [("a", 2, 3), ("b", 5, 1), (None, 1, 1)]
    assert content(table) == first

    def stop():
        raise InterruptedError

    more = rows(spark, ("a", 9, 2), ("b", 6, 1), ("c", 1, 1))
    with pytest.raises(InterruptedError):
        table.apply(more, 1, stop)
    assert content(table) == first and table.commit().batch == 0
    again = KeyedTable(spark, f"file://{tmp_path}/t", SCHEMA, ["k"], ["at"], buckets=4)  # as after a restart
    assert again.apply(more, 1) and not again.apply(more, 1) and not again.apply(rows(spark, ("z", 1, 1)), 0)
    second = [("a", 2, 3), ("b", 6, 1), ("c", 1, 1), (None, 1, 1)]
    assert content(table) == second and content(table, 1) == first
    assert table.apply(rows(spark), 2) and content(table) == second
    assert table.vacuum() > 0 and content(table) == second and table.vacuum() == 0


def test_two_writers(spark, tmp_path):
    """Of two that write the same version one fails, and loses nothing of the other."""
    one, two = (KeyedTable(spark, f"file://{tmp_path}/t", SCHEMA, ["k"], ["at"], buckets=2) for _ in range(2))
    with pytest.raises(RuntimeError):
        one.apply(rows(spark, ("a", 1, 1)), 0, lambda: two.apply(rows(spark, ("b", 2, 1)), 0))
    assert content(one) == [("b", 2, 1)]


def test_a_stream_that_stops_between_write_and_commit(spark, tmp_path):
    """The batch runs again after the restart; the table is as if it had never stopped."""
    folder, path = f"file://{tmp_path}/in", f"file://{tmp_path}/t"
    for k in range(4):
        rows(spark, ("a", k, k), (f"k{k}", k, k)).coalesce(1).write.mode("append").parquet(folder)

    class Stops(KeyedTable):
        def _publish(self, commit):
            if commit.batch == 2:
                raise InterruptedError
            super()._publish(commit)

    def run(kind):
        table = kind(spark, path, SCHEMA, ["k"], ["at"], buckets=4)
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
        q = table.follow(stream, f"file://{tmp_path}/checkpoint").trigger(availableNow=True).start()
        try:
            q.awaitTermination()
        finally:
            q.stop()
        return table

    with pytest.raises(Exception):  # noqa: B017  the stream's error carries the batch's
        run(Stops)
    table = run(KeyedTable)
    assert content(table) == sorted([("a", 3, 3), *((f"k{k}", k, k) for k in range(4))]) and table.commit().batch == 3


def test_reindexing_touches_what_changed(spark, tmp_path):
    """An unchanged snapshot cuts and writes no chunk; changed, new, gone and returning documents; a start document; parts of a site."""
    long = "\n".join(f"line {i} of a text that is long enough to be cut" for i in range(120))
    pages = [("u/", "Start", long, 77), ("u/a", "A", "one", None), ("u/b", "B", "two", None), ("u/b", "B", "two", None), (None, "X", "none", None), ("u/e", None, None, None)]
    site = lambda *x: spark.createDataFrame(list(x), "url string, title string, text string, document_id long")
    index = ri.document_index(spark, f"file://{tmp_path}/i", buckets=4)
    report = lambda df: {x["status"]: x["documents"] for x in df.collect()}
    assert report(ri.reindex(index, site(*pages), 1)) == {"added": 4}
    before, folders = sorted(map(tuple, ri.live_chunks(index).collect()), key=repr), index.commit().folders
    assert {x[0] for x in before if x[1] == "u/"} == {77} and len([x for x in before if x[1] == "u/"]) > 2
    assert report(ri.reindex(index, site(*pages), 2)) == {"unchanged": 4} and index.commit().folders == folders
    assert report(ri.reindex(index, site(*pages[:2], ("u/b", "B", "three", None), ("u/c", "C", "new", None)), 3)) == {"unchanged": 2, "changed": 1, "added": 1, "gone": 1}
    now = sorted(map(tuple, ri.live_chunks(index).collect()), key=repr)
    assert [x for x in now if x[1] in ("u/", "u/a")] == [x for x in before if x[1] in ("u/", "u/a")] and any("three" in x[5] for x in now) and not any("two" in x[5] for x in now)
    ids = {x["url"]: x["document_id"] for x in index.read().collect()}
    assert report(ri.reindex(index, site(("u/e", "E", "back", None)), 4, whole=False)) == {"added": 1}
    assert {x["url"]: x["document_id"] for x in index.read().collect()} == ids and ri.live_chunks(index).where("url = 'u/a'").count() == 1
    assert report(ri.reindex(index, site(), 4)) == {} and report(ri.reindex(index, site(*pages[:0]), 5)) == {"gone": 5}
    assert ri.live_chunks(index).count() == 0


@pytest.mark.parametrize("dense", [0.0, 0.05, 9.0])
def test_text_meets_in_packs(spark, monkeypatch, dense):
    """Against all pairs: ties, repeated, null and own ids, empty texts, frequent terms as matrices and not, a least score; no row for each pair that shares a term."""
    monkeypatch.setattr(r, "BLOCK_CHARS", 300)
    monkeypatch.setattr(r, "PACK_CHARS", 900)
    monkeypatch.setattr(r, "DENSE", dense)
    monkeypatch.setattr(r, "AT_ONCE", 50)
    g = np.random.default_rng(5)
    text = lambda n: " ".join(f"w{int(x)}" for x in 40 * g.random(n) ** 3)
    chunks = [(i % 110, text(1 + i % 30)) for i in range(120)] + [(200, "w0 w1"), (201, "w0 w1"), (None, "w0"), (202, None), (203, "-")]
    asked = [(i % 28, text(1 + i % 9)) for i in range(30)] + [(None, "w0"), (300, ""), (301, None), (302, "nothing of this")]
    tf, share = {}, {}
    for i, t_ in chunks:
        for w in (t_ or "").split():
            tf[i, w] = tf.get((i, w), 0) + (len(w) > 1)
    for i, t_ in asked:
        for w in set(words := (t_ or "").split()):
            share[i, w] = share.get((i, w), 0) + 1 / len(set(words))
    sums = {}
    for (q, w), s in share.items():
        for (c, v), n in tf.items():
            if v == w and n and q != c and None not in (q, c):
                sums[q, c] = sums.get((q, c), 0) + s * 0.1 * sum(1 / j**2 for j in range(1, n + 1))
    for k, least in ((3, 0.0), (70, 0.0), (12, 0.03)):
        want = []
        for q in {x for x, _ in sums}:
            best = sorted((-round(s / 1.64493406685, 6), c) for (x, c), s in sums.items() if x == q)[:k]
            want += [(q, c, -s, n + 1) for n, (s, c) in enumerate(best) if -s >= least]
        found = r.text_top(spark.createDataFrame(asked, "query_id long, question string"), spark.createDataFrame(chunks, "chunk_id long, text string"), k, least)
        assert sorted((x["query_id"], x["chunk_id"], x["text_score"], x["rank"]) for x in found.collect()) == sorted(want)
        plan = found._jdf.queryExecution().toString()
        assert "MapInArrow" in plan and "explode" not in plan


def test_cells_of_a_meeting_are_bounded(monkeypatch):
    """Very many short texts in a pack take fewer questions at a time; only groups of columns whose best counts are looked through, whatever the number of columns."""
    g = np.random.default_rng(3)
    for n in (1, 2, 5, 63, 64, 65, 200):
        scores = np.round(g.random((40, n)) * (g.random((40, n)) < 0.7), 2)
        q, c = r._reaching(scores, 3, lambda kth: np.maximum(kth, 0.3))
        kth = np.maximum(np.sort(scores, axis=1)[:, -3], 0.3) if n >= 3 else np.full(40, 0.3)
        assert {(a, b) for a, b in zip(*np.nonzero(scores >= kth[:, None]))} <= set(zip(q, c)) and len(set(zip(q, c))) == len(q)
    bag = lambda name, texts: {k: v[0] for k, v in r._bag(name)(pa.table({"pack": pa.array([0] * len(texts), pa.int32()), "id": range(len(texts)), "words": texts})).to_pydict().items()}
    row = bag("block", [f"w{i % 7} w{i % 5}" for i in range(30)]) | bag("pack", [f"w{i % 9}" for i in range(50)])
    whole = np.concatenate([scores for _, _, scores in r._meet(row)])
    monkeypatch.setattr(r, "CELLS", 210)
    parts = [scores for _, _, scores in r._meet(row)]
    assert [len(x) for x in parts] == [4] * 7 + [2] and np.allclose(np.concatenate(parts), whole)


def test_tasks_of_the_index_follow_the_input(spark, tmp_path, monkeypatch):
    """Texts, postings and pairs are dealt to as many tasks as their size asks for, not to a fixed number."""
    c, q = t.chunks(spark, DATA), t.questions(spark, DATA)
    size = c.agg(F.sum(F.length("text"))).first()[0]
    monkeypatch.setattr(ix, "TASK_CHARS", size // 7)
    monkeypatch.setattr(ix, "TASK_PAIRS", 900)
    dealt = []
    deal = type(c).repartition
    monkeypatch.setattr(type(c), "repartition", lambda self, n, *cols: dealt.append((n, cols)) or deal(self, n, *cols))
    ix.append_postings(c, f"file://{tmp_path}/p")
    got = ix.indexed_text_top(q, f"file://{tmp_path}/p")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, r.text_top(q, c).collect()))
    assert [n for n, _ in dealt][0] == 8 and all(n > 8 for n, cols in dealt if cols[0] in ("term", "query_id"))


def test_reindexing_shuffles_texts_once(spark, tmp_path, monkeypatch):
    """What is written between the steps has no texts of unchanged documents; two addresses with one document id keep their own chunks; of repeated addresses the least counts."""
    from tessella.streaming import tables

    monkeypatch.setattr(tables, "TASK_BYTES", 2000)  # a bucket by several tasks
    kept, put = [], ri.written
    monkeypatch.setattr(ri, "written", lambda df: kept.append(df.columns) or put(df))
    site = lambda *x: spark.createDataFrame(list(x), "url string, title string, text string, document_id long")
    pages = [(f"u/{i}", "T", f"text of {i} " * 40, i) for i in range(60)]
    index = ri.document_index(spark, f"file://{tmp_path}/i", buckets=2)
    ri.reindex(index, site(*pages, ("u/x", "T", "one", 1), ("u/y", "T", "b", 5), ("u/y", "T", "a", 6), ("u/y", None, "c", 7)), 1)
    assert all("text" not in columns for columns in kept)
    texts = {}
    for x in ri.live_chunks(index).collect():
        texts.setdefault(x["url"], []).append((x["document_id"], x["text"].split("\n")[1]))
    assert texts["u/x"] == [(1, "one")] and texts["u/1"] == [(1, ("text of 1 " * 40).strip())] and texts["u/y"] == [(7, "c")] and len(texts) == 62
    assert spark.read.parquet(f"file://{tmp_path}/i/data").count() == 62
    files = len({x[0] for x in index.read().select(F.input_file_name()).distinct().collect()})
    assert files > 2
    assert {x["status"]: x["documents"] for x in ri.reindex(index, site(*pages), 2).collect()} == {"unchanged": 60, "gone": 2}
    assert index.read().count() == 62 and index.read().where("NOT live").count() == 2


def test_texts_are_cut_once_and_packs_have_tasks(spark, monkeypatch):
    """Terms are cut behind the joins, without a condition that is taken on texts which no join keeps; each pack is a task of its own, and blocks in slices find the same."""
    c, q = t.chunks(spark, DATA), t.questions(spark, DATA)
    want = sorted(map(tuple, r.text_top(q, c, 5).collect()))
    kept, put = [], r.written
    monkeypatch.setattr(r, "written", lambda df: kept.append(df) or put(df))
    monkeypatch.setattr(r, "SLICE", 7)
    monkeypatch.setattr(r, "PACK_CHARS", 20_000)
    found = r.text_top(q, c, 5)
    assert sorted(map(tuple, found.collect())) == want
    cut = [str(df._jdf.queryExecution().optimizedPlan()).splitlines() for df in kept]
    assert sum("regexp_extract_all" in line for plan in cut for line in plan) == 2
    assert not any("regexp_extract_all" in line and "Filter" in line for plan in cut for line in plan)
    packs = [df for df in kept if "pack_ids" in df.columns][0]
    n = packs.select("pack").distinct().count()
    assert n > 4 and n == packs.count()
    dealt = put(packs).repartitionById(n, "pack").select(F.spark_partition_id().alias("task")).distinct().count()
    assert dealt == n and "RepartitionByExpression" in found._jdf.queryExecution().optimizedPlan().toString()


def test_postings_meet_questions_by_size(spark, tmp_path, monkeypatch):
    """Frequent terms are joined as a table of known size, so that the counts aren't sorted by term in a fixed number of tasks; postings and questions meet in as many tasks as there are postings."""
    c, q, path = t.chunks(spark, DATA), t.questions(spark, DATA), f"file://{tmp_path}/p"
    monkeypatch.setattr(ix, "TASK_PAIRS", 900)
    monkeypatch.setattr(ix, "POSTINGS", 20)
    kept, put, dealt, deal = [], ix.written, [], type(c).repartition
    monkeypatch.setattr(ix, "written", lambda df: kept.append(df.columns) or put(df))
    monkeypatch.setattr(type(c), "repartition", lambda self, n, *cols: dealt.append((n, cols)) or deal(self, n, *cols))
    ix.append_postings(c, path)
    assert ["term", "parts"] in kept
    rows = spark.read.parquet(path)
    assert rows.where("n <> size(postings)").count() == 0
    total = rows.agg(F.sum("n")).first()[0]
    got = ix.indexed_text_top(q, path)
    assert [n for n, cols in dealt if all(isinstance(x, str) for x in cols) and cols == ("bucket", "term")] == [-(-total // 900)] * 2
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, r.text_top(q, c).collect()))
