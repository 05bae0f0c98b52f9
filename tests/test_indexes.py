"""The vector index against exact search, the inverted index against scoring everything."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexivec.operators import inverted_index as I
from lexivec.operators import retrieval as R
from lexivec.operators import vector_index as V

from .conftest import SF


def vectors(spark, n=900):
    """Clustered vectors, one of them in a third of all rows, zeros and nulls."""
    g = np.random.default_rng(3)
    heads = g.normal(size=(12, 16))
    m = heads[g.integers(12, size=n)] + 0.5 * g.normal(size=(n, 16))
    m[::3] = m[0]
    m[5] = 0
    rows = [(k, None if k == 7 else [float(x) for x in v]) for k, v in enumerate(m)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>")


def rows(d):
    return sorted((r["query_id"], r["rank"], r["id"], r["score"]) for r in d.collect())


def test_vector_index(spark, tmp_path, monkeypatch):
    """All lists probed are exact search; a few give nine in ten; a hot list is dealt out; an index is opened and appended to."""
    monkeypatch.setattr(V, "PER_PART", 50)
    d = vectors(spark)
    q = d.filter("vec_id % 30 = 1 or vec_id = 5").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    exact = R.vector_search(d, q, 10)
    index = V.VectorIndex.build(d, str(tmp_path / "ix"), lists=24)
    assert rows(index.search(q, 10)) == rows(exact)
    few = index.search(q, 10, probes=6)
    (got,) = V.recall(few, exact).collect()
    assert got["queries"] == 31 and got["recall"] >= 0.9
    again = V.VectorIndex.open(spark, str(tmp_path / "ix"))
    again.append(d.filter("vec_id < 50").withColumn("vec_id", F.col("vec_id") + 10_000))
    both = d.union(d.filter("vec_id < 50").withColumn("vec_id", F.col("vec_id") + 10_000))
    assert rows(again.search(q, 10)) == rows(R.vector_search(both, q, 10))


def test_vector_index_of_nothing(spark):
    none = vectors(spark, 9).filter("vec_id > 99")
    index = V.VectorIndex.build(none)
    q = vectors(spark, 9).filter("vec_id = 1").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    assert index.search(q.limit(0), 3).collect() == []


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(5)
    words = [f"word{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(300)]
    rows = [(k, None if k == 3 else " ".join(r.choices(words, [1 / (1 + i) for i in range(300)], k=r.randrange(80)))) for k in range(1200)]
    return spark.createDataFrame(rows, "id long, text string").repartition(3).cache()


def queries(spark):
    r = random.Random(6)
    rows = [(k, " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in r.choices(range(300), k=r.randrange(1, 6)))) for k in range(30)]
    return spark.createDataFrame([*rows, (99, "unheard"), (98, None), (97, "wordaa wordaa wordba")], "query_id long, query_text string")


def matched(spark, docs, k):
    """The best k that match, by scoring everything."""
    return [x for x in rows(R.bm25_top(docs, queries(spark), k)) if x[3] > 0]


def test_inverted_index(spark, docs, tmp_path, monkeypatch):
    monkeypatch.setattr(I, "PER_GROUP", 20)
    index = I.InvertedIndex(spark, str(tmp_path / "ix")).append(docs, "one")
    want = matched(spark, docs, 10)
    assert rows(index.search(queries(spark), 10)) == want and len(want) > 200
    # A batch that is written again replaces itself.
    assert rows(index.append(docs, "one").search(queries(spark), 10)) == want


def test_inverted_index_grows(spark, docs, tmp_path):
    index = I.InvertedIndex(spark, str(tmp_path / "ix"))
    for k in range(3):
        index.append(docs.filter(F.col("id") % 3 == k), str(k))
    assert rows(index.search(queries(spark), 7)) == matched(spark, docs, 7)


def test_groups_are_left_out(spark, tmp_path, monkeypatch):
    """Where a few groups hold the best documents, the others are not scored."""
    monkeypatch.setattr(I, "PER_GROUP", 10)
    text = lambda k: "rare " * 9 + "common" if k % 500 == 0 else "common filler words here"
    docs = spark.range(2000).select("id").collect()
    d = spark.createDataFrame([(x["id"], text(x["id"])) for x in docs], "id long, text string")
    seen, keep = [], I.InvertedIndex._scored
    monkeypatch.setattr(I.InvertedIndex, "_scored", staticmethod(lambda blocks, groups: seen.append(groups) or keep(blocks, groups)))
    q = spark.createDataFrame([(1, "rare common")], "query_id long, query_text string")
    index = I.InvertedIndex(spark, str(tmp_path / "ix")).append(d)
    got = rows(index.search(q, 4))
    assert [x[2] for x in got] == [0, 500, 1000, 1500]
    assert seen[1].count() <= 8 < index.postings.select("grp").distinct().count()


def test_documents_of_the_table(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet").select(F.col("doc_id").alias("id"), "text")
    q = spark.read.parquet(f"{SF}/benchmark.parquet").select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))
    got = rows(I.InvertedIndex(spark).append(d).search(q, 10))
    assert got == [x for x in rows(R.bm25_top(d, q, 10)) if x[3] > 0]


def test_only_completed_documents_are_searched(spark):
    chunks = spark.createDataFrame([(k, f"alpha word{k}", [1.0, float(k)], f"d{k % 4}") for k in range(12)], "id long, text string, embedding array<double>, document_id string")
    documents = spark.createDataFrame([("d0", "completed"), ("d1", "processing"), ("d2", "failed"), ("d9", "completed")], "doc_id string, processing_status string")
    q = spark.createDataFrame([(1, "alpha", [1.0, 5.0])], "query_id long, query_text string, query_vector array<double>")
    every, some = (sorted(r["id"] for r in R.hybrid(chunks, q, 20, 0.0, documents=d).collect()) for d in (None, documents))
    assert every == list(range(12)) and some == [0, 4, 8]


def test_an_index_is_made_where_texts_are_read(spark, docs, tmp_path, monkeypatch):
    """Neither texts nor postings are moved to be stored, and a search moves a few rows a query and part, not one per pair."""
    plans, keep, frame = [], I.InvertedIndex._scored, type(docs)
    write = frame.write.fget
    monkeypatch.setattr(frame, "write", property(lambda d: plans.append(d._jdf.queryExecution().executedPlan().toString()) or write(d)))
    index = I.InvertedIndex(spark, str(tmp_path / "ix")).append(docs.coalesce(3))
    # A cached table's own plan is below its scan.
    stored = [p for p in plans if "MapInArrow" in p]
    assert len(stored) == 1 and "Exchange" not in stored[0].split("InMemoryRelation")[0] and "Aggregate" not in stored[0]
    made = []
    monkeypatch.setattr(I.InvertedIndex, "_scored", staticmethod(lambda a, g: made.append(keep(a, g)) or made[-1]))
    monkeypatch.setattr(R, "MOST_SENT", 1)
    got = rows(index.search(queries(spark), 3))
    assert got == matched(spark, docs, 3)
    pairs = R.bm25_top(docs, queries(spark), 1200).filter("score > 0").count()
    assert len(got) <= made[1].count() < pairs / 10


def test_texts_of_one_id_count_as_one(spark, tmp_path):
    d = spark.createDataFrame([(1, "alpha beta"), (1, "alpha"), (2, "beta"), (3, None), (4, ""), (4, None), (5, "alpha gamma delta")], "id long, text string")
    q = spark.createDataFrame([(1, "alpha"), (2, "beta gamma"), (3, "")], "query_id long, query_text string")
    assert rows(I.InvertedIndex(spark).append(d).search(q, 9)) == [x for x in rows(R.bm25_top(d, q, 9)) if x[3] > 0]
    assert rows(I.InvertedIndex(spark).append(d.limit(0)).search(q, 9)) == []
