"""Every query of the catalogue that has SQL gives the SQL's rows; every other one runs."""

import pytest

from lexivec.queries import ORACLES, QUERIES, flagship

from .conftest import SF


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(name, spark, same):
    same(QUERIES[name](spark, SF), ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_runs(name, spark):
    assert QUERIES[name](spark, SF).count() > 0


def test_flagship(spark):
    assert flagship(spark, SF).columns == ["query_id", "id", "vector_score", "bm25_score", "fused", "rank"]


def test_entry_imports_without_the_training_data_folder(monkeypatch):
    import importlib

    import __spark_entry__

    load = importlib.import_module

    def without(name, *a):
        if name.startswith(("lexivec.llm", "corpus_pipeline")):
            raise ImportError(name)
        return load(name, *a)

    monkeypatch.setattr(importlib, "import_module", without)
    assert set(__spark_entry__.queries()) == set(QUERIES)
    assert set(__spark_entry__.oracle_sql()) == set(ORACLES)


def test_keyword_search_fills_up_and_takes_a_pool(spark):
    from lexivec.operators import retrieval as R

    docs = spark.createDataFrame([(k, "alpha beta" if k > 150 else "gamma delta" if k % 2 else None) for k in range(160)], "id long, text string")
    queries = spark.createDataFrame([(1, "alpha alpha"), (2, "delta"), (3, "nothing else"), (4, None)], "query_id long, query_text string")
    rows = lambda d: sorted((r["query_id"], r["rank"], r["id"], r["score"]) for r in d.collect())
    got = rows(R.keyword_search(docs, queries))
    assert [i for q, _, i, _ in got if q == 1] == [*range(151, 160), 0] and [i for q, _, i, _ in got if q > 2] == 2 * [*range(10)]
    for pool in (None, 20):
        d = docs if pool is None else docs.filter(f"id < {pool}")
        want = R.bm25(d.crossJoin(queries.select("query_id")), queries).filter("rank <= 10")
        assert rows(R.keyword_search(docs, queries, pool=pool)) == rows(want)
