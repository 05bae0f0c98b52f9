"""Calls of models and what their failures leave; reranking against plain versions of the same rules."""

import json

import pytest
from pyspark.sql import functions as F

from lexivec.operators import models
from lexivec.operators import reranking as K


def test_a_model_is_made_once_a_worker_and_asked_in_batches(spark):
    def make():
        import os
        import uuid

        me = f"{os.getpid()}:{uuid.uuid4().hex}"
        return lambda rows: [f"{me}|{len(rows)}|{a + b}" for a, b in rows]

    d = spark.range(0, 400, 1, 8).select("id", F.col("id").alias("a"), F.lit(1).cast("long").alias("b"), F.lit("old").alias("reply"))
    got = [r["reply"].split("|") for r in models.call(d, ["a", "b"], make, batch=16).collect()]
    assert sorted(int(x[2]) for x in got) == list(range(1, 401))
    assert {int(x[1]) for x in got} == {16, 2} and len({x[0] for x in got}) == len({x[0].split(":")[0] for x in got})


def test_retries_and_rows_that_fail(spark):
    def make():
        calls = []

        def model(rows):
            calls.append(len(rows))
            if len(calls) == 1:
                raise TimeoutError("first call of all")
            if any(a == "bad" for (a,) in rows):
                raise ValueError("bad row")
            if any(a == "short" for (a,) in rows) and len(rows) > 1:
                return []
            return ["no number" if a == "word" else float(len(a)) for (a,) in rows]

        return model

    rows = [(1, "a"), (2, "bad"), (3, None), (4, "ccc"), (5, "short"), (6, "word"), (7, ""), (7, "")]
    d = spark.createDataFrame(rows, "id long, a string").coalesce(1)
    got = {(r["id"], r["x"], r["x_error"]) for r in models.call(d, ["a"], make, "x", "double", wait=0.0).collect()}
    errors = {i: e for i, _, e in got if e is not None}
    assert {(i, x) for i, x, _ in got} == {(1, 1.0), (2, None), (3, None), (4, 3.0), (5, 5.0), (6, None), (7, 0.0)}
    assert set(errors) == {2, 6} and errors[2] == "ValueError: bad row"
    called = models.call(d, ["a"], make, "x", "double", tries=2, wait=0.0)
    assert {r["n"] for r in models.failures(called, "x").collect()} == {1}
    assert models.call(d.limit(0), ["a"], make).count() == 0


def _results(spark):
    long = "z" * 600
    rows = [(1, "what is alpha", k, t, s, r) for r, (k, t, s) in enumerate([(10, "alpha " + long, 0.9), (11, "beta", 0.5), (12, None, 0.4), (13, "delta", 0.2)], 1)]
    rows += [(2, "apa yang benar", 20, "satu", 0.7, 1), (3, "broken", 30, "one", 0.6, 1), (3, "broken", 31, "two", 0.1, 2)]
    return spark.createDataFrame(rows, "query_id long, query_text string, id long, text string, score double, rank long")


def test_cross_encoder_cuts_and_counts_failures_as_nothing(spark):
    def make():
        def model(rows):
            if any(q == "broken" for q, _ in rows):
                raise RuntimeError
            return [float("nan") if t == "beta" else len(t) / 1000 for _, t in rows]

        return model

    got = {r["id"]: r["cross"] for r in K.cross_encoder(_results(spark), make, wait=0.0).collect()}
    assert got == {10: 0.512, 11: 0.0, 12: 0.0, 13: 0.005, 20: 0.004, 30: 0.0, 31: 0.0}


def test_scores_of_a_judges_reply(spark):
    replies = {'{"score": 0.8, "reasoning": "r"}': 0.8, '{"score": 7}': 1.0, '{"score": -1}': 0.0, '{"other": 1}': 0.0, "0.7": 0.0, "null": 0.3, "score is 0.6 of 1": 0.6, "nothing": 0.3, None: 0.3, "": 0.3, '{"score": 0.9': 0.9, '{"score": "x"}': 0.0}
    d = spark.createDataFrame([(r,) for r in replies], "r string")
    assert {r["r"]: r["s"] for r in d.select("r", K.point_score(F.col("r"), F.lit(0.3)).alias("s")).collect()} == replies
    plain = {"0.25 or so": 0.25, " 3": 1.0, "-2": 0.0, ".5": 0.5, "about 0.5": 0.3, None: 0.3}
    d = spark.createDataFrame([(r,) for r in plain], "r string")
    assert {r["r"]: r["s"] for r in d.select("r", K.point_score(F.col("r"), F.lit(0.3), False).alias("s")).collect()} == plain


def test_pointwise_falls_back_row_by_row(spark):
    def make():
        def model(rows):
            if any("Question: broken" in p for _, p in rows):
                raise RuntimeError
            return ['{"score": 0.5, "reasoning": "' + ("id" if "Anda" in s else "en") + '"}' if "beta" not in p else "none" for s, p in rows]

        return model

    got = {r["id"]: (r["judged"], r["reasoning"]) for r in K.pointwise(_results(spark), make, wait=0.0).collect()}
    assert got == {10: (0.5, "en"), 11: (0.5, None), 12: (0.4, None), 13: (0.5, "en"), 20: (0.5, "id"), 30: (0.6, None), 31: (0.1, None)}


def test_listwise(spark):
    def make():
        def model(rows):
            out = []
            for _, p in rows:
                assert "z" * 294 in p or "alpha" not in p
                assert "z" * 295 not in p
                if "what is" in p:
                    said = [{"id": "doc_0", "rank": 2, "score": 0, "reasoning": "first"}, {"id": "doc_1", "rank": 1, "score": 0.2}, {"id": "doc_1", "rank": 1, "score": 1.5}, {"id": "doc_9", "rank": 1}, {"id": "none", "rank": 1}, {"id": "doc_3", "rank": 20}]
                    out.append(json.dumps({"rankings": said}))
                else:
                    out.append('{"rankings": [{"id": "doc_0", "rank": 1, "score": 0.9}' if "yang" in p else None)
            return out

        return model

    d = K.listwise(_results(spark).withColumn("extra", F.lit(1)), make, wait=0.0)
    assert d.columns[-3:] == ["extra", "judged", "reasoning"]
    got = {r["id"]: (round(r["judged"], 9), r["reasoning"]) for r in d.collect()}
    assert got == {10: (0.9, "first"), 11: (1.0, None), 12: (0.4, None), 13: (0.0, None), 20: (0.7, None), 30: (0.6, None), 31: (0.1, None)}


def test_pairwise_counts_wins_of_the_longer_passage(spark):
    from lexivec.operators.retrieval import tournament_pairs

    def make():
        def model(rows):
            out = []
            for _, p in rows:
                a, b = p.split("Passage A:\n")[1].split("\n\nWhich")[0].split("\n\nPassage B:\n")
                assert len(a) <= 500 and len(b) <= 500
                out.append("?" if "Question: broken" in p else " a " if len(a) >= len(b) else "B")
            return out

        return model

    r = _results(spark)
    texts = {x["id"]: x["text"] or "" for x in r.collect()}
    wins: dict[int, int] = {}
    for p in tournament_pairs(r).collect():
        if p["query_id"] != 3:
            best = p["x"] if len(texts[p["x"]][:500]) >= len(texts[p["y"]][:500]) else p["y"]
            wins[best] = wins.get(best, 0) + 1
    most = max(wins.values())
    own = {x["id"]: x["score"] for x in r.collect()}
    want = {i: 1.0 if i == 20 else wins[i] / most if i in wins else own[i] for i in own}
    assert {x["id"]: x["judged"] for x in K.pairwise(r, make, wait=0.0).collect()} == pytest.approx(want)


def test_reranked_by_strategy(spark):
    cross = lambda: lambda rows: [0.5 if t == "beta" else 0.4 for _, t in rows]
    judge = lambda: lambda rows: [None for _ in rows]
    r = _results(spark)
    places = lambda d: [(x["id"], x["new_rank"]) for x in d.filter("query_id = 1").orderBy("new_rank").collect()]
    assert places(K.reranked(r, "none")) == [(10, 1), (11, 2), (12, 3), (13, 4)]
    assert places(K.reranked(r, "cross_encoder", cross, min_score=0.1)) == [(11, 1), (10, 2), (13, 3)]
    assert places(K.reranked(r, "llm", judge=judge, top_k=2)) == [(10, 1), (11, 2)]
    got = K.reranked(r, "ensemble", cross, judge)
    assert {x["id"]: round(x["rerank_score"], 9) for x in got.filter("query_id = 1").collect()} == {10: 0.7, 11: 0.5}
    with pytest.raises(ValueError):
        K.reranked(r, "other")
