"""Operators whose work must not grow faster than their input, against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from lexivec.operators import retrieval as R

from .conftest import SF


def plan_of(d):
    return d._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", ["plain", "odd"])
def test_vector_search_meets_in_blocks(spark, monkeypatch, name):
    """No row per pair of a query and a chunk, and the scores and ties of `cosine`; the odd ones are null, of other lengths,
    zeros, not numbers, or copies."""
    monkeypatch.setattr(R, "BLOCK", 700)
    monkeypatch.setattr(R, "PER_PART", 60)
    monkeypatch.setattr(R, "QUERY_BYTES", 512)
    r = random.Random(2)
    rows = [(f"v{k:03}", [r.gauss(0, 1) for _ in range(8)]) for k in range(250)]
    if name == "odd":
        odd = {3: None, 4: [0.0] * 8, 5: [1.0, None] + [0.0] * 6, 6: [1.0] * 5, 7: [float("nan")] * 8, 8: [], 9: [1.0] * 11}
        rows = [(i, odd[k] if k in odd else rows[0][1] if k % 3 == 0 else v) for k, (i, v) in enumerate(rows)]
    d = spark.createDataFrame(rows, "vec_id string, embedding array<double>").coalesce(1)
    q = d.filter(F.substring("vec_id", 2, 3).cast("int") % 20 < 10).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    got = R.vector_search(d, q, 7)
    assert "NestedLoop" not in plan_of(got) and "Cartesian" not in plan_of(got)
    each = d.filter("embedding is not null").crossJoin(q).select("query_id", F.col("vec_id").alias("id"), F.round(R.cosine(F.col("embedding"), F.col("query_vector")), 9).alias("score"))
    want = R.ranked(each, "score", "id", ["query_id"]).filter("rank <= 7")
    said = lambda x: sorted((a["query_id"], a["rank"], a["id"], repr(a["score"])) for a in x.collect())
    assert said(got) == said(want)
    assert got.dtypes == want.dtypes
    assert R.vector_search(d.limit(0), q, 7).count() == 0 == R.vector_search(d, q.limit(0), 7).count()


def test_rounding_to_nine_places_is_spark_s(spark):
    r = random.Random(4)
    values = [0.0, -0.0, 1.0, 0.0000000005, 0.1234567885, -0.1234567885, 0.1234567895, -4e-10, *[round(r.uniform(-1, 1), 10) for _ in range(3000)]]
    d = spark.createDataFrame([(v,) for v in values], "x double").select(F.round("x", 9))
    import numpy as np

    assert [repr(float(v)) for v in R._nine_places(np.array(values))] == [repr(a[0] + 0.0) for a in d.collect()]


@pytest.mark.parametrize("folder", [False, True])
def test_stream_guard_reads_a_table_of_several_files(spark, tmp_path, folder):
    from lexivec.plans.flow_queries import stream_guard

    from .conftest import SF

    d = spark.read.parquet(f"{SF}/conversations.parquet")
    if folder:
        d.repartition(3).write.parquet(str(tmp_path / "conversations.parquet"))
    said = lambda x: sorted(map(tuple, x.collect()))
    got = said(stream_guard(spark, str(tmp_path) if folder else SF))
    assert sum(r[2] for r in got) == d.count()
    assert got == said(stream_guard(spark, SF))


def test_bootstrap_makes_no_row_per_draw(spark, same):
    """The resamples of a plain loop over MD5; a key that is null, one beyond a block of MD5, values that are null."""
    import hashlib

    from lexivec.operators import stats as X

    r = random.Random(6)
    rows = [(["a", "b", None][k % 3], None if k == 9 else str(k) if k % 7 else "k" * (k % 70), None if k % 11 == 0 else r.gauss(5, 2)) for k in range(150)]
    rows += [("c", "1", None), ("c", "2", None)]
    d = spark.createDataFrame(rows, "g string, key string, x double")
    got = X.bootstrap_mean(d, ["g"], "x", "key", times=120)
    assert "Generate explode(sequence" not in plan_of(got)
    cuts = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119)
    want = []
    for g in ("a", "b"):
        means = []
        for i in range(120):
            w = [(sum(int(hashlib.md5(f"{'' if k is None else k + ':'}{i}".encode()).hexdigest()[:8], 16) / 2**32 >= c for c in cuts), x) for h, k, x in rows if h == g]
            means.append(sum(n * x for n, x in w if x is not None) / sum(n for n, _ in w))
        means.sort()
        xs = [x for h, _, x in rows if h == g and x is not None]
        want.append((g, round(means[3], 9), round(means[117], 9), round(sum(xs) / len(xs), 9)))
    rounded = sorted((a["g"], *(None if a[c] is None else round(a[c], 9) for c in ("lower", "upper", "estimate"))) for a in got.collect())
    assert rounded == [*want, ("c", None, None, None)]


def test_terms_are_counted_once(spark):
    """The counts of `tokens`; each text is cut once for a keyword search, and counts by key are not dealt out again."""
    from lexivec.functions.text import term_counts, tokens

    texts = ["Alpha beta, ALPHA-beta_2 of the Élan vital", "menjalankan running runs berlari's", None, "", "ab abc çédille  x日本y words", "İstanbul straße naïve"]
    d = spark.createDataFrame([(k // 2, t) for k, t in enumerate(texts)], "id long, text string")
    for stemmed in (True, False):
        want = d.select("id", F.explode(tokens(F.col("text"), stemmed)).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))
        assert sorted(map(tuple, term_counts(d, ["id"], "text", stemmed).collect())) == sorted(map(tuple, want.collect()))
    d = d.repartition(3)
    plan = term_counts(d, ["id"])
    plan.collect()
    assert plan._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("hashpartitioning(id") == 1
    q = spark.createDataFrame([(1, "alpha words")], "query_id long, query_text string")
    assert "ArrowEvalPython" not in plan_of(R.bm25_top(d, q, 3))


def test_probes_are_counted_without_a_row_per_list(spark, tmp_path, monkeypatch):
    """As many probes as a plain loop over all lists says, and no table of every query with every list."""
    import numpy as np

    from lexivec.operators import vector_index as V

    g = np.random.default_rng(8)
    d = spark.createDataFrame([(k, [float(x) for x in v]) for k, v in enumerate(g.normal(size=(300, 6)))], "vec_id long, embedding array<double>")
    q = d.filter("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    index, exact = V.VectorIndex.build(d, str(tmp_path / "ix"), lists=20), R.vector_search(d, q, 10)
    lists = {r["id"]: r["list"] for r in index.rows.collect()}
    order = {r["query_id"]: [int(x) for x in np.argsort(-(index.centroids @ (np.array(r["query_vector"]) / np.linalg.norm(r["query_vector"]))), kind="stable")] for r in q.collect()}
    places = sorted(order[r["query_id"]].index(lists[r["id"]]) for r in exact.collect())
    want = places[int(np.ceil(0.9 * len(places))) - 1] + 1

    def never(*a):
        raise AssertionError("a row per list")

    monkeypatch.setattr(V.VectorIndex, "_probed", never)
    assert index.probes_for(q, exact, 0.9) == want


def test_copies_of_a_vector_are_scored_k_times_a_query(monkeypatch):
    """Rows and queries of which most have one vector: those past the first k are no candidates, and what is found is the same."""
    import numpy as np
    import pyarrow as pa

    draw = np.random.default_rng(3)
    m, k = draw.normal(size=(2500, 6)), 5
    m[::2] = m[0]
    q = np.concatenate([m[:40], draw.normal(size=(20, 6))])
    table = lambda name, x: pa.table({name: pa.array(x.tolist(), pa.list_(pa.float64()))})
    scored, plain = [], R._nine_places
    monkeypatch.setattr(R, "_nine_places", lambda s: scored.append(len(s)) or plain(s))
    place_q, place_m, score = R.nearest(table("vector", m), table("query_vector", q), k)
    assert sum(scored) < 4 * k * len(q)
    unit = lambda x: x / np.linalg.norm(x, axis=1)[:, None]
    want = np.argsort(-np.round(unit(q) @ unit(m).T, 9), axis=1, kind="stable")[:, :k]
    assert place_q.tolist() == np.repeat(np.arange(len(q)), k).tolist()
    assert place_m.reshape(-1, k).tolist() == want.tolist()
    assert np.allclose(score, (unit(q)[place_q] * unit(m)[place_m]).sum(axis=1), atol=1e-9)


@pytest.mark.parametrize("rows", [30, 31, 250, 1003])
def test_nearest_takes_runs_of_any_number_of_rows(rows):
    import numpy as np
    import pyarrow as pa

    draw, k = np.random.default_rng(rows), 3
    m = np.round(draw.normal(size=(rows, 2)))
    q = draw.normal(size=(17, 2))
    table = lambda name, x: pa.table({name: pa.array(x.tolist(), pa.list_(pa.float64()))})
    place_q, place_m, _ = R.nearest(table("vector", m), table("query_vector", q), k)
    size = np.linalg.norm(m, axis=1)
    scores = np.round((q / np.linalg.norm(q, axis=1)[:, None]) @ np.divide(m, size[:, None], out=np.zeros_like(m), where=size[:, None] > 0).T, 9)
    assert place_m.reshape(-1, k).tolist() == np.argsort(-scores, axis=1, kind="stable")[:, :k].tolist()


@pytest.mark.parametrize("most", [0, 64 << 20])
def test_counts_of_texts_are_not_grouped_again(spark, monkeypatch, most):
    """What a text gives is written as it is, unless an id is there twice; then its texts count as one."""
    plans, plain = [], R.written
    monkeypatch.setattr(R, "MOST_SENT", most)
    monkeypatch.setattr(R, "written", lambda d, name: plans.append(plan_of(d)) or plain(d, name))
    terms = spark.createDataFrame([("q", "alpha", 1), ("r", "gamma", 2), ("r", "alpha", 1)], "query_id string, term string, qf long")
    said = lambda rows: sorted(map(tuple, R._counted(spark.createDataFrame(rows, "id long, text string"), terms, False).collect()), key=repr)
    a, c = [(1, None, 4, 4), (1, "alpha", 2, 4), (2, None, 1, 1)], [(3, None, 1, 1), (3, "gamma", 1, 1)]
    assert said([(1, "alpha beta alpha delta"), (2, "beta"), (3, "gamma"), (4, None), (5, "of")]) == sorted(a + c, key=repr)
    assert "Window" not in plans[0] and "Aggregate [id" not in plans[0] and "Exchange hashpartitioning(id" not in plans[0]
    assert said([(1, "alpha beta"), (1, "alpha delta"), (2, "beta"), (3, "gamma")]) == sorted(a + c, key=repr)


def test_contexts_tell_words_once_a_text(spark):
    """No text is taken apart in each pair; the scores are those of `overlap`, and texts without words or null score 0."""
    from lexivec.functions.text import with_words
    from lexivec.plans import rag
    from lexivec.providers import overlap, overlap_of

    texts = ["Maps of rivers and rivers' mappings", "mapping the Rivers", "", None, "of the", "Ünder x_1 naïve walking walked"]
    d = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id long, text string")
    pairs = d.crossJoin(d.select(F.col("id").alias("o"), F.col("text").alias("other")))
    said = lambda x, c: [r["s"] for r in x.select("id", "o", c.alias("s")).orderBy("id", "o").collect()]
    got = said(with_words(with_words(pairs, "text", "x"), "other", "y"), overlap_of(F.col("x"), F.col("y")))
    assert got == said(pairs, overlap(F.col("text"), F.col("other"))) and any(got)
    chunks = d.withColumn("embedding", F.array(F.lit(1.0), F.col("id").cast("double")))
    q = spark.createDataFrame([(1, "rivers of maps", [1.0, 2.0]), (2, None, [1.0, 2.0])], "query_id long, query_text string, query_vector array<double>")
    out = rag.answer_contexts(q, chunks)
    assert "filter(split(" not in plan_of(out) and "lower(text" not in plan_of(out)
    rows = out.collect()
    assert [r["query_id"] for r in rows] == [1] and "mapping the Rivers" in rows[0]["context"]


def test_full_ranking_keeps_no_row_per_pair(spark, monkeypatch):
    """Pairs of a query and a document are scored in blocks: each part gives top_k rows a query, the same as a plain sum, with
    copies, texts without words, terms that all have and terms that one has, however postings and queries are dealt out."""
    from lexivec.operators import sparse

    r, given, plain = random.Random(8), [], R.ranked
    words = [f"word{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(200)]
    texts = ["everyone " + " ".join(r.choices(words, [1 / (1 + i) for i in range(200)], k=r.randrange(1, 40))) for _ in range(120)]
    rows = [(f"d{k:03}", None if k == 5 else "" if k == 6 else texts[k % 40 if k % 2 else k % 120]) for k in range(240)]
    d = spark.createDataFrame([*rows, ("e", "unique")], "id string, text string")
    q = spark.createDataFrame([(k, t) for k, t in enumerate([*texts[:25], "unique", "unheard", "", None, "everyone", "worda worda wordba"])], "query_id long, query_text string")
    c = R.term_counts(d, ["id"], "text").withColumn("dl", F.expr("sum(tf) over (partition by id)"))
    avgdl, n = c.agg(F.sum("tf")).first()[0] / 241, F.lit(241)
    w = R._query_terms(q, True).join(c.groupBy("term").agg(F.count("*").alias("df")), "term")
    part = F.col("qf") * R._idf(n, F.col("df")) * R._tfn(F.col("tf"), F.col("dl"), F.lit(avgdl)) * R._qtf(F.col("qf"))
    each = c.join(w, "term").groupBy("query_id", "id").agg(F.sum(part).alias("s"))
    s = q.crossJoin(d.select("id")).join(each, ["query_id", "id"], "left").select("query_id", "id", F.round(F.coalesce("s", F.lit(0.0)), 6).alias("score"))
    want = sorted(map(tuple, plain(s, "score", "id", ["query_id"]).filter("rank <= 6").select("query_id", "rank", "id", "score").collect()))
    monkeypatch.setattr(R, "ranked", lambda d, *a: given.append(d) or plain(d, *a))
    for dear, block, part in ((200, 4_000_000, 4_000_000), (0, 900, 500), (10**9, 50, 900)):
        for name, value in (("DEAR", dear), ("BLOCK", block), ("PER_PART", part), ("QUERY_BYTES", 2048), ("LEAST_PART", 400)):
            monkeypatch.setattr(sparse, name, value)
        given.clear()
        got = R.bm25_top(d, q, 6)
        assert given[0].groupBy("query_id", F.spark_partition_id()).count().count() < given[0].count() < each.count() / 2
        assert sorted(map(tuple, got.select("query_id", "rank", "id", "score").collect())) == want


def test_pools_meet_as_arrays(spark):
    """BM25 on pools makes no row per pair and term; the scores are those of a plain loop, with rows that have no words, no text
    and no terms of the query, and queries without words."""
    import math

    from lexivec.functions import lexicon as L

    texts = {1: "alpha beta beta gamma", 2: "alpha", 3: None, 4: "", 5: "gamma delta alpha", 6: "omega", 7: "beta beta beta alpha"}
    asked = {1: "alpha beta alpha", 2: "omega nothing", 3: "", 4: None, 5: "gamma"}
    pools = {1: [1, 2, 3, 4, 7], 2: [1, 6, 99], 3: [1, 2], 4: [5], 5: [1, 5, 6], 6: [1]}
    docs = spark.createDataFrame(list(texts.items()), "id long, text string")
    pool = spark.createDataFrame([(q, i) for q, ids in pools.items() for i in ids], "query_id long, id long")
    got = R.bm25(pool, spark.createDataFrame(list(asked.items()), "query_id long, query_text string"), False, texts=docs)
    assert "FlatMapCoGroupsInArrow" in plan_of(got)
    want = []
    for q, ids in pools.items():
        rows = {i: (texts[i] or "").split() for i in ids if i in texts}
        avg = sum(map(len, rows.values())) / len(rows)
        score = {}
        for i in ids:
            for t in dict.fromkeys((asked.get(q) or "").split()):
                qf, df, tf = asked[q].split().count(t), sum(t in r for r in rows.values()), rows.get(i, []).count(t)
                if tf:
                    tfn = tf * (L.K1 + 1) / (tf + L.K1 * (1 - L.B + L.B * len(rows[i]) / avg)) + L.DELTA
                    score[i] = score.get(i, 0) + qf * math.log((len(rows) - df + 0.5) / (df + 0.5) + 1) * tfn * (L.K3 + 1) * qf / (L.K3 + qf)
        best = sorted(((-round(score.get(i, 0.0), 6), i) for i in ids))
        want += [(q, i, pytest.approx(-s, abs=1e-9), k) for k, (s, i) in enumerate(best, 1)]
    assert sorted(tuple(a) for a in got.select("query_id", "id", "score", "rank").collect()) == sorted(want, key=lambda x: x[:2])


def test_a_study_searches_only_what_it_asks(spark, monkeypatch):
    """No configuration searches a question's parts by keywords; the texts that meet searches are those that were found."""
    from lexivec.plans import study

    from .test_study import CONFIGS, _data

    q, parts, chunkings = _data(spark)
    asked, sent, plain, small = [], [], R.keyword_search, R.sent_if_few
    monkeypatch.setattr(R, "keyword_search", lambda d, q, k: asked.append(q.select("query_id").collect()) or plain(d, q, k))
    monkeypatch.setattr(R, "sent_if_few", lambda d, key: sent.append(key) or small(d, key))
    assert study.contexts(q, chunkings, CONFIGS, parts).count()
    assert sorted(r[0] for r in asked[0]) == ["1:-1", "2:-1", "3:-1", "5:-1"] and sent[-1] == "id"


def test_answers_keep_the_contexts_they_read(spark, monkeypatch, same):
    """Of each configuration and question the study keeps one text, the best, which is the answer."""
    from lexivec.plans import study_queries as Q

    kept, plain = {}, Q.written
    monkeypatch.setattr(Q, "written", lambda d, name: kept.setdefault(name, plain(d, name)))
    same(Q.ablation_runs(spark, SF), Q.ORACLES["ablation_runs"])
    assert 0 < kept["contexts"].count() == kept["contexts"].select("ord", "query_id").distinct().count()
    assert not kept["chunks"].filter("embedding is null").count()
