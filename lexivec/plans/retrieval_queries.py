"""Queries of retrieval, with their SQL. Query vectors and texts are those of the rows whose id is divisible by 100."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexivec.compat import spread, written
from lexivec.functions import lexicon as L
from lexivec.functions.text import term_counts
from lexivec.operators import reranking as K
from lexivec.operators import retrieval as R
from lexivec.operators.inverted_index import InvertedIndex
from lexivec.operators.vector_index import VectorIndex, recall
from lexivec.plans import sql as S

EVERY = 100


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    """The documents, on all cores."""
    return spread(_t(spark, sf, "documents"))


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _asked(spark, sf):
    return _t(spark, sf, "embeddings").filter(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"), F.col("label").alias("query_label"))


def _queries(spark, sf):
    return _asked(spark, sf).join(_t(spark, sf, "documents").select(F.col("doc_id").alias("query_id"), F.col("text").alias("query_text")), "query_id", "left")


def _chunks(spark, sf):
    return _t(spark, sf, "embeddings").join(_t(spark, sf, "documents"), F.col("vec_id") == F.col("doc_id")).select(F.col("doc_id").alias("id"), "text", "embedding", "label")


def vector_topk(spark, sf):
    q = _t(spark, sf, "embeddings").filter("vec_id = 0").select(F.lit(0).cast("long").alias("query_id"), F.col("embedding").alias("query_vector"))
    return R.vector_search(_t(spark, sf, "embeddings"), q, 10).drop("query_id")


def vector_topk_multi(spark, sf):
    return R.vector_search(_t(spark, sf, "embeddings"), _asked(spark, sf), L.TOP_K * L.VECTOR_POOL)


_VEC = f"""
qv as (select vec_id query_id, embedding qe, label query_label from embeddings where vec_id % {EVERY} = 0),
sim as (select query_id, vec_id id, round(coalesce(list_cosine_similarity(embedding::double[], qe::double[]), 0), 9) score from embeddings, qv where embedding is not null),
vec as (select *, row_number() over (partition by query_id order by score desc, id) as rank from sim qualify rank <= {L.TOP_K * L.VECTOR_POOL})"""


def _bm25_sql(pool: str, queries: str, out: str) -> str:
    """CTEs of BM25 on pool(query_id, id, text) under queries(query_id, query_text)."""
    return f"""
pt as (select query_id, id, {S.tokens("text")} terms from {pool}),
sz as (select query_id, count(*) n, avg(len(terms)) avgdl from pt group by query_id),
qt as (select query_id, term, count(*) qf from (select query_id, unnest({S.tokens("query_text")}) term from {queries}) group by 1, 2),
ps as (select query_id, id, dl, term, count(*) tf from (select query_id, id, len(terms) dl, unnest(terms) term from pt) group by 1, 2, 3, 4),
dq as (select query_id, term, count(*) df from ps group by 1, 2),
sc as (select query_id, id, sum(qf * ln((n - df + 0.5) / (df + 0.5) + 1) * (tf * {L.K1 + 1} / (tf + {L.K1} * ({1 - L.B} + {L.B} * dl / avgdl)) + {L.DELTA}) * ({L.K3 + 1} * qf / ({L.K3} + qf)::double)) s
       from ps join dq using (query_id, term) join qt using (query_id, term) join sz using (query_id) group by 1, 2),
bz as (select query_id, id, round(coalesce(s, 0), 6) score from {pool} left join sc using (query_id, id)),
{out} as (select *, row_number() over (partition by query_id order by score desc, id) as rank from bz)"""


_POOL = "qd as (select query_id, text query_text from qv join documents on doc_id = query_id), pool as (select query_id, id, text from vec join documents on doc_id = id)"
_FUSED = f"""
fus as (select query_id, id, coalesce(v.score, 0) vector_score, coalesce(b.score, 0) bm25_score, round(coalesce(1 / ({L.RRF_K} + v.rank)::double, 0) + coalesce(1 / ({L.RRF_K} + b.rank)::double, 0), 8) fused
        from vec v full join bm b using (query_id, id)),
top as (select *, row_number() over (partition by query_id order by fused desc, id) as rank from fus)"""
#: The chunks of hybrid search are the vectors that have a text.
_CHUNKED = _VEC.replace("where embedding is not null)", "where embedding is not null and vec_id in (select doc_id from documents))")
_HYBRID_CHUNKS = f"with {_CHUNKED}, {_POOL}, {_bm25_sql('pool', 'qd', 'bm')}, {_FUSED}"
_HYBRID = f"with {_VEC}, {_POOL}, {_bm25_sql('pool', 'qd', 'bm')}, {_FUSED}"


def tokenize_tf(spark, sf):
    return term_counts(_docs(spark, sf), ["doc_id"])


def doc_freq_avgdl(spark, sf):
    """One count of all texts gives both: the words of all documents are those of all terms."""
    terms = written(term_counts(_docs(spark, sf), ["doc_id"]).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("words")), "terms")
    n = _t(spark, sf, "documents").agg(F.count("*").alias("n"))
    length = terms.agg(F.sum("words").alias("words")).crossJoin(n).select(F.round(F.col("words") / F.col("n"), 6).alias("avgdl"))
    return terms.select("term", "df").crossJoin(F.broadcast(length))


def vector_index_full(spark, sf):
    """The index with all lists probed: exact search by blocks."""
    return VectorIndex.build(_t(spark, sf, "embeddings")).search(_asked(spark, sf), L.TOP_K * L.VECTOR_POOL)


def vector_index_recall(spark, sf):
    """Whether as many probes as are said to find nine in ten rows find them; the number depends on the vectors."""
    index, q = VectorIndex.build(_t(spark, sf, "embeddings")), _asked(spark, sf)
    exact = _pool(spark, sf)
    found = index.search(q, L.TOP_K * L.VECTOR_POOL, index.probes_for(q, exact, 0.9))
    return recall(found, exact).select("queries", (F.col("recall") >= 0.9).alias("enough"))


def bm25_indexed(spark, sf):
    """The benchmark's texts against a stored index of all documents, written in two batches."""
    docs, index = _docs(spark, sf).select(F.col("doc_id").alias("id"), "text"), InvertedIndex(spark)
    for k in range(2):
        index.append(docs.filter(F.pmod("id", F.lit(2)) == k), str(k))
    q = _t(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))
    return index.search(q, L.TOP_K).filter("score > 0")


def bm25_keyword(spark, sf):
    docs = _docs(spark, sf).select(F.col("doc_id").alias("id"), "text")
    q = _t(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))
    return R.keyword_search(docs, q).select("query_id", "id", "score", "keyword_score", "rank")


def _pool(spark, sf, k=L.TOP_K * L.VECTOR_POOL):
    """The k nearest rows of the stated queries, searched once and written, as what builds on it reads it several times."""
    return written(R.vector_search(_t(spark, sf, "embeddings"), _asked(spark, sf), k), "pool")


def _bm25_of(spark, sf, pool):
    docs = _docs(spark, sf).select(F.col("doc_id").alias("id"), "text")
    return R.bm25(written(pool.select("query_id", "id").join(docs.select("id"), "id", "left_semi"), "pooled"), _queries(spark, sf), texts=docs)


def bm25_on_pool(spark, sf):
    return _bm25_of(spark, sf, _pool(spark, sf))


def rrf_fusion(spark, sf):
    pool = _pool(spark, sf)
    return R.rrf(pool, _bm25_of(spark, sf, pool))


def hybrid_search(spark, sf):
    return R.hybrid(_chunks(spark, sf), _queries(spark, sf))


def ensemble_rerank(spark, sf):
    """Two supplied scores beside the vector score: of the label and of the rank."""
    d = _pool(spark, sf)
    d = d.withColumn("ensemble", F.round(R.ensemble(1.0 / F.col("rank"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - 0.1 * (F.col("rank") - 1))), F.col("score")), 6))
    return R.rerank(d, "ensemble").select("query_id", "id", "ensemble", "new_rank")


def _scripted_judge():
    """A judge that says something about a prompt's length, in each of the forms that are read, and fails on every fifth."""

    def judge(rows):
        lengths = [len(p) for _, p in rows]
        if any(n % 5 == 0 for n in lengths):
            raise RuntimeError("no reply")
        return ["none" if n % 5 == 1 else f"a score of 0.{n % 10}" if n % 5 == 2 else f'{{"score": 0.{n % 100:02d}, "reasoning": "length"}}' for n in lengths]

    return judge


def _passages(spark, sf):
    """The ten nearest documents of the stated queries, with the texts of both."""
    d = _t(spark, sf, "documents")
    p = _pool(spark, sf, 10).join(d.select(F.col("doc_id").alias("id"), "text"), "id")
    return p.join(d.select(F.col("doc_id").alias("query_id"), F.col("text").alias("query_text")), "query_id")


def judged_rerank(spark, sf):
    d = K.reranked(_passages(spark, sf), "llm", judge=_scripted_judge, top_k=L.RERANK_TOP_K, wait=0.0)
    return d.select("query_id", "id", F.round("rerank_score", 9).alias("rerank_score"), "reasoning", F.col("new_rank"))


def keyword_extract(spark, sf):
    return R.top_keywords(_docs(spark, sf))


def context_budget(spark, sf):
    d = hybrid_search(spark, sf).join(_t(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"), "id")
    return R.context(d, R.token_estimate(F.col("text")), 1000).select("query_id", "id", "rank", "tokens", "total_tokens")


def citation_numbers(spark, sf):
    e = _t(spark, sf, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("seq"), (F.get_json_object("props", "$.k").cast("long") % 20).alias("chunk"))
    return R.citation_numbers(e)


def context_relevance(spark, sf):
    c = bm25_keyword(spark, sf).filter("rank <= 5").join(_t(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"), "id")
    return R.context_relevance(c, _t(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("truth")))


def _relevance(spark, sf):
    label = _t(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "label")
    q = _asked(spark, sf).select("query_id", "query_label")
    return _pool(spark, sf, 10).join(label, "id").join(q, "query_id").withColumn("rel", (F.col("label") == F.col("query_label")).cast("int"))


def ir_ndcg(spark, sf):
    from lexivec.operators.evaluate import ndcg

    return ndcg(_relevance(spark, sf))


def ir_mrr(spark, sf):
    from lexivec.operators.evaluate import mrr

    return mrr(_relevance(spark, sf))


def ir_precision(spark, sf):
    from lexivec.operators.evaluate import precision

    return precision(_relevance(spark, sf))


def rank_change(spark, sf):
    v = _pool(spark, sf)
    b = _bm25_of(spark, sf, v)
    d = v.select("query_id", "id", F.col("rank").alias("o")).join(b.select("query_id", "id", F.col("rank").alias("n")), ["query_id", "id"])
    return d.groupBy("query_id").agg(F.round(F.avg(F.abs(F.col("n") - F.col("o"))), 6).alias("rank_change"))


#: BM25 of all documents under the benchmark's texts; each document is tokenised once.
_KEYWORD = f"""with bq as (select item_id query_id, text query_text from benchmark),
kt as (select doc_id id, {S.tokens("text")} terms from documents),
ks as (select count(*) n, avg(len(terms)) avgdl from kt),
kq as (select query_id, term, count(*) qf from (select query_id, unnest({S.tokens("query_text")}) term from bq) group by 1, 2),
kp as (select id, dl, term, count(*) tf from (select id, len(terms) dl, unnest(terms) term from kt) where term in (select term from kq) group by 1, 2, 3),
kf as (select term, count(*) df from kp group by 1),
sc as (select query_id, id, sum(qf * ln((n - df + 0.5) / (df + 0.5) + 1) * (tf * {L.K1 + 1} / (tf + {L.K1} * ({1 - L.B} + {L.B} * dl / avgdl)) + {L.DELTA}) * ({L.K3 + 1} * qf / ({L.K3} + qf)::double)) s
       from kp join kf using (term) join kq using (term), ks group by 1, 2),
bz as (select query_id, id, round(coalesce(s, 0), 6) score from (select query_id, id from bq, kt) left join sc using (query_id, id)),
bm as (select *, row_number() over (partition by query_id order by score desc, id) as rank from bz),
kw as (select query_id, id, score, round(score / greatest(max(score) over (partition by query_id), 1), 6) keyword_score, rank from bm)"""
_REL = f"with {_VEC}, r as (select v.*, (e.label = q.query_label)::int rel from vec v join embeddings e on e.vec_id = v.id join qv q using (query_id) where rank <= 10)"

QUERIES = {
    f.__name__: f
    for f in (
        vector_topk, vector_topk_multi, tokenize_tf, doc_freq_avgdl, bm25_keyword, bm25_on_pool, rrf_fusion, hybrid_search, ensemble_rerank, keyword_extract,
        context_budget, citation_numbers, context_relevance, ir_ndcg, ir_mrr, ir_precision, rank_change, judged_rerank, vector_index_full, vector_index_recall, bm25_indexed,
    )
}

ORACLES = {
    "vector_topk": "with q as (select embedding qe from embeddings where vec_id = 0), s as (select vec_id id, round(coalesce(list_cosine_similarity(embedding::double[], qe::double[]), 0), 9) score from embeddings, q) select id, score, row_number() over (order by score desc, id) as rank from s qualify rank <= 10",
    "vector_index_full": f"with {_VEC} select query_id, id, score, rank from vec",
    "vector_index_recall": f"with {_VEC} select count(distinct query_id) queries, true enough from vec",
    "bm25_indexed": f"{_KEYWORD} select query_id, id, score, rank from kw where rank <= {L.TOP_K} and score > 0",
    "vector_topk_multi": f"with {_VEC} select query_id, id, score, rank from vec",
    "tokenize_tf": f"select doc_id, term, count(*) tf from (select doc_id, unnest({S.tokens('text')}) term from documents) group by 1, 2",
    "doc_freq_avgdl": f"with d as (select {S.tokens('text')} terms from documents) select term, count(*) df, (select round(avg(len(terms)), 6) from d) avgdl from (select unnest(list_distinct(terms)) term from d) group by 1",
    "bm25_keyword": f"{_KEYWORD} select * from kw where rank <= {L.TOP_K}",
    "bm25_on_pool": f"with {_VEC}, {_POOL}, {_bm25_sql('pool', 'qd', 'bm')} select query_id, id, score, rank from bm",
    "rrf_fusion": f"{_HYBRID} select query_id, id, fused from fus",
    "hybrid_search": f"{_HYBRID_CHUNKS} select query_id, id, vector_score, bm25_score, fused, rank from top where rank <= {L.TOP_K} and fused >= {L.MIN_SCORE}",
    "ensemble_rerank": f"with {_VEC}, e as (select query_id, id, round((0.4::double * (1.0::double / rank) + 0.4::double * least(1, greatest(0, 1 - 0.1::double * (rank - 1))) + 0.2::double * score) / 1.0::double, 6) ensemble from vec), n as (select *, row_number() over (partition by query_id order by ensemble desc, id) new_rank from e where ensemble >= {L.RERANK_MIN_SCORE}) select * from n where new_rank <= {L.RERANK_TOP_K}",
    "judged_rerank": f"""with {_VEC}, p as (select v.query_id, v.id, v.score, q.text query_text, d.text from vec v join documents d on d.doc_id = v.id join documents q on q.doc_id = v.query_id where rank <= 10),
      n as (select *, length(query_text) + length(text) + {len("Question: " + chr(10) * 2 + "Passage: " + K.REPLY_JSON)} n from p),
      s as (select query_id, id, round(case when n % 5 in (0, 1) or n is null then score when n % 5 = 2 then (n % 10) / 10.0::double else (n % 100) / 100.0::double end, 9) rerank_score, case when n % 5 > 2 then 'length' end reasoning from n)
      select *, row_number() over (partition by query_id order by rerank_score desc, id) new_rank from s where rerank_score >= {L.RERANK_MIN_SCORE} qualify new_rank <= {L.RERANK_TOP_K}""",
    "keyword_extract": f"with t as (select doc_id, terms, unnest(range(1, len(terms) + 1)) i from (select doc_id, {S.tokens('text')} terms from documents)), c as (select doc_id, terms[i] term, count(*) n, min(i) f from t group by 1, 2) select doc_id, term, n, row_number() over (partition by doc_id order by n desc, f) as rank from c qualify rank <= 50",
    "context_budget": f"{_HYBRID_CHUNKS}, c as (select query_id, id, rank, ceil(length(text) / 4.0)::bigint tokens from top join documents on doc_id = id where rank <= {L.CONTEXT_TOP_K} and fused >= {L.MIN_SCORE}) select *, (sum(tokens) over (partition by query_id order by rank))::bigint total_tokens from c qualify total_tokens <= 1000",
    "citation_numbers": "with f as (select user_id session, (json_extract_string(props, '$.k')::bigint % 20) chunk, min(event_id) seq from events group by 1, 2) select session, chunk, row_number() over (partition by session order by seq, chunk) citation from f",
    "context_relevance": f"{_KEYWORD}, g as (select item_id query_id, list_filter(string_split_regex(lower(text), '\\s+'), lambda x: length(x) > 4) words from benchmark), h as (select query_id, lower(d.text) t from kw join documents d on d.doc_id = id where rank <= 5) select query_id, round(avg((len(list_filter(words, lambda x: contains(t, x))) >= len(words) * 0.3)::int), 6) relevance from h join g using (query_id) group by 1",
    "ir_ndcg": f"{_REL}, s as (select query_id, sum(rel / log2(rank + 1)) dcg, sum(rel) k from r group by 1) select query_id, round(case when k = 0 then 0 else dcg / list_sum(list_transform(range(1, k::bigint + 1), lambda i: 1 / log2(i + 1))) end, 6) ndcg from s",
    "ir_mrr": f"{_REL} select query_id, round(coalesce(1.0::double / min(rank) filter (rel = 1), 0), 6) mrr from r group by 1",
    "ir_precision": f"{_REL} select query_id, round(avg(rel), 6) as \"precision\" from r group by 1",
    "rank_change": f"with {_VEC}, {_POOL}, {_bm25_sql('pool', 'qd', 'bm')} select query_id, round(avg(abs(b.rank - v.rank)), 6) rank_change from vec v join bm b using (query_id, id) group by 1",
}
