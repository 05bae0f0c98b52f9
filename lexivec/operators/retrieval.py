"""Retrieval for whole batches of queries: vector top-k, BM25 on a candidate pool or on all rows, rank fusion, reranking, context."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexivec.compat import ship_package, written
from lexivec.functions import lexicon as L
from lexivec.functions.text import term_counts, tokens
from lexivec.operators.sparse import best_products, rounded


#: Bytes of a table, counted, up to which it is sent to every task.
MOST_SENT = 64 << 20
#: Rows, and bytes of query vectors, that meet in one task at most, about; numbers of a block of scores; rows worth a task; most scores in a run.
PER_PART, QUERY_BYTES, BLOCK, LEAST_PART, RUN = 50_000, 16 << 20, 4_000_000, 1_000, 64


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where a vector is 0."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def ranked(df: DataFrame, score: str, id_col: str, by: list[str], name: str = "rank") -> DataFrame:
    """df with the place of each row under the score; ties go by id."""
    w = Window.partitionBy(*by).orderBy(F.desc(score), F.asc(id_col))
    return df.withColumn(name, F.row_number().over(w).cast("long"))


def _dense(column, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows of a matrix, filled up with zeros, and their lengths; one that is null or has a null is zeros, length -1."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten()
    if not flat.null_count and (sizes == width).all():
        return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), width), sizes
    m = np.zeros((len(column), width))
    for i, v in enumerate(column.to_pylist()):
        if v is None or None in v:
            sizes[i] = -1
        else:
            m[i, : len(v)] = v
    return m, sizes


def _in_order(m: np.ndarray) -> np.ndarray:
    """Sums of rows, added from left to right as `dot` adds them."""
    return np.cumsum(m, axis=1)[:, -1] + 0.0


def _nine_places(s: np.ndarray) -> np.ndarray:
    """Rounded to nine places, halves away from zero, as Spark rounds."""
    return rounded(s, 9)


def _first_of_each(m: np.ndarray, sizes: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k rows of each vector."""
    bits = np.ascontiguousarray(m).view(np.uint64)
    number = (bits * np.random.default_rng(7).integers(1 << 62, size=m.shape[1], dtype=np.uint64)).sum(axis=1, dtype=np.uint64) + sizes.astype(np.uint64)
    order = np.argsort(number, kind="stable")
    start = np.searchsorted(number[order], number[order])
    late = np.arange(len(m)) - start >= k
    # Vectors that share a hash by chance all stay.
    if not late.any() or (bits[order] != bits[order[start]]).any() or (sizes[order] != sizes[order[start]]).any():
        return np.arange(len(m))
    return np.sort(order[~late])


def nearest(rows: pa.Table, asked: pa.Table, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of queries (query_vector) and of rows (vector, in the order that settles ties), scores: the k best rows of each.

    A matrix product tells which rows can be among them; their scores are then added up and rounded as `cosine` does it. Of
    rows with one vector only the first k can be among them, so only these are looked at.
    """
    width = max([1, *(pc.max(pc.list_value_length(c)).as_py() or 0 for c in (rows.column("vector"), asked.column("query_vector")))])
    (m, ms), (q, qs) = _dense(rows.column("vector"), width), _dense(asked.column("query_vector"), width)
    first = _first_of_each(m, ms, k)
    m, ms = (m, ms) if len(first) == len(m) else (m[first], ms[first])
    mn, qn = np.sqrt(_in_order(m * m)), np.sqrt(_in_order(q * q))
    unit = lambda v, n: np.divide(v, n[:, None], out=np.zeros_like(v), where=n[:, None] != 0)
    mu, qu, found = unit(m, mn), unit(q, qn), ([], [], [])
    uneven = len(np.unique(ms)) > 1 or len(np.unique(qs)) > 1 or ms[0] != qs[0]
    finite = np.isfinite(mn).all() and np.isfinite(qn).all()
    # Scores are looked at by the greatest of each run: k runs that reach a bound have k rows that do.
    run = max(1, min(RUN, len(m) // (8 * k)))
    runs = -(-len(m) // run)
    mu = np.concatenate([mu, np.zeros((runs * run - len(m), width))])
    for lo in range(0, len(q), step := max(1, BLOCK // len(mu))):
        at = slice(lo, lo + step)
        s = qu[at] @ mu.T
        if uneven:
            s[:, : len(m)][qs[at, None] != ms[None, :]] = 0.0
        if not finite:
            # Not a number sorts before all.
            s[np.isnan(s)] = np.inf
        s[:, len(m) :] = -np.inf
        if len(m) > k:
            s = s.reshape(len(s), runs, run)
            most = s.max(axis=2)
            least = np.partition(most, runs - k, axis=1)[:, runs - k] - 2e-9
            in_q, in_run = np.nonzero(most >= least[:, None])
            which, place = np.nonzero(s[in_q, in_run] >= least[in_q, None])
            place_q, place_m = in_q[which], in_run[which] * run + place
        else:
            place_q, place_m = (x.ravel() for x in np.indices(s.shape))
        place_q += lo
        score = np.zeros(len(place_q))
        for i in range(0, len(score), BLOCK // width + 1):
            b = slice(i, i + BLOCK // width + 1)
            over = mn[place_m[b]] * qn[place_q[b]]
            score[b] = np.divide(_in_order(m[place_m[b]] * q[place_q[b]]), over, out=np.zeros(len(over)), where=over != 0)
        if uneven:
            score[qs[place_q] != ms[place_m]] = 0.0
        score = _nine_places(score)
        order = np.lexsort((place_m, np.where(np.isnan(score), -np.inf, -score), place_q))
        place_q, place_m, score = place_q[order], place_m[order], score[order]
        best = np.arange(len(order)) - np.searchsorted(place_q, place_q) < k
        for x, y in zip(found, (place_q, place_m, score)):
            x.append(y[best])
    place_q, place_m, score = (np.concatenate(x) for x in found)
    return place_q, first[place_m], score


def vector_search(chunks: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, id, score, rank: the k nearest chunks of each query (query_id, query_vector).

    A stated set of queries against all rows. Rows are dealt out in parts of a bounded size, queries in blocks of bounded
    bytes; each part meets each block as a matrix product, and gives the k best rows of each query.
    """
    spark = chunks.sparkSession
    ship_package(spark)
    q = queries.select("query_id", "query_vector")
    c = chunks.filter(F.col(vector).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector).alias("vector"))
    n, sent = c.count(), q.agg(F.sum(32 + 8 * F.size("query_vector"))).first()[0] or 0
    parts = max(1, -(-n // PER_PART), min(4 * spark.sparkContext.defaultParallelism, n // LEAST_PART))
    blocks = max(1, -(-sent // QUERY_BYTES))
    out = T.StructType([q.schema["query_id"], T.StructField("id", c.schema["id"].dataType), T.StructField("score", T.DoubleType())])

    def meet(rows: pa.Table, asked: pa.Table) -> pa.Table:
        if not rows.num_rows or not asked.num_rows:
            return pa.table([asked.column("query_id").slice(0, 0), rows.column("id").slice(0, 0), pa.array([], pa.float64())], names=["query_id", "id", "score"])
        rows = rows.take(pc.sort_indices(rows.column("id"), null_placement="at_start"))
        place_q, place_m, score = nearest(rows, asked, k)
        return pa.table([asked.column("query_id").take(place_q), rows.column("id").take(place_m), pa.array(score)], names=["query_id", "id", "score"])

    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    c = c.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")).withColumn("block", each(blocks))
    q = q.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).withColumn("part", each(parts))
    d = c.groupBy("part", "block").cogroup(q.groupBy("part", "block")).applyInArrow(meet, out)
    return ranked(d, "score", "id", ["query_id"]).filter(F.col("rank") <= k)


def _query_terms(queries: DataFrame, stemmed: bool) -> DataFrame:
    """query_id, term, qf of queries (query_id, query_text)."""
    return term_counts(queries.filter(F.col("query_text").isNotNull()), ["query_id"], "query_text", stemmed).withColumnRenamed("tf", "qf")


def sent_if_few(d: DataFrame, key: str) -> DataFrame:
    """d, to be sent to every task if its rows, counted, are few enough: keys to look up."""
    return F.broadcast(d) if (d.agg(F.sum(64 + F.octet_length(F.col(key).cast("string")))).first()[0] or 0) <= MOST_SENT else d


def _counted(docs: DataFrame, terms: DataFrame, stemmed: bool) -> DataFrame:
    """id, term, tf, dl of docs (id, text): how often a text has each of these terms (term), and its length; a text with words
    has one row without a term, of all its words. Written, so that each text is tokenised once.

    Where no id is there twice, what a text gives is whole, and no row is moved or grouped.
    """
    asked = sent_if_few(terms.select(F.col("term").alias("_asked")).distinct(), "_asked")
    once = docs.groupBy("id").count().filter("count > 1").isEmpty()
    # Rows without a term have a key of their own, which is no word, so that a shuffle spreads them.
    key = F.coalesce("term", F.concat(F.lit("-"), F.col("id").cast("string")))
    d = term_counts(docs, ["id"], "text", stemmed, whole=True).join(asked, key == F.col("_asked"), "left")
    d = d.filter(F.col("term").isNull() | F.col("_asked").isNotNull()).select("id", "term", "tf", "dl")
    if not once:
        d = d.groupBy("id", "term").agg(F.sum("tf").alias("tf"))
        d = d.withColumn("dl", F.max(F.when(F.col("term").isNull(), F.col("tf"))).over(Window.partitionBy("id")))
    return written(d, "counts")


def _idf(n: Column, df: Column, log=F.log) -> Column:
    return log((n - df + 0.5) / (df + 0.5) + 1)


def _tfn(tf: Column, dl: Column, avgdl: Column) -> Column:
    return tf * (L.K1 + 1) / (tf + L.K1 * (1 - L.B + L.B * dl / avgdl)) + L.DELTA


def _qtf(qf: Column) -> Column:
    return (L.K3 + 1) * qf / (L.K3 + qf)


def _of_pool(rows: pa.Table, asked: pa.Table) -> pa.Table:
    """query_id, id, score of the rows (query_id, id, dl, posts) of one query's pool that have terms (terms) of the query."""
    flat = lambda d, column, *names: [d.column(column).combine_chunks().flatten().field(n).to_numpy() for n in names]
    t, tf = flat(rows, "posts", "t", "tf")
    wanted, qf = flat(asked, "terms", "t", "qf")
    order = np.argsort(wanted)
    wanted, qf = wanted[order], qf[order]
    row = np.repeat(np.arange(len(rows)), pc.fill_null(pc.list_value_length(rows.column("posts").combine_chunks()), 0).to_numpy(zero_copy_only=False))
    at = np.minimum(np.searchsorted(wanted, t), max(0, len(wanted) - 1))
    both = wanted[at] == t if len(wanted) else np.zeros(len(t), bool)
    at, row, tf, dl = at[both], row[both], tf[both], rows.column("dl").to_numpy()
    qf, df = qf[at], np.bincount(at, minlength=len(wanted))[at]
    part = qf * _idf(len(rows), df, np.log) * _tfn(tf, dl[row], dl.mean() if len(rows) else 0.0) * _qtf(qf)
    out, some = np.bincount(row, part, minlength=len(rows)).astype(float, copy=False), np.unique(row)
    found = rows.select(["query_id", "id"]).take(pa.array(some))
    return found.append_column("score", pa.array(out[some]))


def bm25(pool: DataFrame, queries: DataFrame, stemmed: bool = True, texts: DataFrame | None = None) -> DataFrame:
    """query_id, id, score, rank of every pool row (query_id, id) under its query (query_id, query_text).

    Frequencies and lengths are those of the query's own pool; a term that a query repeats counts each time. texts: id, text
    of the pool's rows, if pool has no text itself. Each text is tokenised once, however many queries have it in their pool.
    A pool's rows come together as arrays of numbers, and what a query does not ask for is left out where they meet.
    """
    if texts is None:
        texts = pool.select("id", "text").dropDuplicates(["id"])
    else:
        texts = texts.join(sent_if_few(pool.select("id").distinct(), "id"), "id", "left_semi")
    q = written(_query_terms(queries, stemmed), "terms")
    counts = _counted(texts, q, stemmed)
    length = texts.select("id").join(counts.filter(F.col("term").isNull()).select("id", "dl"), "id", "left").select("id", F.coalesce("dl", F.lit(0)).alias("dl"))
    # Terms have numbers, which are written, so that they stay.
    terms = written(q.select("term").distinct().withColumn("t", F.monotonically_increasing_id()), "numbers")
    posts = counts.filter(F.col("term").isNotNull()).join(sent_if_few(terms, "term"), "term").groupBy("id").agg(F.collect_list(F.struct("t", "tf")).alias("posts"))
    p = pool.select("query_id", "id").join(length.join(posts, "id", "left"), "id")
    wanted = q.join(terms, "term").groupBy("query_id").agg(F.collect_list(F.struct("t", "qf")).alias("terms"))
    s = p.groupBy("query_id").cogroup(wanted.groupBy("query_id")).applyInArrow(_of_pool, T.StructType([p.schema["query_id"], p.schema["id"], T.StructField("score", T.DoubleType())]))
    s = s.groupBy("query_id", "id").agg(F.sum("score").alias("score"))
    out = pool.select("query_id", "id").join(s, ["query_id", "id"], "left").select("query_id", "id", F.round(F.coalesce("score", F.lit(0.0)), 6).alias("score"))
    return ranked(out, "score", "id", ["query_id"])


def rrf(*lists: DataFrame, k: int = L.RRF_K, weights: tuple[float, ...] | None = None) -> DataFrame:
    """query_id, id, fused: sum of weight / (k + rank) over the lists (query_id, id, rank)."""
    parts = [d.select("query_id", "id", (F.lit(w) / (k + F.col("rank"))).alias("part")) for d, w in zip(lists, weights or [1.0] * len(lists))]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return both.groupBy("query_id", "id").agg(F.round(F.sum("part"), 8).alias("fused"))


def combine(vector: DataFrame, keyword: DataFrame, strategy: str = "hybrid", k: int = L.RRF_K) -> DataFrame:
    """query_id, id, vector_score, bm25_score, fused by strategy: hybrid, vector or keyword; a missing score is 0."""
    v = vector.select("query_id", "id", F.col("score").alias("vector_score"), F.col("rank").alias("_vr"))
    b = keyword.select("query_id", "id", F.col("score").alias("bm25_score"), F.col("rank").alias("_br"))
    d = v.join(b, ["query_id", "id"], "full_outer")
    if strategy == "hybrid":
        part = lambda r: F.coalesce(1.0 / (k + F.col(r)), F.lit(0.0))
        fused = F.round(part("_vr") + part("_br"), 8)
    elif strategy == "vector":
        fused = F.coalesce("vector_score", F.lit(0.0))
    else:
        top = F.greatest(F.max("bm25_score").over(Window.partitionBy("query_id")), F.lit(1.0))
        fused = F.round(F.coalesce("bm25_score", F.lit(0.0)) / top, 8)
    return d.select("query_id", "id", F.coalesce("vector_score", F.lit(0.0)).alias("vector_score"), F.coalesce("bm25_score", F.lit(0.0)).alias("bm25_score"), fused.alias("fused"))


def of_completed(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """The chunks (document_id, ...) of documents (doc_id, processing_status) that are completely processed.

    Chunks of documents that are unknown, still in work, or failed are no candidates of any search.
    """
    done = documents.filter("processing_status = 'completed'").select(F.col("doc_id").alias("_done"))
    return chunks.join(done, F.col("document_id") == F.col("_done"), "left_semi")


def hybrid(chunks: DataFrame, queries: DataFrame, top_k: int = L.TOP_K, min_score: float = L.MIN_SCORE, strategy: str = "hybrid", documents: DataFrame | None = None) -> DataFrame:
    """query_id, id, vector_score, bm25_score, fused, rank: vector pool, BM25 on it, fusion, floor, top k.

    chunks: id, text, embedding; queries: query_id, query_text, query_vector. documents: with it, only chunks `of_completed`.
    """
    chunks = chunks if documents is None else of_completed(chunks, documents)
    pool = written(vector_search(chunks.withColumnRenamed("id", "vec_id"), queries, top_k * L.VECTOR_POOL), "pool")
    d = combine(pool, bm25(pool, queries, texts=chunks.select("id", "text")), strategy)
    return ranked(d, "fused", "id", ["query_id"]).filter((F.col("rank") <= top_k) & (F.col("fused") >= min_score))


def bm25_top(docs: DataFrame, queries: DataFrame, top_k: int, stemmed: bool = True) -> DataFrame:
    """query_id, id, score, rank: the best top_k of all docs (id, text) under each query (query_id, query_text).

    Frequencies and lengths are those of docs. Each text is tokenised once; pairs of a query and a document are scored in blocks, of which only
    top_k rows a query move at the end. Rows that match nothing score 0.
    """
    q = written(_query_terms(queries, stemmed), "terms")
    counts = _counted(docs, q, stemmed)
    size = docs.agg(F.count("*").alias("n")).crossJoin(counts.filter(F.col("term").isNull()).agg(F.sum("tf").alias("words"))).select("n", (F.coalesce("words", F.lit(0)) / F.nullif("n", F.lit(0))).alias("avgdl"))
    tf = counts.filter(F.col("term").isNotNull())
    # Terms have numbers, which are written, so that they stay.
    terms = written(tf.groupBy("term").agg(F.count("*").alias("df")).withColumn("t", F.monotonically_increasing_id()), "numbers")
    weights = q.join(terms, "term").crossJoin(F.broadcast(size)).select("query_id", "t", (F.col("qf") * _idf(F.col("n"), F.col("df")) * _qtf(F.col("qf"))).alias("weight"))
    posts = tf.join(sent_if_few(terms.select("term", "t"), "term"), "term").crossJoin(F.broadcast(size)).select("id", "t", _tfn(F.col("tf"), F.col("dl"), F.col("avgdl")).alias("x"))
    s = best_products(posts, weights, top_k, terms.agg(F.sum("df")).first()[0] or 0, docs.schema["id"].dataType)
    best = written(ranked(s, "score", "id", ["query_id"]).filter(F.col("rank") <= top_k).drop("rank"), "best")
    # A query with fewer matches than top_k is filled with the smallest ids that it doesn't match: they lie among the
    # first 2 * top_k, as fewer than top_k of these are matches.
    short = queries.select("query_id").join(best.groupBy("query_id").agg(F.count("*").alias("c")), "query_id", "left").filter(F.coalesce("c", F.lit(0)) < top_k).select("query_id")
    first = docs.select("id").orderBy("id").limit(2 * top_k)
    rest = short.crossJoin(F.broadcast(first)).join(best, ["query_id", "id"], "left_anti").select("query_id", "id", F.lit(0.0).alias("score"))
    return ranked(best.unionByName(rest), "score", "id", ["query_id"]).filter(F.col("rank") <= top_k)


def keyword_search(docs: DataFrame, queries: DataFrame, top_k: int = L.TOP_K, pool: int | None = None) -> DataFrame:
    """Keyword strategy: the top_k of all docs (id, text) by BM25; pool: only of so many first rows by id."""
    d = bm25_top(docs if pool is None else docs.orderBy("id").limit(pool), queries, top_k)
    top = F.greatest(F.max("score").over(Window.partitionBy("query_id")), F.lit(1.0))
    return d.withColumn("keyword_score", F.round(F.col("score") / top, 6))


def rerank(results: DataFrame, score: str, top_k: int = L.RERANK_TOP_K, min_score: float = L.RERANK_MIN_SCORE, fallback: str | None = None) -> DataFrame:
    """The results at or over the floor, best first, top k of each query; a null score falls back to another column."""
    s = F.coalesce(F.col(score), F.col(fallback)) if fallback else F.col(score)
    return ranked(results.withColumn("rerank_score", s).filter(F.col("rerank_score") >= min_score), "rerank_score", "id", ["query_id"], "new_rank").filter(F.col("new_rank") <= top_k)


def ensemble(cross: Column, judged: Column, original: Column, weights: tuple[float, float, float] = (0.4, 0.4, 0.2)) -> Column:
    return (weights[0] * cross + weights[1] * judged + weights[2] * original) / float(sum(weights))


def listwise_score(score: Column, rank: Column, original: Column) -> Column:
    """A judge's score, or 1 - 0.1 (rank - 1), or the original, between 0 and 1."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(score, 1 - 0.1 * (rank - 1), original)))


#: Most pairs that a tournament draws.
TOURNAMENT_PAIRS = 20


def _pair_at(query: Column, k: Column, n: Column, seed: int) -> Column:
    """Draw k of a query: two places below n, by hashes."""
    at = lambda salt: F.pmod(F.xxhash64(query, k, F.lit(seed), F.lit(salt)), n).cast("int")
    return F.struct(F.least(at(1), at(2)).alias("x"), F.greatest(at(1), at(2)).alias("y"))


def tournament_pairs(passages: DataFrame, seed: int = 42) -> DataFrame:
    """query_id, x, xs, y, ys: min(2n, 20) drawn pairs of each query's passages (query_id, id, score), with their scores.

    A pair's draw is a hash of its ids and the seed, so it repeats.
    """
    n = F.count("*").over(Window.partitionBy("query_id"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("id")) - 1
    p = passages.withColumn("n", n).withColumn("place", place)
    # Places of pairs are drawn, not pairs made: as many distinct ones as are wanted, of twice as many draws.
    wanted = F.least(2 * F.col("n"), F.lit(TOURNAMENT_PAIRS), (F.col("n") * (F.col("n") - 1) / 2).cast("long")).cast("int")
    all_pairs = (F.col("n") * (F.col("n") - 1) / 2).cast("long")
    few = F.expr("transform(filter(flatten(transform(sequence(0, cast(n as int) - 1), i -> transform(sequence(0, cast(n as int) - 1), j -> struct(i, j)))), p -> p.i < p.j), p -> struct(p.i as x, p.j as y))")
    drawn = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(8 * TOURNAMENT_PAIRS)), lambda k: _pair_at(F.col("query_id"), k, F.col("n"), seed)))
    drawn = F.filter(drawn, lambda q: q["x"] < q["y"])
    shuffled = lambda a: F.transform(F.array_sort(F.transform(a, lambda q: F.struct(F.xxhash64("query_id", q["x"], q["y"], F.lit(seed)).alias("h"), q["x"].alias("x"), q["y"].alias("y")))), lambda q: F.struct(q["x"].alias("x"), q["y"].alias("y")))
    games = F.when(all_pairs <= 4 * TOURNAMENT_PAIRS, shuffled(few)).otherwise(drawn)
    q = p.filter("n > 1").select("query_id", "n").distinct().select("query_id", F.explode(F.slice(games, 1, wanted)).alias("g")).select("query_id", "g.x", "g.y")
    at = lambda k, i, v: p.select("query_id", F.col("place").alias(k), F.col("id").alias(i), F.col("score").alias(v))
    return q.join(at("x", "xi", "xs"), ["query_id", "x"]).join(at("y", "yi", "ys"), ["query_id", "y"]).select("query_id", F.col("xi").alias("x"), "xs", F.col("yi").alias("y"), "ys")


def tournament_scores(passages: DataFrame, won: DataFrame) -> DataFrame:
    """query_id, id, tournament: wins (query_id, id, a row each) over the most wins of the query; without wins the passage's
    own score, and 1 for a query's only passage."""
    wins = won.groupBy("query_id", "id").agg(F.count("*").alias("wins"))
    d = passages.withColumn("n", F.count("*").over(Window.partitionBy("query_id")))
    d = d.join(wins, ["query_id", "id"], "left").withColumn("wins", F.coalesce("wins", F.lit(0)))
    most = F.greatest(F.max("wins").over(Window.partitionBy("query_id")), F.lit(1))
    return d.select("query_id", "id", F.when(F.col("n") <= 1, 1.0).when(F.col("wins") == 0, F.col("score")).otherwise(F.col("wins") / most).alias("tournament"))


def tournament(passages: DataFrame, seed: int = 42) -> DataFrame:
    """query_id, id, tournament of `tournament_scores`, where the higher score wins a drawn pair, and ties the smaller id."""
    won = tournament_pairs(passages, seed).select("query_id", F.when(F.col("xs") >= F.col("ys"), F.col("x")).otherwise(F.col("y")).alias("id"))
    return tournament_scores(passages, won)


def context(results: DataFrame, tokens_of: Column, max_tokens: int = L.CONTEXT_TOKENS, top_k: int = L.CONTEXT_TOP_K) -> DataFrame:
    """Rows of each query, best first, up to the first that would overflow the budget, with their running sum.

    results: query_id, id, rank. Sums of counts never fall, so what fits is a prefix.
    """
    w = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    d = results.filter(F.col("rank") <= top_k).withColumn("tokens", tokens_of.cast("long"))
    return d.withColumn("total_tokens", F.sum("tokens").over(w)).filter(F.col("total_tokens") <= max_tokens)


def context_text(results: DataFrame, *more: Column) -> DataFrame:
    """query_id, context: the selected chunks (title, score, text) one after another; more: other aggregates of them."""
    part = F.format_string("\n\n---\nSource: %s (Score: %.3f)\n%s", "title", "score", "text")
    parts = F.sort_array(F.collect_list(F.struct("rank", part.alias("part"))))
    return results.groupBy("query_id").agg(F.regexp_replace(F.array_join(F.transform(parts, lambda p: p["part"]), ""), r"^\s+|\s+$", "").alias("context"), *more)


def token_estimate(text: Column) -> Column:
    """Offline stand-in for a tokenizer's count: a quarter of the characters, rounded up."""
    return F.ceil(F.length(text) / 4)


def top_keywords(docs: DataFrame, k: int = 50, stemmed: bool = True) -> DataFrame:
    """doc_id, term, n, rank: the most frequent terms of each document; ties by first place."""
    t = docs.select("doc_id", F.posexplode(tokens(F.col("text"), stemmed)).alias("pos", "term"))
    d = t.groupBy("doc_id", "term").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    w = Window.partitionBy("doc_id").orderBy(F.desc("n"), "first")
    return d.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k).select("doc_id", "term", "n", "rank")


def citation_numbers(hits: DataFrame) -> DataFrame:
    """session, chunk, citation: chunks numbered by their first appearance (session, seq, chunk)."""
    first = hits.groupBy("session", "chunk").agg(F.min("seq").alias("seq"))
    return first.select("session", "chunk", F.row_number().over(Window.partitionBy("session").orderBy("seq", "chunk")).cast("long").alias("citation"))


def citations_between(events: DataFrame) -> DataFrame:
    """session, epoch, chunk, citation: chunks numbered by their first appearance since their session was last cleared.

    events: (session, seq, chunk, clear); a row with `clear` ends an epoch and names no chunk.
    """
    cleared = F.coalesce(F.col("clear").cast("int"), F.lit(0))
    d = events.withColumn("epoch", F.sum(cleared).over(Window.partitionBy("session").orderBy("seq", "chunk").rowsBetween(Window.unboundedPreceding, 0)))
    first = d.filter((cleared == 0) & F.col("chunk").isNotNull()).groupBy("session", "epoch", "chunk").agg(F.min("seq").alias("seq"))
    number = F.row_number().over(Window.partitionBy("session", "epoch").orderBy("seq", "chunk")).cast("long")
    return first.select("session", "epoch", "chunk", number.alias("citation"))


def context_relevance(contexts: DataFrame, truths: DataFrame) -> DataFrame:
    """query_id, relevance: share of a query's contexts that contain 30 % of the truth's words of five letters or more."""
    w = truths.select("query_id", F.filter(F.split(F.lower("truth"), r"\s+"), lambda t: F.length(t) > 4).alias("words"))
    d = contexts.select("query_id", F.lower("text").alias("t")).join(w, "query_id")
    hit = F.size(F.filter("words", lambda x: F.col("t").contains(x))) >= F.size("words") * 0.3
    return d.groupBy("query_id").agg(F.round(F.avg(hit.cast("double")), 6).alias("relevance"))
