"""A study that runs its configurations: one plan for all questions, whose dear stages are made once and shared.

Each table of chunks is searched once by vectors, by BM25 on the pool of the nearest, and by BM25 on all chunks, for every
question and part of a question; each pair of a search and a chunk that some configuration reranks is scored once. The configurations
meet these results as rows of a small table: they say by their columns what they retrieve, rerank and keep.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexivec.compat import written
from lexivec.functions import lexicon as L
from lexivec.operators import evaluate as E
from lexivec.operators import retrieval as R
from lexivec.operators.agent_loop import BLOCKED
from lexivec.operators.guard import validate_input
from lexivec.providers import overlap, support

#: Part of a search for a question as a whole.
WHOLE = -1

Scorer = Callable[[DataFrame], DataFrame]


def lexical_cross(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("cross", overlap(F.col("query_text"), F.col("text")))


def lexical_judge(pairs: DataFrame) -> DataFrame:
    """A passage is as good as the share of the question's words that it has."""
    return pairs.withColumn("judged", support(F.col("query_text"), F.col("text")))


def _searches(questions: DataFrame, parts: DataFrame | None) -> DataFrame:
    """sid, query_id, part, query_text, query_vector, plain, agentic: which configurations a search is for.

    An agent searches for a question's parts, or for the whole where it has none.
    """
    columns = ["query_id", "part", "query_text", "query_vector"]
    whole = questions.withColumn("part", F.lit(WHOLE).cast("long")).select(*columns, F.lit(True).alias("plain"))
    if parts is None:
        d = whole.withColumn("agentic", F.lit(True))
    else:
        known = parts.join(questions.select("query_id").distinct(), "query_id", "left_semi")
        has = known.select("query_id").distinct().withColumn("_has", F.lit(True))
        d = whole.join(has, "query_id", "left").select(*columns, "plain", F.col("_has").isNull().alias("agentic"))
        d = d.unionByName(known.withColumn("part", F.col("part").cast("long")).select(*columns, F.lit(False).alias("plain"), F.lit(True).alias("agentic")))
    return d.withColumn("sid", F.concat_ws(":", F.col("query_id").cast("string"), F.col("part").cast("string")))


def _found(chunks: DataFrame, asked: DataFrame, k: int, ways: dict[str, set[bool]], min_score: float) -> DataFrame:
    """retrieval, sid, id, score, rank: the best k chunks of each search by each way, of searches that an agentic configuration
    (true), a plain one (false) or either makes by it."""
    def of(*named: str) -> DataFrame:
        kinds = set().union(*(ways.get(w, set()) for w in named))
        mine = [F.col("agentic" if k else "plain") for k in kinds]
        return asked.filter(mine[0] if len(mine) == 1 else mine[0] | mine[1]).select(F.col("sid").alias("query_id"), "query_text", "query_vector")

    out = []
    if ways.keys() & {"vector", "hybrid"}:
        q = of("vector", "hybrid")
        pool = written(R.vector_search(chunks.withColumnRenamed("id", "vec_id"), q, k * L.VECTOR_POOL), "pool")
        if "vector" in ways:
            out.append(("vector", pool.select("query_id", "id", "score", "rank")))
        if "hybrid" in ways:
            both = R.combine(pool, R.bm25(pool, q, texts=chunks.select("id", "text")))
            out.append(("hybrid", R.ranked(both, "fused", "id", ["query_id"]).select("query_id", "id", F.col("fused").alias("score"), "rank")))
    if "keyword" in ways:
        out.append(("keyword", R.keyword_search(chunks.select("id", "text"), of("keyword"), k).select("query_id", "id", F.col("keyword_score").alias("score"), "rank")))
    rows = None
    for way, d in out:
        d = d.filter((F.col("rank") <= k) & (F.col("score") >= min_score)).select(F.lit(way).alias("retrieval"), F.col("query_id").alias("sid"), "id", "score", "rank")
        rows = d if rows is None else rows.unionByName(d)
    return rows


def contexts(
    questions: DataFrame, chunkings: dict[str, DataFrame], configs: tuple = E.ABLATIONS, parts: DataFrame | None = None, cross: Scorer = lexical_cross, judge: Scorer = lexical_judge,
    floor: float = L.RERANK_MIN_SCORE, min_score: float = L.MIN_SCORE,
) -> DataFrame:
    """ord, query_id, place, id, text, score: what each configuration would answer each question from, best first.

    questions: query_id, query_text, query_vector; parts: query_id, part (from 0), query_text, query_vector, for agentic
    configurations; chunkings: chunks (id, text, embedding) by the name that configurations use, of which those that are the same
    table are searched once. All configurations draw on pools of one size, that of the one that wants most; with a reranker,
    twice the chunks it keeps are looked at. cross and judge add a column of their name to pairs (query_text, text, ...).
    Guarded configurations give nothing for questions that the guard blocks. An agent's parts follow one another, and a chunk counts where
    it is found first. A question without a vector or text has no contexts.
    """
    spark = questions.sparkSession
    tables: list[DataFrame] = []
    number: dict[str, int] = {}
    for name in {c[3] for c in configs if c[1] != "none"}:
        same = [k for k, t in enumerate(tables) if t is chunkings[name]]
        number[name] = same[0] if same else len(tables)
        if not same:
            tables.append(chunkings[name])
    number = {name: number[name] for name in sorted(number)}
    if not tables:
        none = next(iter(chunkings.values()))
        return questions.limit(0).select(F.lit(0).alias("ord"), "query_id", F.lit(0).cast("long").alias("place")).join(none.limit(0).select("id", "text"), F.lit(False)).withColumn("score", F.lit(0.0))
    wanted = F.when(F.col("reranker") == "none", F.col("top_k")).otherwise(2 * F.col("top_k"))
    table = F.coalesce(*[F.when(F.col("chunking") == name, k) for name, k in number.items()])
    c = E.ablation_configs(spark, configs).filter("retrieval <> 'none'").select("ord", "retrieval", "reranker", table.alias("tab"), F.col("agentic").alias("_agent"), "guardrails", "top_k", wanted.alias("wanted"))
    k = max(x[6] * (1 if x[2] == "none" else 2) for x in configs if x[1] != "none")
    sound = questions.filter(F.col("query_text").isNotNull() & F.col("query_vector").isNotNull())
    asked = written(_searches(sound, parts), "searches")
    found, texts = None, None
    for t, chunks in enumerate(tables):
        ways: dict[str, set[bool]] = {}
        for x in configs:
            if x[1] != "none" and number[x[3]] == t:
                ways.setdefault(x[1], set()).add(bool(x[4]))
        d = _found(chunks, asked, k, ways, min_score).withColumn("tab", F.lit(t))
        x = chunks.select(F.lit(t).alias("tab"), "id", "text")
        found, texts = (d, x) if found is None else (found.unionByName(d), texts.unionByName(x))
    found = written(found, "found")
    blocked = validate_input(sound.select("query_id", "query_text"), "query_text").filter("blocked").select("query_id", F.lit(True).alias("_stop"))
    rows = found.join(asked.select("sid", "query_id", "part", "plain", "agentic"), "sid").join(F.broadcast(c), ["tab", "retrieval"])
    rows = rows.filter((F.col("rank") <= F.col("wanted")) & F.when(F.col("_agent"), F.col("agentic")).otherwise(F.col("plain")))
    rows = rows.join(blocked, "query_id", "left").filter(~(F.col("guardrails") & F.col("_stop").isNotNull()))
    rows = written(rows.select("ord", "tab", "reranker", "top_k", "sid", "query_id", "part", "id", "score", "rank"), "candidates")
    # Only texts that were found are moved.
    texts = texts.join(R.sent_if_few(rows.select("tab", "id").distinct(), "id"), ["tab", "id"], "left_semi")
    pairs = rows.filter("reranker <> 'none'").select("tab", "sid", "id").distinct().join(texts, ["tab", "id"]).join(asked.select("sid", "query_text"), "sid")
    scored = written(judge(cross(pairs)).select("tab", "sid", "id", F.col("cross").cast("double").alias("cross"), F.col("judged").cast("double").alias("judged")), "scored")
    own = F.col("score")
    told = lambda x: F.coalesce(F.nanvl(x, F.lit(None).cast("double")), own)
    by = F.when(F.col("reranker") == "none", own).when(F.col("reranker") == "cross_encoder", F.coalesce("cross", F.lit(0.0))).when(F.col("reranker") == "llm", told("judged"))
    by = F.round(by.otherwise(R.ensemble(F.coalesce("cross", F.lit(0.0)), told("judged"), own)), 9)
    d = rows.join(scored, ["tab", "sid", "id"], "left").withColumn("_by", by).filter((F.col("reranker") == "none") | (F.col("_by") >= floor))
    best = F.row_number().over(Window.partitionBy("ord", "sid").orderBy(F.desc("_by"), "id"))
    d = d.withColumn("_best", best).filter(F.col("_best") <= F.col("top_k"))
    once = d.groupBy("ord", "tab", "query_id", "id").agg(F.min(F.struct("part", "_best", F.col("_by").alias("score"))).alias("f"))
    place = F.row_number().over(Window.partitionBy("ord", "query_id").orderBy("f.part", "f._best", "id")).cast("long")
    return once.withColumn("place", place).join(texts, ["tab", "id"]).select("ord", "query_id", "place", "id", "text", F.col("f.score").alias("score"))


def run(questions: DataFrame, found: DataFrame, answer: Scorer, score: Scorer, configs: tuple = E.ABLATIONS) -> DataFrame:
    """name, ord, questions, failed, score of every configuration over every question, from what `contexts` found.

    answer: adds `answer` to rows (the configuration's columns, query_id, query_text, ..., contexts: array<string>, best first),
    null where a question fails; score: adds `score`. Questions that a guarded configuration blocks are told so, and that is
    their answer.
    """
    told = found.groupBy("ord", "query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "text"))), lambda x: x["text"]).alias("contexts"))
    blocked = validate_input(questions.select("query_id", "query_text"), "query_text").select("query_id", F.coalesce("blocked", F.lit(False)).alias("_blocked"))

    def answered(pairs: DataFrame) -> DataFrame:
        d = pairs.join(told, ["ord", "query_id"], "left").withColumn("contexts", F.coalesce("contexts", F.array().cast("array<string>")))
        d = answer(d).join(blocked, "query_id", "left")
        return d.withColumn("answer", F.when(F.col("guardrails") & F.col("_blocked"), BLOCKED).otherwise(F.col("answer"))).drop("_blocked")

    return E.ablation_study(questions, E.ablation_configs(questions.sparkSession, configs), answered, score)
