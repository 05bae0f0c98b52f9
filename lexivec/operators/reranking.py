"""Reranking by models: a cross-encoder, a judge of single passages, of lists, or of pairs, and an ensemble of them.

All take results (query_id, query_text, id, text, score, rank), the best of each query, and give them a score of their own.
A call that fails costs its own rows their new score, and no other's: what they count then is said at each function.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexivec.compat import written
from lexivec.operators import models
from lexivec.operators import retrieval as R

# Characters of a passage that a model is shown, and words that mark a question as Indonesian.
CROSS_LENGTH, LIST_LENGTH, PAIR_LENGTH = 512, 300, 500
INDONESIAN = r"(?i)\b(yang|dengan|untuk|adalah)\b"
NUMBER, LISTED = r"\d+\.?\d*", r"doc_(\d+)"

SYSTEM = {
    "point": {
        "en": "You judge how relevant a passage is to a question. Give a score from 0.0 (not at all) to 1.0 (answers it directly).",
        "id": "Anda menilai seberapa relevan suatu bagian terhadap pertanyaan. Berikan skor dari 0.0 (tidak relevan) hingga 1.0 (langsung menjawab).",
    },
    "list": {
        "en": 'You rank documents by their relevance to a question. Reply in JSON: {"rankings": [{"id": "doc_X", "rank": 1, "score": 0.95, "reasoning": "..."}]}',
        "id": 'Anda mengurutkan dokumen menurut relevansinya terhadap pertanyaan. Jawab dalam JSON: {"rankings": [{"id": "doc_X", "rank": 1, "score": 0.95, "reasoning": "..."}]}',
    },
    "pair": {
        "en": "Which of two passages is more relevant to the question? Reply with A or B alone.",
        "id": "Bagian mana yang lebih relevan untuk pertanyaan? Jawab hanya dengan A atau B.",
    },
}
REASONS = {"en": " Add the reason in one sentence.", "id": " Tambahkan alasan dalam satu kalimat."}
REPLY_JSON, REPLY_NUMBER = '\n\nReply in JSON: {"score": <number>, "reasoning": "<string>"}', "\n\nReply with the score alone:"


def language(text: Column) -> Column:
    """en for a question in Latin letters without common Indonesian words, else id."""
    return F.when(text.rlike("[a-zA-Z]") & ~text.rlike(INDONESIAN), "en").otherwise("id")


def _system(kind: str, more: dict[str, str] | None = None) -> Column:
    said = {k: v + (more[k] if more else "") for k, v in SYSTEM[kind].items()}
    return F.when(language(F.col("query_text")) == "en", said["en"]).otherwise(said["id"])


def _unit(x: Column) -> Column:
    """x between 0 and 1; null stays null."""
    return F.when(x.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), x)))


def _is_json(reply: Column) -> Column:
    """Whether a reply is JSON other than null."""
    return F.coalesce(F.try_parse_json(reply).isNotNull() & (F.trim(reply) != "null"), F.lit(False))


def cross_encoder(results: DataFrame, make: Callable[[], models.Model], to: str = "cross", **how) -> DataFrame:
    """results with the model's score of (question, first 512 characters of the passage); 0 where it fails or has none."""
    d = results.withColumn("_shown", F.substring("text", 1, CROSS_LENGTH))
    d = models.call(d, ["query_text", "_shown"], make, "_said", "double", **how)
    return d.withColumn(to, F.coalesce(F.nanvl("_said", F.lit(None).cast("double")), F.lit(0.0))).drop("_shown", "_said", "_said_error")


def point_score(reply: Column, original: Column, detailed: bool = True) -> Column:
    """A judge's score between 0 and 1: of JSON its `score`, 0 if that is no number; else the first number, else the original.

    Not detailed: the number that the reply begins with, else the original.
    """
    if not detailed:
        return F.coalesce(_unit(F.nullif(F.regexp_extract(F.trim(reply), r"^[-+]?(?:\d+\.?\d*|\.\d+)", 0), F.lit("")).try_cast("double")), original)
    number = F.nullif(F.regexp_extract(reply, NUMBER, 0), F.lit("")).try_cast("double")
    return F.when(_is_json(reply), _unit(F.coalesce(F.get_json_object(reply, "$.score").try_cast("double"), F.lit(0.0)))).otherwise(F.coalesce(_unit(number), original))


def pointwise(results: DataFrame, make: Callable[[], models.Model], to: str = "judged", detailed: bool = True, **how) -> DataFrame:
    """results with the judge's score of each passage, and its `reasoning`; the passage's own score where the call fails.

    The model is asked (system, prompt).
    """
    prompt = F.concat(F.lit("Question: "), F.col("query_text"), F.lit("\n\nPassage: "), F.col("text"), F.lit(REPLY_JSON if detailed else REPLY_NUMBER))
    d = models.call(results.withColumn("_system", _system("point", REASONS if detailed else None)).withColumn("_prompt", prompt), ["_system", "_prompt"], make, "_said", **how)
    reason = F.get_json_object("_said", "$.reasoning") if detailed else F.lit(None).cast("string")
    return d.withColumn(to, point_score(F.col("_said"), F.col("score"), detailed)).withColumn("reasoning", reason).drop("_system", "_prompt", "_said", "_said_error")


def listwise(results: DataFrame, make: Callable[[], models.Model], to: str = "judged", **how) -> DataFrame:
    """results with the judge's score of a list: one call a query, which is shown 300 characters of each passage.

    Passages are numbered from 0 by rank; a number that the reply names twice counts as it is named last. A score of 0 or none is taken
    from the rank; passages that the reply leaves out, and all of a query whose call fails, keep their own score. A query's
    results are its best few, so its prompt is one row.
    """
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "id")) - 1
    r = results.withColumn("_at", place.cast("int"))
    shown = F.concat(F.lit("Document "), (F.col("_at") + 1).cast("string"), F.lit(" (id: doc_"), F.col("_at").cast("string"), F.lit("):\n"), F.substring(F.coalesce("text", F.lit("")), 1, LIST_LENGTH), F.lit("..."))
    listed = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_at", shown.alias("shown")))), lambda x: x["shown"]), "\n\n")
    q = r.groupBy("query_id").agg(F.first("query_text", True).alias("query_text"), listed.alias("listed"), F.count("*").alias("n"))
    prompt = F.concat(F.lit("Question: "), F.col("query_text"), F.lit("\n\n"), F.col("listed"), F.lit("\n\nRank these "), F.col("n").cast("string"), F.lit(" documents by relevance:"))
    said = models.call(q.select("query_id", _system("list").alias("_system"), prompt.alias("_prompt")), ["_system", "_prompt"], make, "_said", **how)
    ranked = F.from_json(F.when(_is_json(F.col("_said")), F.col("_said")), "struct<rankings:array<struct<id:string,rank:double,score:double,reasoning:string>>>")["rankings"]
    one = said.select("query_id", F.posexplode(ranked).alias("_k", "r"))
    one = one.select("query_id", "_k", F.nullif(F.regexp_extract("r.id", LISTED, 1), F.lit("")).try_cast("int").alias("_at"), "r")
    last = one.filter(F.col("_at").isNotNull()).groupBy("query_id", "_at").agg(F.max_by("r", "_k").alias("_r"))
    d = r.join(last, ["query_id", "_at"], "left")
    score = R.listwise_score(F.nullif(F.col("_r.score"), F.lit(0.0)), F.col("_r.rank"), F.col("score"))
    return d.select(*results.columns, F.when(F.col("_r").isNull(), F.col("score")).otherwise(score).alias(to), F.col("_r.reasoning").alias("reasoning"))


def pairwise(results: DataFrame, make: Callable[[], models.Model], to: str = "judged", seed: int = 42, **how) -> DataFrame:
    """results with their wins in drawn pairs over the most wins of the query; the own score without wins.

    The model is shown 500 characters of each passage; its reply is A or B, and anything else, or a failed call, is no win. A
    query's only passage scores 1.
    """
    text = results.select("query_id", "id", F.substring(F.coalesce("text", F.lit("")), 1, PAIR_LENGTH).alias("t"))
    asked = results.groupBy("query_id").agg(F.first("query_text", True).alias("query_text"))
    pairs = R.tournament_pairs(results.select("query_id", "id", "score"), seed).select("query_id", "x", "y").join(asked, "query_id")
    for k in "xy":
        pairs = pairs.join(text.select("query_id", F.col("id").alias(k), F.col("t").alias(f"{k}t")), ["query_id", k])
    prompt = F.concat(F.lit("Question: "), F.col("query_text"), F.lit("\n\nPassage A:\n"), F.col("xt"), F.lit("\n\nPassage B:\n"), F.col("yt"), F.lit("\n\nWhich passage is more relevant?"))
    said = models.call(pairs.select("query_id", "x", "y", _system("pair").alias("_system"), prompt.alias("_prompt")), ["_system", "_prompt"], make, "_said", **how)
    winner = F.upper(F.trim("_said"))
    won = said.select("query_id", F.when(winner == "A", F.col("x")).when(winner == "B", F.col("y")).alias("id")).filter("id is not null")
    scores = R.tournament_scores(results.select("query_id", "id", "score"), won)
    return results.join(scores.withColumnRenamed("tournament", to), ["query_id", "id"]).select(*results.columns, to)


def ensemble(results: DataFrame, cross: Callable[[], models.Model], judge: Callable[[], models.Model], to: str = "judged", weights: tuple[float, float, float] = (0.4, 0.4, 0.2), **how) -> DataFrame:
    """results with the weighted mean of the cross-encoder's score, the list's, and their own."""
    d = listwise(cross_encoder(results, cross, "_cross", **how), judge, "_judged", **how)
    return d.withColumn(to, R.ensemble(F.col("_cross"), F.col("_judged"), F.col("score"), weights)).drop("_cross", "_judged")


def reranked(results: DataFrame, strategy: str, cross: Callable[[], models.Model] | None = None, judge: Callable[[], models.Model] | None = None, top_k: int = R.L.RERANK_TOP_K, min_score: float = R.L.RERANK_MIN_SCORE, **how) -> DataFrame:
    """results with rerank_score and new_rank: the top_k at or over the floor under a strategy.

    none (all results, in their order), cross_encoder, llm, llm_listwise, pairwise, ensemble. Models are asked once: what they
    said is written before it is ranked.
    """
    if strategy == "none":
        return results.withColumn("rerank_score", F.col("score")).withColumn("new_rank", F.col("rank"))
    by = {"cross_encoder": (cross_encoder, cross), "llm": (pointwise, judge), "llm_listwise": (listwise, judge), "pairwise": (pairwise, judge)}
    if strategy == "ensemble":
        d = ensemble(results, cross, judge, "_new", **how)
    elif strategy in by:
        ask, make = by[strategy]
        d = ask(results, make, to="_new", **how)
    else:
        raise ValueError(f"no strategy {strategy!r}")
    return R.rerank(written(d, "reranked"), "_new", top_k, min_score).drop("_new")
