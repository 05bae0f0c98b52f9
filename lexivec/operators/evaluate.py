"""Retrieval metrics, latency profiles, summaries and ablations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ndcg(results: DataFrame) -> DataFrame:
    """query_id, ndcg of results (query_id, rank, rel): binary, against the best order of the relevant ones found."""
    d = results.groupBy("query_id").agg(F.sum(F.col("rel") / F.log2(F.col("rank") + 1)).alias("dcg"), F.sum("rel").cast("int").alias("k"))
    best = F.aggregate(F.sequence(F.lit(1), F.greatest("k", F.lit(1))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    return d.select("query_id", F.round(F.when(F.col("k") == 0, 0.0).otherwise(F.col("dcg") / best), 6).alias("ndcg"))


def mrr(results: DataFrame) -> DataFrame:
    return results.groupBy("query_id").agg(F.round(F.coalesce(1 / F.min(F.when(F.col("rel") == 1, F.col("rank"))), F.lit(0.0)), 6).alias("mrr"))


def precision(results: DataFrame) -> DataFrame:
    return results.groupBy("query_id").agg(F.round(F.avg("rel"), 6).alias("precision"))


def improvement(base: Column, other: Column) -> Column:
    """Percent by which `other` exceeds `base`; over a base of 0 it is 100 or 0."""
    return F.when(base == 0, F.when(other > 0, 100.0).otherwise(0.0)).otherwise(F.try_divide(other - base, base) * 100)


def latency_profile(marks: DataFrame, phase: str = "phase", ms: str = "ms") -> DataFrame:
    """phase, n, total, avg, sd, p50, p95, p99 of marks: the values at places floor(n p), neither interpolated nor nearest rank."""
    from lexivec.operators.stats import at_places

    d = marks.groupBy(phase).agg(F.count("*").alias("n"), F.round(F.sum(ms), 6).alias("total"), F.round(F.avg(ms), 6).alias("avg"), F.round(F.stddev_pop(ms), 6).alias("sd"))
    at = {f"p{k}": (lambda n, k=k: F.least(F.floor(n * F.lit(k / 100)), n - 1)) for k in (50, 95, 99)}
    return d.join(at_places(marks, [phase], ms, at).drop("n"), phase, "left")


def mean_or_zero(column: str) -> Column:
    """Mean of a group in which missing values and NaN count as 0."""
    return F.sum(F.coalesce(F.nanvl(column, F.lit(0.0)), F.lit(0.0))) / F.count("*")


def best_of(results: DataFrame, name: str, metric: str, least: bool = False) -> DataFrame:
    """Name of the row with the greatest or least metric; the first in `ord` wins ties."""
    key = F.struct(F.col(metric) * (-1 if least else 1), -F.col("ord"))
    return results.agg(F.max_by(name, key).alias("best"), (F.min(metric) if least else F.max(metric)).alias("value"))


# Ablation configurations: name, retrieval, reranker, chunking, agentic, guardrails, top_k, language.
ABLATIONS = (
    ("baseline_no_rag", "none", "none", "recursive", False, False, 5, "auto"),
    ("vector_only", "vector", "none", "recursive", False, False, 5, "auto"),
    ("bm25_only", "keyword", "none", "recursive", False, False, 5, "auto"),
    ("hybrid_no_rerank", "hybrid", "none", "recursive", False, False, 5, "auto"),
    ("hybrid_cross_encoder", "hybrid", "cross_encoder", "recursive", False, False, 5, "auto"),
    ("hybrid_llm_rerank", "hybrid", "llm", "recursive", False, False, 5, "auto"),
    ("hybrid_ensemble_rerank", "hybrid", "ensemble", "recursive", False, False, 5, "auto"),
    ("semantic_chunking", "hybrid", "ensemble", "semantic", False, False, 5, "auto"),
    ("sentence_window", "hybrid", "ensemble", "sentence_window", False, False, 5, "auto"),
    ("hierarchical_chunking", "hybrid", "ensemble", "hierarchical", False, False, 5, "auto"),
    ("agentic_mode", "hybrid", "ensemble", "recursive", True, False, 5, "auto"),
    ("full_system", "hybrid", "ensemble", "semantic", True, True, 5, "auto"),
    ("indonesian_optimized", "hybrid", "ensemble", "semantic", True, True, 7, "id"),
)


def ablation_configs(spark, configs: tuple = ABLATIONS) -> DataFrame:
    """ord and the columns of the configurations, a row each."""
    rows = ", ".join(f"({k}, '{n}', '{r}', '{x}', '{c}', {str(a).lower()}, {str(g).lower()}, {t}, '{lang}')" for k, (n, r, x, c, a, g, t, lang) in enumerate(configs))
    return spark.sql(f"select * from values {rows} as v(ord, name, retrieval, reranker, chunking, agentic, guardrails, top_k, language)")


#: Judged metrics and what a judge's unreadable reply counts as.
JUDGED = {
    "faithfulness": 0.0, "context_precision": 0.0, "context_recall": 0.0, "factual_correctness": 0.0, "academic_rigor": 0.0, "citation_accuracy": 0.0, "terminology": 0.0,
    "hallucination_rate": 0.5, "factual_consistency": 0.5, "source_attribution": 0.5, "contradiction": 0.5,
}

#: Metrics of the bundle that are means over a run's questions.
AVERAGED = (*JUDGED, "answer_relevancy", "answer_correctness", "tokens_per_second", "token_efficiency", "avg_step_ms")
PHASES = ("retrieval", "reranking", "generation", "planning", "tool_call", "synthesis")
AGENT_PHASES = ("tool_call", "planning", "synthesis")


def judged_scores(answers: DataFrame, replies: dict[str, str]) -> DataFrame:
    """answers (answer, ...) with a score from 0 to 1 per judged metric that has a column of replies.

    A blank answer scores 0, and 1 for what it invents.
    """
    from lexivec.providers import judged

    blank = F.coalesce(F.trim("answer"), F.lit("")) == ""
    return answers.select("*", *[F.when(blank, 1.0 if m == "hallucination_rate" else 0.0).otherwise(judged(F.col(c), JUDGED[m])).alias(m) for m, c in replies.items()])


def answer_metrics(answers: DataFrame) -> DataFrame:
    """answers (question_vector, answer_vector, truth_vector, factual_correctness) with answer_relevancy and
    answer_correctness (0.3 of the likeness, 0.7 of the judge)."""
    from lexivec.operators.retrieval import cosine

    like = cosine(F.col("answer_vector"), F.col("truth_vector"))
    return answers.withColumn("answer_relevancy", cosine(F.col("question_vector"), F.col("answer_vector"))).withColumn("answer_correctness", 0.3 * like + 0.7 * F.col("factual_correctness"))


def phase_sums(marks: DataFrame, key: str) -> DataFrame:
    """key, total_ms, <phase>_ms, agent_steps, avg_step_ms of marks (key, phase, ms)."""
    ms = lambda p: F.coalesce(F.sum(F.when(F.col("phase") == p, F.col("ms"))), F.lit(0.0)).alias(f"{p}_ms")
    steps = F.count_if(F.col("phase").isin(*AGENT_PHASES)).alias("agent_steps")
    d = marks.groupBy(key).agg(F.coalesce(F.sum("ms"), F.lit(0.0)).alias("total_ms"), *[ms(p) for p in PHASES], steps)
    agent = sum((F.col(f"{p}_ms") for p in AGENT_PHASES), F.lit(0.0))
    return d.withColumn("avg_step_ms", F.coalesce(F.try_divide(agent, F.col("agent_steps").cast("double")), F.lit(0.0)))


def token_metrics(df: DataFrame, answer: str, context: str, total_ms: str) -> DataFrame:
    """df with answer_tokens, context_tokens (words between white space), tokens_per_second and token_efficiency; 0 where a
    divisor is 0."""
    from lexivec.functions.text import word_count

    words = lambda c: word_count(F.coalesce(F.col(c), F.lit(""))).cast("long")
    d = df.withColumn("answer_tokens", words(answer)).withColumn("context_tokens", words(context))
    rate = F.when(F.col(total_ms) > 0, F.col("answer_tokens") / F.col(total_ms) * 1000).otherwise(0.0)
    return d.withColumn("tokens_per_second", F.coalesce(rate, F.lit(0.0))).withColumn("token_efficiency", F.when(F.col("context_tokens") > 0, F.col("answer_tokens") / F.col("context_tokens")).otherwise(0.0))


def metric_bundle(answers: DataFrame, marks: DataFrame, key: str, replies: dict[str, str]) -> DataFrame:
    """All metrics of each answer: judged, of likeness, latencies by phase (0 without marks) and tokens.

    answers: key, answer, context, the three vectors, and the judge's replies, of which `factual_correctness` is one.
    """
    d = answer_metrics(judged_scores(answers, replies))
    zero = [F.coalesce(c, F.lit(0.0)).alias(c) for c in ("total_ms", *[f"{p}_ms" for p in PHASES], "avg_step_ms")]
    d = d.join(phase_sums(marks, key), key, "left").select(*d.columns, *zero, F.coalesce("agent_steps", F.lit(0)).alias("agent_steps"))
    return token_metrics(d, "answer", "context", "total_ms")


def run_averages(bundle: DataFrame, by: list[str]) -> DataFrame:
    """by, n and the mean of each metric that the bundle has: nulls are left out, and a mean of none is 0."""
    return bundle.groupBy(*by).agg(F.count("*").alias("n"), *[F.coalesce(F.avg(m), F.lit(0.0)).alias(m) for m in AVERAGED if m in bundle.columns])


def with_defaults(results: DataFrame, configs: DataFrame, key: str, defaults: dict) -> DataFrame:
    """results with their configuration's columns by name, and the defaults where it is unknown."""
    c = configs.select(F.col(key).alias("_key"), *defaults)
    return results.join(c, F.col(key) == F.col("_key"), "left").select(*results.columns, *[F.coalesce(F.col(k), F.lit(v)).alias(k) for k, v in defaults.items()])


def ablation_study(questions: DataFrame, configs: DataFrame, answer, score) -> DataFrame:
    """name, ord, questions, failed, score: every configuration (ord, name, ...) asked every question (query_id, ...).

    answer(pairs) gives the pairs an `answer`, null where a question failed, which scores 0 and keeps the study going;
    score(answers) gives them a `score`. Both are plans over all pairs, not loops.
    """
    pairs = questions.crossJoin(F.broadcast(configs))
    d = score(answer(pairs))
    failed = F.col("answer").isNull()
    s = F.when(failed, 0.0).otherwise(F.coalesce(F.nanvl("score", F.lit(0.0)), F.lit(0.0)))
    return d.groupBy("ord", "name").agg(F.count("*").alias("questions"), F.count_if(failed).alias("failed"), (F.sum(s) / F.count("*")).alias("score"))


def evaluate_run(questions: DataFrame, rag, plain, score) -> DataFrame:
    """questions with rag_score, plain_score and improvement_pct: both answers of every question, in one plan.

    rag(questions) and plain(questions) give (query_id, answer); score(answers) gives (query_id, score).
    """
    one = lambda make, name: score(questions.join(make(questions).select("query_id", "answer"), "query_id", "left")).select("query_id", F.coalesce("score", F.lit(0.0)).alias(name))
    d = questions.join(one(rag, "rag_score"), "query_id").join(one(plain, "plain_score"), "query_id")
    return d.withColumn("improvement_pct", improvement(F.col("plain_score"), F.col("rag_score")))


def ablation_report(results: DataFrame, date: str = "") -> str:
    """The study's result as Markdown: best configurations, and a row each. results: name, ord, faithfulness,
    answer_relevancy, context_precision, hallucination_rate, total_ms, agent_steps, <phase>_ms; few rows."""
    rows = [r.asDict() for r in results.orderBy("ord").collect()]
    pct, ms = (lambda v: f"{100 * v:.1f}%"), (lambda v: f"{v:.0f}")
    best = lambda m, least=False: (min if least else max)(rows, key=lambda r: r[m])
    top = (("Faithfulness Terbaik", "faithfulness", False, pct), ("Relevancy Terbaik", "answer_relevancy", False, pct), ("Halusinasi Terendah", "hallucination_rate", True, pct), ("Latensi Terendah", "total_ms", True, lambda v: ms(v) + "ms"))
    out = ["# Laporan Studi Ablasi RAG", f"Tanggal: {date}", "## Ringkasan Eksekutif"]
    if rows:
        out.append("\n".join(f"- **{label}**: {best(m, least)['name']} ({fmt(best(m, least)[m])})" for label, m, least, fmt in top))
    line = lambda cells: "| " + " | ".join(cells) + " |"
    table = lambda head, cells: "\n".join([line(head), "|" + "---|" * len(head), *[line(cells(r)) for r in rows]])
    detail = table(("Konfigurasi", "Faithfulness", "Relevancy", "Precision", "Hallucination", "Latency (ms)", "Agent Steps"), lambda r: [r["name"], *[pct(r[m]) for m in ("faithfulness", "answer_relevancy", "context_precision", "hallucination_rate")], ms(r["total_ms"]), str(r["agent_steps"])])
    phases = ("total", "retrieval", "reranking", "generation", "planning")
    latency = table(("Konfigurasi", "Total", "Retrieval", "Reranking", "Generation", "Agent Reasoning"), lambda r: [r["name"], *[ms(r[f"{p}_ms"]) + "ms" for p in phases]])
    return "\n\n".join([*out, "## Hasil Detail", detail, "## Analisis Latensi", latency]) + "\n"
