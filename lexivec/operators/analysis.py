"""The analysis of an experiment: comparisons, ablations, latencies and their report, composed of statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexivec.operators import stats as X

ALPHA = 0.05


def compare(rows: DataFrame, by: list[str], rag: str, plain: str, paired: bool = True) -> DataFrame:
    """by, and of both columns n, mean and sd, the test's t, df, p and d, improvement and improvement_pct (0 over a mean of 0).

    paired: the columns of one row belong together; else Welch's test of two samples.
    """
    describe = lambda c, name: [F.count(c).alias(f"{name}_n"), F.avg(c).alias(f"{name}_mean"), F.stddev_samp(c).alias(f"{name}_sd")]
    both = rows.groupBy(*by).agg(*describe(rag, "rag"), *describe(plain, "plain"))
    if paired:
        test = X.paired_t(rows, by, rag, plain).select(*by, "t", "df", "p", "d")
    else:
        long = rows.select(*by, F.explode(F.array(F.struct(F.lit(1).alias("g"), F.col(rag).alias("x")), F.struct(F.lit(2).alias("g"), F.col(plain).alias("x")))).alias("e")).select(*by, "e.*")
        test = welch_by(long, by, "g", "x", 1, 2).select(*by, "t", "df", "p", "d")
    d = both.join(test, by)
    d = d.withColumn("improvement", F.col("rag_mean") - F.col("plain_mean"))
    return d.withColumn("improvement_pct", F.when(F.col("plain_mean") != 0, F.col("improvement") / F.col("plain_mean") * 100).otherwise(0.0)).withColumn("significant", F.coalesce(F.col("p") < ALPHA, F.lit(False)))


def welch_by(df: DataFrame, by: list[str], group: str, x: str, first, second) -> DataFrame:
    """Welch's test of two groups, for each key of `by`: m1, m2, t, df, p, pooled d."""
    of = lambda k, g: [F.count(F.when(F.col(group) == g, F.col(x))).cast("double").alias(f"n{k}"), F.avg(F.when(F.col(group) == g, F.col(x))).alias(f"m{k}"), F.var_samp(F.when(F.col(group) == g, F.col(x))).alias(f"s{k}")]
    d = (df.groupBy(*by) if by else df.groupBy()).agg(*of(1, first), *of(2, second))
    d = d.withColumn("v1", F.expr("s1 / n1")).withColumn("v2", F.expr("s2 / n2"))
    d = d.withColumn("t", F.expr("try_divide(m1 - m2, sqrt(v1 + v2))")).withColumn("df", F.expr("pow(v1 + v2, 2) / (v1 * v1 / (n1 - 1) + v2 * v2 / (n2 - 1))"))
    return d.select(*by, "m1", "m2", "t", "df", X.t_p(F.col("t"), F.col("df")).alias("p"), F.expr("(m1 - m2) / sqrt(((n1 - 1) * s1 + (n2 - 1) * s2) / (n1 + n2 - 2))").alias("d"))


def ablation_rankings(scores: DataFrame, name: str, x: str) -> DataFrame:
    """name, n, mean, lower, upper, place: configurations by their mean, best first; ties by name."""
    d = X.mean_interval(scores, [name], x)
    return d.select(name, "n", "mean", "lower", "upper", F.row_number().over(Window.orderBy(F.desc("mean"), name)).cast("long").alias("place"))


def significant_pairs(scores: DataFrame, name: str, x: str) -> DataFrame:
    """a, b, q, p of the pairs that a post-hoc test tells apart; none unless the analysis of variance is significant."""
    gate = X.anova(scores, name, x).filter(F.col("p") < ALPHA).select(F.lit(True).alias("_gate"))
    return X.tukey(scores, name, x).filter(F.col("p") < ALPHA).crossJoin(F.broadcast(gate)).drop("_gate")


def ablation_analysis(scores: DataFrame, name: str, x: str) -> dict[str, DataFrame]:
    """anova, rankings, best and significant differences of configurations."""
    rankings = ablation_rankings(scores, name, x)
    return {"anova": X.anova(scores, name, x), "rankings": rankings, "best": rankings.filter("place = 1").select(name), "significant": significant_pairs(scores, name, x)}


def is_agentic(name: Column, ignore_case: bool = False) -> Column:
    """Whether a configuration works with an agent, by its name. Names in lower case count only if case is ignored."""
    n = F.lower(name) if ignore_case else name
    return n.contains("agentic" if ignore_case else "Agentic") | n.contains("full" if ignore_case else "Full")


def agentic_latency(latencies: DataFrame, name: str, ms: str, ignore_case: bool = False) -> DataFrame:
    """agentic, plain (mean latencies), difference, t, df, p, significant: Welch's test; no row unless both kinds occur."""
    d = latencies.withColumn("_g", is_agentic(F.col(name), ignore_case).cast("int"))
    t = welch_by(d, [], "_g", ms, 1, 0).filter(F.col("m1").isNotNull() & F.col("m2").isNotNull())
    return t.select(F.col("m1").alias("agentic"), F.col("m2").alias("plain"), (F.col("m1") - F.col("m2")).alias("difference"), "t", "df", "p", F.coalesce(F.col("p") < ALPHA, F.lit(False)).alias("significant"))


def grouped_scores(results: DataFrame, name: str, metrics: list[str]) -> DataFrame:
    """name, n and, per metric, the values of its rows in order of `ord`: one configuration's questions, which are bounded."""
    lists = [F.transform(F.sort_array(F.collect_list(F.struct("ord", F.col(m).alias("v")))), lambda s: s["v"]).alias(m) for m in metrics]
    return results.groupBy(name).agg(F.count("*").alias("n"), *lists)


def comparison_rows(runs: DataFrame, rate: str = "hallucination_rate", latency: str = "latency_ms") -> DataFrame:
    """runs with factual (100 times what is not invented) and axis (the greatest latency of all runs, for a chart)."""
    top = runs.agg(F.max(latency).alias("axis"))
    return runs.withColumn("factual", (1 - F.col(rate)) * 100).crossJoin(F.broadcast(top))


def variants(df: DataFrame, by: list[str], x: str) -> DataFrame:
    """by, cohen_d and sd with the variance of the whole population, as scripts outside Spark often take it."""
    return df.groupBy(*by).agg(F.try_divide(F.avg(x), F.stddev_pop(x)).alias("cohen_d"), F.stddev_pop(x).alias("sd"))


#: Words of the report by language.
_SAID = {
    "en": ("# Statistical Analysis Report", "## RAG vs Non-RAG Comparison", "| Statistic | RAG | Non-RAG |", "Improvement", "## Ablation Study Results", "### Configuration Rankings", "| Rank | Configuration | Mean | 95% CI |", "### Significant Differences (Post-hoc)"),
    "id": ("# Laporan Analisis Statistik", "## Perbandingan RAG vs Non-RAG", "| Statistik | RAG | Non-RAG |", "Peningkatan", "## Hasil Studi Ablasi", "### Peringkat Konfigurasi", "| Peringkat | Konfigurasi | Mean | 95% CI |", "### Perbedaan Signifikan (Post-hoc)"),
}


def report(comparisons: DataFrame, by: str, ablation: dict[str, DataFrame] | None = None, name: str = "name", language: str = "en", date: str = "") -> str:
    """A report of small results as Markdown. The interval is that of the mean, from its deviation."""
    head, versus, columns, gain, study, ranking, ranks, apart = _SAID[language]
    out = [head, f"{'Tanggal' if language == 'id' else 'Date'}: {date}", versus]
    margin = X.t_critical(F.col("rag_n") - 1) * F.col("rag_sd") / F.sqrt(F.col("rag_n").cast("double"))
    for r in comparisons.withColumn("margin", margin).orderBy(by).collect():
        m, e = r["rag_mean"], r["margin"] or 0.0
        out += [f"### {r[by]}", "\n".join([columns, "|---|---|---|", f"| Mean | {m:.4f} | {r['plain_mean']:.4f} |", f"| Std Dev | {r['rag_sd'] or 0:.4f} | {r['plain_sd'] or 0:.4f} |", f"| 95% CI | [{m - e:.4f}, {m + e:.4f}] | - |"])]
        out += [f"t({r['df']:g}) = {r['t'] or 0:.4f}, p = {r['p']:.4f}, d = {r['d'] or 0:.4f}", f"**{gain}:** {r['improvement']:+.4f} ({r['improvement_pct']:.1f}%)"]
    if ablation:
        a = ablation["anova"].first()
        out += [study, f"F({a['df_between']}, {a['df_within']}) = {a['f'] or 0:.4f}, p = {a['p']:.4f}, eta2 = {a['eta2'] or 0:.4f} ({a['effect']})", ranking]
        out.append("\n".join([ranks, "|---|---|---|---|", *[f"| {r['place']} | {r[name]} | {r['mean']:.4f} | [{r['lower']:.4f}, {r['upper']:.4f}] |" for r in ablation["rankings"].orderBy("place").collect()]]))
        if pairs := ablation["significant"].orderBy("a", "b").collect():
            out += [apart, "\n".join(f"- {r['a']} vs {r['b']}" for r in pairs)]
    return "\n\n".join(out) + "\n"


def run_analysis(questions: DataFrame, metrics: list[str], scores: DataFrame, x: str, latency: str, language: str = "en") -> dict:
    """The whole analysis: questions (rag_<metric>, plain_<metric>), scores (name, x, latency) of configurations.

    descriptions, comparisons, ablation, latencies (with the order statistics of the values, not of copies of their mean),
    agentic (names regardless of case) and the report.
    """
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"rag_{m}").alias("rag"), F.col(f"plain_{m}").alias("plain")) for m in metrics]))
    long = questions.select(each.alias("e")).select("e.*")
    from lexivec.operators.evaluate import latency_profile

    out = {"descriptions": X.describe(long, ["metric"], "rag"), "comparisons": compare(long, ["metric"], "rag", "plain"), "ablation": ablation_analysis(scores, "name", x)}
    out |= {"latencies": latency_profile(scores, "name", latency), "agentic": agentic_latency(scores, "name", latency, True)}
    return out | {"report": report(out["comparisons"], "metric", out["ablation"], language=language)}


def completed(questions: DataFrame, run: str, run_id) -> DataFrame:
    """A run's questions that have been answered."""
    return questions.filter((F.col(run) == F.lit(run_id)) & F.col("answer").isNotNull())
