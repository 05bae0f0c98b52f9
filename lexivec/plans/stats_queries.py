"""Queries of statistics, summaries and exports, with their SQL. Doubles are rounded at the end."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexivec.compat import spread
from lexivec.operators import chunking as C
from lexivec.operators import evaluate as E
from lexivec.operators import stats as X
from lexivec.functions import lexicon as L


def _t(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _rounded(df, digits=6):
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _r(columns: str) -> str:
    return ", ".join(f"round({c}, 6) {c}" for c in columns.split())


def _t_crit(df: str, table=L.T_05) -> str:
    return "case " + " ".join(f"when {df} >= {d} then {v}::double" for d, v in table) + f" else {table[-1][1]}::double end"


_TP = "case when df > 30 then 2 * exp(-t * t / 2) / 2.5066282746310002 * (1 + 0.2316419::double * abs(t)) when abs(t) > 4 then 0.001 when abs(t) > 3 then 0.01 when abs(t) > 2 then 0.05 when abs(t) > 1.5 then 0.15 else 0.5 end"


def describe_stats(spark, sf):
    return _rounded(X.describe(_t(spark, sf, "events"), ["event_type"], "value"))


def paired_ttest(spark, sf):
    return _rounded(X.paired_t(_t(spark, sf, "lineitem"), ["l_returnflag"], "l_tax", "l_discount"))


def welch_ttest(spark, sf):
    return _rounded(X.welch_t(_t(spark, sf, "orders"), "o_orderstatus", "o_totalprice", "F", "O"))


def anova(spark, sf):
    return _rounded(X.anova(_t(spark, sf, "orders"), "o_orderpriority", "o_totalprice"))


def tukey(spark, sf):
    return _rounded(X.tukey(_t(spark, sf, "orders"), "o_orderpriority", "o_totalprice"))


def mean_ci(spark, sf):
    return _rounded(X.mean_interval(_t(spark, sf, "events"), ["event_type"], "value"))


def bootstrap_ci(spark, sf):
    return _rounded(X.bootstrap_mean(spread(_t(spark, sf, "events")), ["event_type"], "value", "event_id"), 4)


def rag_comparison(spark, sf):
    o = _t(spark, sf, "orders").withColumn("other", F.col("o_totalprice") * 0.9)
    d = o.groupBy("o_orderpriority").agg(F.avg("o_totalprice").alias("rag"), F.avg("other").alias("plain"), F.count("*").alias("n"))
    d = d.withColumn("improvement", F.col("rag") - F.col("plain")).withColumn("percent", E.improvement(F.col("plain"), F.col("rag")))
    return _rounded(d, 4)


def ablation_rank(spark, sf):
    from pyspark.sql import Window

    d = X.mean_interval(_t(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice")
    d = d.withColumn("mean", F.round("mean", 4)).withColumn("place", F.row_number().over(Window.orderBy(F.desc("mean"), "l_returnflag", "l_linestatus")).cast("long"))
    return _rounded(d, 4)


def pearson_matrix(spark, sf):
    return _rounded(X.pearson(_t(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]))


def cronbach(spark, sf):
    return _rounded(X.cronbach(_t(spark, sf, "lineitem"), ["l_quantity", "l_discount", "l_tax"]))


def run_summary(spark, sf):
    o = _t(spark, sf, "orders")
    return _rounded(o.groupBy("o_orderstatus").agg(F.count("*").alias("total"), F.count_if(F.col("o_totalprice").isNotNull()).alias("completed"), F.coalesce(F.avg("o_totalprice"), F.lit(0.0)).alias("avg_price"), F.coalesce(F.avg(F.when(F.col("o_totalprice") < 0, F.col("o_totalprice"))), F.lit(0.0)).alias("avg_none")), 4)


def improvement_pct(spark, sf):
    d = _t(spark, sf, "lineitem").groupBy("l_linenumber").agg(F.avg("l_tax").alias("a"), F.avg("l_discount").alias("b"))
    return _rounded(d.select("l_linenumber", E.improvement(F.col("b"), F.col("a")).alias("pct"), E.improvement(F.lit(0.0), F.col("a")).alias("pct_zero")))


def status_counts(spark, sf):
    e = _t(spark, sf, "events")
    return e.agg(F.count("*").alias("total"), *[F.count_if(F.col("event_type") == k).alias(k) for k in ("purchase", "click", "error")], F.countDistinct("user_id").alias("users"))


def latency_profile(spark, sf):
    return _rounded(E.latency_profile(_t(spark, sf, "events"), "event_type", "value"), 4)


def step_durations(spark, sf):
    from pyspark.sql import Window

    e = _t(spark, sf, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    w = Window.partitionBy("user_id").orderBy("us", "event_id")
    now = F.unix_micros(F.lit("2100-01-01 00:00:00").cast("timestamp"))
    return e.select("user_id", "event_id", (F.coalesce(F.lead("us").over(w), now) - F.col("us")).alias("duration_us"), (F.col("us") - F.lag("us").over(w)).alias("phase_us"))


def active_heading_asof(spark, sf):
    """Each event's last order not after it, per customer: events as chunks, orders as headings, by their time."""
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    e = _t(spark, sf, "events").select(F.col("user_id").alias("doc_id"), "event_id", us("ts").alias("start"))
    o = _t(spark, sf, "orders").groupBy(F.col("o_custkey").alias("doc_id"), us("o_orderdate").alias("offset")).agg(F.max("o_orderkey").cast("string").alias("heading"))
    return C.active_heading(e, o).select("event_id", F.col("active_heading").cast("long").alias("heading"))


def hallucination_summary(spark, sf):
    c = _t(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'").select("c_custkey")
    o = _t(spark, sf, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"))
    return _rounded(o.agg(F.avg("o_totalprice").alias("avg_price"), F.count("*").alias("n")), 4)


def ablation_cross(spark, sf):
    """The study with a made-up answer and score: every seventh question fails, and counts as 0."""
    q = _t(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.length("text").alias("n"))
    answer = lambda d: d.withColumn("answer", F.when((F.col("query_id") + F.col("ord")) % 7 != 0, "an answer"))
    score = lambda d: d.withColumn("score", (F.col("n") % (F.col("ord") + 2)).cast("double"))
    return _rounded(E.ablation_study(q, E.ablation_configs(spark), answer, score).select("name", "questions", "score"))


def ablation_best(spark, sf):
    d = ablation_cross(spark, sf).join(E.ablation_configs(spark).select("name", "ord"), "name")
    return E.best_of(d, "name", "score")


def session_list(spark, sf):
    c = _t(spark, sf, "conversations")
    d = c.groupBy("conv_id").agg(F.count("*").alias("messages"), F.max("turn").alias("last_turn"), F.max_by("text", F.when(F.col("role") == "user", F.col("turn"))).alias("last_user_text"))
    return d


def message_history(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return _t(spark, sf, "conversations").withColumn("back", F.row_number().over(w).cast("long")).filter("back <= 10").select("conv_id", "turn", "role", "back")


def session_merge(spark, sf):
    """Stored sessions override local ones of the same id; local ones without a stored one stay."""
    db = _t(spark, sf, "conversations").groupBy("conv_id").agg(F.max("turn").alias("turns"))
    local = _t(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("conv_id"), F.col("n_name").alias("title"))
    d = local.join(db, "conv_id", "full_outer")
    return d.select("conv_id", F.coalesce(F.concat(F.lit("stored "), F.col("turns").cast("string")), "title").alias("title"))


def tombstone_delete(spark, sf):
    """Deletes orders by key, and their items with them."""
    from lexivec.sources.sinks import cascade

    gone = _t(spark, sf, "orders").filter("o_orderkey % 7 = 0").select("o_orderkey")
    tables = {"orders": _t(spark, sf, "orders"), "lineitem": _t(spark, sf, "lineitem")}
    left = cascade(tables, gone, "orders", "o_orderkey", {"lineitem": ("l_orderkey", "o_orderkey")})["lineitem"]
    return left.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.countDistinct("l_orderkey").alias("orders"))


def csv_rows(spark, sf):
    from lexivec.sources.sinks import csv_lines

    return csv_lines(_t(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment"))


def json_rows(spark, sf):
    from lexivec.sources.sinks import json_rows as rows

    return rows(_t(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey")).select("n_nationkey", F.col("value").alias("json"))


def latest_version(spark, sf):
    """The last change of each key in an append-only log; of one time, that of the greatest id."""
    from lexivec.sources.sinks import current

    e = _t(spark, sf, "events").withColumn("version", F.struct("ts", "event_id"))
    return current(e, "user_id", "version").select("user_id", "event_id", "event_type")


QUERIES = {
    f.__name__: f
    for f in (
        describe_stats, paired_ttest, welch_ttest, anova, tukey, mean_ci, bootstrap_ci, rag_comparison, ablation_rank, pearson_matrix, cronbach, run_summary, improvement_pct,
        status_counts, latency_profile, step_durations, active_heading_asof, hallucination_summary, ablation_cross, ablation_best, session_list, message_history, session_merge,
        tombstone_delete, csv_rows, json_rows, latest_version,
    )
}

_MOM = "m as (select o_orderpriority g, count(o_totalprice)::double n, avg(o_totalprice) m, var_pop(o_totalprice) * count(o_totalprice) ss from orders group by 1)"
_CROSS = "cfg(ord, name) as (values " + ", ".join(f"({k}, '{x[0]}')" for k, x in enumerate(E.ABLATIONS)) + "), cr as (select name, ord, count(*) questions, round(sum(coalesce(case when (item_id + ord) % 7 = 0 then null else length(text) % (ord + 2) end, 0)) / count(*), 6) score from benchmark, cfg group by 1, 2)"
_QP = "case when q > 5 then 0.001 when q > 4 then 0.01 when q > 3.5 then 0.05 when q > 3 then 0.1 else 0.5 end"

_ITEMS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")

ORACLES = {
    "describe_stats": f"select event_type, n, {_r('mean median variance sd min max range sem skewness kurtosis')} from (select event_type, count(value) n, avg(value) mean, median(value) median, var_samp(value) variance, stddev_samp(value) sd, min(value) min, max(value) max, max(value) - min(value) as range, stddev_samp(value) / sqrt(count(value)) sem, skewness(value) skewness, kurtosis(value) kurtosis from events group by 1)",
    "paired_ttest": f"with a as (select l_returnflag, count(*) n, avg(l_tax - l_discount) mean, stddev_samp(l_tax - l_discount) sd from lineitem group by 1), b as (select *, sd / sqrt(n) sem, mean / (sd / sqrt(n)) t, n - 1 df from a) select l_returnflag, n, round(t, 6) t, df, round({_TP}, 6) p, round(mean / sd, 6) d, round(mean - {_t_crit('df')} * sem, 6) lower, round(mean + {_t_crit('df')} * sem, 6) upper from b",
    "welch_ttest": f"with a as (select count(*) filter (o_orderstatus = 'F')::double n1, count(*) filter (o_orderstatus = 'O')::double n2, avg(o_totalprice) filter (o_orderstatus = 'F') m1, avg(o_totalprice) filter (o_orderstatus = 'O') m2, var_samp(o_totalprice) filter (o_orderstatus = 'F') s1, var_samp(o_totalprice) filter (o_orderstatus = 'O') s2 from orders), b as (select *, s1 / n1 v1, s2 / n2 v2 from a), c as (select *, m1 - m2 diff, sqrt(v1 + v2) se, (m1 - m2) / sqrt(v1 + v2) t, pow(v1 + v2, 2) / (v1 * v1 / (n1 - 1) + v2 * v2 / (n2 - 1)) df from b) select round(t, 6) t, round(df, 6) df, round({_TP}, 6) p, round(diff / sqrt(((n1 - 1) * s1 + (n2 - 1) * s2) / (n1 + n2 - 2)), 6) d, round(diff - {_t_crit('round(df)')} * se, 6) lower, round(diff + {_t_crit('round(df)')} * se, 6) upper from c",
    "anova": f"with {_MOM}, a as (select count(*) k, sum(n) n, sum(n * m * m) - pow(sum(n * m), 2) / sum(n) ssb, sum(ss) ssw from m), b as (select k, k - 1 df_between, (n - k)::bigint df_within, (ssb / (k - 1)) / (ssw / (n - k)) f, ssb / (ssb + ssw) eta2 from a) select k, df_between, df_within, round(f, 6) f, case when f < 1 then 0.5 when f > 10 then 0.001 when f > 5 then 0.01 when f > 3 then 0.05 when f > 2 then 0.15 else 0.3 end::double p, round(eta2, 6) eta2, case when eta2 < 0.01 then 'negligible' when eta2 < 0.06 then 'small' when eta2 < 0.14 then 'medium' else 'large' end effect from b",
    "tukey": f"with {_MOM}, w as (select sum(ss) / (sum(n) - count(*)) msw from m), d as (select a.g a, b.g b, abs(a.m - b.m) / sqrt(msw * (1 / a.n + 1 / b.n) / 2) q from m a join m b on a.g < b.g, w) select a, b, round(q, 6) q, {_QP}::double p from d",
    "mean_ci": f"with a as (select event_type, count(value) n, avg(value) mean, {_t_crit('count(value) - 1')} * stddev_samp(value) / sqrt(count(value)) margin from events group by 1) select event_type, n, {_r('mean margin')}, round(mean - margin, 6) lower, round(mean + margin, 6) upper from a",
    "bootstrap_ci": "with d as (select event_type, event_id, value, i, ('0x' || substr(md5(event_id || ':' || i), 1, 8))::bigint / 4294967296.0::double u from events, range(1000) r(i)), w as (select event_type, i, value, (u >= 0.36787944117144233)::int + (u >= 0.7357588823428847)::int + (u >= 0.9196986029286058)::int + (u >= 0.9810118431238462)::int + (u >= 0.9963401531726563)::int + (u >= 0.9994058151824183)::int + (u >= 0.9999167588507119)::int w from d), m as (select event_type, i, sum(w * value) / sum(w) m from w group by 1, 2), l as (select event_type, list_sort(list(m)) ms from m group by 1) select event_type, round(ms[26], 4) lower, round(ms[976], 4) upper, round((select avg(value) from events e where e.event_type = l.event_type), 4) estimate from l",
    "rag_comparison": "with d as (select o_orderpriority, avg(o_totalprice) rag, avg(o_totalprice * 0.9::double) plain, count(*) n from orders group by 1) select o_orderpriority, round(rag, 4) rag, round(plain, 4) plain, n, round(rag - plain, 4) improvement, round(case when plain = 0 then case when rag > 0 then 100 else 0 end else (rag - plain) / plain * 100 end, 4) percent from d",
    "ablation_rank": f"with a as (select l_returnflag, l_linestatus, count(*) n, avg(l_extendedprice) m, {_t_crit('count(*) - 1')} * stddev_samp(l_extendedprice) / sqrt(count(*)) margin from lineitem group by 1, 2) select l_returnflag, l_linestatus, n, round(m, 4) mean, round(margin, 4) margin, round(m - margin, 4) lower, round(m + margin, 4) upper, row_number() over (order by round(m, 4) desc, l_returnflag, l_linestatus) place from a",
    "pearson_matrix": "select a, b, round(r, 6) r, n from (" + " union all ".join(f"select '{a}' a, '{b}' b, corr({a}, {b}) r, count(*) filter ({a} is not null and {b} is not null) n from lineitem" for i, a in enumerate(_ITEMS) for b in _ITEMS[i + 1 :]) + ") where n >= 3",
    "cronbach": "select round(1.5::double * (1 - (var_samp(l_quantity) + var_samp(l_discount) + var_samp(l_tax)) / var_samp(l_quantity + l_discount + l_tax)), 6) alpha from lineitem",
    "run_summary": "select o_orderstatus, count(*) total, count(o_totalprice) completed, round(coalesce(avg(o_totalprice), 0), 4) avg_price, round(coalesce(avg(o_totalprice) filter (o_totalprice < 0), 0), 4) avg_none from orders group by 1",
    "improvement_pct": "with d as (select l_linenumber, avg(l_tax) a, avg(l_discount) b from lineitem group by 1) select l_linenumber, round(case when b = 0 then case when a > 0 then 100 else 0 end else (a - b) / b * 100 end, 6) pct, case when a > 0 then 100::double else 0 end pct_zero from d",
    "status_counts": "select count(*) total, count(*) filter (event_type = 'purchase') purchase, count(*) filter (event_type = 'click') click, count(*) filter (event_type = 'error') error, count(distinct user_id) users from events",
    "latency_profile": "with l as (select event_type, list_sort(list(value)) v, count(*) n, sum(value) total, avg(value) a, stddev_pop(value) sd from events group by 1) select event_type, n, round(total, 4) total, round(a, 4) avg, round(sd, 4) sd, round(v[floor(n * 0.5)::bigint + 1], 4) p50, round(v[floor(n * 0.95)::bigint + 1], 4) p95, round(v[floor(n * 0.99)::bigint + 1], 4) p99 from l",
    "step_durations": "select user_id, event_id, coalesce(lead(epoch_us(ts)) over w, epoch_us(timestamp '2100-01-01')) - epoch_us(ts) duration_us, epoch_us(ts) - lag(epoch_us(ts)) over w phase_us from events window w as (partition by user_id order by epoch_us(ts), event_id)",
    "active_heading_asof": "with o as (select o_custkey, o_orderdate, max(o_orderkey) o_orderkey from orders group by 1, 2) select event_id, o_orderkey heading from events e asof left join o on e.user_id = o.o_custkey and e.ts >= o.o_orderdate",
    "hallucination_summary": "select round(avg(o_totalprice), 4) avg_price, count(*) n from orders join customer on o_custkey = c_custkey where c_mktsegment = 'BUILDING'",
    "ablation_cross": f"with {_CROSS} select name, questions, score from cr",
    "ablation_best": f"with {_CROSS} select name best, score as value from cr order by score desc, ord limit 1",
    "session_list": "select conv_id, count(*) messages, max(turn) last_turn, max_by(text, turn) filter (role = 'user') last_user_text from conversations group by 1",
    "message_history": "select conv_id, turn, role, row_number() over (partition by conv_id order by turn desc) back from conversations qualify back <= 10",
    "session_merge": "with d as (select conv_id, max(turn) turns from conversations group by 1) select conv_id, coalesce('stored ' || turns, n_name) title from (select n_nationkey::bigint conv_id, n_name from nation) full join d using (conv_id)",
    "tombstone_delete": "select l_returnflag, count(*) n, count(distinct l_orderkey) orders from lineitem where l_orderkey not in (select o_orderkey from orders where o_orderkey % 7 = 0) group by 1",
    "csv_rows": "select c_custkey || ',' || case when regexp_matches(c_name, '[,\"\\n]') then '\"' || replace(c_name, '\"', '\"\"') || '\"' else c_name end || ',' || printf('%.4f', c_acctbal) || ',' || c_mktsegment line from customer",
    "json_rows": "select n_nationkey, '{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\",\"n_regionkey\":' || n_regionkey || '}' json from nation",
    "latest_version": "select user_id, event_id, event_type from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1",
}
