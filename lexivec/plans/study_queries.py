"""Queries of document facts, an experiment's analysis and an agent's tools, with their SQL."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from lexivec.functions import lexicon as L
from lexivec.functions import text as T
from lexivec.functions.automaton import with_seen
from lexivec.compat import written
from lexivec.operators import agent, analysis, guard
from lexivec.operators import agent_loop as agent_loop_
from lexivec.operators import chunking as C
from lexivec.operators import domain as D
from lexivec.operators import evaluate as E
from lexivec.operators.agent_loop import BLOCKED
from lexivec.operators.retrieval import sent_if_few
from lexivec.plans import sql as S
from lexivec.plans import study
from lexivec.plans.retrieval_queries import _FUSED, _KEYWORD, _VEC, EVERY, _bm25_sql, _pool, _queries
from lexivec.plans.stats_queries import _rounded, _t_crit
from lexivec.plans.text_queries import _DISTINCT, _KW_SQL, _PII_SQL, _TYPE_SQL, _docs, _joined, _norm_sql, _t, _texts
from lexivec.providers import overlap
from lexivec.sources import readers


def headings_offsets(spark, sf):
    return D.placed_headings(_texts(spark, sf))


def typed_sections(spark, sf):
    return D.typed_sections(_texts(spark, sf))


def document_facts(spark, sf):
    t = F.col("text")
    d, seen = with_seen(_texts(spark, sf), F.lower(t), T.needs([a for a, _ in L.ABSTRACTS], L.TABLE_HEADER))
    return d.select("doc_id", T.abstract(t, seen).alias("abstract"), T.has_table(t, seen).alias("has_table"))


def metadata_bundle(spark, sf):
    d = D.metadata(_texts(spark, sf))
    return d.select("doc_id", "doc_type", "language", _joined(F.col("citations")).alias("citations"), _joined(F.col("keywords")).alias("keywords"), F.size("sections").cast("long").alias("n_sections"))


def file_titles(spark, sf):
    d = _t(spark, sf, "pages").select("page_id", F.element_at(F.split("url", "/"), -1).alias("name"), F.concat_ws(" , ", F.lit("a"), F.col("page_id").cast("string"), F.lit("")).alias("tags"))
    return d.select("page_id", T.title_of(F.col("name")).alias("title"), F.array_join(T.tags_of(F.col("tags")), ",").alias("tags"))


def rag_vs_plain(spark, sf):
    return _rounded(analysis.compare(_t(spark, sf, "lineitem"), ["l_linenumber"], "l_discount", "l_tax"))


def rag_vs_plain_unpaired(spark, sf):
    return _rounded(analysis.compare(_t(spark, sf, "lineitem"), ["l_returnflag"], "l_discount", "l_tax", paired=False))


def ablation_rankings(spark, sf):
    return _rounded(analysis.ablation_rankings(_t(spark, sf, "lineitem"), "l_linenumber", "l_quantity"))


def significant_pairs(spark, sf):
    """Order prices by status: a wide enough gap is significant."""
    o = _t(spark, sf, "orders").select("o_orderstatus", (F.col("o_totalprice") + F.when(F.col("o_orderstatus") == "F", 50000.0).otherwise(0.0)).alias("x"))
    return _rounded(analysis.significant_pairs(o, "o_orderstatus", "x"))


def agentic_latency(spark, sf):
    name = F.when(F.col("event_type") == "view", "Agentic mode").when(F.col("event_type") == "click", "Full system").otherwise(F.col("event_type"))
    return _rounded(analysis.agentic_latency(_t(spark, sf, "events").select(name.alias("name"), "value"), "name", "value"))


def grouped_scores(spark, sf):
    d = analysis.grouped_scores(_t(spark, sf, "nation").withColumn("ord", F.col("n_nationkey")), "n_regionkey", ["n_nationkey", "n_name"])
    return d.select("n_regionkey", "n", _joined(F.col("n_nationkey")).alias("keys"), _joined(F.col("n_name")).alias("names"))


def comparison_rows(spark, sf):
    runs = _t(spark, sf, "events").groupBy("event_type").agg((F.avg(F.col("event_id") % 100) / 100).alias("hallucination_rate"), F.max("value").alias("latency_ms"))
    return _rounded(analysis.comparison_rows(runs))


def population_variants(spark, sf):
    return _rounded(analysis.variants(_t(spark, sf, "events"), ["event_type"], "value"))


def _answers(spark, sf):
    """Assistant turns with the other turns of their conversation, and a made-up one for each branch."""
    c = _t(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    made = spark.sql("""select * from values (-1L, 0L, 'user', 'Doe wrote in 2020 on maps'), (-1L, 1L, 'assistant', 'As (Doe, 2020) said [1] and (Roe, 1999) too'),
      (-1L, 2L, 'assistant', 'racist words'), (-1L, 3L, 'assistant', 'mail a@b.co, always 50% of it'), (-2L, 1L, 'assistant', 'a study (Poe, 1990) found it')  as v(conv_id, turn, role, text)""")
    c = c.unionByName(made)
    context = c.filter("role <> 'assistant'").groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), " ").alias("context"))
    return c.filter("role = 'assistant'").join(context, "conv_id", "left")


def output_guard(spark, sf):
    d = guard.validate_output(_answers(spark, sf), "text", "context", invented=F.length("text") % 2 == 0)
    return d.select("conv_id", "turn", _joined(F.col("pii")).alias("pii"), _joined(F.col("toxic")).alias("toxic"), "risky", "hallucinated", _joined(F.col("unverified")).alias("unverified"), "blocked", "severity")


def audit_log(spark, sf):
    return guard.audit_rows(guard.validate_input(_texts(spark, sf)), "doc_id", "input")


def token_metrics(spark, sf):
    d = E.token_metrics(_answers(spark, sf).withColumn("ms", (F.col("turn") * 100).cast("double")), "text", "context", "ms")
    return _rounded(d.select("conv_id", "turn", "answer_tokens", "context_tokens", "tokens_per_second", "token_efficiency"))


_PHASE = "case event_type when 'view' then 'retrieval' when 'click' then 'tool_call' when 'purchase' then 'planning' when 'error' then 'generation' else 'other' end"


def phase_sums(spark, sf):
    return _rounded(E.phase_sums(_t(spark, sf, "events").select("user_id", F.expr(_PHASE).alias("phase"), F.col("value").alias("ms")), "user_id"), 8)


def search_tool(spark, sf):
    """Ten sessions, whose parts are the stated queries."""
    hits = _pool(spark, sf, 10).select((F.col("query_id") / 100 % 10).cast("long").alias("session"), F.col("query_id").alias("part"), "rank", F.col("id").alias("chunk"), "score")
    chunks = _t(spark, sf, "documents").select(F.col("doc_id").alias("chunk"), F.concat(F.lit("document "), F.col("doc_id").cast("string")).alias("title"), "text")
    return agent.search_tool(hits, chunks)


def sources_text(spark, sf):
    return agent.sources_text(search_tool(spark, sf))


def distinct_contents(spark, sf):
    d = _t(spark, sf, "documents").select("lang", "doc_id", agent.preview(F.col("text")).alias("content"))
    return agent.distinct_contents(d, "lang", ["doc_id"])


def tool_results(spark, sf):
    o = _t(spark, sf, "orders").select(F.col("o_custkey").alias("session"), F.col("o_orderkey").alias("call_id"), "o_orderstatus", F.col("o_totalprice").alias("output"))
    return agent.called(o.select("session", "call_id"), o.filter("o_orderstatus = 'F'"))


def agent_trace(spark, sf):
    e = _t(spark, sf, "events").filter("event_type <> 'signup'")
    started = e.groupBy("user_id").agg(F.min("ts").alias("started"))
    calls = e.join(started, "user_id").select(F.col("user_id").alias("session"), "started", F.col("ts").alias("at"), F.concat(F.when(F.col("event_type") == "view", "text").otherwise("search")).alias("kind"), F.col("event_id").alias("tokens"))
    return agent.trace(calls)


def config_defaults(spark, sf):
    names = spark.sql("select * from values ('full_system'), ('bm25_only'), ('unknown') as v(name)")
    return E.with_defaults(names, E.ablation_configs(spark), "name", {"retrieval": "hybrid", "reranker": "none", "agentic": False})


def _study(spark, sf):
    """Questions, found contexts of the thirteen configurations: the stated queries, which an agent splits in half, over all
    documents as the chunks of every strategy."""
    q = _queries(spark, sf).filter("query_text is not null and query_vector is not null").select("query_id", "query_text", "query_vector")
    words = F.split("query_text", " ")
    half = F.ceil(F.size(words) / 2).cast("int")
    halves = F.array(F.slice(words, F.lit(1), half), F.slice(words, half + 1, F.greatest(F.size(words) - half, F.lit(0))))
    parts = q.select("query_id", F.posexplode(F.transform(halves, lambda h: F.array_join(h, " "))).alias("part", "query_text"), "query_vector")
    # Only texts that have a vector are moved, and once.
    vectors = _t(spark, sf, "embeddings").filter("embedding is not null").select(F.col("vec_id").alias("id"), "embedding")
    texts = _t(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text").join(sent_if_few(vectors.select("id").distinct(), "id"), "id", "left_semi")
    chunks = written(texts.join(vectors, "id"), "chunks")
    return q, study.contexts(q, dict.fromkeys(("recursive", "semantic", "sentence_window", "hierarchical"), chunks), parts=parts)


def ablation_contexts(spark, sf):
    return _study(spark, sf)[1].select("ord", "query_id", "place", "id", "score")


def ablation_runs(spark, sf):
    """The best context is the answer, and the plain model repeats the question; answers are held against the question's text."""
    q, found = _study(spark, sf)
    answer = lambda d: d.withColumn("answer", F.when(F.col("retrieval") == "none", F.col("query_text")).otherwise(F.get("contexts", F.lit(0))))
    score = lambda d: d.withColumn("score", overlap(F.col("answer"), F.col("query_text")))
    # No answer reads more than the best context, so no other text is kept for them.
    return _rounded(study.run(q, written(found.filter("place = 1"), "contexts"), answer, score).select("name", "questions", "failed", "score"))


def point_lookup(spark, sf):
    return readers.by_key(_t(spark, sf, "documents"), "doc_id", 100).select("doc_id", "lang", "n_chars")


def question_bank(spark, sf):
    q = _t(spark, sf, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("question"), F.when(F.col("item_id") % 2 == 0, "methods").otherwise("facts").alias("category"), F.when(F.col("item_id") % 3 == 0, "hard").otherwise("easy").alias("difficulty"))
    return readers.questions(q, category="methods", difficulty="easy", n=5, seed=7).select("id", "category", "difficulty")


def chunk_dispatch(spark, sf):
    return C.chunk(_texts(spark, sf))


def guardrails_run(spark, sf):
    """Conversations as requests: users' turns with the answer that follows, two requests a minute each."""
    c = _t(spark, sf, "conversations")
    a = c.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    d = c.filter("role = 'user'").join(a, ["conv_id", "turn"], "left")
    ts = F.timestamp_seconds(F.col("turn") * 10)
    return guard.run_guardrails(d.select((F.col("conv_id") * 1000 + F.col("turn")).alias("event_id"), F.col("conv_id").alias("user_id"), ts.alias("ts"), "text", "answer", F.col("text").alias("context")), 2, 60_000)


def agent_loop(spark, sf):
    """The benchmark's texts as questions to a scripted agent: it looks up as many of their words as the id says, one a step,
    every second session also how many documents have the word; beyond its steps the answer is synthesised."""
    q = _t(spark, sf, "benchmark").select(F.col("item_id").alias("session"), F.col("text").alias("query_text"))
    words = _docs(spark, sf).select("doc_id", F.explode(F.array_distinct(F.split(F.lower("text"), " "))).alias("input"))
    facts = written(words.groupBy("input").agg(F.min("doc_id").cast("string").alias("first"), F.count("*").cast("string").alias("n")), "words")
    told = F.concat(F.lit("seen "), F.size(F.filter("observed", lambda o: o["output"].isNotNull())).cast("string"))

    def choose(d):
        calls = F.when(F.col("session") % 2 == 0, F.array(F.lit("search"), F.lit("count"))).otherwise(F.array(F.lit("search")))
        more = F.col("step") < F.col("session") % 7
        word = F.get(F.split(F.lower("query_text"), " "), F.col("step"))
        d = d.select("session", F.posexplode(F.when(more, calls).otherwise(F.array(F.lit(None).cast("string")))).alias("call", "tool"), F.when(more, word).alias("input"), F.when(~more, told).alias("text"))
        return d

    tools = {k: lambda c, k=k: c.join(facts, "input").select("session", "call", F.col("first" if k == "search" else "n").alias("output")) for k in ("search", "count")}
    d = agent_loop_.run(q, choose, tools, synthesise=lambda d: d.select("session", told.alias("text")))
    return d.select("session", "status", "answer", "n_steps", F.size("citations").cast("long").alias("n_citations"))


QUERIES = {
    f.__name__: f
    for f in (
        headings_offsets, typed_sections, document_facts, metadata_bundle, file_titles, rag_vs_plain, rag_vs_plain_unpaired, ablation_rankings, significant_pairs, agentic_latency, grouped_scores,
        comparison_rows, population_variants, output_guard, audit_log, token_metrics, phase_sums, search_tool, sources_text, distinct_contents, tool_results, agent_trace, config_defaults, ablation_contexts, ablation_runs, point_lookup,
        question_bank, chunk_dispatch, guardrails_run, agent_loop,
    )
}


def _placed_sql(source: str, patterns, where: str = "true") -> str:
    """CTEs u (doc_id, ord, kind, st, v): matches of the patterns in source (doc_id, t, ...), with their places."""
    split = "string_split(regexp_replace(t, {p}, chr(1) || '\\0' || chr(1), 'g'), chr(1))"
    one = " union all ".join(f"select doc_id, {k} ord, '{kind}' kind, {split.format(p=S.q(p))} parts from {source} where {w}" for k, (kind, p, w) in enumerate(patterns))
    return f"""pp as ({one}), pu as (select doc_id, ord, kind, unnest(parts) v, unnest(range(len(parts))) k from pp),
      pe as (select *, (sum(length(v)) over (partition by doc_id, ord order by k))::bigint - length(v) st from pu), u as (select * from pe where k % 2 = 1)"""


def _group_sql(patterns) -> str:
    return "case " + " ".join(f"when ord = {k} then nullif(regexp_extract(v, {S.q(p)}, 1), '')" for k, (_, p, _) in enumerate(patterns) if "(" in p.replace("(?", "")) + " end"


_HEADING_RULES = [(str(k), p, "true") for k, p in enumerate(L.PLACED_HEADINGS)]
_SECTION_RULES = [*[(k, p, "lang = 'id'") for k, p in L.TYPED_SECTIONS_ID], *[(k, p, "lang = 'en'") for k, p in L.TYPED_SECTIONS_EN]]
_NORMED = f"{S.TEXTS}, nt as (select doc_id, replace({_norm_sql('text')}, chr(1), ' ') t from texts), nl as (select doc_id, t, length(t) n, case when {S.count('t', L.LANGUAGE_LONG)} > 10 then 'id' else 'en' end lang from nt)"
_SECTIONS = f"{_NORMED}, {_placed_sql('nl', _SECTION_RULES)}, ts as (select doc_id, kind as type, coalesce({_group_sql(_SECTION_RULES)}, v) title, st as start, coalesce(lead(st) over (partition by doc_id order by st, ord), n) as \"end\" from u join nl using (doc_id))"
_ABSTRACT = "case " + " ".join(f"when regexp_matches(text, {S.q(a + b)}) then substr({S.strip(f'regexp_extract(text, {S.q(a + b)}, 1)')}, 1, {L.ABSTRACT_LENGTH})" for a, b in L.ABSTRACTS) + " end"
_T_P = "case when df > 30 then 2 * exp(-t * t / 2) / 2.5066282746310002::double * (1 + 0.2316419::double * abs(t)) when abs(t) > 4 then 0.001 when abs(t) > 3 then 0.01 when abs(t) > 2 then 0.05 when abs(t) > 1.5 then 0.15 else 0.5 end"
_SAID = """c as (select conv_id, turn, role, text from conversations union all select * from (values (-1, 0, 'user', 'Doe wrote in 2020 on maps'), (-1, 1, 'assistant', 'As (Doe, 2020) said [1] and (Roe, 1999) too'),
  (-1, 2, 'assistant', 'racist words'), (-1, 3, 'assistant', 'mail a@b.co, always 50% of it'), (-2, 1, 'assistant', 'a study (Poe, 1990) found it'))),
  x as (select conv_id, string_agg(text, ' ' order by turn) ctx from c where role <> 'assistant' group by 1),
  a as (select c.conv_id, turn, text, ctx from c left join x using (conv_id) where role = 'assistant')"""
_RISKY = " or ".join(S.matches("text", p) for p in L.RISKY)
_WORDS = r"len(list_filter(string_split_regex({x}, '\s+'), lambda w: w <> ''))"
_DESCRIBED = "count({x}) {n}_n, avg({x}) {n}_mean, stddev_samp({x}) {n}_sd"
_GAIN = "round(rag_mean, 6) rag_mean, round(rag_sd, 6) rag_sd, round(plain_mean, 6) plain_mean, round(plain_sd, 6) plain_sd, rag_n, plain_n, round(rag_mean - plain_mean, 6) improvement, round(case when plain_mean <> 0 then (rag_mean - plain_mean) / plain_mean * 100 else 0 end, 6) improvement_pct, round(t, 6) t, round(d, 6) d"
_FOUND = f"with {_VEC}, h as (select (query_id // 100) % 10 as session, query_id part, rank, id chunk, score from vec where rank <= 10), f as (select session, chunk, arg_min(part, part * 1000 + rank) part, arg_min(rank, part * 1000 + rank) rank, arg_min(score, part * 1000 + rank) score from h group by 1, 2), n as (select *, row_number() over (partition by session order by part, rank, chunk) citation from f), st as (select session, chunk, citation, part, round(score, 3) score, 'document ' || chunk title, substr(text, 1, 500) || case when length(text) > 500 then '...' else '' end as content from n join documents on doc_id = chunk)"

#: Most chunks that a configuration looks at.
_LOOK = max(c[6] * (1 if c[2] == "none" else 2) for c in E.ABLATIONS)
_CONFIGS = ", ".join(f"({k}, '{c[0]}', '{c[1]}', '{c[2]}', {str(c[4]).lower()}, {str(c[5]).lower()}, {c[6]})" for k, c in enumerate(E.ABLATIONS))
#: BM25 of all chunks under all searches, from the SQL of keyword search.
_ALL_BM25 = re.sub(r"\b(sc|bz|bm)\b", r"all_\1", _KEYWORD.removeprefix("with bq as (select item_id query_id, text query_text from benchmark),")).replace("bq", "asked").replace("doc_id id", "id").replace("from documents", "from ch")
_BOTH = "len(list_intersect(x, y))"
_STUDY = f"""with cfg(ord, name, retrieval, reranker, agentic, guardrails, top_k) as (values {_CONFIGS}),
  qs as (select vec_id q, text t, string_split(text, ' ') ws, embedding qe, {S.which('text', L.INJECTION)} <> '' or {S.which('text', L.TOXICITY)} <> '' blocked from embeddings join documents on doc_id = vec_id where vec_id % {EVERY} = 0 and text is not null and embedding is not null),
  asked as (select q || ':-1' query_id, q, -1 part, t query_text, qe, true plain, blocked from qs union all select q || ':0', q, 0, array_to_string(ws[1:(len(ws) + 1) // 2], ' '), qe, false, blocked from qs
    union all select q || ':1', q, 1, array_to_string(ws[(len(ws) + 1) // 2 + 1:], ' '), qe, false, blocked from qs),
  ch as (select vec_id id, text, embedding from embeddings join documents on doc_id = vec_id where embedding is not null),
  sim as (select query_id, id, round(coalesce(list_cosine_similarity(embedding::double[], qe::double[]), 0), 9) score from ch, asked),
  vec as (select *, row_number() over (partition by query_id order by score desc, id) as rank from sim qualify rank <= {_LOOK * L.VECTOR_POOL}),
  pool as (select query_id, id, text from vec join ch using (id)), {_bm25_sql('pool', 'asked', 'bm')}, {_FUSED}, {_ALL_BM25},
  found as (select 'vector' retrieval, query_id, id, score, rank from vec union all select 'hybrid', query_id, id, fused, rank from top union all select 'keyword', query_id, id, keyword_score, rank from kw),
  cand as (select ord, reranker, top_k, q, part, query_text, query_id, id, score from found f join asked a using (query_id) join cfg c on c.retrieval = f.retrieval and c.agentic <> a.plain
    where score >= {L.MIN_SCORE} and rank <= case when reranker = 'none' then top_k else 2 * top_k end and not (guardrails and blocked)),
  pairs as (select query_id, id, list_distinct({S.tokens('query_text')}) x, list_distinct({S.tokens('text')}) y from (select distinct query_id, query_text, id from cand where reranker <> 'none') join ch using (id)),
  told as (select query_id, id, coalesce(2.0::double * {_BOTH} / nullif(len(x) + len(y), 0), 0) c, coalesce({_BOTH}::double / nullif(len(x), 0), 0) j from pairs),
  new as (select ord, reranker, top_k, q, part, query_id, id, round(case reranker when 'none' then score when 'cross_encoder' then c when 'llm' then j else (0.4::double * c + 0.4::double * j + 0.2::double * score) / 1.0::double end, 9) s from cand left join told using (query_id, id)),
  best as (select *, row_number() over (partition by ord, query_id order by s desc, id) b from new where reranker = 'none' or s >= {L.RERANK_MIN_SCORE} qualify b <= top_k),
  once as (select ord, q, id, min(part * 1000 + b) f, arg_min(s, part * 1000 + b) s from best group by 1, 2, 3),
  ctx as (select ord, q query_id, row_number() over (partition by ord, q order by f, id) place, id, s score from once)"""

ORACLES = {
    "ablation_contexts": f"{_STUDY} select * from ctx",
    "ablation_runs": f"""{_STUDY}, an as (select c.name, t, case when guardrails and blocked then {S.q(BLOCKED)} when retrieval = 'none' then t else d.text end a from cfg c cross join qs left join ctx on ctx.ord = c.ord and ctx.query_id = qs.q and place = 1 left join documents d on d.doc_id = ctx.id),
      sc2 as (select name, a is null failed, list_distinct({S.tokens('a')}) x, list_distinct({S.tokens('t')}) y from an)
      select name, count(*) questions, count(*) filter (failed) failed, round(sum(case when failed then 0 else coalesce(2.0::double * {_BOTH} / nullif(len(x) + len(y), 0), 0) end) / count(*), 6) score from sc2 group by 1""",
    "agent_loop": f"""with q as (select item_id session, string_split(lower(text), ' ') ws, item_id % 7 wanted, {S.which('text', L.INJECTION)} <> '' or {S.which('text', L.TOXICITY)} <> '' blocked from benchmark),
      w as (select word, min(doc_id)::varchar as "first", count(*)::varchar n from (select distinct doc_id, word from (select doc_id, unnest(string_split(lower(text), ' ')) word from documents)) group by 1),
      s as (select session, unnest(range(0, least(wanted, 5))) step, ws from q where not blocked),
      c as (select session, ws[step + 1] word from s),
      o as (select session, "first" as output from c left join w using (word) union all select session, n from c left join w using (word) where session % 2 = 0),
      p as (select session, count(*) calls, count(output) seen, count(distinct output) n_citations from o group by 1)
      select session, case when blocked then 'blocked' when wanted < 5 then 'answered' else 'synthesised' end status,
        case when blocked then 'The question breaks the rules of use and is not answered.' else 'seen ' || coalesce(seen, 0) end answer,
        case when blocked then 0 else coalesce(calls, 0) + (wanted < 5)::int end n_steps, coalesce(n_citations, 0) n_citations from q left join p using (session)""",
    "headings_offsets": f"with {S.TEXTS}, nt as (select doc_id, replace(coalesce(text, ''), chr(1), ' ') t from texts), {_placed_sql('nt', _HEADING_RULES)}, h as (select *, {S.strip(f'coalesce({_group_sql(_HEADING_RULES[:3])}, v)')} heading from u) select doc_id, heading, arg_min(st, ord::bigint * 1000000000 + st) as \"offset\" from h where heading <> '' group by 1, 2",
    "typed_sections": f"with {_SECTIONS} select * from ts",
    "document_facts": f"with {S.TEXTS} select doc_id, {_ABSTRACT} abstract, {S.matches('text', L.TABLE_HEADER, True)} or len(regexp_extract_all(text, {S.q(L.NUMBERED_ROW)})) > {L.NUMBERED_ROWS} has_table from texts",
    "metadata_bundle": f"with {_SECTIONS}, m as (select doc_id, t as text, lang from nl) select doc_id, {_TYPE_SQL} doc_type, lang as language, array_to_string({_DISTINCT.format(x='cs')}, ',') citations, array_to_string({_KW_SQL}, ',') keywords, (select count(*) from ts where ts.doc_id = m.doc_id) n_sections from (select *, regexp_extract_all(text, '\\[(\\d+)\\]', 1) cs from m) m",
    "file_titles": "select page_id, regexp_replace(string_split(url, '/')[-1], '\\.[^/.]+$', '') title, 'a,' || page_id tags from pages",
    "rag_vs_plain": f"with s as (select l_linenumber, {_DESCRIBED.format(x='l_discount', n='rag')}, {_DESCRIBED.format(x='l_tax', n='plain')}, avg(l_discount - l_tax) m, stddev_samp(l_discount - l_tax) sd, count(*) n from lineitem group by 1), t as (select *, m / (sd / sqrt(n::double)) t, n - 1 df, m / sd d from s), p as (select *, {_T_P} p from t) select l_linenumber, {_GAIN}, df, round(p, 6) p, p < 0.05 significant from p",
    "rag_vs_plain_unpaired": f"with s as (select l_returnflag, {_DESCRIBED.format(x='l_discount', n='rag')}, {_DESCRIBED.format(x='l_tax', n='plain')}, var_samp(l_discount) s1, var_samp(l_tax) s2, count(*)::double n from lineitem group by 1), t as (select *, (rag_mean - plain_mean) / sqrt(s1 / n + s2 / n) t, pow(s1 / n + s2 / n, 2) / (pow(s1 / n, 2) / (n - 1) + pow(s2 / n, 2) / (n - 1)) df, (rag_mean - plain_mean) / sqrt(((n - 1) * s1 + (n - 1) * s2) / (n + n - 2)) d from s), p as (select *, {_T_P} p from t) select l_returnflag, {_GAIN}, round(df, 6) df, round(p, 6) p, p < 0.05 significant from p",
    "ablation_rankings": f"with a as (select l_linenumber, count(*) n, avg(l_quantity) mean, {_t_crit('count(*) - 1')} * stddev_samp(l_quantity) / sqrt(count(*)::double) e from lineitem group by 1) select l_linenumber, n, round(mean, 6) mean, round(mean - e, 6) lower, round(mean + e, 6) upper, row_number() over (order by mean desc, l_linenumber) place from a",
    "significant_pairs": """with x as (select o_orderstatus g, o_totalprice + case when o_orderstatus = 'F' then 50000 else 0 end x from orders), m as (select g, count(x)::double n, avg(x) m, var_pop(x) * count(x) ss from x group by 1),
      w as (select sum(ss) / (sum(n) - count(*)) msw, (sum(n * m * m) - pow(sum(n * m), 2) / sum(n)) / (count(*) - 1) / (sum(ss) / (sum(n) - count(*))) f from m),
      d as (select a.g a, b.g b, abs(a.m - b.m) / sqrt(msw * (1 / a.n + 1 / b.n) / 2) q, f from m a join m b on a.g < b.g, w), p as (select a, b, q, case when q > 5 then 0.001::double when q > 4 then 0.01 when q > 3.5 then 0.05 when q > 3 then 0.1 else 0.5 end p from d where f > 5)
      select a, b, round(q, 6) q, p from p where p < 0.05""",
    "agentic_latency": f"with g as (select event_type in ('view', 'click') g, count(value)::double n, avg(value) m, var_samp(value) s from events group by 1), t as (select a.m agentic, b.m plain, (a.m - b.m) / sqrt(a.s / a.n + b.s / b.n) t, pow(a.s / a.n + b.s / b.n, 2) / (pow(a.s / a.n, 2) / (a.n - 1) + pow(b.s / b.n, 2) / (b.n - 1)) df from g a, g b where a.g and not b.g), p as (select *, {_T_P} p from t) select round(agentic, 6) agentic, round(plain, 6) plain, round(agentic - plain, 6) difference, round(t, 6) t, round(df, 6) df, round(p, 6) p, p < 0.05 significant from p",
    "grouped_scores": "select n_regionkey, count(*) n, string_agg(n_nationkey::varchar, ',' order by n_nationkey) as keys, string_agg(n_name, ',' order by n_nationkey) as names from nation group by 1",
    "comparison_rows": "with r as (select event_type, avg(event_id % 100) / 100 h, max(value) l from events group by 1) select event_type, round(h, 6) hallucination_rate, round(l, 6) latency_ms, round((1 - h) * 100, 6) factual, round((select max(l) from r), 6) axis from r",
    "population_variants": "select event_type, round(avg(value) / stddev_pop(value), 6) cohen_d, round(stddev_pop(value), 6) sd from events group by 1",
    "output_guard": f"""with {_SAID}, s as (select conv_id, turn, {_PII_SQL} pii, {S.which('text', L.TOXICITY)} toxic, ({_RISKY}) and ctx is not null risky, length(text) % 2 = 0 odd,
        case when ctx is null then '' else array_to_string(list_filter(regexp_extract_all(text, {S.q(L.CITATION)}, 0), lambda v: not contains(ctx, v) and not (regexp_extract(v, {S.q(L.AUTHOR_YEAR)}, 2) <> '' and contains(ctx, trim(regexp_extract(v, {S.q(L.AUTHOR_YEAR)}, 1))) and contains(ctx, regexp_extract(v, {S.q(L.AUTHOR_YEAR)}, 2))) and not regexp_matches(v, '^\\[\\d+\\]$')), ',') end unverified from a)
      select conv_id, turn, pii, toxic, risky, risky and odd hallucinated, unverified, toxic <> '' blocked, case when pii <> '' or toxic <> '' then 'high' when risky and odd then 'medium' when unverified <> '' then 'low' else 'none' end severity from s""",
    "audit_log": f"""with {S.TEXTS}, k as (select doc_id, {S.which('text', L.INJECTION)} <> '' i, {_PII_SQL} <> '' p, {S.which('text', L.TOXICITY)} <> '' t, {S.which('text', L.INTEGRITY)} <> '' d,
        not (""" + " or ".join(f"contains(lower(text), {S.q(w)})" for w in (*L.TOPICS, *L.COMMANDS)) + f""") and not {S.matches('text', L.QUESTION, True)} and length(text) > 50 o from texts)
      select doc_id, 'input' stage, 'prompt_injection' rule, 'critical' severity, 'blocked' as action from k where i union all select doc_id, 'input', 'pii_detection', 'high', 'redacted' from k where p union all
      select doc_id, 'input', 'toxicity', 'high', 'blocked' from k where t union all select doc_id, 'input', 'academic_integrity', 'medium', 'flagged' from k where d union all select doc_id, 'input', 'topic_relevance', 'low', 'warned' from k where o""",
    "token_metrics": f"with {_SAID}, n as (select conv_id, turn, {_WORDS.format(x='text')} answer_tokens, {_WORDS.format(x=chr(99) + 'oalesce(ctx, ' + chr(39) * 2 + ')')} context_tokens from a) select *, round(case when turn > 0 then answer_tokens / (turn * 100)::double * 1000 else 0 end, 6) tokens_per_second, round(case when context_tokens > 0 then answer_tokens / context_tokens::double else 0 end, 6) token_efficiency from n",
    "phase_sums": f"with e as (select user_id, {_PHASE} phase, value ms from events), s as (select user_id, sum(ms) total_ms, " + ", ".join(f"coalesce(sum(ms) filter (phase = '{p}'), 0) {p}_ms" for p in E.PHASES) + ", count(*) filter (phase in ('tool_call', 'planning', 'synthesis')) agent_steps from e group by 1) select user_id, round(total_ms, 8) total_ms, " + ", ".join(f"round({p}_ms::double, 8) {p}_ms" for p in E.PHASES) + ", agent_steps, round(case when agent_steps > 0 then (tool_call_ms + planning_ms + synthesis_ms) / agent_steps else 0 end, 8) avg_step_ms from s",
    "search_tool": f"{_FOUND} select * from st",
    "sources_text": f"{_FOUND} select session, string_agg('[' || citation || '] ' || title || ':' || chr(10) || content, chr(10) || chr(10) order by citation) sources, count(*) n from st group by 1",
    "distinct_contents": "with p as (select lang, doc_id, substr(text, 1, 500) || case when length(text) > 500 then '...' else '' end as content from documents) select lang, content, min(doc_id) doc_id from p group by 1, 2",
    "tool_results": "select a.o_custkey as session, a.o_orderkey call_id, b.o_totalprice as output from orders a left join (select * from orders where o_orderstatus = 'F') b using (o_orderkey)",
    "agent_trace": "with e as (select user_id, ts, event_id, case when event_type = 'view' then 'text' else 'search' end kind from events where event_type <> 'signup'), w as (select *, row_number() over g - 1 i, coalesce(lag(ts) over g, min(ts) over (partition by user_id)) b from e window g as (partition by user_id order by ts, kind)) select user_id as session, i step_index, case when kind = 'text' then 'synthesis' else 'tool_call' end step_type, (epoch_us(ts) - epoch_us(b)) // 1000 duration_ms, event_id tokens from w",
    "config_defaults": "select * from (values ('full_system', 'hybrid', 'ensemble', true), ('bm25_only', 'keyword', 'none', false), ('unknown', 'hybrid', 'none', false)) v(name, retrieval, reranker, agentic)",
    "point_lookup": "select doc_id, lang, n_chars from documents where doc_id = 100",
    "question_bank": "select item_id id, 'methods' category, 'easy' difficulty from benchmark where item_id % 2 = 0 and item_id % 3 <> 0 order by md5('7:' || item_id), item_id limit 5",
}
