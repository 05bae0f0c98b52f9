"""Queries of guardrails, texts and document facts, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexivec.compat import spread
from lexivec.functions import lexicon as L
from lexivec.functions import text as T
from lexivec.functions.automaton import with_seen
from lexivec.operators import guard as G
from lexivec.operators.domain import document_types
from lexivec.plans import sql as S


def _t(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _docs(spark, sf):
    """The documents, on all cores."""
    return spread(_t(spark, sf, "documents"))


def _texts(spark, sf):
    """The documents and the hand-made rows."""
    made = ", ".join(f"({-k - 1}L, " + " || chr(10) || ".join("'" + x.replace("''", "\\'") + "'" for x in t.split("\n")) + ")" for k, t in enumerate(S.FIXTURES))
    return _docs(spark, sf).select("doc_id", "text").unionByName(spark.sql(f"select * from values {made} as v(doc_id, text)"))


_joined = lambda c: F.array_join(c.cast("array<string>"), ",")


def _projection(scan=None, **columns):
    """A query of one column per function of the text; scan: literals, of which the functions get what was seen in the text."""
    if scan is None:
        return lambda spark, sf: _texts(spark, sf).select("doc_id", *[make(F.col("text")).alias(name) for name, make in columns.items()])

    def query(spark, sf):
        d, seen = with_seen(_texts(spark, sf), F.lower("text"), scan)
        return d.select("doc_id", *[make(F.col("text"), seen).alias(name) for name, make in columns.items()])

    return query


def rate_limit_anchored(spark, sf):
    return G.rate_limit(_t(spark, sf, "events"), most=2, window_ms=86_400_000)


def guard_summary(spark, sf):
    """Severities and blocks of all labelled documents, by label."""
    labelled = _docs(spark, sf).select("doc_id", "text").join(_t(spark, sf, "labels").select("doc_id", F.col("toxic").alias("label")), "doc_id")
    d = G.validate_input(labelled).drop("toxic").withColumnRenamed("label", "toxic")
    return d.groupBy("toxic", "severity", "blocked").agg(F.count("*").alias("n"), F.sum(F.size("pii")).cast("long").alias("n_pii"))


def citation_verify(spark, sf):
    """Citations of each answer against the conversation's other turns."""
    c = _t(spark, sf, "conversations")
    made = spark.sql("select * from values (-1L, 0L, 'user', 'Doe wrote in 2020 on maps'), (-1L, 1L, 'assistant', 'As (Doe, 2020) said [1] and (Roe, 1999) too') as v(conv_id, turn, role, text)")
    c = c.select("conv_id", "turn", "role", "text").unionByName(made)
    context = c.filter("role <> 'assistant'").groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), " ").alias("context"))
    a = c.filter("role = 'assistant'").join(context, "conv_id", "left").withColumn("context", F.coalesce("context", F.lit("")))
    return a.select("conv_id", "turn", _joined(G.unverified(F.col("text"), F.col("context"))).alias("unverified"))


def sentence_split(spark, sf):
    return _texts(spark, sf).select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence")).select("doc_id", F.col("pos").cast("long").alias("pos"), "sentence")


def negative_reaction(spark, sf):
    d, seen = with_seen(_texts(spark, sf).select("doc_id", F.lower("text").alias("low")), F.col("low"), T.needs([p for _, p in L.REACTIONS_ID + L.REACTIONS_EN]))
    d = d.select("doc_id", G.reaction(F.col("low"), F.col("low"), seen).alias("reaction"))
    return d.select("doc_id", "reaction", G.reaction_severity(F.col("reaction")).alias("severity"))


def course_info(spark, sf):
    return _texts(spark, sf).select("doc_id", *[c.alias(k) for k, c in T.course_info(F.col("text")).items()])


def kv_pairs(spark, sf):
    d = _texts(spark, sf).select("doc_id", F.posexplode(T.key_values(F.col("text"))).alias("pos", "kv"))
    return d.select("doc_id", F.col("pos").cast("long").alias("pos"), F.col("kv.key").alias("key"), F.col("kv.value").alias("value"))


def doc_search(spark, sf):
    d = _texts(spark, sf)
    k = T.keyword_line(F.col("text"))
    hit = F.lower("text").contains("skripsi") | F.lower("text").contains("license") | F.exists(k, lambda w: w.contains("alpha"))
    return d.filter(hit).select("doc_id")


def synonym_expand(spark, sf):
    from lexivec.operators.domain import expand_synonyms

    q = spark.sql("select * from values (-1L, 'the analysis of methods'), (-2L, 'dosen dan mahasiswa'), (-3L, 'none here') as v(query_id, query)")
    b = _t(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return expand_synonyms(q.unionByName(b)).select("query_id", "expanded")


def _norm_sql(text: str) -> str:
    """The repairs of the one list; DuckDB writes groups with a backslash."""
    for p, to in T.REPAIRS:
        text = f"regexp_replace({text}, {S.q(p)}, {S.q(to.replace('$', chr(92)))}, 'g')"
    return text


def _redact_sql(text: str) -> str:
    for k, p in L.PII:
        text = f"regexp_replace({text}, {S.q(p)}, '[REDACTED_{k.upper()}]', 'g')"
    return text


_PII_SQL = "array_to_string(list_filter([" + ", ".join(f"case when {S.matches('text', p)} then '{k}' end" for k, p in L.PII) + "], lambda x: x is not null), ',')"
_OFF_SQL = "not (" + " or ".join(f"contains(lower(text), {S.q(w)})" for w in (*L.TOPICS, *L.COMMANDS)) + f") and not {S.matches('text', L.QUESTION, True)} and length(text) > 50"
_REACT_SQL = S.first_label("lower(text)", L.REACTIONS_ID + L.REACTIONS_EN)
# RE2 has no look-around: boundaries become control characters.
_SENT_SQL = rf"""list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(text, {S.q(L.ABBREVIATIONS)}, '\1' || chr(1), 'g'), '(\d+)\.(\d+)', '\1' || chr(1) || '\2', 'g'),
  '([.!?])\s+([A-Z])', '\1' || chr(2) || '\2', 'g'), chr(2)), lambda s: regexp_replace(replace(s, chr(1), '.'), '^\s+|\s+$', '', 'g')), lambda s: s <> '')"""
_HEAD_SQL = "list_concat(" + ", ".join(f"regexp_extract_all(text, {S.q(p)}, 1)" for p in L.HEADINGS) + ")"
_DISTINCT = "list_filter({x}, lambda v, i: list_position({x}, v) = i)"
_CODE_SQL = S.first_match(_norm_sql("text"), L.COURSE_CODE, 0)
_TYPE_SQL = f"coalesce({S.first_label('text', L.DOCUMENT_TYPES)}, case when {S.count('text', L.LANGUAGE_LONG)} > 10 then {S.first_label('text', L.TRADITIONAL_ID)} else {S.first_label('text', L.TRADITIONAL_EN)} end, 'other')"
_LINES = "string_split(text, chr(10))"
_n = lambda p: f"len(list_filter({_LINES}, lambda x: regexp_matches(x, {S.q(p)})))"
_REPORT_SQL = (
    f"(case when {_n(T.REPORT_ROW)} >= 2 then 2 else 0 end + case when {_n(T.REPORT_RULE)} >= 1 then 1 else 0 end"
    f" + case when {_n(T.REPORT_DELIMITER)} >= 1 then 1 else 0 end + case when {_n(T.REPORT_PAIR)} >= 2 then 1 else 0 end)"
)
_KV = r"^([A-Za-z][A-Za-z0-9\s]*?)\s*:\s*(.+)$"
_KW_SQL = rf"list_filter(list_transform(string_split_regex(coalesce({S.first_match('text', L.KEYWORDS, 1)}, ''), '[,;]'), lambda x: lower({S.strip('x')})), lambda x: length(x) > 2)"


def _row(expr: str) -> str:
    return f"with {S.TEXTS} select doc_id, {expr} from texts"


QUERIES = {
    "pii_detect": _projection(kinds=lambda t: _joined(G.pii_kinds(t))),
    "pii_redact": _projection(redacted=G.redact),
    "injection_scan": _projection(T.needs(L.INJECTION), hits=lambda t, seen: _joined(G.hits(t, L.INJECTION, seen))),
    "toxicity_scan": _projection(T.needs(L.TOXICITY), hits=lambda t, seen: _joined(G.hits(t, L.TOXICITY, seen))),
    "integrity_scan": _projection(T.needs(L.INTEGRITY), hits=lambda t, seen: _joined(G.hits(t, L.INTEGRITY, seen))),
    "topic_relevance": _projection((*L.TOPICS, *L.COMMANDS), off_topic=G.off_topic),
    "negative_reaction": negative_reaction,
    "guard_summary": guard_summary,
    "citation_verify": citation_verify,
    "rate_limit_anchored": rate_limit_anchored,
    "sentence_split": sentence_split,
    "lang_score": _projection(
        T.needs(L.LANGUAGE_SHORT, L.LANGUAGE_LONG), short=lambda t, low: T.language_score(t, L.LANGUAGE_SHORT, low).cast("long"), long=lambda t, low: T.language_score(t, L.LANGUAGE_LONG, low).cast("long"),
        chunk_lang=lambda t, low: T.language(t, L.LANGUAGE_SHORT, 5, low), domain_lang=lambda t, low: T.language(t, low=low),
    ),
    "pdf_normalize": _projection(normalized=T.normalize_pdf),
    "headings": _projection(headings=lambda t: F.array_join(T.headings(t), "¦")),
    "doc_type": lambda spark, sf: document_types(_texts(spark, sf)),
    "course_info": course_info,
    "kw_line": _projection(keywords=lambda t: _joined(T.keyword_line(t))),
    "ieee_citations": _projection(citations=lambda t: _joined(T.numbered_citations(t))),
    "ascii_report_detect": _projection(score=lambda t: T.report_score(t).cast("long"), structured=lambda t: T.report_score(t) >= 3),
    "kv_pairs": kv_pairs,
    "word_count": _projection(words=lambda t: T.word_count(t).cast("long")),
    "section_tag": _projection(en=lambda t: T.section_of(t, "en"), id=lambda t: T.section_of(t, "id")),
    "synonym_expand": synonym_expand,
    "doc_search": doc_search,
}

_GROUPS = ", ".join(f"({g}, {k}, {S.q(t)})" for g, terms in enumerate(L.SYNONYMS) for k, t in enumerate(terms))

ORACLES = {
    "pii_detect": _row(f"{_PII_SQL} kinds"),
    "pii_redact": _row(f"{_redact_sql('text')} redacted"),
    "injection_scan": _row(f"{S.which('text', L.INJECTION)} hits"),
    "toxicity_scan": _row(f"{S.which('text', L.TOXICITY)} hits"),
    "integrity_scan": _row(f"{S.which('text', L.INTEGRITY)} hits"),
    "topic_relevance": _row(f"({_OFF_SQL}) off_topic"),
    "negative_reaction": f"with {S.TEXTS}, r as (select doc_id, {_REACT_SQL} reaction from texts) select *, case reaction when 'frustration' then 'high' when 'disappointment' then 'medium' when 'confusion' then 'low' when 'helpRequest' then 'low' end severity from r",
    "guard_summary": f"""with d as (select doc_id, toxic, text, {_PII_SQL} pii, {S.which('text', L.INJECTION)} <> '' inj, {S.which('text', L.TOXICITY)} <> '' tox, {S.which('text', L.INTEGRITY)} <> '' dis, {_OFF_SQL} off_ from documents join labels using (doc_id))
      select toxic, case when inj or regexp_matches(pii, '(^|,)(nik|ssn|creditCard)(,|$)') then 'critical' when pii <> '' or tox then 'high' when dis then 'medium' when off_ then 'low' else 'none' end severity, inj or tox blocked,
        count(*) n, sum(case when pii = '' then 0 else len(string_split(pii, ',')) end)::bigint n_pii from d group by all""",
    "citation_verify": f"""with c as (select conv_id, turn, role, text from conversations union all select * from (values (-1, 0, 'user', 'Doe wrote in 2020 on maps'), (-1, 1, 'assistant', 'As (Doe, 2020) said [1] and (Roe, 1999) too'))),
      x as (select conv_id, string_agg(text, ' ' order by turn) ctx from c where role <> 'assistant' group by 1),
      a as (select c.conv_id, turn, regexp_extract_all(text, {S.q(L.CITATION)}, 0) cs, coalesce(ctx, '') ctx from c left join x using (conv_id) where role = 'assistant')
      select conv_id, turn, array_to_string(list_filter(cs, lambda v: not contains(ctx, v) and not (regexp_extract(v, {S.q(L.AUTHOR_YEAR)}, 2) <> '' and contains(ctx, trim(regexp_extract(v, {S.q(L.AUTHOR_YEAR)}, 1))) and contains(ctx, regexp_extract(v, {S.q(L.AUTHOR_YEAR)}, 2))) and not regexp_matches(v, '^\\[\\d+\\]$')), ',') unverified from a""",
    "rate_limit_anchored": """with recursive e as (select user_id, event_id, epoch_ms(ts) t, row_number() over (partition by user_id order by epoch_ms(ts), event_id) i from events),
      w as (select user_id, event_id, i, t + 86400000 reset_at, 1 n, true passed from e where i = 1 union all
        select e.user_id, e.event_id, e.i, case when e.t > w.reset_at then e.t + 86400000 else w.reset_at end, case when e.t > w.reset_at then 1 when w.n < 2 then w.n + 1 else w.n end, e.t > w.reset_at or w.n < 2
        from w join e on e.user_id = w.user_id and e.i = w.i + 1) select user_id, event_id, passed from w""",
    "sentence_split": f"with {S.TEXTS}, s as (select doc_id, {_SENT_SQL} ss from texts), u as (select doc_id, ss, unnest(range(len(ss))) pos from s) select doc_id, pos, ss[pos + 1] sentence from u",
    "lang_score": _row(f"{S.count('text', L.LANGUAGE_SHORT)} short, {S.count('text', L.LANGUAGE_LONG)} \"long\", case when {S.count('text', L.LANGUAGE_SHORT)} > 5 then 'id' else 'en' end chunk_lang, case when {S.count('text', L.LANGUAGE_LONG)} > 10 then 'id' else 'en' end domain_lang"),
    "pdf_normalize": _row(f"{_norm_sql('text')} normalized"),
    "headings": f"with {S.TEXTS}, h as (select doc_id, {_HEAD_SQL} hs from texts) select doc_id, array_to_string({_DISTINCT.format(x='hs')}, '¦') headings from h",
    "doc_type": _row(f"{_TYPE_SQL} doc_type"),
    "course_info": _row(f"{_CODE_SQL} course_code, {S.strip(S.first_match('text', L.COURSE_NAME, 1))} course_name, {S.strip(S.first_match('text', L.INSTRUCTOR, 1))} instructor, {S.first_match('text', L.SEMESTER, 0)} semester, {S.strip(S.first_match('text', L.FACULTY, 1))} faculty, try_cast({S.first_match('text', (L.CREDITS,), 1)} as bigint) credits"),
    "kw_line": _row(f"array_to_string({_KW_SQL}, ',') keywords"),
    "ieee_citations": f"with {S.TEXTS}, c as (select doc_id, regexp_extract_all(text, '\\[(\\d+)\\]', 1) cs from texts) select doc_id, array_to_string({_DISTINCT.format(x='cs')}, ',') citations from c",
    "ascii_report_detect": _row(f"{_REPORT_SQL}::bigint score, {_REPORT_SQL} >= 3 structured"),
    "kv_pairs": rf"""with {S.TEXTS}, l as (select doc_id, list_filter(list_transform({_LINES}, lambda x: {S.strip('x')}), lambda x: not contains(x, '|') and not regexp_matches(x, '^[-=+]+$') and regexp_matches(x, '{_KV}')) ls from texts),
      p as (select doc_id, list_filter(list_transform(ls, lambda x: {{k: regexp_extract(x, '{_KV}', 1), v: regexp_replace(regexp_extract(x, '{_KV}', 2), '\s+$', '')}}), lambda s: length(s.k) <= 50 and length(s.v) > 0) ps from l),
      u as (select doc_id, ps, unnest(range(len(ps))) pos from p) select doc_id, pos, ps[pos + 1].k as "key", ps[pos + 1].v as value from u""",
    "word_count": _row(r"len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) words"),
    "section_tag": _row(f"{S.first_label(S.strip('text'), L.SECTIONS_EN)} en, {S.first_label(S.strip('text'), L.SECTIONS_ID)} id"),
    "synonym_expand": f"""with q as (select item_id query_id, text query from benchmark union all select * from (values (-1, 'the analysis of methods'), (-2, 'dosen dan mahasiswa'), (-3, 'none here'))),
      g(g, k, term) as (values {_GROUPS}),
      e as (select query_id, regexp_replace(query, '(?i)\\b' || a.term || '\\b', b.term, 'g') expanded from q join g a on regexp_matches(query, '(?i)\\b' || a.term || '\\b') join g b on a.g = b.g and a.k <> b.k)
      select distinct query_id, expanded from (select query_id, query expanded from q union all select * from e)""",
    "doc_search": f"with {S.TEXTS} select doc_id from texts where contains(lower(text), 'skripsi') or contains(lower(text), 'license') or len(list_filter({_KW_SQL}, lambda w: contains(w, 'alpha'))) > 0",
}
