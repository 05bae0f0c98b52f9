"""Document facts that need more than one expression: query expansion, sections, report parsing."""

from __future__ import annotations

import re
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexivec.compat import ship_package
from lexivec.functions import lexicon as L
from lexivec.functions import text as T
from lexivec.functions.automaton import Seen, with_seen
from lexivec.functions.text import BOUNDARY, java


def expand_synonyms(queries: DataFrame, groups: tuple[tuple[str, ...], ...] = L.SYNONYMS, most: int | None = None) -> DataFrame:
    """query_id, expanded, k: the query itself, then with each whole-word hit of a group's term replaced by each other one.

    queries: query_id, query. Distinct, in the order of groups and terms; `most` keeps the first ones of each query.
    """
    spark = queries.sparkSession
    rows = ", ".join(f"({g * 1000 + i * 30 + k}, '{a}', '{b}')" for g, terms in enumerate(groups) for i, a in enumerate(terms) for k, b in enumerate(terms) if i != k)
    pairs = F.broadcast(spark.sql(f"select * from values {rows} as v(k, term, synonym)"))
    whole = F.concat(F.lit("(?i)" + BOUNDARY + r"\Q"), "term", F.lit(r"\E" + BOUNDARY))
    hits = queries.join(pairs, F.expr("contains(lower(query), term)")).filter(F.regexp_like("query", whole))
    made = hits.select("query_id", F.regexp_replace(F.col("query"), whole, F.col("synonym")).alias("expanded"), "k")
    d = queries.select("query_id", F.col("query").alias("expanded"), F.lit(-1).alias("k")).unionByName(made)
    d = d.groupBy("query_id", "expanded").agg(F.min("k").alias("k"))
    if most is not None:
        d = d.withColumn("_n", F.row_number().over(Window.partitionBy("query_id").orderBy("k"))).filter(F.col("_n") <= most).drop("_n")
    return d


def sections(docs: DataFrame, markers: tuple[tuple[str, str], ...] = L.SECTIONS_EN) -> DataFrame:
    """doc_id, section, start, end: lines that begin a section, each up to the next one or the end of the text.

    Positions come from summed line lengths, so the work stays in expressions.
    """
    lines = F.split("text", "\n")
    d = docs.select("doc_id", F.length("text").alias("n"), F.posexplode(lines).alias("pos", "line"))
    before = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("start", F.coalesce(F.sum(F.length("line") + 1).over(before), F.lit(0)))
    label: Column = F.coalesce(*[F.when(F.col("line").rlike("(?i)" + p), k) for k, p in markers])
    d = d.withColumn("section", label).filter(F.col("section").isNotNull())
    after = Window.partitionBy("doc_id").orderBy("start")
    return d.select("doc_id", "section", F.col("start").cast("long").alias("start"), F.coalesce(F.lead("start").over(after), F.col("n")).cast("long").alias("end"))


def _unmarked(text: Column) -> Column:
    return F.replace(text, F.lit(T.MARK), F.lit(" "))


_PLACE = "array<struct<start:bigint,ord:int,kind:string,value:string>>"


def _places(text: Column, patterns: list[tuple[str, str]], low=None) -> Column:
    """Matches of the patterns (kind, pattern): start, ord (the pattern's number), kind, value."""

    def one(k: int, kind: str, p: str) -> Column:
        hits = F.transform(T.spans(text, java(p)), lambda s: F.struct(s["start"].cast("long").alias("start"), F.lit(k).alias("ord"), F.lit(kind).alias("kind"), s["value"].alias("value")))
        return F.when(T.possible(p, low), hits).otherwise(F.array().cast(_PLACE))

    return F.concat(*[one(k, kind, p) for k, (kind, p) in enumerate(patterns)])


def placed_headings(docs: DataFrame) -> DataFrame:
    """doc_id, offset, heading of docs (doc_id, text): each heading once, where the first pattern that has it finds it first."""
    d = docs.select("doc_id", _unmarked(F.coalesce("text", F.lit(""))).alias("text"))
    d, seen = with_seen(d, F.lower("text"), T.needs(L.PLACED_HEADINGS))
    d = d.select("doc_id", F.explode(_places(F.col("text"), [(str(k), p) for k, p in enumerate(L.PLACED_HEADINGS)], seen)).alias("m")).select("doc_id", "m.*")
    named = F.coalesce(*[F.when(F.col("ord") == k, F.nullif(F.regexp_extract("value", java(p), 1), F.lit(""))) for k, p in enumerate(L.PLACED_HEADINGS) if "(.+)" in p], F.col("value"))
    d = d.withColumn("heading", F.regexp_replace(named, r"^\s+|\s+$", "")).filter("heading <> ''")
    first = d.groupBy("doc_id", "heading").agg(F.min(F.struct("ord", "start")).alias("m"))
    return first.select("doc_id", F.col("m.start").alias("offset"), "heading")


#: What a text is scanned for before its facts are read.
FACT_LITERALS = T.needs(
    [p for _, p in L.TYPED_SECTIONS_ID + L.TYPED_SECTIONS_EN], [p for _, p in L.DOCUMENT_TYPES], [p for _, p in L.TRADITIONAL_ID], [p for _, p in L.TRADITIONAL_EN],
    L.LANGUAGE_LONG, L.TABLE_HEADER, L.COURSE_NAME, L.INSTRUCTOR, L.SEMESTER, L.FACULTY, L.CREDITS, L.KEYWORDS, [a for a, _ in L.ABSTRACTS],
)


def _scanned(docs: DataFrame) -> tuple[DataFrame, Seen]:
    """doc_id, the repaired text `t`, and what was seen in it: the text is repaired and scanned once for all that follows."""
    d = docs.select("doc_id", T.normalize_pdf(F.coalesce("text", F.lit(""))).alias("t"))
    return with_seen(d, F.lower("t"), FACT_LITERALS)


def _sections_of(t: Column, lang: Column, seen: Seen) -> Column:
    """array<struct<start, type, title, end>> of a repaired text, by the patterns of its language, in one row."""
    t = _unmarked(t)

    def titled(rules) -> Column:
        title = lambda m: F.coalesce(*[F.when(m["ord"] == k, F.nullif(F.regexp_extract(m["value"], java(p), 1), F.lit(""))) for k, (_, p) in enumerate(rules)], m["value"])
        return F.transform(F.sort_array(_places(t, list(rules), seen)), lambda m: F.struct(m["start"].alias("start"), m["kind"].alias("type"), title(m).alias("title")))

    def ended(ms: Column) -> Column:
        end = lambda k: F.coalesce(F.get(ms, k + 1)["start"], F.length(t).cast("long"))
        return F.transform(ms, lambda m, k: F.struct(m["start"].alias("start"), m["type"].alias("type"), m["title"].alias("title"), end(k).alias("end")))

    return T.bound(F.when(lang == "id", titled(L.TYPED_SECTIONS_ID)).otherwise(titled(L.TYPED_SECTIONS_EN)), ended)


def typed_sections(docs: DataFrame) -> DataFrame:
    """doc_id, type, title, start, end of docs (doc_id, text): sections by their headings in the repaired text, each up to the
    next one. The patterns are those of the text's language; the title is the pattern's first group, or the whole match.
    """
    d, seen = _scanned(docs)
    d = d.select("doc_id", F.explode(_sections_of(F.col("t"), T.language(F.col("t"), low=seen), seen)).alias("s"))
    return d.select("doc_id", "s.type", "s.title", "s.start", "s.end")


def metadata(docs: DataFrame) -> DataFrame:
    """doc_id and what a text tells of itself: type, course facts, citations, keywords, abstract, language, table flag,
    and its sections as array<struct<start, type, title, end>>. One scan, one row a document throughout."""
    d, seen = _scanned(docs.select("doc_id", "text"))
    t = F.col("t")
    d = d.select("*", T.language(t, low=seen).alias("language"), T.normalize_pdf(t).alias("again"))
    return d.select(
        "doc_id", T.doc_type(t, seen, F.col("language")).alias("doc_type"), *[c.alias(k) for k, c in T.course_info(t, seen, F.col("again")).items()], T.numbered_citations(t).alias("citations"),
        T.keyword_line(t, seen).alias("keywords"), T.abstract(t, seen).alias("abstract"), "language", T.has_table(t, seen).alias("has_table"), _sections_of(t, F.col("language"), seen).alias("sections"),
    )


def document_types(docs: DataFrame) -> DataFrame:
    """doc_id, doc_type of docs (doc_id, text): `doc_type` of the text as it is, after one scan for all its patterns."""
    d, seen = with_seen(docs.select("doc_id", "text"), F.lower("text"), FACT_LITERALS)
    return d.select("doc_id", T.doc_type(F.col("text"), seen).alias("doc_type"))


def synonym_groups(spark, path: str) -> tuple[tuple[str, ...], ...]:
    """Groups of synonyms from a text file: one group a line, its terms between bars."""
    lines = [r["value"] for r in spark.read.text(path).collect()]
    return tuple(terms for line in lines if len(terms := tuple(t.strip() for t in line.split("|") if t.strip())) > 1)


_DELIMITER = re.compile(r"\n={3,}\n|\n-{3,}\n")
_RULE = re.compile(r"[|+\-\s]*[-+][|+\-\s]*")
_FULL_STOP = (".", "!", "?")


def _table(lines: list[str], title: str | None) -> dict | None:
    rows = [[c for c in (re.sub(r"\s+", " ", c.strip()) for c in x.split("|")) if c] for x in lines if "|" in x and not _RULE.fullmatch(x.strip())]
    if len(rows) < 2:
        return None
    head = rows[0]
    return {"title": title, "headers": head, "rows": [dict(zip(head, [*r, *[""] * len(head)])) for r in rows[1:]]}


def _pairs(lines: list[str]) -> list[tuple[str, str]]:
    found = (re.match(r"([A-Za-z][A-Za-z0-9\s]*?)\s*:\s*(.+)$", x.strip()) for x in lines)
    return [(m[1], m[2].strip()) for m in found if m and len(m[1]) <= 50]


def parse_report(text: str) -> list[dict]:
    """Sections of an ASCII report: title, tables (title, headers, rows), key-value pairs.

    A section's first line is its title if it is in capitals, or short, without a full stop and no table row. A run of table
    rows and rules is a table; a short line before it, without a full stop, is the table's title.
    """
    out = []
    for part in _DELIMITER.split(text or ""):
        lines = [x for x in part.split("\n") if x.strip()]
        if not lines:
            continue
        head = lines[0].strip()
        titled = bool(re.fullmatch(r"[A-Z][A-Z\s0-9]+", head)) or (len(head) < 80 and not head.endswith(_FULL_STOP) and "|" not in head)
        tables, rest = [], []
        for is_table, run in groupby(lines[1:] if titled else lines, lambda x: "|" in x or bool(_RULE.fullmatch(x.strip()))):
            run = list(run)
            if not is_table:
                rest += run
                continue
            before = rest[-1].strip() if rest else ""
            title = rest.pop().strip() if 0 < len(before) < 100 and not before.endswith(_FULL_STOP) else None
            if table := _table(run, title):
                tables.append(table)
        out.append({"title": head if titled else None, "tables": tables, "metadata": _pairs(rest)})
    return out


def _sentences_of(table: dict) -> list[str]:
    rows = (", ".join(f"{h}: {row[h]}" for h in table["headers"] if row[h]) for row in table["rows"])
    return [f"[{table['title']}] {x}." if table["title"] else f"{x}." for x in rows if x]


def serialise_report(text: str) -> str:
    """A report as sentences, its blocks apart: the first section's pairs under a heading of their own, then each section with
    `## title`, `key adalah value.`, and its tables with `### title` and `[title] header: value, header: value.` a row.
    """
    said = lambda pairs: "\n".join(f"{k} adalah {v}." for k, v in pairs)
    sections = parse_report(text)
    blocks = [f"# Informasi Umum\n\n{said(sections[0]['metadata'])}"] if sections and sections[0]["metadata"] else []
    for s in sections:
        of = [f"## {s['title']}"] if s["title"] else []
        of += [said(s["metadata"])] if s["metadata"] else []
        of += ["\n".join([*([f"### {t['title']}"] if t["title"] else []), *_sentences_of(t)]) for t in s["tables"]]
        if of:
            blocks.append("\n\n".join(of))
    return "\n\n".join(blocks)


def serialised_reports(docs: DataFrame) -> DataFrame:
    """doc_id, serialised text of documents that look like ASCII reports; others as they are."""
    ship_package(docs.sparkSession)

    def rows(frames):
        for f in frames:
            yield pd.DataFrame({"doc_id": f["doc_id"], "text": f["text"].map(serialise_report)})

    d = docs.select("doc_id", "text", (T.report_score(F.coalesce("text", F.lit(""))) >= 3).alias("r"))
    made = d.filter("r").select("doc_id", "text").mapInPandas(rows, "doc_id long, text string")
    return made.unionByName(d.filter("not r").select("doc_id", "text"))
