"""Chunking: recursive, semantic, sentence windows, hierarchical; and the chunk record.

Recursive cutting needs a cursor and recursion, so it runs as Arrow batches through Python; the others are windows and
array expressions around it.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexivec.compat import ship_package
from lexivec.functions import lexicon as L
from lexivec.functions.text import headings, keyword_line, language, section_of, sentences
from lexivec.operators.retrieval import cosine
from lexivec.providers import embed

SIZE, OVERLAP, THRESHOLD, LEAST, CONTEXT = 1000, 200, 0.5, 100, 3
#: A semantic run that begins so far behind the one before it carries a warning.
FAR = 2000

# Separators in the order in which they are tried; the empty one cuts anywhere.
SEPARATORS = ("\n\n\n", "\n\n", re.compile(r"(?<=\.)\s+(?=[A-Z])"), "\n", re.compile(r"(?<=:)\s+"), re.compile(r"(?<=;)\s+"), ". ", " ", "")
CHAPTERS = re.compile(r"\n(?=BAB\s+[IVXLCDM]+)", re.IGNORECASE)
SEPARATORS_ID = ("\n\n\n", CHAPTERS, *SEPARATORS[1:])
PARAGRAPHS = ("\n\n\n", "\n\n")
PARAGRAPHS_ID = ("\n\n\n", CHAPTERS, "\n\n")


def _parts(text: str, separator) -> list[tuple[int, int]]:
    """Spans between the separator's occurrences."""
    if isinstance(separator, str):
        separator = re.compile(re.escape(separator))
    cuts = [m.span() for m in separator.finditer(text)]
    return list(zip([0, *[e for _, e in cuts]], [*[s for s, _ in cuts], len(text)]))


def cut_spans(text: str, size: int = SIZE, overlap: int = OVERLAP, separators=SEPARATORS) -> list[tuple[int, int]]:
    """Spans of the chunks: parts of the first separator joined while they fit, too long ones cut by the next separator.

    As spans of the text, joined parts keep the delimiters that stood between them. The empty separator gives windows
    that overlap. When separators run out, a long part stays whole.
    """
    if len(text) <= size or not separators:
        return [(0, len(text))] if text.strip() else []
    first, *rest = separators
    if first == "":
        step = max(1, size - overlap)
        return [(k, min(k + size, len(text))) for k in range(0, len(text), step)]
    out: list[tuple[int, int]] = []
    start = None
    for lo, hi in _parts(text, first):
        if start is not None and hi - start <= size:
            end = hi
            continue
        if start is not None:
            out.append((start, end))
            start = None
        if hi - lo > size:
            out += [(lo + a, lo + b) for a, b in cut_spans(text[lo:hi], size, overlap, tuple(rest))]
        elif hi > lo:
            start, end = lo, hi
    if start is not None:
        out.append((start, end))
    return out


def _trimmed(text: str, spans):
    for lo, hi in spans:
        body = text[lo:hi]
        if left := len(body) - len(body.lstrip()):
            lo, body = lo + left, body.lstrip()
        if body.rstrip():
            yield lo, lo + len(body.rstrip())


def _separators_of(lang: str | None):
    return SEPARATORS_ID if lang == "id" else SEPARATORS


def _with_lang(docs: DataFrame, lang: str | None) -> DataFrame:
    """doc_id, text, lang; lang: a language for all, `auto` for each text's own, None for the separators that all share."""
    t = F.coalesce("text", F.lit(""))
    own = language(t, L.LANGUAGE_SHORT, 5) if lang == "auto" else F.lit(lang).cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), t.alias("text"), own.alias("lang"))


def _arrow_rows(out: list[tuple], names: list[str], types: list) -> pa.RecordBatch:
    columns = list(zip(*out)) if out else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)


def recursive_chunks(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP, separators=None, lang: str | None = None) -> DataFrame:
    """doc_id, pos, start, end, content of docs (doc_id, text); offsets in code points, the content is the text between.

    Separators are those of the language unless given; see `_with_lang`.
    """
    ship_package(docs.sparkSession)

    def rows(batches):
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text, own in zip(*[c.to_pylist() for c in batch.columns]):
                spans = cut_spans(text, size, overlap, separators or _separators_of(own))
                out += [(doc_id, k, a, b, text[a:b]) for k, (a, b) in enumerate(_trimmed(text, spans))]
            yield _arrow_rows(out, ["doc_id", "pos", "start", "end", "content"], [pa.int64()] * 4 + [pa.string()])

    return _with_lang(docs, lang).mapInArrow(rows, "doc_id long, pos long, start long, end long, content string")


def sentence_windows(docs: DataFrame, reach: int = CONTEXT) -> DataFrame:
    """doc_id, pos, content, context: each sentence with those up to `reach` places away."""
    d = docs.select("doc_id", sentences(F.col("text")).alias("s"))
    at = F.posexplode("s").alias("pos", "content")
    first = F.greatest(F.col("pos") - reach, F.lit(0))
    around = F.slice("s", first + 1, F.col("pos") - first + reach + 1)
    return d.select("doc_id", "s", at).select("doc_id", F.col("pos").cast("long").alias("pos"), "content", F.array_join(around, " ").alias("context"))


def semantic_chunks(docs: DataFrame, threshold: float = THRESHOLD, least: int = LEAST, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, pos, start, end, content, score, offset_warning: runs of sentences whose neighbours are alike.

    Runs shorter than `least` are dropped, those over 1.5 times the size are cut again. The score is the mean likeness of
    neighbours in the run, 1 for a single sentence. A run starts where its text is found after the run before it; a run whose
    sentences the text has with other spaces between them isn't found, and starts after the one before.
    """
    d = docs.select("doc_id", F.posexplode(sentences(F.col("text"))).alias("pos", "sentence"))
    d = embed(d, "sentence", "_v")
    w = Window.partitionBy("doc_id").orderBy("pos")
    d = d.withColumn("_s", cosine(F.col("_v"), F.lag("_v").over(w)))
    d = d.withColumn("_s", F.when(F.col("pos") == 0, F.lit(None).cast("double")).otherwise(F.col("_s")))
    cut = F.when(F.col("_s") < threshold, 1).otherwise(0)
    d = d.withColumn("segment", F.sum(cut).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inside = F.when(F.col("_s") >= threshold, F.col("_s"))
    g = d.groupBy("doc_id", "segment").agg(F.sort_array(F.collect_list(F.struct("pos", "sentence"))).alias("x"), F.coalesce(F.avg(inside), F.lit(1.0)).alias("score"))
    g = g.select("doc_id", "segment", F.array_join(F.transform("x", lambda s: s["sentence"]), " ").alias("content"), F.round("score", 6).alias("score")).filter(F.length("content") >= least)
    runs = g.groupBy(F.col("doc_id").alias("_id")).agg(F.sort_array(F.collect_list(F.struct("segment", "content", "score"))).alias("runs"))
    ship_package(docs.sparkSession)
    names = ["doc_id", "pos", "start", "end", "content", "score", "offset_warning"]

    def rows(batches):
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text, some in zip(*[c.to_pylist() for c in batch.columns]):
                out += [(doc_id, k, *x) for k, x in enumerate(placed_runs(text, [(r["content"], r["score"]) for r in some], size, overlap))]
            yield _arrow_rows(out, names, [pa.int64()] * 4 + [pa.string(), pa.float64(), pa.bool_()])

    d = docs.select("doc_id", "text").join(runs, F.col("doc_id") == F.col("_id")).select(F.col("doc_id").cast("long"), "text", "runs")
    return d.mapInArrow(rows, "doc_id long, pos long, start long, end long, content string, score double, offset_warning boolean")


def placed_runs(text: str, runs: list[tuple[str, float]], size: int, overlap: int):
    """(start, end, content, score, whether it jumped far) of the runs of a text, long ones cut again."""
    at = 0
    for content, score in runs:
        found = text.find(content, at)
        start = found if found >= 0 else at + len(content)
        far = found >= 0 and abs(start - at) > FAR
        at = start + len(content)
        if len(content) <= 1.5 * size:
            yield start, at, content, score, far
        else:
            yield from ((start + a, start + b, content[a:b], score, far) for a, b in _trimmed(content, cut_spans(content, size, overlap)))


def hierarchical_chunks(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP, lang: str | None = None) -> DataFrame:
    """doc_id, level, pos, parent, content, index, start, end, children: parents of three times the size by paragraphs (and
    chapters, in Indonesian), each followed by its children.

    index numbers all chunks of a document; a child names its parent `parent_<index>`, a parent its children `child_<index>`.
    """
    ship_package(docs.sparkSession)
    names = ["doc_id", "level", "pos", "parent", "content", "index", "start", "end", "children"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string())]

    def rows(batches):
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text, own in zip(*[c.to_pylist() for c in batch.columns]):
                index = 0
                for pos, (lo, hi) in enumerate(_trimmed(text, cut_spans(text, 3 * size, overlap, PARAGRAPHS_ID if own == "id" else PARAGRAPHS))):
                    body, name = text[lo:hi], f"parent_{index}"
                    inner = list(_trimmed(body, cut_spans(body, size, overlap)))
                    out.append((doc_id, "parent", pos, None, body, index, lo, hi, [f"child_{index + 1 + k}" for k in range(len(inner))]))
                    out += [(doc_id, "child", k, name, body[a:b], index + 1 + k, lo + a, lo + b, []) for k, (a, b) in enumerate(inner)]
                    index += 1 + len(inner)
            yield _arrow_rows(out, names, types)

    return _with_lang(docs, lang).mapInArrow(rows, "doc_id long, level string, pos long, parent string, content string, index long, start long, end long, children array<string>")


def chunk(docs: DataFrame, strategy: str = "recursive", lang: str | None = "auto", size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """Chunks of docs (doc_id, text) by strategy: recursive, semantic, sentence_window or hierarchical; any other is recursive.

    lang `auto` tells each text's language first: Indonesian ones are cut at chapters too.
    """
    if strategy == "semantic":
        return semantic_chunks(docs, size=size, overlap=overlap)
    if strategy == "sentence_window":
        return sentence_windows(docs)
    if strategy == "hierarchical":
        return hierarchical_chunks(docs, size, overlap, lang)
    return recursive_chunks(docs, size, overlap, lang=lang)


def chunk_records(chunks: DataFrame, lang: str = "en") -> DataFrame:
    """Chunks with headings, section, keywords and embedding: the rows of the chunk table."""
    d = chunks.withColumn("keywords", keyword_line(F.col("content")))
    d = d.withColumn("headings", headings(F.col("content"))).withColumn("section", section_of(F.col("content"), lang))
    return embed(d, "content", "embedding")


def active_heading(chunks: DataFrame, found: DataFrame) -> DataFrame:
    """chunks with the last heading (doc_id, offset, heading) at or before their start: an as-of join per document.

    One union and a running last value, so a document's headings are never one list. Of one offset the last heading in
    their order holds.
    """
    columns = chunks.columns
    h = found.groupBy("doc_id", F.col("offset").alias("_at")).agg(F.max("heading").alias("_heading")).withColumn("_row", F.lit(None).cast(chunks.select(F.struct(*columns).alias("r")).schema["r"].dataType))
    c = chunks.select("doc_id", F.col("start").alias("_at"), F.lit(None).cast("string").alias("_heading"), F.struct(*columns).alias("_row"))
    w = Window.partitionBy("doc_id").orderBy("_at", F.col("_row").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    d = c.unionByName(h).withColumn("active_heading", F.last("_heading", ignorenulls=True).over(w)).filter("_row is not null")
    return d.select("_row.*", "active_heading")


def pages(text: Column) -> Column:
    """Pages between form feeds, blank ones left out."""
    return F.filter(F.split(text, "\f"), lambda p: F.trim(p) != "")
