"""Readers: files to texts with their envelope, question imports, tables."""

from __future__ import annotations

import io
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexivec.compat import ship_package
from lexivec.functions.text import word_count

ENVELOPE = "path string, file_type string, text string, encoding string, file_size long, error string"
TYPES = ("txt", "md", "pdf", "docx")


def encoding_of(content: Column) -> Column:
    """Encoding by a byte order mark; UTF-8 without one."""
    head = F.hex(F.substring(content, 1, 3))
    return F.when(head.startswith("EFBBBF"), "UTF-8").when(head.startswith("FFFE"), "UTF-16LE").when(head.startswith("FEFF"), "UTF-16BE").otherwise("UTF-8")


def decode_texts(files: DataFrame) -> DataFrame:
    """files (path, content) with encoding and text, by expressions."""
    e = encoding_of(F.col("content"))
    text = F.when(e == "UTF-16LE", F.decode("content", "UTF-16LE")).when(e == "UTF-16BE", F.decode("content", "UTF-16BE")).otherwise(F.decode("content", "UTF-8"))
    return files.withColumn("encoding", e).withColumn("text", F.regexp_replace(text, "^﻿", ""))


def docx_text(content: bytes) -> str:
    """Paragraphs of a DOCX file."""
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    return "\n".join("".join(t.text or "" for t in p.iter(f"{w}t")) for p in root.iter(f"{w}p"))


def pdf_pages(content: bytes) -> list[str]:
    """Texts of a PDF's pages, if a PDF library is there."""
    try:
        import pypdf
    except ImportError as e:
        raise ValueError("reading PDF files needs pypdf; extracted text with form feeds can be read as txt") from e
    return [p.extract_text() or "" for p in pypdf.PdfReader(io.BytesIO(content)).pages]


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """ENVELOPE of every txt, md, pdf and docx file under a path; what can't be read has an error and no text."""
    ship_package(spark)
    d = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return extract(d.select("path", "length", "content"))


def extract(files: DataFrame) -> DataFrame:
    """ENVELOPE of files (path, length, content), batch or stream."""
    kind = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    d = decode_texts(files.withColumn("file_type", kind))

    def rows(frames):
        for f in frames:
            out = []
            for r in f.itertuples():
                text, error = r.text, None
                try:
                    if r.file_type == "docx":
                        text = docx_text(bytes(r.content))
                    elif r.file_type == "pdf":
                        text = "\f".join(pdf_pages(bytes(r.content)))
                    elif r.file_type not in TYPES:
                        raise ValueError(f"unsupported file type: {r.file_type}")
                    if not text.strip():
                        raise ValueError("empty text")
                except Exception as e:  # a file that can't be read is a row with its error
                    text, error = None, str(e)
                out.append((r.path, r.file_type, text, r.encoding, r.length, error))
            yield pd.DataFrame(out, columns=[x.split()[0] for x in ENVELOPE.split(", ")])

    return d.select("path", "file_type", "text", "encoding", "length", "content").mapInPandas(rows, ENVELOPE)


def documents_of(envelopes: DataFrame) -> DataFrame:
    """Document rows: title from the file name, word count, status."""
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return envelopes.select(
        F.sha2("path", 256).alias("doc_id"), F.regexp_replace(name, r"\.[^.]+$", "").alias("title"), name.alias("file_name"), "file_type", "file_size",
        F.col("text").alias("content"), word_count(F.coalesce("text", F.lit(""))).alias("words"),
        F.when(F.col("error").isNull(), "completed").otherwise("failed").alias("processing_status"), F.col("error").alias("processing_error"),
    )


def markdown_headings(text: Column) -> Column:
    """array<struct<level, text>> of `#` lines."""
    marks, words = F.regexp_extract_all(text, F.lit(r"(?m)^(#{1,6})\s+(.+)$"), F.lit(1)), F.regexp_extract_all(text, F.lit(r"(?m)^(#{1,6})\s+(.+)$"), F.lit(2))
    return F.zip_with(marks, words, lambda m, w: F.struct(F.length(m).alias("level"), F.trim(w).alias("text")))


def line_headings(text: Column, kind: str) -> Column:
    """Headings by the look of a line. pdf: all capitals (level 1) or Title Case (2), under 80 characters. docx: numbered
    with a capital (level by its dots, 6 at most) or all capitals, under 100."""
    lines = F.transform(F.split(text, "\n"), F.trim)
    caps = lambda x: x.rlike(r"^[A-Z][A-Z0-9\s\W]{3,}$") & (F.upper(x) == x)
    if kind == "pdf":
        found = F.filter(lines, lambda x: (F.length(x) < 80) & (caps(x) | x.rlike(r"^(?:[A-Z][a-z]+\s)*[A-Z][a-z]+$")))
        return F.transform(found, lambda x: F.struct(F.when(caps(x), 1).otherwise(2).alias("level"), x.alias("text")))
    number = r"^(\d+(?:\.\d+)*)\.?\s+[A-Z]"
    found = F.filter(lines, lambda x: (F.length(x) < 100) & (x.rlike(number) | caps(x)))
    depth = lambda x: F.least(F.size(F.split(F.regexp_extract(x, number, 1), r"\.")), F.lit(6))
    return F.transform(found, lambda x: F.struct(F.when(x.rlike(number), depth(x)).otherwise(1).alias("level"), x.alias("text")))


def page_breaks(text: Column) -> Column:
    """Offsets at which the pages of a text with form feeds begin, when joined by blank lines."""
    lengths = F.transform(F.split(text, "\f"), lambda p: F.length(p) + 2)
    return F.transform(F.sequence(F.lit(0), F.size(lengths) - 1), lambda i: F.aggregate(F.slice(lengths, 1, i), F.lit(0), lambda a, x: a + x))


def import_questions(spark: SparkSession, path: str, run_id: str) -> DataFrame:
    """Questions of a JSON array; any row without question or ground truth rejects the whole import."""
    d = spark.read.schema("question string, groundTruth string").option("multiLine", "true").json(path)
    bad = d.filter("question is null or groundTruth is null or trim(question) = '' or trim(groundTruth) = ''")
    if not bad.isEmpty():
        raise ValueError("every question needs a text and a ground truth")
    return d.select(F.lit(run_id).alias("run_id"), "question", F.col("groundTruth").alias("ground_truth"))


def with_total(runs: DataFrame, imported: DataFrame) -> DataFrame:
    """runs (run_id, total_questions) with the number of questions that were imported last for them, as before for others."""
    n = imported.groupBy("run_id").agg(F.count("*").alias("_n"))
    return runs.join(n, "run_id", "left").withColumn("total_questions", F.coalesce("_n", "total_questions")).drop("_n")


BANK = "question string, groundTruth string, category string, difficulty string, language string"


def question_bank(spark: SparkSession, path: str) -> DataFrame:
    """A bank of questions, a JSON array of objects with the fields of BANK."""
    return spark.read.schema(BANK).option("multiLine", "true").json(path)


def questions(bank: DataFrame, category: str | None = None, difficulty: str | None = None, language: str | None = None, n: int | None = None, seed: int = 42, key: str = "id") -> DataFrame:
    """The bank's questions of a category, difficulty and language, or n of them drawn by a seeded hash of their key."""
    d = bank
    for column, value in (("category", category), ("difficulty", difficulty), ("language", language)):
        if value is not None:
            d = d.filter(F.col(column) == value)
    if n is None:
        return d
    return d.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key).limit(n)


def question_sample(bank: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """n questions of a bank, drawn by a seeded hash: a rerun draws the same."""
    return questions(bank, n=n, seed=seed, key="question")


def by_key(df: DataFrame, key: str, value) -> DataFrame:
    """The rows of one key: none if there is no such key."""
    return df.filter(F.col(key) == F.lit(value))


def listed(df: DataFrame, order: str, newest_first: bool = True) -> DataFrame:
    """df in the order of a time, newest first unless told."""
    return df.orderBy(F.desc(order) if newest_first else F.asc(order))
