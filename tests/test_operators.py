"""Hand-computed values, properties, and batch against stream."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexivec import providers
from lexivec.functions import text as T
from lexivec.operators import chunking as C
from lexivec.operators import domain as D
from lexivec.operators import guard as G
from lexivec.operators import retrieval as R
from lexivec.operators import stats as X
from lexivec.plans import rag
from lexivec.sources import readers, sinks
from lexivec.streaming import streams

from .conftest import SF


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "text string").select(column.alias("x")).first()["x"]


def test_stemmer(spark):
    for word, to in (("makan", "mak"), ("penelitian", "eliti"), ("di", "di")):
        assert one(spark, T.stem(F.col("text")), word) == to


def test_normalisation(spark):
    assert one(spark, T.normalize_pdf(F.col("text")), "B A B  1") == "BAB 1"
    assert one(spark, T.normalize_pdf(F.col("text")), "2 0 2 4") == "2024"


def test_sentences(spark):
    assert one(spark, T.sentences(F.col("text")), "Dr. A met B. Then left.") == ["Dr. A met B.", "Then left."]
    assert one(spark, T.sentences(F.col("text")), "pi is 3.14. Next.") == ["pi is 3.14.", "Next."]


def test_rrf(spark):
    a = spark.createDataFrame([(1, 7, 1)], "query_id long, id long, rank long")
    b = spark.createDataFrame([(1, 7, 3)], "query_id long, id long, rank long")
    assert R.rrf(a, b).first()["fused"] == round(1 / 61 + 1 / 63, 8)
    assert R.rrf(b, a).first()["fused"] == R.rrf(a, b).first()["fused"]


def test_bm25_rises_with_frequency(spark):
    pool = spark.createDataFrame([(1, 1, "alpha beta gamma"), (1, 2, "alpha alpha gamma"), (1, 3, "delta delta delta")], "query_id long, id long, text string")
    q = spark.createDataFrame([(1, "alpha")], "query_id long, query_text string")
    s = {r["id"]: r["score"] for r in R.bm25(pool, q, False).collect()}
    assert s[2] > s[1] > s[3] == 0
    twice = {r["id"]: r["score"] for r in R.bm25(pool, q.withColumn("query_text", F.lit("alpha alpha")), False).collect()}
    assert twice[1] == pytest.approx(2 * s[1] * (9 * 2 / 10), rel=1e-5)


def test_rate_limit_batch_and_stream(spark, tmp_path):
    rows = [(1, k, f"2024-01-01 00:00:{t:02d}") for k, t in enumerate((0, 1, 2))] + [(1, 3, "2024-01-01 00:01:00"), (1, 4, "2024-01-01 00:01:01")]
    d = spark.createDataFrame(rows, "user_id long, event_id long, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    got = {r["event_id"]: r["passed"] for r in G.rate_limit(d, 2, 60_000).collect()}
    assert got == {0: True, 1: True, 2: False, 3: False, 4: True}
    e = spark.read.parquet(f"{SF}/events.parquet")
    e.write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    q = streams.rate_limited(source, 2, 86_400_000).writeStream.format("memory").queryName("limited").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    key = lambda d: sorted((r["user_id"], r["event_id"], r["passed"]) for r in d.collect())
    assert key(spark.table("limited")) == key(G.rate_limit(e, 2, 86_400_000))


def test_session_citations_stream(spark, tmp_path):
    d = spark.createDataFrame([(1, 1, 9), (1, 2, 8), (1, 3, 9), (2, 1, 8)], "session long, seq long, chunk long")
    d.coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(d.schema).parquet(str(tmp_path / "in"))
    streams.session_citations(source).writeStream.format("memory").queryName("cited").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    key = lambda d: sorted(map(tuple, d.select("session", "chunk", "citation").collect()))
    assert key(spark.table("cited")) == key(R.citation_numbers(d)) == [(1, 8, 2), (1, 9, 1), (2, 8, 1)]


def test_redaction_leaves_no_match(spark):
    t = "mail a@b.co or 10.0.0.1"
    out = one(spark, G.redact(F.col("text")), t)
    assert "a@b.co" not in out and "10.0.0.1" not in out and "[REDACTED_EMAIL]" in out


@settings(max_examples=60, deadline=None)
@given(st.text("ab. \n:;A", max_size=400), st.integers(5, 60))
def test_chunk_spans(text, size):
    spans = C.cut_spans(text, size, size // 5)
    assert all(0 <= a < b <= len(text) for a, b in spans)
    assert all(b - a <= size for a, b in spans)
    kept = {i for a, b in spans for i in range(a, b)}
    assert all(i in kept or c.isspace() or c in ".:;" for i, c in enumerate(text)) or not text.strip()


def test_hierarchical_and_heading(spark):
    d = spark.createDataFrame([(1, "word " * 900)], "doc_id long, text string")
    levels = {r["level"]: r["count"] for r in C.hierarchical_chunks(d, 500).groupBy("level").count().collect()}
    assert levels["parent"] == 1 and levels["child"] >= 9
    chunks = spark.createDataFrame([(1, 0), (1, 15)], "doc_id long, start long")
    found = spark.createDataFrame([(1, 10, "H")], "doc_id long, offset long, heading string")
    assert [r["active_heading"] for r in C.active_heading(chunks, found).orderBy("start").collect()] == [None, "H"]


def test_describe_small_groups(spark):
    d = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("b", 2.0), ("b", 6.0)], "g string, x double")
    r = {x["g"]: x for x in X.describe(d, ["g"], "x").collect()}
    assert r["a"]["variance"] is None and r["b"]["kurtosis"] == 0 and r["b"]["median"] == 2 and r["b"]["mean"] == 3


def test_t_tables(spark):
    d = spark.createDataFrame([(10, 2.5), (10, 3.5), (40, 2.0)], "df int, t double").select(X.t_p(F.col("t"), F.col("df")).alias("p"), X.t_critical(F.col("df")).alias("c")).collect()
    assert [r["p"] for r in d[:2]] == [0.05, 0.01] and [r["c"] for r in d] == [2.228, 2.228, 2.042]


def test_csv(spark):
    d = spark.createDataFrame([('a"b', 1.5, None)], "a string, b double, c string")
    assert sinks.csv_lines(d).first()["line"] == '"a""b",1.5000,-999'
    assert sinks.csv_lines(d, legacy=True).first()["line"] == 'a""b,1.5000,-999'


def test_sinks(spark, tmp_path):
    d = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "id long, version long, v string")
    assert sorted(r["v"] for r in sinks.current(d, "id", "version").collect()) == ["b", "c"]
    sinks.append(d, str(tmp_path / "t"))
    sinks.append(d, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 6
    gone = spark.createDataFrame([(1,)], "id long")
    left = sinks.cascade({"runs": d, "answers": d.select(F.col("id").alias("run_id"))}, gone, "runs", "id", {"answers": ("run_id", "id")})
    assert left["runs"].count() == 1 and left["answers"].count() == 1
    assert "DESCRIPTIVES VARIABLES=id version" in sinks.spss_syntax(d) and "read.csv" in sinks.analysis_script(d, "v", ["id"], "x.csv", "r")


def test_readers(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"\xef\xbb\xbfhello world")
    (tmp_path / "b.txt").write_bytes(b"\xff\xfe" + "grün".encode("utf-16-le"))
    (tmp_path / "c.md").write_text("# Head\ntext")
    (tmp_path / "d.exe").write_text("no")
    (tmp_path / "e.txt").write_text("  ")
    d = readers.documents_of(readers.read_files(spark, str(tmp_path)))
    got = {r["file_name"]: (r["content"], r["processing_status"]) for r in d.collect()}
    assert got["a.txt"] == ("hello world", "completed") and got["b.txt"][0] == "grün" and got["d.exe"][1] == "failed" and got["e.txt"][1] == "failed"
    assert one(spark, readers.markdown_headings(F.col("text")), "# Head\ntext\n## Sub") == [(1, "Head"), (2, "Sub")]
    assert one(spark, readers.page_breaks(F.col("text")), "ab\fcde\ff") == [0, 4, 9]


def test_ingest_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("One. Two.")
    streams.ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), C.recursive_chunks).start().awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out/documents")).count() == 1 and spark.read.parquet(str(tmp_path / "out/chunks")).count() == 1


def test_question_import(spark, tmp_path):
    (tmp_path / "q.json").write_text('[{"question": "a?", "groundTruth": "b"}]')
    assert readers.import_questions(spark, str(tmp_path / "q.json"), "r").count() == 1
    (tmp_path / "bad.json").write_text('[{"question": "a?"}]')
    with pytest.raises(ValueError):
        readers.import_questions(spark, str(tmp_path / "bad.json"), "r")


def test_report(spark):
    # A short line before a table is its title; what is no title is a pair, and the first section's pairs stand first.
    t = "TITLE\nKey : Val\n| a | b |\n| 1 | 2 |\n"
    assert D.serialise_report(t) == "## TITLE\n\n### Key : Val\n[Key : Val] a: 1, b: 2."
    t = "TITLE\nKey : Val\nIt ends.\n| a | b |\n| 1 | 2 |\n"
    assert D.serialise_report(t) == "# Informasi Umum\n\nKey adalah Val.\n\n## TITLE\n\nKey adalah Val.\n\na: 1, b: 2."
    rows = one(spark, T.ascii_table(F.col("text")), "| a | b |\n+--+--+\n| 1 | 2 |")
    assert rows == [{"a": "1", "b": "2"}]


def test_providers(spark):
    assert one(spark, providers.judged(F.col("text"), 0.5), '```json\n{"score": 1.7}\n```') == 1.0
    assert one(spark, providers.judged(F.col("text"), 0.5), "none") == 0.5
    assert one(spark, providers.sub_questions(F.col("text"), F.lit("q")), '["a", "b"]') == ["a", "b"]
    assert one(spark, providers.sub_questions(F.col("text"), F.lit("q")), "oops") == ["q"]
    v = providers.embed_text("alpha beta")
    assert sum(x * x for x in v) == pytest.approx(1)


def test_scores_and_agent(spark):
    a = spark.createDataFrame([(1, "what alpha", "alpha beta", "alpha beta gamma", "alpha"), (2, "q", "", "c", "t")], "query_id long, question string, answer string, context string, truth string")
    r = {x["query_id"]: x for x in rag.score_answers(a).collect()}
    assert r[1]["faithfulness_lexical"] == 1 and r[2]["hallucination_lexical"] == 1 and r[2]["faithfulness_lexical"] == 0
    random.seed(1)
    words = ["alpha", "beta", "gamma", "delta"]
    chunks = [(k, " ".join(random.choices(words, k=6))) for k in range(20)]
    c = spark.createDataFrame([(k, t, providers.embed_text(t)) for k, t in chunks], "id long, text string, embedding array<float>")
    parts = spark.createDataFrame([(1, p, w, providers.embed_text(w)) for p, w in enumerate(("alpha", "beta"))], "query_id long, part long, query_text string, query_vector array<float>")
    got = rag.multi_query(spark.createDataFrame([(1,)], "query_id long"), parts, c).collect()
    assert sorted(r["citation"] for r in got) == list(range(1, len(got) + 1)) and len({r["chunk"] for r in got}) == len(got)
