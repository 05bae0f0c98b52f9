"""Queries of chunking, sections, question answering and streams. Those without SQL are held against brute force in tests."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lexivec.compat import shared_folder, spread
from lexivec.functions import lexicon as L
from lexivec.operators import chunking as C
from lexivec.operators import domain as D
from lexivec.operators import retrieval as R
from lexivec.plans import rag
from lexivec.plans import sql as S
from lexivec.plans.text_queries import _OFF_SQL, _PII_SQL, _SENT_SQL, _t, _texts
from lexivec.streaming import streams


def recursive_chunks(spark, sf):
    return C.recursive_chunks(spread(_t(spark, sf, "documents")))


def hierarchical_chunks(spark, sf):
    return C.hierarchical_chunks(spread(_t(spark, sf, "documents")))


def semantic_chunks(spark, sf):
    return C.semantic_chunks(spread(_t(spark, sf, "documents")))


def sentence_window_chunks(spark, sf):
    return C.sentence_windows(_texts(spark, sf))


def sections(spark, sf):
    return D.sections(_texts(spark, sf))


def report_serialise(spark, sf):
    return D.serialised_reports(_texts(spark, sf))


def rag_context(spark, sf):
    """Context of every stated query over all chunks: guard, retrieval, rerank, budget."""
    from lexivec.plans.retrieval_queries import _chunks, _queries

    return rag.answer_contexts(_queries(spark, sf), _chunks(spark, sf))


def tournament_rerank(spark, sf):
    from lexivec.plans.retrieval_queries import _pool

    return R.tournament(_pool(spark, sf).select("query_id", "id", "score"))


def _streamed(spark, sf, name, make):
    """A table, a file or a folder of files, read as a stream to its end, into a table of the shared folder."""
    path = f"{sf}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    out = f"{shared_folder(spark)}/lexivec/stream-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    source = spark.readStream.schema(schema)
    # A stream reads the files of a folder; a table that is one file is picked from the folder it lies in.
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory():
        source = source.parquet(path)
    else:
        source = source.option("pathGlobFilter", f"{name}.parquet").parquet(f"{sf}/")
    d = make(source)
    d.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(d.schema).parquet(f"{out}/rows")


def stream_guard(spark, sf):
    d = _streamed(spark, sf, "conversations", lambda s: streams.guarded(s).select("conv_id", "turn", "severity", "blocked"))
    return d.groupBy("severity", "blocked").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (recursive_chunks, hierarchical_chunks, semantic_chunks, sentence_window_chunks, sections, report_serialise, rag_context, tournament_rerank, stream_guard)}

_LABEL = S.first_label("line", L.SECTIONS_EN)
_BATCH = f"""g as (select {_PII_SQL} pii, {S.which('text', L.INJECTION)} <> '' inj, {S.which('text', L.TOXICITY)} <> '' tox, {S.which('text', L.INTEGRITY)} <> '' dis, {_OFF_SQL} off_ from conversations)"""
ORACLES = {
    "stream_guard": f"with {_BATCH}, s as (select case when inj or regexp_matches(pii, '(^|,)(nik|ssn|creditCard)(,|$)') then 'critical' when pii <> '' or tox then 'high' when dis then 'medium' when off_ then 'low' else 'none' end severity, inj or tox blocked from g) select severity, blocked, count(*) n from s group by all",
    "sentence_window_chunks": f"with {S.TEXTS}, s as (select doc_id, {_SENT_SQL} ss from texts), u as (select doc_id, ss, unnest(range(len(ss))) pos from s) select doc_id, pos, ss[pos + 1] as content, array_to_string(ss[greatest(pos - 3, 0) + 1 : pos + 4], ' ') context from u",
    "sections": f"with {S.TEXTS}, l as (select doc_id, length(text) n, ls, unnest(range(len(ls))) pos from (select *, string_split(text, chr(10)) ls from texts)), o as (select doc_id, n, pos, ls[pos + 1] line, coalesce(sum(length(ls[pos + 1]) + 1) over (partition by doc_id order by pos rows between unbounded preceding and 1 preceding), 0)::bigint as start from l), x as (select *, {_LABEL} section from o) select doc_id, section, start, coalesce(lead(start) over (partition by doc_id order by start), n) as \"end\" from x where section is not null",
}
