"""An agent's tools and its trace, as operators over whole batches of questions; and the prompts they fill."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexivec.operators import retrieval as R

PREVIEW = 500


def preview(text: Column) -> Column:
    """The first 500 characters, with an ellipsis where more follow."""
    return F.concat(F.substring(text, 1, PREVIEW), F.when(F.length(text) > PREVIEW, "...").otherwise(""))


def search_tool(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """session, chunk, citation, part, title, content (a preview), score of hits (session, part, rank, chunk, score).

    A chunk that several sub-questions of a session find is once there, under its first part and rank, and numbered so.
    chunks: chunk, title, text.
    """
    first = hits.groupBy("session", "chunk").agg(F.min_by(F.struct("part", "rank", "score"), F.struct("part", "rank")).alias("h"))
    number = F.row_number().over(Window.partitionBy("session").orderBy("h.part", "h.rank", "chunk")).cast("long")
    d = first.select("session", "chunk", number.alias("citation"), F.col("h.part").alias("part"), F.round("h.score", 3).alias("score"))
    return d.join(chunks.select("chunk", "title", preview(F.col("text")).alias("content")), "chunk")


def distinct_contents(results: DataFrame, key: str, order: list[str], content: str = "content") -> DataFrame:
    """The first of each key's rows with one content. A preview and its full text are two contents."""
    first = results.groupBy(key, F.xxhash64(content).alias("_h"), content).agg(F.min(F.struct(*order)).alias("_first"))
    return first.select(key, content, "_first.*")


def called(steps: DataFrame, results: DataFrame) -> DataFrame:
    """steps (session, call_id, ...) with the output of their call; null where it has none."""
    return steps.join(results.select("session", "call_id", "output"), ["session", "call_id"], "left")


def verified(reply: Column) -> Column:
    """struct<supported, confidence, evidence> of a judge's JSON reply; false and 0 where it can't be read."""
    got = F.from_json(F.trim(F.regexp_replace(reply, r"```(?:json)?", "")), "supported boolean, confidence double, evidence string")
    return F.struct(F.coalesce(got["supported"], F.lit(False)).alias("supported"), F.coalesce(got["confidence"], F.lit(0.0)).alias("confidence"), F.coalesce(got["evidence"], F.lit("not verified")).alias("evidence"))


def sources_text(sources: DataFrame) -> DataFrame:
    """session, sources, n: the texts of sources (session, citation, title, content), numbered, in the order of citations."""
    part = F.concat(F.lit("["), F.col("citation").cast("string"), F.lit("] "), "title", F.lit(":\n"), "content")
    parts = F.sort_array(F.collect_list(F.struct("citation", part.alias("part"))))
    return sources.groupBy("session").agg(F.array_join(F.transform(parts, lambda p: p["part"]), "\n\n").alias("sources"), F.count("*").alias("n"))


def trace(calls: DataFrame) -> DataFrame:
    """session, step_index, step_type, duration_ms, tokens of calls (session, at, kind, tokens): a finished step a row.

    A step lasts from the end of the one before it, the first from the session's start (`started`).
    """
    w = Window.partitionBy("session").orderBy("at", "kind")
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    kind = F.when(F.col("kind") == "text", "synthesis").otherwise("tool_call")
    d = calls.withColumn("_before", F.coalesce(F.lag("at").over(w), F.col("started")))
    return d.select("session", (F.row_number().over(w) - 1).cast("long").alias("step_index"), kind.alias("step_type"), F.floor((us("at") - us("_before")) / 1000).alias("duration_ms"), "tokens")


#: System prompts: what an assistant is told before the context.
PROMPTS = {
    "rag": "Answer from the given context only. Cite each claim by the number of its source in brackets. Say what the context lacks.",
    "agentic": "Split the question, search for each part, check claims against what was found, then answer with numbered sources.",
    "plain": "Answer the question from general knowledge. Say where you are not sure.",
}

#: What a document's type adds to the prompt.
TYPE_HINTS = {"syllabus": "The sources are course plans.", "rps": "The sources are course plans.", "research_paper": "The sources are papers: name authors and years.", "thesis": "The sources are theses: name authors and years."}


def prompt(question: Column, context: Column, kind: str = "rag", doc_type: Column | None = None, course: Column | None = None, faculty: Column | None = None) -> Column:
    """The prompt of each question with its context, the hint of the sources' type, and course and faculty if known."""
    hint = F.lit("")
    if doc_type is not None:
        hint = F.coalesce(*[F.when(doc_type == k, F.lit("\n" + v)) for k, v in TYPE_HINTS.items()], F.lit(""))
    said = lambda label, c: F.lit("") if c is None else F.when(c.isNotNull(), F.concat(F.lit(f"\n{label}: "), c)).otherwise("")
    return F.concat(F.lit(PROMPTS[kind]), hint, said("Course", course), said("Faculty", faculty), F.lit("\n\n## Context\n"), F.coalesce(context, F.lit("")), F.lit("\n\n## Question\n"), question)


def run(questions: DataFrame, parts: DataFrame, chunks: DataFrame, most_parts: int = 5, top_k: int = 5) -> DataFrame:
    """session, blocked, sources, n of questions (session, query_text): an agent's run as one plan for all questions.

    The guard blocks first; each question's parts (session, part, query_text, query_vector), at most as many as the agent has
    steps, are searched together; chunks (id, title, text, embedding) that several parts find are one source. The answer is
    asked for with `prompt`, and checked by `guard.validate_output`.
    """
    from lexivec.operators.guard import validate_input

    judged = validate_input(questions.select("session", "query_text"), "query_text").select("session", "blocked")
    asked = parts.filter(F.col("part") < most_parts).join(judged.filter("not blocked"), "session", "left_semi")
    keyed = asked.withColumn("_id", F.xxhash64("session", "part"))
    hits = R.hybrid(chunks.select("id", "text", "embedding"), keyed.select(F.col("_id").alias("query_id"), "query_text", "query_vector"), top_k)
    hits = hits.join(keyed.select(F.col("_id").alias("query_id"), "session", "part"), "query_id").select("session", "part", "rank", F.col("id").alias("chunk"), F.col("fused").alias("score"))
    found = search_tool(hits, chunks.select(F.col("id").alias("chunk"), "title", "text"))
    return judged.join(sources_text(found), "session", "left").withColumn("n", F.coalesce("n", F.lit(0)))
