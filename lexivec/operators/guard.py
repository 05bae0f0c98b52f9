"""Guardrails as projections: patterns, redaction, reactions, topic, citations, rate limits, validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexivec.compat import written
from lexivec.functions import lexicon as L
from lexivec.functions.automaton import Seen, with_seen
from lexivec.functions.text import any_needed, any_of, folded, found, java, needs

SEVERITIES = ("none", "low", "medium", "high", "critical")


def _may_have(kind: str, text: Column) -> Column:
    """Whether a kind of personal data is possible at all: an address needs its sign, all others a digit."""
    return text.contains("@") if kind == "email" else text.rlike("[0-9]")


def pii_kinds(text: Column) -> Column:
    """Kinds of personal data found, in the order of the patterns."""
    return F.array_compact(F.array(*[F.when(_may_have(k, text) & text.rlike(java(p)), F.lit(k)) for k, p in L.PII]))


def redact(text: Column) -> Column:
    """The text with each kind's matches replaced, one kind after the other."""
    replaced = lambda t, kind, p: F.regexp_replace(t, java(p), f"[REDACTED_{kind.upper()}]")
    email, out = text, text
    for kind, p in L.PII:
        out = replaced(out, kind, p)
        email = replaced(email, kind, p) if kind == "email" else email
    # Without a digit only addresses are possible, and without their sign nothing.
    return F.when(_may_have("phone", text), out).when(_may_have("email", text), email).otherwise(text)


def hits(text: Column, patterns: tuple[str, ...], low: Column | Seen | None = None) -> Column:
    """Places, from 0, of the patterns that match."""
    low = folded(text) if low is None else low
    all_ = F.array_compact(F.array(*[F.when(found(text, p, low), F.lit(k)) for k, p in enumerate(patterns)]))
    return F.when(any_needed(low, patterns), all_).when(text.isNotNull(), F.array().cast("array<int>"))


def reaction(text: Column, low: Column | None = None, seen: Seen | None = None) -> Column:
    """First reaction that a pattern finds, kinds in order, or null; in each list of languages all kinds are tried.

    low: the text in lower case, best a column of its own; seen: the literals seen in it.
    """
    low = F.lower(text) if low is None else low
    where, rules = seen or low, L.REACTIONS_ID + L.REACTIONS_EN
    return F.when(any_needed(where, [p for _, p in rules]), F.coalesce(*[F.when(found(low, p, where), F.lit(k)) for k, p in rules]))


def reaction_severity(kind: Column) -> Column:
    out = F.lit(None).cast("string")
    for k, s in L.REACTION_SEVERITY.items():
        out = F.when(kind == k, s).otherwise(out)
    return out


def off_topic(text: Column, low: Column | Seen | None = None) -> Column:
    """Over 50 characters without topic word, question cue or command verb. low: the text in lower case, or what was seen in it."""
    low = F.lower(text) if low is None else low
    known = any_of(low, (*L.TOPICS, *L.COMMANDS))
    return (F.length(text) > 50) & ~known & ~text.rlike("(?i)" + L.QUESTION)


def severity_name(level: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, SEVERITIES)), level.cast("int") + 1)


#: What messages are scanned for: the literals that the patterns need, topics and commands.
INPUT_LITERALS = (*needs(L.INJECTION, L.TOXICITY, L.INTEGRITY, [p for _, p in L.REACTIONS_ID + L.REACTIONS_EN]), *L.TOPICS, *L.COMMANDS)


def validate_input(df: DataFrame, text: str = "text") -> DataFrame:
    """df with pii, injections, toxic, dishonest, off_topic, reaction, blocked, severity, redacted."""
    t, low = F.col(text), F.col("_lower")
    # Lower case is made once, in a projection of its own, and scanned once for the literals of all lists.
    d, seen = with_seen(df.select("*", F.lower(t).alias("_lower")), low, INPUT_LITERALS)
    d = d.select(
        *df.columns, pii_kinds(t).alias("pii"), hits(t, L.INJECTION, seen).alias("injections"), hits(t, L.TOXICITY, seen).alias("toxic"),
        hits(t, L.INTEGRITY, seen).alias("dishonest"), off_topic(t, seen).alias("off_topic"), reaction(t, low, seen).alias("reaction"), redact(t).alias("redacted"),
    )
    some = lambda c: F.size(c) > 0
    level = F.greatest(
        F.when(some("injections") | F.arrays_overlap("pii", F.array(*map(F.lit, L.CRITICAL_PII))), 4).otherwise(0),
        F.when(some("pii") | some("toxic"), 3).otherwise(0),
        F.when(some("dishonest"), 2).otherwise(0),
        F.when(F.col("off_topic"), 1).otherwise(0),
    )
    return d.withColumn("blocked", some("injections") | some("toxic")).withColumn("severity", severity_name(level))


def sentiment(reply: Column) -> Column:
    """struct<sentiment, confidence, action> of a judge's JSON reply; neutral, 0.5 and continue where it can't be read."""
    clean = F.trim(F.regexp_replace(reply, r"```(?:json)?", ""))
    got = F.from_json(clean, "sentiment string, confidence double, suggestedAction string")
    return F.struct(
        F.coalesce(got["sentiment"], F.lit("neutral")).alias("sentiment"), F.coalesce(got["confidence"], F.lit(0.5)).alias("confidence"), F.coalesce(got["suggestedAction"], F.lit("continue")).alias("action")
    )


def escalates(reaction_kind: Column, judged: Column | None = None) -> Column:
    """Whether a message needs a person: frustration, or a judge's word (see `sentiment`)."""
    out = F.coalesce(reaction_kind == "frustration", F.lit(False))
    return out if judged is None else out | F.coalesce(judged["action"] == "escalate", F.lit(False))


def risky(answer: Column) -> Column:
    """Whether an answer claims what should be checked."""
    out = F.lit(False)
    for p in L.RISKY:
        out = out | answer.rlike(java(p))
    return out


#: Over this similarity of the least alike passage, answers are not checked for invention.
SURE = 0.85


def to_check(answer: Column, similarity: Column | None = None) -> Column:
    """Whether an answer is to be checked for invention: a risky claim, unless all passages were close to the question."""
    return risky(answer) if similarity is None else risky(answer) & ~F.coalesce(similarity > SURE, F.lit(False))


def validate_output(df: DataFrame, answer: str, context: str, similarity: str | None = None, invented: Column | None = None) -> DataFrame:
    """df with pii, toxic, risky (to be checked), hallucinated, unverified citations, blocked and severity, for answers.

    context: the retrieved passages, null if none were. invented: a judge's verdict, asked for only where `risky` holds and
    there is a context; without one nothing counts as invented.
    """
    t, c = F.col(answer), F.col(context)
    d, seen = with_seen(df, F.lower(t), needs(L.TOXICITY))
    asked = to_check(t, F.col(similarity) if similarity else None) & c.isNotNull()
    d = d.select(
        *df.columns, pii_kinds(t).alias("pii"), hits(t, L.TOXICITY, seen).alias("toxic"), asked.alias("risky"),
        F.when(c.isNotNull(), unverified(t, c)).otherwise(F.array().cast("array<string>")).alias("unverified"),
    )
    d = d.withColumn("hallucinated", F.lit(False) if invented is None else F.coalesce(F.col("risky") & invented, F.lit(False)))
    some = lambda x: F.size(x) > 0
    level = F.greatest(F.when(some("pii") | some("toxic"), 3).otherwise(0), F.when(F.col("hallucinated"), 2).otherwise(0), F.when(some("unverified"), 1).otherwise(0))
    return d.withColumn("blocked", some("toxic")).withColumn("severity", severity_name(level))


def run_guardrails(requests: DataFrame, most: int = 50, window_ms: int = 60_000) -> DataFrame:
    """event_id, user_id, rate_passed, input_passed, output_passed, passed, escalate of requests (event_id, user_id, ts, text,
    answer, context).

    The rate comes first: a request over it is judged no further. Input and output are judged where they are; what is not
    judged is null, and does not count against passing.
    """
    rate = rate_limit(requests, most, window_ms).withColumnRenamed("passed", "rate_passed")
    d = requests.select("event_id", "user_id", "text", "answer", "context").join(rate, ["user_id", "event_id"])
    i = validate_input(d.select("event_id", "user_id", "rate_passed", "text", "answer", "context"))
    i = i.select("event_id", "user_id", "rate_passed", "answer", "context", F.when(F.col("text").isNotNull(), ~F.col("blocked")).alias("input_passed"), escalates(F.col("reaction")).alias("escalate"))
    o = validate_output(i, "answer", "context").withColumn("output_passed", F.when(F.col("answer").isNotNull() & F.col("context").isNotNull(), ~F.col("blocked")))
    only = lambda c: F.when(F.col("rate_passed"), F.col(c)).alias(c)
    yes = lambda c: F.coalesce(F.col(c), F.lit(True))
    d = o.select("event_id", "user_id", "rate_passed", only("input_passed"), only("output_passed"), only("escalate"))
    return d.withColumn("passed", F.col("rate_passed") & yes("input_passed") & yes("output_passed"))


def audit_rows(checked: DataFrame, key: str, stage: str) -> DataFrame:
    """A row for each rule that a checked message broke: key, stage, rule, severity, action. For the audit log."""
    rule = lambda found, name, severity, action: F.when(found, F.struct(F.lit(name).alias("rule"), F.lit(severity).alias("severity"), F.lit(action).alias("action")))
    some = lambda c: F.size(c) > 0
    known = {
        "injections": rule(some("injections"), "prompt_injection", "critical", "blocked") if "injections" in checked.columns else None,
        "pii": rule(some("pii"), "pii_detection", "high", "redacted" if stage == "input" else "flagged"),
        "toxic": rule(some("toxic"), "toxicity", "high", "blocked"),
        "dishonest": rule(some("dishonest"), "academic_integrity", "medium", "flagged") if "dishonest" in checked.columns else None,
        "hallucinated": rule(F.col("hallucinated"), "hallucination", "medium", "flagged") if "hallucinated" in checked.columns else None,
        "off_topic": rule(F.col("off_topic"), "topic_relevance", "low", "warned") if "off_topic" in checked.columns else None,
        "unverified": rule(some("unverified"), "citation", "low", "flagged") if "unverified" in checked.columns else None,
    }
    rules = F.array_compact(F.array(*[c for c in known.values() if c is not None]))
    return checked.select(key, F.lit(stage).alias("stage"), F.explode(rules).alias("r")).select(key, "stage", "r.*")


def unverified(answer: Column, context: Column) -> Column:
    """Citations of the answer that the context has neither as they stand nor by author and year; numbers are trusted."""

    def missing(c: Column) -> Column:
        author, year = F.trim(F.regexp_extract(c, L.AUTHOR_YEAR, 1)), F.regexp_extract(c, L.AUTHOR_YEAR, 2)
        by_parts = (year != "") & context.contains(author) & context.contains(year)
        return ~context.contains(c) & ~by_parts & ~c.rlike(r"^\[\d+\]$")

    return F.filter(F.regexp_extract_all(answer, F.lit(L.CITATION), F.lit(0)), missing)


def _openers(times: DataFrame, window_ms: int) -> DataFrame:
    """u, bucket, t: the times at which windows open, of distinct times (u, bucket, t); bucket: t by the window's length.

    A window opens with the first request after the last one closed. Openers are more than a window apart, so a bucket has
    one at most, and the next one of a time lies in the next bucket, or is the first time after that. A time that nothing
    precedes within a window's length opens one in any case; from these the others are reached by pointers to the next
    opener, whose reach doubles each round.
    """
    ends = times.groupBy("u", "bucket").agg(F.min("t").alias("least"), F.max("t").alias("most"))
    # A row per bucket: the first time of the next bucket that has one.
    ends = ends.withColumn("then", F.lead("least").over(Window.partitionBy("u").orderBy("bucket")))
    at = lambda d, shift, *columns: d.select(F.col("u"), (F.col("bucket") + shift).alias("bucket"), *columns)
    # Within a bucket, times meet those of the next one in order: each asks for the first after it and a window's length.
    asks = times.select("u", (F.col("bucket") + 1).alias("bucket"), (F.col("t") + window_ms).alias("k"), F.lit(1).alias("kind"), "t")
    both = asks.union(times.select("u", "bucket", F.col("t").alias("k"), F.lit(0).alias("kind"), "t"))
    later = Window.partitionBy("u", "bucket").orderBy("k", "kind").rowsBetween(1, Window.unboundedFollowing)
    found = both.withColumn("to", F.first(F.when(F.col("kind") == 0, F.col("t")), ignorenulls=True).over(later)).filter("kind = 1")
    # Otherwise the first time of a later bucket: that after the next one if the next has any, else that after its own.
    found = found.join(at(ends, 0, F.col("then").alias("after_next")), ["u", "bucket"], "left").join(at(ends, 1, F.col("then").alias("after_own")), ["u", "bucket"], "left")
    next_one = F.when(F.col("after_own") < F.col("bucket") * window_ms, F.lit(None)).otherwise(F.col("after_own"))
    beyond = F.when(F.floor(next_one / window_ms) > F.col("bucket"), next_one).otherwise(F.col("after_next"))
    jumps = written(found.select("u", "t", F.coalesce("to", beyond).alias("to")).filter("to is not null"), "jumps")
    before = F.coalesce(F.lag("t").over(Window.partitionBy("u", "bucket").orderBy("t")), F.col("previous"))
    fresh = times.join(at(ends, 1, F.col("most").alias("previous")), ["u", "bucket"], "left").withColumn("before", before)
    reached = written(fresh.filter(F.col("before").isNull() | (F.col("before") < F.col("t") - window_ms)).select("u", "t"), "openers")
    while True:
        new = reached.join(jumps, ["u", "t"]).select("u", F.col("to").alias("t")).join(reached, ["u", "t"], "left_anti").distinct()
        new = written(new, "openers")
        if new.isEmpty():
            return reached.select("u", F.floor(F.col("t") / window_ms).alias("bucket"), "t")
        reached = written(reached.union(new), "openers")
        far = jumps.select("u", F.col("t").alias("to"), F.col("to").alias("far"))
        jumps = written(jumps.join(far, ["u", "to"]).select("u", "t", F.col("far").alias("to")), "jumps")


def rate_limit(events: DataFrame, most: int = 50, window_ms: int = 60_000) -> DataFrame:
    """user_id, event_id, passed: a window opens with the first request after the last one closed, and lets `most` pass.

    No user's requests meet in one task: they are dealt out by times, window by window. Requests without a time pass, and
    open nothing; rows that repeat a request are judged alike.
    """
    if window_ms < 1 or most < 1:
        raise ValueError("a window needs a length, and lets one request pass at least")
    e = events.select("user_id", F.coalesce(F.concat(F.lit("="), F.col("user_id").cast("string")), F.lit("")).alias("u"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at"), "event_id")
    timed = e.filter("at is not null").withColumn("bucket", F.floor(F.col("at") / window_ms))
    openers = _openers(written(timed.select("u", "bucket", F.col("at").alias("t")).distinct(), "times"), window_ms)
    # A window's requests lie in its opener's bucket and the next one.
    o = openers.select("u", F.explode(F.array(F.col("bucket"), F.col("bucket") + 1)).alias("bucket"), "t")
    o = o.groupBy("u", "bucket").agg(F.sort_array(F.collect_list("t"), False).alias("ts"))
    d = timed.join(o, ["u", "bucket"]).withColumn("opened", F.get(F.filter("ts", lambda t: t <= F.col("at")), F.lit(0))).drop("ts")
    # Only the first requests of a window are ranked; the last one of them tells for all.
    order = Window.partitionBy("u", "opened").orderBy("at", "event_id")
    ranked = d.select("u", "opened", "at", "event_id").distinct().withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most)
    last = ranked.groupBy("u", "opened").agg(F.max(F.struct("at", "event_id")).alias("last"))
    d = d.join(last, ["u", "opened"]).select("user_id", "event_id", (F.struct("at", "event_id") <= F.col("last")).alias("passed"))
    return d.union(e.filter("at is null").select("user_id", "event_id", F.lit(True).alias("passed")))
