"""An agent's loop for all sessions at once: guard, rounds of choosing and calling tools, synthesis, output guard, durations.

A round is one plan over the sessions that are still open: a chooser says for each which tools to call with what, or the
answer; each tool answers all calls of the round together. What was said is written before it is used, so a model behind
the chooser is asked once a round, also when executors are lost. There are as many rounds as the longest session needs, and
`max_steps` at most.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexivec.compat import written
from lexivec.operators.guard import validate_input, validate_output

MAX_STEPS = 5
#: What a user is told where there is no answer of the agent's own.
BLOCKED = "The question breaks the rules of use and is not answered."
WITHHELD = "The answer breaks the rules of use and is withheld."
NO_TOOL = "A tool was asked for that does not exist."
#: How much of an answer its step keeps.
REASONING = 200

_OBSERVED = "array<struct<step:int,call:int,tool:string,input:string,output:string>>"
_STEP = "array<struct<step_index:bigint,step_type:string,tool:string,input:string,output:string,reasoning:string,duration_ms:bigint>>"


def _observed(steps: list[DataFrame]) -> DataFrame | None:
    """session, observed: what its calls gave so far, in order."""
    if not steps:
        return None
    rows = steps[0]
    for s in steps[1:]:
        rows = rows.union(s)
    seen = F.sort_array(F.collect_list(F.struct("step", "call", "tool", "input", "output")))
    return rows.filter(F.col("tool").isNotNull()).groupBy("session").agg(seen.alias("observed"))


def _asked(sessions: DataFrame, steps: list[DataFrame], step: int) -> DataFrame:
    seen, none = _observed(steps), F.array().cast(_OBSERVED)
    d = sessions.withColumn("observed", none) if seen is None else sessions.join(seen, "session", "left").withColumn("observed", F.coalesce("observed", none))
    return d.select("session", "query_text", F.lit(step).alias("step"), "observed")


def run(
    questions: DataFrame, choose: Callable[[DataFrame], DataFrame], tools: dict[str, Callable[[DataFrame], DataFrame]], max_steps: int = MAX_STEPS,
    synthesise: Callable[[DataFrame], DataFrame] | None = None, now: Callable[[], Column] = F.current_timestamp,
) -> DataFrame:
    """session, answer, status, severity, n_steps, steps, citations of questions (session, query_text).

    choose: rows (session, query_text, step, observed) to rows (session, call, tool, input, text): calls to make, numbered, or
    one row without a tool and with the answer; a text beside calls is no answer yet. tools: each takes (session, call,
    input) and gives (session, call, output); a call that gets nothing has a null output. synthesise: gives (session, text)
    for sessions that used up their steps, or said nothing, from the same rows as the chooser.

    status: blocked (the question), answered, synthesised, no_tool, silent, or withheld (the answer was blocked). citations:
    the distinct outputs, in order of their first call.
    """
    judged = written(validate_input(questions.select("session", "query_text"), "query_text").select("session", "query_text", "blocked"), "judged")
    sessions = judged.filter(~F.coalesce("blocked", F.lit(False))).select("session", "query_text")
    steps, ended = [], []
    for step in range(max_steps):
        said = written(choose(_asked(sessions, steps, step)).select("session", F.col("call").cast("int").alias("call"), "tool", "input", "text", now().alias("at")), "said")
        calls = said.filter(F.col("tool").isNotNull())
        outputs = None
        for name, tool in tools.items():
            out = tool(calls.filter(F.col("tool") == name).select("session", "call", "input")).select("session", "call", "output")
            outputs = out if outputs is None else outputs.union(out)
        done = calls.withColumn("output", F.lit(None).cast("string")) if outputs is None else calls.join(outputs, ["session", "call"], "left")
        final = said.filter(F.col("tool").isNull() & (F.trim("text") != "")).join(calls.select("session"), "session", "left_anti")
        rows = done.select("session", F.lit(step).alias("step"), "call", "tool", "input", "output", F.lit(None).cast("string").alias("text"), "at")
        rows = rows.union(final.select("session", F.lit(step).alias("step"), "call", "tool", "input", F.lit(None).cast("string"), "text", "at"))
        steps.append(written(rows, "steps"))
        unknown = calls.filter(~F.col("tool").isin(*tools)).select("session").distinct()
        ended.append(unknown.select("session", F.lit("no_tool").alias("status"), F.lit(NO_TOOL).alias("text")))
        ended.append(final.groupBy("session").agg(F.lit("answered").alias("status"), F.min_by("text", "call").alias("text")))
        sessions = written(sessions.join(calls.select("session").distinct(), "session", "left_semi").join(unknown, "session", "left_anti"), "open")
        if sessions.isEmpty():
            break
    over = ended[0] if ended else sessions.select("session", F.lit("").alias("status"), F.lit("").alias("text")).limit(0)
    for e in ended[1:]:
        over = over.union(e)
    over = written(over, "ended")
    # Sessions without an end of their own: out of steps, or silent.
    rest = judged.filter(~F.coalesce("blocked", F.lit(False))).select("session", "query_text").join(over, "session", "left_anti")
    if synthesise is not None:
        made = written(synthesise(_asked(rest, steps, max_steps)).filter(F.trim("text") != "").select("session", F.lit("synthesised").alias("status"), "text"), "synthesised")
        over = over.union(made)
    seen = _observed(steps)
    d = judged.join(over, "session", "left")
    d = d.join(seen, "session", "left") if seen is not None else d.withColumn("observed", F.array().cast(_OBSERVED))
    outputs = F.array_distinct(F.filter(F.transform(F.coalesce("observed", F.array().cast(_OBSERVED)), lambda o: o["output"]), lambda o: o.isNotNull()))
    d = d.select("session", F.col("blocked").alias("refused"), F.when(F.col("blocked"), "blocked").otherwise(F.coalesce("status", F.lit("silent"))).alias("status"), F.coalesce("text", F.lit("")).alias("answer"), outputs.alias("citations"))
    d = validate_output(d.withColumn("context", F.when(F.size("citations") > 0, F.array_join("citations", "\n"))), "answer", "context")
    stopped = F.col("blocked") & (F.col("status") != "blocked")
    d = d.select(
        "session", F.when(F.col("status") == "blocked", BLOCKED).when(stopped, WITHHELD).otherwise(F.col("answer")).alias("answer"), F.when(stopped, "withheld").otherwise(F.col("status")).alias("status"), "severity", "citations",
    )
    found = _timed(steps, now)
    d = d.join(found, "session", "left") if found is not None else d.withColumn("steps", F.lit(None).cast(_STEP))
    d = d.withColumn("steps", F.coalesce("steps", F.array().cast(_STEP)))
    return d.select("session", "answer", "status", "severity", F.size("steps").cast("long").alias("n_steps"), "steps", "citations")


def _timed(steps: list[DataFrame], now: Callable[[], Column]) -> DataFrame | None:
    """session, steps: each lasts until the next one begins, the last until now."""
    if not steps:
        return None
    rows = steps[0]
    for s in steps[1:]:
        rows = rows.union(s)
    w = Window.partitionBy("session").orderBy("step", "call")
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    until = F.coalesce(F.lead("at").over(w), now())
    kind = F.when(F.col("tool").isNull(), "synthesis").otherwise("tool_call")
    step = F.struct((F.row_number().over(w) - 1).cast("long").alias("step_index"), kind.alias("step_type"), "tool", "input", "output", F.substring("text", 1, REASONING).alias("reasoning"), F.floor((us(until) - us(F.col("at"))) / 1000).alias("duration_ms"))
    return rows.select("session", step.alias("s")).groupBy("session").agg(F.sort_array(F.collect_list("s")).alias("steps"))
