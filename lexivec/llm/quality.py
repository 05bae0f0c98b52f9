"""Quality rules: a table of thresholds compiled into one projection of built-in expressions.

Defined results: a null or blank text has no words, all counts 0, base_failed true, kept false. Rows that repeat are
judged one by one. Texts of any length are read whole; their windows are compared by words, not only by hashes. Extra columns
pass through `annotate` untouched unless they bear the name of an added column, which then replaces them. An empty table
gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexivec.llm.common import table, whole_row, with_words

#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the be to of and that have with a in is on for as at by an it this was are from or "
    "le la les de des du un une et en que qui pour par dans est sur au avec "
    "der die das und ein eine in zu den von mit ist im für auf dem nicht "
    "el los las del y que una por con para su es se lo no"
).split()

SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """A document fails where the metric lies under `least` or over `most`."""

    metric: str
    least: float | None = None
    most: float | None = None


#: Thresholds of the base verdict. They are the contract of the query op5.
BASE_RULES = (Rule("n_words", least=50), Rule("repeat_word_ratio", most=0.5))

#: The other thresholds: wide enough for clean prose in any of the four languages.
RULES = (
    Rule("mean_word_chars", least=2.5, most=14.0),
    Rule("symbol_ratio", most=0.1),
    Rule("stop_word_ratio", least=0.02),
    Rule("dup_line_ratio", most=0.5),
    Rule("shout_ratio", most=0.3),
    Rule("bullet_line_ratio", most=0.9),
)


def _ratio(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def _gram(words: Column, at: Column) -> Column:
    """Hash of the three words from the 0-based place `at`."""
    return F.xxhash64(F.get(words, at), F.get(words, at + 1), F.get(words, at + 2))


def _window_keys(words: Column, n: Column, high: Column) -> Column:
    """Three-word windows as sorted longs: their hash in the high bits, their place in the low ones."""
    keys = F.sort_array(F.transform(F.sequence(F.lit(0), (n - 3).cast("int")), lambda i: _gram(words, i).bitwiseAND(high).bitwiseOR(i.cast("long"))))
    return F.when(n >= 3, keys).otherwise(F.array().cast("array<bigint>"))


def _place(key: Column, high: Column) -> Column:
    return key.bitwiseAND(F.bitwise_not(high)).cast("int")


def _same_words(words: Column, i: Column, j: Column) -> Column:
    return (F.get(words, i) == F.get(words, j)) & (F.get(words, i + 1) == F.get(words, j + 1)) & (F.get(words, i + 2) == F.get(words, j + 2))


def _near(a: Column, b: Column, high: Column) -> Column:
    return a.bitwiseAND(high) == b.bitwiseAND(high)


def _repeats(words: Column, keys: Column, high: Column) -> Column:
    """Places of the windows that occur twice or more.

    The sort brings equal windows together, and words decide. Should two windows share the high bits and differ, which could
    stand between equal ones, the text's windows are sorted by their words instead (`worded`), which takes n log n still.
    """
    same = lambda a, b: F.coalesce(_near(a, b, high) & _same_words(words, _place(a, high), _place(b, high)), F.lit(False))
    twice = F.filter(keys, lambda x, k: same(x, F.get(keys, k - 1)) | same(x, F.get(keys, k + 1)))
    by_words = lambda k: F.get("worded", k)["words"]
    again = F.filter("worded", lambda x, k: (x["words"] == by_words(k - 1)) | (x["words"] == by_words(k + 1)))
    return F.when(F.col("worded").isNotNull(), F.transform(again, lambda x: x["place"])).otherwise(F.transform(twice, lambda x: _place(x, high)))


def _worded(words: Column, n: Column, keys: Column, high: Column) -> Column:
    """The windows with their places, sorted by their words, where two that differ share the high bits; else null."""
    differ = lambda a, b: _near(a, b, high) & ~_same_words(words, _place(a, high), _place(b, high))
    odd = F.exists(F.transform(keys, lambda x, k: F.coalesce(differ(x, F.get(keys, k + 1)), F.lit(False))), lambda x: x)
    windows = F.transform(F.sequence(F.lit(0), (n - 3).cast("int")), lambda i: F.struct(F.slice(words, i + 1, 3).alias("words"), i.alias("place")))
    return F.when((n >= 3) & odd, F.sort_array(windows))


def _annotated(docs: DataFrame, rules: tuple[Rule, ...] = RULES, base: tuple[Rule, ...] = BASE_RULES, text: str = "text") -> DataFrame:
    """row (all columns of docs) with the counts, the ratios, base_failed, kept and the failed metrics."""
    body = F.coalesce(F.col(text), F.lit(""))
    d = docs.select(whole_row(docs), body.alias("text"), F.split(body, "\n").alias("split"))
    d = with_words(d, "text", "words")
    d = d.select("*", F.size("words").alias("n"), F.filter("split", lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    n, words = F.col("n"), F.col("words")
    # As many low bits as places need; at least one window, or the sequence would run backwards.
    d = d.withColumn("high", F.expr("shiftleft(-1L, cast(ceil(log2(n + 1)) as int))"))
    d = d.withColumn("keys", _window_keys(words, n, F.col("high")))
    d = d.withColumn("worded", _worded(words, n, F.col("keys"), F.col("high")))
    d = d.withColumn("hits", _repeats(words, F.col("keys"), F.col("high")))
    covered = F.size(F.array_distinct(F.flatten(F.transform("hits", lambda p: F.array(p, p + 1, p + 2)))))
    stop = [*dict.fromkeys(f(w) for w in STOP_WORDS for f in (str, str.capitalize, str.upper))]
    counts = {
        "n_words": n,
        "word_chars": F.length(F.array_join("words", "")),
        "n_symbols": F.length(F.regexp_replace("text", f"[^{SYMBOLS}]+", "")),
        "n_dup_lines": F.size("lines") - F.size(F.array_distinct("lines")),
        "n_repeat_words": F.when(F.size("hits") == 0, F.lit(0)).otherwise(covered),
        "n_lines": F.size("lines"),
        "n_stop_words": F.size(F.filter("words", lambda w: w.isin(stop))),
        "n_bullet_lines": F.size(F.filter("lines", lambda x: x.rlike(r"^\s*[-*•]"))),
        "n_shouts": F.length(F.regexp_replace("text", "[^!]+", "")),
    }
    d = d.select("row", *[c.cast("long").alias(k) for k, c in counts.items()], F.monotonically_increasing_id().alias("number"))
    q = {c: F.col(c) for c in counts}
    ratios = {
        "mean_word_chars": _ratio(q["word_chars"], q["n_words"]),
        "symbol_ratio": _ratio(q["n_symbols"], q["n_words"]),
        "stop_word_ratio": _ratio(q["n_stop_words"], q["n_words"]),
        "dup_line_ratio": _ratio(q["n_dup_lines"], q["n_lines"]),
        "bullet_line_ratio": _ratio(q["n_bullet_lines"], q["n_lines"]),
        "shout_ratio": _ratio(q["n_shouts"], q["n_words"]),
        "repeat_word_ratio": _ratio(q["n_repeat_words"], q["n_words"]),
    }
    d = d.select("row", "number", *q, *[r.alias(k) for k, r in ratios.items()])

    def failed(rule: Rule) -> Column:
        value, out = F.col(rule.metric), F.lit(False)
        if rule.least is not None:
            out = out | (value < rule.least)
        if rule.most is not None:
            out = out | (value > rule.most)
        return out

    def names(some: tuple[Rule, ...]) -> Column:
        return F.array_compact(F.array(*[F.when(failed(r), F.lit(r.metric)) for r in some])) if some else F.array().cast("array<string>")

    d = d.withColumn("failed_rules", F.concat(names(base), names(rules)))
    d = d.withColumn("base_failed", F.coalesce(F.expr(" or ".join(["false", *[f"array_contains(failed_rules, '{r.metric}')" for r in base]])), F.lit(False)))
    # The row number is never negative. As it isn't deterministic, it keeps Spark from moving a filter on these columns
    # below the counts, where each use would repeat the whole expression.
    d = d.withColumn("kept", (F.size("failed_rules") == 0) & (F.col("number") >= 0))
    return d.select("row", *counts, *ratios, "failed_rules", "base_failed", "kept")


def annotate(docs: DataFrame, **options) -> DataFrame:
    """docs with the counts, the ratios, base_failed, kept and the failed metrics."""
    d = _annotated(docs, **options)
    added = d.columns[1:]
    return d.select(*[F.col("row")[c].alias(c) for c in docs.columns if c not in added], *added)


def keep_good(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that pass every rule, with the columns of docs, of any name and type."""
    return _annotated(docs, **options).filter("kept").select("row.*")


def op5_quality_rules(spark, sf_dir: str) -> DataFrame:
    d = annotate(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_RULE_SQL = """
  n_words >= 50 and 100 * n_repeat_words <= 50 * n_words
  and word_chars::double / n_words between 2.5 and 14.0 and n_symbols::double / n_words <= 0.1
  and n_stop::double / n_words >= 0.02 and coalesce(n_dup_lines::double / nullif(n_lines, 0), 0) <= 0.5
  and coalesce(n_bullets::double / nullif(n_lines, 0), 0) <= 0.9 and n_shouts::double / n_words <= 0.3"""

#: Counts of one row per document in DuckDB; the repeats come from the exploded windows.
COUNTS_SQL = """
with w as (
  select doc_id, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) ls
  from {docs}),
g as (select doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] gram
      from (select doc_id, ws, unnest(range(1, len(ws) - 1)) i from w)),
r as (select doc_id, i from (select *, count(*) over (partition by doc_id, gram) c from g) where c > 1),
rep as (select doc_id, count(distinct i + k) n from r, (values (0), (1), (2)) v(k) group by doc_id),
m as (
  select w.doc_id, len(ws)::bigint n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::bigint word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::bigint n_symbols, (len(ls) - len(list_distinct(ls)))::bigint n_dup_lines,
    coalesce(rep.n, 0)::bigint n_repeat_words, len(ls) n_lines,
    len(list_filter(ws, lambda x: x in ({stop}))) n_stop,
    len(list_filter(ls, lambda x: regexp_matches(x, '^\\s*[-*•]'))) n_bullets,
    length(regexp_replace(t, '[^!]+', '', 'g')) n_shouts
  from w left join rep using (doc_id)),
q as (select *, (n_words < 50 or 100 * n_repeat_words > 50 * n_words) base_failed, coalesce({rules}, false) kept from m)
"""


def counts_sql(docs: str = "documents") -> str:
    return COUNTS_SQL.format(docs=docs, stop=", ".join(f"'{f(w)}'" for w in dict.fromkeys(STOP_WORDS) for f in (str, str.capitalize, str.upper)), rules=_RULE_SQL)


OP5_SQL = counts_sql() + "select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept from q"
