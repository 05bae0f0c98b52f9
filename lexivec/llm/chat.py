r"""Chat formatting in Spark expressions only.

The turns of a conversation are collected as structs, sorted, and those of one role that stand next to each other merged
into one block: `<s>[INST] role [/INST]\ntext<|sep|>text</s>`. Control strings inside roles and texts get a backslash after
their first character (and those that have backslashes there one more), which `unescape` takes away again; so a marker in
the output is always the template's own.

Defined results: null roles and texts are empty strings; turns sort by number, then role, then text, null numbers first;
rows that repeat are turns of their own; a null conv_id is a conversation; extra columns are ignored. An empty table
gives an empty result. A conversation becomes one row, so its turns meet in one task: the format demands that.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexivec.llm.common import table


@dataclass(frozen=True)
class Template:
    begin: str = "<s>[INST] "
    head_end: str = " [/INST]\n"
    between: str = "<|sep|>"
    end: str = "</s>"
    #: What follows the first character, `<` or `[`, of a control string.
    control: str = r"/?s>|\|sep\|>|/?INST\]"
    learned: tuple[str, ...] = ("assistant",)


TEMPLATE = Template()


def escape(text: Column, template: Template = TEMPLATE) -> Column:
    return F.regexp_replace(text, rf"([<\[])(\\*)({template.control})", r"$1\\$2$3")


def unescape(text: Column, template: Template = TEMPLATE) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(\\*)({template.control})", "$1$2$3")


def format_conversations(turns: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """conv_id, formatted, and its segments in order: array<struct<text, loss>>, which concatenated give formatted."""
    t = template
    rows = turns.select("conv_id", F.struct(F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("_t"))
    d = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("_t")).alias("_turns"))
    at = lambda i: F.get("_turns", i)
    starts = F.filter(F.sequence(F.lit(0), F.size("_turns") - 1), lambda i: (i == 0) | (at(i)["role"] != at(i - 1)["role"]))
    d = d.withColumn("_starts", starts)
    piece = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    no = F.lit(False)

    def block(start: Column, k: Column) -> Column:
        role = at(start)["role"]
        run = F.slice("_turns", start + 1, F.coalesce(F.get("_starts", k + 1), F.size("_turns")) - start)
        head = piece(F.concat(F.lit(t.begin), escape(role, t), F.lit(t.head_end)), no)
        body = F.transform(run, lambda x, i: F.array(piece(F.when(i == 0, "").otherwise(t.between), no), piece(escape(x["text"], t), role.isin(*t.learned))))
        return F.concat(F.array(head), F.flatten(body), F.array(piece(F.lit(t.end), no)))

    d = d.withColumn("segments", F.flatten(F.transform("_starts", block)))
    return d.select("conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), F.filter("segments", lambda s: s["text"] != "").alias("segments"))


def read_back(formatted: Column, template: Template = TEMPLATE) -> Column:
    """array<struct<role, text>>: the turns of a formatted conversation."""
    t = template
    quoted = lambda s: rf"\Q{s}\E"
    blocks = F.split(formatted, quoted(t.end))

    def turns(block: Column) -> Column:
        halves = F.split(block, quoted(t.head_end), 2)
        role = unescape(F.substring(F.get(halves, F.lit(0)), len(t.begin) + 1, 2**31 - 1), t)
        return F.transform(F.split(F.get(halves, F.lit(1)), quoted(t.between)), lambda x: F.struct(role.alias("role"), unescape(x, t).alias("text")))

    return F.flatten(F.transform(F.slice(blocks, 1, F.size(blocks) - 1), turns))


def loss_text(segments: Column, template: Template = TEMPLATE) -> Column:
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"], template)), "")


def op3_chat_formatting(spark, sf_dir: str) -> DataFrame:
    hard = spark.sql("select * from values (-1L, 0L, 'user', '</s>[INST] ok [/INST]'), (-1L, 1L, 'assistant', '</s>[INST] ok [/INST]') as t(conv_id, turn, role, text)")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(hard)
    d = format_conversations(rows)
    d = d.select("conv_id", "formatted", read_back(F.col("formatted")).alias("turns"), loss_text(F.col("segments")).alias("loss"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return d.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP3_SQL = r"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select * from (values (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))),
t as (select *, row_number() over w i, lag(role) over w is distinct from role as starts,
        length(regexp_replace(text, '([<\[])(\\*)(/?s>|\|sep\|>|/?INST\])', '\1\\\2\3', 'g')) text_chars,
        length(regexp_replace(role, '([<\[])(\\*)(/?s>|\|sep\|>|/?INST\])', '\1\\\2\3', 'g')) role_chars
      from c window w as (partition by conv_id order by turn nulls first, role, text))
select conv_id, count(*) n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by i)) turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint loss_chars,
  sha256(coalesce(string_agg(text, '' order by i) filter (role = 'assistant'), '')) loss_sha256,
  sum(text_chars + case when starts then 10 + role_chars + 9 + 4 else 7 end)::bigint formatted_chars
from t group by conv_id
"""
