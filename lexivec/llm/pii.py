r"""Personal data: patterns propose spans, checks confirm them, words nearby adjust the score. Built-in functions only.

Positions come from marking: each match is set between two U+0001 characters, the text is split there, and the lengths of
the pieces are summed, in blocks, so that the work grows with the number of spans and not with its square. (A U+0001 of
the text itself counts as U+0002, which no pattern contains either.) The patterns are written so that a match can begin
only at the start of a run or where the last match ended; that changes no result, but long runs are read once instead of
once per start. Luhn confirms cards, mod 97 account numbers, mixed characters secrets. Scores are points of 100; a whole
word of the kind's context within 40 code points, up to the kind's neighbouring matches, adds 30.

Defined results: a null text is empty and has no spans; positions are code points, ends exclusive; texts of any length and
number of spans are read whole; rows that repeat are judged one by one; kinds may overlap, and equal places (ties) stand in
the order of kinds; extra columns pass through `annotate`, except one named `pii`, which the result replaces. An empty
table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexivec.llm.common import table

MARK, OTHER = "\x01", "\x02"
#: Code points before and after a span in which context words count, and what one adds to the score.
CONTEXT, NEAR = 40, 30
#: The least score of a span of the kinds that the base list doesn't have.
LEAST_SCORE = 50
#: Pieces whose lengths are summed together.
BLOCK = 256


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    score: int
    context: str
    base: bool = True
    #: RE2 spelling for the SQL form, where it differs.
    plain: str = ""

    @property
    def near(self) -> str:
        """The context words, whole, in a lower-case text."""
        return rf"(?:^|[^\p{{L}}\p{{N}}])(?:{self.context})(?:$|[^\p{{L}}\p{{N}}])"


KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", 90, "e?mails?|contact|courriel|correo", plain=r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", 70, "ip|hosts?|servers?|address", plain=r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    Kind("card", r"(?:\G|(?<![0-9]))[0-9](?:[\x20-]?[0-9])++", 80, "cards?|visa|credit|carte|karte|tarjeta", plain=r"[0-9]([\x20-]?[0-9])+"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 70, "phone|tel|call|mobile|fax"),
    Kind("iban", r"[A-Z]{2}[0-9]{2}(?:(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?|[A-Z0-9]{11,30})", 70, "iban|account|bank|konto|compte|cuenta", base=False),
    Kind("ssn", r"[0-9]+(?:-[0-9]+)+", 30, "ssn|social|security", base=False),
    Kind("secret", r"[A-Za-z0-9_+/-]{20,}", 40, "tokens?|secrets?|keys?|api_?key|passwords?|passwd|pwd|bearer|credentials?|authorization", base=False),
    Kind("key", r"AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+|-----BEGIN [A-Z ]*PRIVATE KEY-----", 80, "tokens?|secrets?|keys?", base=False),
)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _chars(value: Column) -> Column:
    return F.filter(F.split(value, ""), lambda c: c != "")


def luhn(digits: Column) -> Column:
    """Whether the checksum of a string of digits is 0."""
    doubled = F.transform(_chars(F.reverse(digits)), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.element_at(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), c.cast("int") + 1)))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(value: Column) -> Column:
    """Whether an account number's remainder modulo 97 is 1; spaces don't count."""
    v = F.replace(value, F.lit(" "))
    step = lambda r, c: F.when(c.between("0", "9"), r * 10 + F.ascii(c) - 48).otherwise(r * 100 + F.ascii(c) - 55) % 97
    return F.aggregate(_chars(F.concat(F.substring(v, 5, 2**31 - 1), F.substring(v, 1, 4))), F.lit(0), step) == 1


OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"


def valid(kind: str, value: Column, before: Column, after: Column) -> Column:
    """Whether a proposed value holds, given the text up to CONTEXT code points before and after it."""
    if kind == "ip":
        return value.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == "card":
        return F.length(_digits(value)).between(13, 19) & luhn(_digits(value))
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    if kind == "iban":
        return ~before.rlike("[A-Za-z0-9]$") & ~after.rlike("^[A-Za-z0-9]") & mod97(value)
    if kind == "ssn":
        return value.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$")
    if kind == "secret":
        return (F.length(value) <= 200) & value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (F.size(F.array_distinct(_chars(value))) >= 8)
    return F.lit(True)


def _parts(kind: Kind, text: Column) -> Column:
    """The text cut before and after each match: pieces of odd number, from 0, are matches."""
    return F.split(F.regexp_replace(text, kind.pattern, f"{MARK}$0{MARK}"), MARK)


def _blocks(parts: Column) -> Column:
    """array<struct<total, starts>>: per block of pieces their length together, and where in it each one starts."""
    zero = F.struct(F.lit(0).alias("total"), F.array().cast("array<int>").alias("starts"))
    step = lambda a, p: F.struct((a["total"] + F.length(p)).alias("total"), F.array_append(a["starts"], a["total"]).alias("starts"))
    numbers = F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / F.lit(BLOCK)).cast("int"))
    return F.transform(numbers, lambda i: F.aggregate(F.slice(parts, i * BLOCK + 1, F.lit(BLOCK)), zero, step))


def _starts(blocks: Column) -> Column:
    """Where in the text each piece starts."""
    zero = F.struct(F.lit(0).alias("total"), F.array().cast("array<int>").alias("starts"))
    step = lambda a, b: F.struct((a["total"] + b["total"]).alias("total"), F.array_append(a["starts"], a["total"]).alias("starts"))
    bases = F.aggregate(blocks, zero, step, lambda a: a["starts"])
    return F.flatten(F.zip_with(blocks, bases, lambda b, base: F.transform(b["starts"], lambda x: x + base)))


def _around(parts: Column, k: Column) -> tuple[Column, Column]:
    """What stands before and after piece k, up to its neighbouring matches."""
    return F.substring(F.get(parts, k - 1), F.lit(-CONTEXT), F.lit(CONTEXT)), F.substring(F.get(parts, k + 1), F.lit(1), F.lit(CONTEXT))


def _score(kind: Kind, before: Column, after: Column) -> Column:
    near = F.lower(F.concat(before, F.lit(" "), after)).rlike(kind.near)
    return F.lit(kind.score) + F.when(near, NEAR).otherwise(0)


def _holds(kind: Kind, value: Column, before: Column, after: Column) -> Column:
    ok = valid(kind.name, value, before, after)
    return ok if kind.base else ok & (_score(kind, before, after) >= LEAST_SCORE)


def _spans(kind: Kind, parts: Column, starts: Column) -> Column:
    """array<struct<kind, start, end, value, score>> of the matches that hold."""

    def one(i: Column) -> Column:
        k = 2 * i + 1
        value, start = F.get(parts, k), F.get(starts, k)
        before, after = _around(parts, k)
        s = F.struct(F.lit(kind.name).alias("kind"), start.alias("start"), (start + F.length(value)).alias("end"), value.alias("value"), _score(kind, before, after).alias("score"))
        return F.when(_holds(kind, value, before, after), s)

    found = F.array_compact(F.transform(F.sequence(F.lit(0), F.floor(F.size(parts) / 2).cast("int") - 1), one))
    none = F.array().cast("array<struct<kind:string,start:int,end:int,value:string,score:int>>")
    return F.when(F.size(parts) > 1, found).otherwise(none)


def annotate(docs: DataFrame, text: str = "text", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """docs with pii: array<struct<kind, start, end, value, score>> in the order of kinds, then of places."""
    safe = F.replace(F.coalesce(F.col(text), F.lit("")), F.lit(MARK), F.lit(OTHER))
    names = [k.name for k in kinds]
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), safe.alias("text"))
    # Each step is a projection of its own, as its arrays are used many times in the next one.
    d = d.select("row", *[_parts(k, F.col("text")).alias(f"p_{k.name}") for k in kinds])
    blocks = lambda n: F.when(F.size(f"p_{n}") > 1, _blocks(F.col(f"p_{n}")))
    d = d.select("row", *[f"p_{n}" for n in names], *[blocks(n).alias(f"b_{n}") for n in names])
    d = d.select("row", *[f"p_{n}" for n in names], *[_starts(F.col(f"b_{n}")).alias(f"s_{n}") for n in names])
    found = F.concat(*[_spans(k, F.col(f"p_{k.name}"), F.col(f"s_{k.name}")) for k in kinds])
    return d.select(*[F.col("row")[c].alias(c) for c in docs.columns if c != "pii"], found.alias("pii"))


def redacted(docs: DataFrame, text: str = "text", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """docs with the values of all kinds replaced by their kind's name in brackets, one kind after the other.

    Each text is cut and joined once a kind, so the work grows with its length. Marks of the text itself come back.
    """
    d = docs.withColumn(text, F.replace(F.replace(F.col(text), F.lit(OTHER), F.lit(OTHER + "\x04")), F.lit(MARK), F.lit(OTHER + "\x03")))
    for kind in kinds:
        d = d.withColumn("_pii_parts", _parts(kind, F.coalesce(F.col(text), F.lit(""))))
        parts = F.col("_pii_parts")
        label = F.lit(f"[{kind.name.upper()}]")
        new = F.array_join(F.transform(parts, lambda p, k: F.when((k % 2 == 1) & _holds(kind, p, *_around(parts, k)), label).otherwise(p)), "")
        d = d.withColumn(text, F.when(F.size(parts) > 1, new).otherwise(F.col(text)))
    back = F.replace(F.replace(F.col(text), F.lit(OTHER + "\x03"), F.lit(MARK)), F.lit(OTHER + "\x04"), F.lit(OTHER))
    return d.withColumn(text, back).select(*docs.columns)


def op4_pii(spark, sf_dir: str) -> DataFrame:
    d = annotate(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = [k.name for k in KINDS if k.base]
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return d.select(
        "doc_id",
        *[F.size(F.filter("pii", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}") for k in base],
        F.sha2(said(F.filter("pii", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"),
        said(F.col("pii")).alias("spans"),
        F.size("pii").cast("long").alias("n_spans"),
        F.array_join(F.transform("pii", lambda s: s["score"].cast("string")), ",").alias("scores"),
    )


def _sql() -> str:
    """The same spans in DuckDB, with the patterns in their plain spelling."""
    split = "string_split(regexp_replace(t, '{p}', chr(1) || '\\0' || chr(1), 'g'), chr(1))"
    kinds = " union all ".join(f"select doc_id, {i} o, '{k.name}' kind, {k.score} score, '{k.near}' context, {str(k.base).lower()} base, {split.format(p=k.plain or k.pattern)} parts from d" for i, k in enumerate(KINDS))
    digits = "regexp_replace(v, '[^0-9]', '', 'g')"
    luhn_sql = f"list_sum(list_transform(range(1, length({digits}) + 1), lambda i: case when (length({digits}) - i) % 2 = 0 then try_cast(substr({digits}, i, 1) as int) else [0, 2, 4, 6, 8, 1, 3, 5, 7, 9][try_cast(substr({digits}, i, 1) as int) + 1] end)) % 10 = 0"
    plain = "replace(v, ' ', '')"
    iban = f"list_reduce(list_transform(string_split(substr({plain}, 5) || left({plain}, 4), ''), lambda c: case when c between '0' and '9' then ascii(c) - 48 else ascii(c) - 55 end)::bigint[], lambda r, x: case when x < 10 then (r * 10 + x) % 97 else (r * 100 + x) % 97 end) % 97 = 1"
    return f"""
with d as (select doc_id, replace(coalesce(text, ''), chr(1), chr(2)) t from documents),
p as (select * from ({kinds}) where len(parts) > 1),
u as (select doc_id, o, kind, score, context, base, unnest(parts) v, unnest(range(len(parts))) k, unnest(list_transform(range(len(parts)), lambda i: right(coalesce(parts[i], ''), {CONTEXT}))) before,
        unnest(list_transform(range(len(parts)), lambda i: left(coalesce(parts[i + 2], ''), {CONTEXT}))) after from p),
s as (select *, (sum(length(v)) over (partition by doc_id, o order by k))::bigint e from u),
ok as (
  select *, e - length(v) b, score + case when regexp_matches(lower(before || ' ' || after), context) then {NEAR} else 0 end points
  from s where k % 2 = 1 and case kind
    when 'ip' then list_bool_and(list_transform(string_split(v, '.'), lambda x: length(ltrim(x, '0')) <= 3 and try_cast('0' || right(x, 4) as int) <= 255))
    when 'card' then length({digits}) between 13 and 19 and {luhn_sql}
    when 'phone' then length({digits}) between 9 and 15
    when 'iban' then not regexp_matches(before, '[A-Za-z0-9]$') and not regexp_matches(after, '^[A-Za-z0-9]') and {iban}
    when 'ssn' then regexp_full_match(v, '[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}')
    when 'secret' then length(v) <= 200 and regexp_matches(v, '[0-9]') and regexp_matches(v, '[A-Za-z]') and list_unique(string_split(v, '')) >= 8
    else true end),
f as (select *, kind || ':' || b || ':' || e said from ok where base or points >= {LEAST_SCORE})
select doc_id, coalesce(count(*) filter (kind = 'email'), 0) n_email, count(*) filter (kind = 'ip') n_ip, count(*) filter (kind = 'card') n_card,
  count(*) filter (kind = 'phone') n_phone, sha256(coalesce(string_agg(said, ',' order by o, b) filter (base), '')) base_sha256,
  coalesce(string_agg(said, ',' order by o, b), '') spans, count(kind) n_spans, coalesce(string_agg(points::varchar, ',' order by o, b), '') scores
from d left join f using (doc_id) group by doc_id
"""


OP4_SQL = _sql()
