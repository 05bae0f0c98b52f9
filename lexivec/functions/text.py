"""Text functions as column expressions: tokens, stems, sentences, normalisation, language scores, headings."""

from __future__ import annotations

import operator
import re
import string
from collections import Counter
from functools import lru_cache, reduce
from re import _parser as sre

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexivec.compat import ship_package
from lexivec.functions import lexicon as L
from lexivec.functions.automaton import Seen

_WORD = "[A-Za-z0-9_]"
#: The boundary between an ASCII word character and anything else; Java's own looks at all of Unicode.
BOUNDARY = f"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"
#: What surely begins, or ends, with a word character, so that one look is enough.
_OPENS = re.compile(r"(?:\\d|\[(?:A-Z|a-z|0-9|_)+\]|[A-Za-z0-9])(?![?*]|\{0)")
_CLOSES = re.compile(r"(?:(?<!\\)[A-Za-z0-9]|(?:\\d|\[0-9\])(?:\{\d+(?:,\d*)?\})?)$")


def _opens(after: str) -> bool:
    """Whether a match of the pattern begins with a word character: it, or each alternative of its group."""
    if not after.startswith("("):
        return bool(_OPENS.match(after))
    m = re.match(r"\((?:\?:)?([^()]*)\)(?![?*]|\{0)", after)
    return bool(m) and all(_OPENS.match(x) for x in m[1].split("|"))


@lru_cache(maxsize=None)
def java(pattern: str, fold: bool = False) -> str:
    """A pattern with ASCII word boundaries for Spark; fold: regardless of case."""

    def look(m: re.Match) -> str:
        if _opens(pattern[m.end() :]):
            return f"(?<!{_WORD})"
        return f"(?!{_WORD})" if _CLOSES.search(pattern[: m.start()]) else BOUNDARY

    return ("(?i)" if fold else "") + re.sub(r"\\b", look, pattern)


@lru_cache(maxsize=None)
def required(pattern: str) -> tuple[str, ...]:
    """Literals in lower case of which any text that the pattern matches has at least one; none if that can't be told."""
    try:
        return _required(sre.parse(pattern)) or ()
    except re.error:
        return ()


def _required(items) -> tuple[str, ...] | None:
    best: list[tuple[str, ...]] = []
    run = ""
    for op, arg in [*items, (None, None)]:
        if op is sre.LITERAL:
            run += chr(arg).lower()
            continue
        if run:
            best.append((run,))
            run = ""
        inner = None
        if op is sre.SUBPATTERN:
            inner = _required(arg[-1])
        elif op is sre.BRANCH:
            each = [_required(x) for x in arg[1]]
            inner = tuple(dict.fromkeys(w for x in each for w in x)) if all(each) else None
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] > 0:
            inner = _required(arg[2])
        if inner:
            best.append(inner)
    return max(best, key=lambda ws: (min(map(len, ws)), -len(ws)), default=None)


def folded(text: Column) -> Column:
    """The text with A-Z in lower case and all else as it is, as patterns regardless of case see it."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


@lru_cache(maxsize=None)
def trie(words: tuple[str, ...]) -> str:
    """A pattern that finds any of the words, their beginnings shared, so that each place of a text is looked at once.

    A word that begins with another one is left to that.
    """
    root: dict = {}
    for w in words:
        node = root
        for c in w:
            node = node.setdefault(c, {})
        node[""] = {}

    def said(node: dict) -> str:
        if "" in node:
            return ""
        items = sorted(node.items())
        parts = [re.escape(c) + said(n) for c, n in items]
        if len(items) > 8:
            # A look at the next character tells which few of many branches to try.
            starts = ["".join(re.escape(c) for c, _ in items[k : k + 5]) for k in range(0, len(items), 5)]
            parts = [f"(?=[{c}])(?:{'|'.join(parts[5 * k : 5 * k + 5])})" for k, c in enumerate(starts)]
        return parts[0] if len(parts) == 1 else "(?:" + "|".join(parts) + ")"

    return said(root)


#: So many words are looked for one by one; more in one pass.
FEW_WORDS = 4


def any_of(low: Column | Seen, literals: tuple[str, ...]) -> Column:
    """Whether any of the literals occurs in a text that is in lower case already, or was scanned for them."""
    if isinstance(low, Seen):
        return low.any(literals)
    if len(literals) > FEW_WORDS:
        return low.rlike(trie(tuple(literals)))
    return reduce(operator.or_, [low.contains(w) for w in literals])


def any_needed(low: Column | Seen, patterns) -> Column:
    """Whether any of the patterns may occur at all: one pass over the text, for lists of patterns that mostly don't."""
    words = [required(p) for p in patterns]
    return any_of(low, tuple(dict.fromkeys(w for ws in words for w in ws))) if all(words) else F.lit(True)


def needs(*lists) -> tuple[str, ...]:
    """The literals that the patterns of some lists, or of lists of pairs and labels, need: what to scan a text for."""
    flat, out = list(lists), []
    while flat:
        x = flat.pop()
        if isinstance(x, str):
            out += required(x)
        else:
            flat += x
    return tuple(dict.fromkeys(out))


def possible(pattern: str, low: Column | Seen | None) -> Column:
    """Whether a match of the pattern is possible by the literals it needs; true where they can't tell, or nothing was scanned."""
    words = required(pattern)
    return any_of(low, words) if words and low is not None else F.lit(True)


def found(text: Column, pattern: str, low: Column | Seen | None = None) -> Column:
    """Whether the pattern occurs, regardless of case. low: the folded text, best a column of its own, or what was seen in it.

    Literals that a match must have are looked for first, as most texts have none of them.
    """
    hit = text.rlike(java(pattern, True))
    words = required(pattern)
    if not words:
        return hit
    return any_of(folded(text) if low is None else low, words) & hit


def stem(word: Column) -> Column:
    """Light stemmer: the first suffix that leaves three characters goes, then the first such prefix."""
    cut = F.regexp_replace(word, rf"^(.{{3,}}?)({'|'.join(L.SUFFIXES)})$", "$1")
    return F.regexp_replace(cut, rf"^(?:{'|'.join(L.PREFIXES)})(.{{3,}})$", "$1")


def without_suffix(word: Column) -> Column:
    """The word without its longest suffix that leaves three characters, in compiled code; see `stem`."""
    out = word
    for x in sorted(L.SUFFIXES, key=len):
        out = F.when(word.endswith(x) & (F.length(word) >= 3 + len(x)), F.substring(word, F.lit(1), F.length(word) - len(x))).otherwise(out)
    return out


def without_prefix(word: Column) -> Column:
    """The word without the first prefix of the list that leaves three characters, in compiled code; see `stem`."""
    out = word
    for x in reversed(L.PREFIXES):
        out = F.when(word.startswith(x) & (F.length(word) >= 3 + len(x)), F.substring(word, len(x) + 1, 2**31 - 1)).otherwise(out)
    return out


def with_stems(df: DataFrame, word: str, to: str) -> DataFrame:
    """df with the stems of a column of words, as `stem` gives them; each half in a projection of its own, as it is used often."""
    return df.withColumn("_cut", without_suffix(F.col(word))).withColumn(to, without_prefix(F.col("_cut"))).drop("_cut")


def tokens(text: Column, stemmed: bool = True) -> Column:
    """Lower-case words of three letters or more that are no stop words, stemmed if asked."""
    clean = F.regexp_replace(F.lower(text), r"[^A-Za-z0-9_\sÀ-ɏ]", " ")
    words = F.filter(F.split(clean, r"\s+"), lambda w: (F.length(w) > 2) & ~w.isin(L.STOP_WORDS))
    return F.transform(words, stem) if stemmed else words


def token_rows(df: DataFrame, text: str = "text", to: str = "term", stemmed: bool = True) -> DataFrame:
    """df's other columns with a row per word of `tokens`: as rows, words pass through compiled code, not through lambdas."""
    rest = [c for c in df.columns if c != text]
    d = df.select(*rest, F.explode(F.split(F.lower(F.col(text)), "[^A-Za-z0-9_À-ɏ]+")).alias(to)).filter((F.length(to) > 2) & ~F.col(to).isin(L.STOP_WORDS))
    return with_stems(d, to, to) if stemmed else d


def _stemmed(word: str, suffix=re.compile(rf"^(.{{3,}}?)(?:{'|'.join(L.SUFFIXES)})$"), prefix=re.compile(rf"^(?:{'|'.join(L.PREFIXES)})(.{{3,}})$")) -> str:
    """`stem` of one word; most have no affix, which is told without the patterns."""
    if word.endswith(L.SUFFIXES):
        word = suffix.sub(r"\1", word)
    return prefix.sub(r"\1", word) if word.startswith(L.PREFIXES) else word


def _word_counts(texts: pa.Array, stemmed: bool, whole: bool = False) -> pa.Array:
    """Per text in lower case its terms and how often it has each; words are told apart before they are stemmed.

    whole: with all its words as a term that is null, and their number beside each term.
    """
    find, stops, stems = re.compile("[A-Za-z0-9_À-ɏ]{3,}").findall, frozenset(L.STOP_WORDS), {}
    ends, terms, counts, sizes = [0], [], [], []
    for t in texts.to_pylist():
        words = Counter(find(t or ""))
        if stemmed:
            out: dict[str, int] = {}
            for w, n in words.items():
                if w not in stops:
                    x = stems.get(w) or stems.setdefault(w, _stemmed(w))
                    out[x] = out.get(x, 0) + n
            words = out
        else:
            words = {w: n for w, n in words.items() if w not in stops}
        if whole and words:
            size = sum(words.values())
            terms.append(None)
            counts.append(size)
            sizes.extend([size] * (len(words) + 1))
        terms.extend(words)
        counts.extend(words.values())
        ends.append(len(terms))
    columns = [pa.array(terms, pa.string()), pa.array(counts, pa.int64())] + [pa.array(sizes, pa.int64())] * whole
    rows = pa.StructArray.from_arrays(columns, ["term", "tf", "dl"][: len(columns)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows)


def term_counts(df: DataFrame, by: list[str], text: str = "text", stemmed: bool = True, whole: bool = False) -> DataFrame:
    """by, term, tf: how often each term occurs in each text, the words and stems of `tokens`.

    whole: instead by, term, tf, dl as each row of df gives them, not grouped, with a row of all its words without a term.

    Counts are dealt out by the texts' key, so what is counted or grouped by key from there on needs no shuffle. A text's words are found and counted by Python's compiled matcher: Java's looks at each character through a
    chain of calls, which took most of the time.
    """
    ship_package(df.sparkSession)

    @F.arrow_udf(f"array<struct<term:string,tf:bigint{',dl:bigint' if whole else ''}>>")
    def counted(texts: pa.Array) -> pa.Array:
        return _word_counts(texts, stemmed, whole)

    d = df.select(*by, F.inline(counted(F.lower(F.col(text)))))
    if whole:
        return d
    d = d.repartition(*by)
    return d.groupBy(*by, "term").agg(F.sum("tf").alias("tf"))


def with_words(df: DataFrame, text: str, to: str, stemmed: bool = True) -> DataFrame:
    """df with the distinct words of `tokens` of a text; none where it is null."""
    ship_package(df.sparkSession)

    @F.arrow_udf("array<struct<term:string,tf:bigint>>")
    def counted(texts: pa.Array) -> pa.Array:
        return _word_counts(texts, stemmed)

    return df.withColumn(to, counted(F.lower(F.col(text)))["term"])


def sentences(text: Column) -> Column:
    """Sentences: cut after `.`, `!` or `?` and white space before a capital, but not after abbreviations or in numbers."""
    safe = F.regexp_replace(text, java(L.ABBREVIATIONS), "$1\u0001")
    safe = F.regexp_replace(safe, r"(\d+)\.(\d+)", "$1\u0001$2")
    parts = F.transform(F.split(safe, r"(?<=[.!?])\s+(?=[A-Z])"), lambda s: F.regexp_replace(F.replace(s, F.lit("\u0001"), F.lit(".")), r"^\s+|\s+$", ""))
    return F.filter(parts, lambda s: s != "")


#: The repairs of extracted text, in their order.
REPAIRS = (
    (r"[\x{2000}-\x{200B}]", " "),
    (r"\b([A-Z])\s+([A-Z])\s+([A-Z])\s+(\d)", "$1$2$3 $4"),
    (r"\b([A-Z])\s+([A-Z])\s+(\d)", "$1$2 $3"),
    (r"\b(\d)\s+(\d)\s+(\d)\s+(\d)\b", "$1$2$3$4"),
    (r"\b(\d)\s+(\d)\s+(\d)\b", "$1$2$3"),
    (r"\b(\d)\s+(\d)\b", "$1$2"),
    (r"\s+([.,;:!?)])", "$1"),
    (r"([(\[])\s+", "$1"),
    (r"[ \t]+", " "),
    (r"\n{3,}", "\n\n"),
    (r"(?m)^[ \t\r\f]+|[ \t\r\f]+$", ""),
    (r"^\s+|\s+$", ""),
)


def normalize_pdf(text: Column) -> Column:
    """OCR repairs: spaced capitals before a digit, spaced digits, punctuation, blanks and line breaks."""
    for pattern, to in REPAIRS:
        text = F.regexp_replace(text, java(pattern), to)
    return text


def language(text: Column, lists: tuple[str, ...] = L.LANGUAGE_LONG, cut: int = 10, low: Column | Seen | None = None) -> Column:
    """`id` if the words of the lists occur more often than the cut, else `en`."""
    return F.when(language_score(text, lists, low) > cut, "id").otherwise("en")


def language_score(text: Column, lists: tuple[str, ...], low: Column | Seen | None = None) -> Column:
    out = F.lit(0)
    for p in lists:
        some = any_of(folded(text) if low is None else low, required(p))
        out = out + F.when(some, F.regexp_count(text, F.lit(java(p, True)))).otherwise(0)
    return F.when(text.isNotNull(), out)


MARK = "\x01"
#: Pieces whose lengths are summed one by one; then blocks of as many.
BLOCK = 128


def _running(lengths: Column) -> Column:
    """struct<total, starts> of an array of numbers: their sum, and what stands before each of them."""
    zero = F.struct(F.lit(0).alias("total"), F.array().cast("array<int>").alias("starts"))
    return F.aggregate(lengths, zero, lambda a, n: F.struct((a["total"] + n).alias("total"), F.array_append(a["starts"], a["total"]).alias("starts")))


def bound(value: Column, use) -> Column:
    """use(value), the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def starts_of(parts: Column) -> Column:
    """Where each piece of a text starts: running sums by blocks, so that no array grows piece by piece over a long text."""
    numbers = F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / F.lit(BLOCK)).cast("int"))
    blocks = F.transform(numbers, lambda i: _running(F.transform(F.slice(parts, i * BLOCK + 1, F.lit(BLOCK)), F.length)))

    def based(bs: Column) -> Column:
        return F.flatten(F.zip_with(bs, _running(F.transform(bs, lambda b: b["total"]))["starts"], lambda b, base: F.transform(b["starts"], lambda x: x + base)))

    return bound(blocks, based)


def spans(text: Column, pattern: str) -> Column:
    """array<struct<start, value>> of a pattern's matches, in order; places in code points. The text must not hold U+0001."""
    parts = F.split(F.regexp_replace(text, pattern, f"{MARK}$0{MARK}"), MARK)
    none = F.array().cast("array<struct<start:int,value:string>>")

    def placed(x: Column) -> Column:
        at = F.sequence(F.lit(1), F.size(x["parts"]) - 1, F.lit(2))
        return F.transform(at, lambda i: F.struct(F.get(x["starts"], i).alias("start"), F.get(x["parts"], i).alias("value")))

    some = lambda ps: F.when(F.size(ps) > 1, bound(F.struct(ps.alias("parts"), starts_of(ps).alias("starts")), placed)).otherwise(none)
    return F.when(text.isNotNull(), bound(parts, some))


def abstract(text: Column, low: Column | Seen | None = None) -> Column:
    """The first 500 characters of the abstract, or null."""
    out = []
    for start, end in L.ABSTRACTS:
        p = start + f"(?={end})"
        out.append(F.when(possible(start, low) & text.rlike(p), F.substring(F.regexp_replace(F.regexp_extract(text, p, 1), r"^\s+|\s+$", ""), 1, L.ABSTRACT_LENGTH)))
    return F.coalesce(*out)


def has_table(text: Column, low: Column | Seen | None = None) -> Column:
    """Whether header cells of a table stand in the text, or many numbered rows."""
    return found(text, L.TABLE_HEADER, low) | (F.regexp_count(text, F.lit(L.NUMBERED_ROW)) > L.NUMBERED_ROWS)


def title_of(file_name: Column) -> Column:
    """A file name without its last extension."""
    return F.regexp_replace(file_name, r"\.[^/.]+$", "")


def tags_of(tags: Column) -> Column:
    """Tags between commas, trimmed, blank ones left out."""
    return F.filter(F.transform(F.split(tags, ","), lambda t: F.trim(t)), lambda t: t != "")


def headings(text: Column) -> Column:
    """Headings by seven patterns, each once, in the order of the patterns."""
    return F.array_distinct(F.flatten(F.array(*[F.regexp_extract_all(text, F.lit(java(p)), F.lit(1)) for p in L.HEADINGS])))


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def first_match(text: Column, patterns: tuple[str, ...], group: int, low: Column | Seen | None = None) -> Column:
    """Value of the first pattern that matches, or null."""
    return F.coalesce(*[F.when(possible(p, low) & text.rlike(java(p)), F.regexp_extract(text, java(p), group)) for p in patterns])


def first_label(text: Column, rules, low: Column | Seen | None = None) -> Column:
    """Label of the first rule whose patterns all match, or null."""
    out, first = [], []
    for label, patterns in rules:
        ps = (patterns,) if isinstance(patterns, str) else patterns
        first.append(ps[0])
        out.append(F.when(reduce(operator.and_, [found(text, p, low) for p in ps]), label))
    return F.when(any_needed(folded(text) if low is None else low, first), F.coalesce(*out))


def keyword_line(text: Column, low: Column | Seen | None = None) -> Column:
    """Keywords of a `keywords:` line: parts of more than two letters, in lower case."""
    line = F.coalesce(first_match(text, L.KEYWORDS, 1, low), F.lit(""))
    return F.filter(F.transform(F.split(line, "[,;]"), lambda w: F.lower(F.regexp_replace(w, r"^\s+|\s+$", ""))), lambda w: F.length(w) > 2)


def numbered_citations(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\[(\d+)\]"), F.lit(1)))


def course_info(text: Column, low: Column | Seen | None = None, repaired: Column | None = None) -> dict[str, Column]:
    """Facts of a course. repaired: the text as `normalize_pdf` leaves it, best a column of its own."""
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    return {
        "course_code": first_match(normalize_pdf(text) if repaired is None else repaired, L.COURSE_CODE, 0),
        "course_name": strip(first_match(text, L.COURSE_NAME, 1, low)),
        "instructor": strip(first_match(text, L.INSTRUCTOR, 1, low)),
        "semester": first_match(text, L.SEMESTER, 0, low),
        "faculty": strip(first_match(text, L.FACULTY, 1, low)),
        "credits": F.try_to_number(first_match(text, (L.CREDITS,), 1, low), F.lit("9999999999")).cast("long"),
    }


def doc_type(text: Column, low: Column | Seen | None = None, lang: Column | None = None) -> Column:
    """The first matching type of the ordered groups, then of the older rules of the text's language, else `other`."""
    lang = language(text, low=low) if lang is None else lang
    old = F.when(lang == "id", first_label(text, L.TRADITIONAL_ID, low)).otherwise(first_label(text, L.TRADITIONAL_EN, low))
    return F.coalesce(first_label(text, L.DOCUMENT_TYPES, low), old, F.lit("other"))


def section_of(chunk: Column, lang: str = "en") -> Column:
    return first_label(F.regexp_replace(chunk, r"^\s+|\s+$", ""), L.SECTIONS_ID if lang == "id" else L.SECTIONS_EN)


#: Lines of an ASCII report: table rows, separators, delimiters, key-value pairs.
REPORT_ROW, REPORT_RULE, REPORT_DELIMITER, REPORT_PAIR = r"^\s*\|.+\|", r"^[\s|+]*[-+]+[\s|+]*$", r"^={3,}$|^-{3,}$", r"^[A-Za-z\s]+\s*:\s*.+$"


def report_score(text: Column) -> Column:
    """Evidence of an ASCII report: table rows 2, separators 1, delimiters 1, key-value lines 1; 3 or more is one."""
    lines = F.split(text, "\n")
    n = lambda p: F.size(F.filter(lines, lambda x: x.rlike(p)))
    one = lambda hit, k: F.when(hit, k).otherwise(0)
    return one(n(REPORT_ROW) >= 2, 2) + one(n(REPORT_RULE) >= 1, 1) + one(n(REPORT_DELIMITER) >= 1, 1) + one(n(REPORT_PAIR) >= 2, 1)


def key_values(text: Column) -> Column:
    """array<struct<key, value>> of `Key: value` lines without pipes, keys up to 50 characters."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    pattern = r"^([A-Za-z][A-Za-z0-9\s]*?)\s*:\s*(.+)$"
    able = F.filter(lines, lambda x: ~x.contains("|") & ~x.rlike("^[-=+]+$") & x.rlike(pattern))
    pairs = F.transform(able, lambda x: F.struct(F.regexp_extract(x, pattern, 1).alias("key"), F.regexp_replace(F.regexp_extract(x, pattern, 2), r"\s+$", "").alias("value")))
    return F.filter(pairs, lambda p: (F.length(p["key"]) <= 50) & (F.length(p["value"]) > 0))


def ascii_table(text: Column, keep_empty: bool = False) -> Column:
    """Rows of a pipe table as array<map>: the first row names the columns; empty cells are dropped unless kept."""
    lines = F.filter(F.split(text, "\n"), lambda x: (F.trim(x) != "") & ~F.trim(x).rlike(r"^[|+\-\s]+$") & x.contains("|"))
    edge = r"^\s*\|\s*|\s*\|\s*$"
    def cells(x):
        got = F.transform(F.split(F.regexp_replace(x, edge, "") if keep_empty else x, r"\s*\|\s*"), lambda c: F.regexp_replace(F.trim(c), r"\s+", " "))
        return got if keep_empty else F.filter(got, lambda c: c != "")
    head = cells(F.get(lines, F.lit(0)))
    row = lambda x: F.map_from_arrays(head, F.transform(head, lambda h, i: F.coalesce(F.get(cells(x), i), F.lit(""))))
    return F.when((F.size(lines) >= 2) & (F.size(head) > 0), F.transform(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), row))
