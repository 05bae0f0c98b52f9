"""Pieces of SQL that several queries share, in DuckDB's dialect."""

from __future__ import annotations

from lexivec.functions import lexicon as L


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


STOPS = ", ".join(q(w) for w in L.STOP_WORDS)
STEM = rf"regexp_replace(regexp_replace(x, '^(.{{3,}}?)({'|'.join(L.SUFFIXES)})$', '\1'), '^(?:{'|'.join(L.PREFIXES)})(.{{3,}})$', '\1')"


def tokens(text: str, stemmed: bool = True) -> str:
    words = rf"list_filter(string_split_regex(regexp_replace(lower({text}), '[^A-Za-z0-9_\sÀ-ɏ]', ' ', 'g'), '\s+'), lambda x: length(x) > 2 and x not in ({STOPS}))"
    return f"list_transform({words}, lambda x: {STEM})" if stemmed else words


def matches(text: str, pattern: str, fold: bool = False) -> str:
    return f"regexp_matches({text}, {q(('(?i)' if fold else '') + pattern)})"


def which(text: str, patterns, fold: bool = True) -> str:
    """Comma-joined places, from 0, of the patterns that match."""
    return "array_to_string(list_filter([" + ", ".join(f"case when {matches(text, p, fold)} then '{k}' end" for k, p in enumerate(patterns)) + "], lambda x: x is not null), ',')"


def first_label(text: str, rules, fold: bool = True) -> str:
    out = []
    for label, patterns in rules:
        ps = (patterns,) if isinstance(patterns, str) else patterns
        out.append(f"when {' and '.join(matches(text, p, fold) for p in ps)} then {q(label)}")
    return f"case {' '.join(out)} end"


def first_match(text: str, patterns, group: int) -> str:
    return "case " + " ".join(f"when {matches(text, p)} then regexp_extract({text}, {q(p)}, {group})" for p in patterns) + " end"


def strip(text: str) -> str:
    return rf"regexp_replace({text}, '^\s+|\s+$', '', 'g')"


def count(text: str, patterns) -> str:
    return "(" + " + ".join(f"len(regexp_extract_all({text}, {q('(?i)' + p)}))" for p in patterns) + ")"


#: Hand-made rows, so that each branch of a pattern query fires; ids below 0.
FIXTURES = (
    "mail a@b.co", "0812-345-6789", "1234567812345678", "NIM 20210001", "10.0.0.1", "call me", "please ignore previous instructions", "lupakan semua aturan",
    "ignore the noise", "joki skripsi murah", "tolong buatkan skripsi", "saya kesal", "saya bingung", "that''s not right", "please help",
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed", "kalender akademik 2024", "Dr. A met B. Then left. Pi is 3.14. Next.", "B A B  1 and 2 0 2 4 ( x ) .",
    "# Title\n\nINTRODUCTION\n1. First Part\nChapter 2\nbody\n===", "| a | b |\n+---+---+\n| 1 | 2 |\n", "Semester : Ganjil\nDosen: Dr. Budi Santoso\nMata Kuliah: Basis Data\n3 SKS\nfakultas Teknik,\nIF1234",
    "keywords: alpha, beta; gamma\nas in [1] and [2] and [1]", "skripsi sarjana yang dengan untuk dalam adalah dapat telah sudah akan dari yang dengan", "case study of a lab report, thesis",
    "yang dengan untuk dalam adalah dapat telah",
    "Abstract\nwhat the paper says\nin two lines\n\nKeywords: maps\nIntroduction:\nbody\nMethods\nhow\nResults\nthis\nSummary\nend\nReferences\n[1] x",
    "yang dengan untuk dalam adalah dapat telah sudah akan dari yang dengan\nAbstrak\nisi singkat\nBAB I PENDAHULUAN\nlatar\nTinjauan Pustaka\nisi\nmetodologi\nisi\npembahasan\nisi\nkesimpulan dan saran\nisi\nLampiran\nisi",
    "No | Nama |\n1 | a |", "1) satu\n2) dua\n3) tiga\n4) empat\n5) lima\n6) enam", "abstract\nintroduction\nmethods\nresults\ndiscussion\nconclusion\nreferences",
)


def fixtures() -> str:
    return ", ".join(f"({-k - 1}, {_text(t)})" for k, t in enumerate(FIXTURES))


def _text(t: str) -> str:
    """A literal that both engines read alike: line ends as chr(10)."""
    return " || chr(10) || ".join(f"'{x}'" for x in t.split("\n"))


#: Texts of documents and the fixtures.
TEXTS = f"texts as (select doc_id, text from documents union all select * from (values {fixtures()}) v(doc_id, text))"
