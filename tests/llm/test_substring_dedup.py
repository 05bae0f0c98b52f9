"""Substring dedup: brute force on hard rows and on the table, hashes of windows, empty tables."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexivec.llm import substring_dedup as S
from lexivec.llm.queries import QUERIES

from .conftest import SF
from .test_llm import HARD, edited


def plain(rows, window=50):
    """Rows of (doc_id, n_words, n_removed, longest, kept_sha256) for rows (doc_id, text), repeated and null ids too."""
    rank = lambda i: 2**63 - 1 if i is None else i
    texts = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    least, out, length = {}, {}, window
    covered, longest = [set() for _ in texts], [0] * len(texts)
    while any(len(w) >= length for _, w in texts):
        least = {}
        for i, w in texts:
            for p in range(len(w) - length + 1):
                k = tuple(w[p : p + length])
                least[k] = min(rank(i), least.get(k, rank(i)))
        for n, (i, w) in enumerate(texts):
            for p in range(len(w) - length + 1):
                if least[tuple(w[p : p + length])] < rank(i):
                    longest[n] = length
                    if length == window:
                        covered[n].update(range(p, p + length))
        length *= 2
    for n, (i, w) in enumerate(texts):
        kept = " ".join(x for k, x in enumerate(w) if k not in covered[n])
        out.setdefault(n, (i, len(w), len(covered[n]), longest[n], hashlib.sha256(kept.encode()).hexdigest()))
    return Counter(out.values())


def got(d):
    return Counter((r["doc_id"], r["n_words"], r["n_removed"], r["longest"], r["kept_sha256"]) for r in d.collect())


def passages():
    """Documents that share passages of 45 to 240 words, copies, copies with edits, one passage in most."""
    r = random.Random(11)
    word = lambda: f"w{r.randrange(5000)}"
    shared = [[word() for _ in range(n)] for n in (45, 49, 50, 51, 99, 100, 120, 240)]
    hot = [word() for _ in range(60)]
    rows = []
    for k in range(260):
        w = [word() for _ in range(r.randrange(120))]
        for _ in range(r.randrange(3)):
            s = r.choice(shared)
            at = r.randrange(len(w) + 1)
            w[at:at] = s[r.randrange(3) :]
        if k % 3:
            w += hot
        rows.append((r.randrange(-5, 400), r.choice([" ", "\n", " \t "]).join(w)))
    rows += [(r.randrange(400), t) for _, t in rows[:40]] + [(500 + k, edited(rows[k][1] or "x", 1, k)) for k in range(40) if rows[k][1]]
    rows += [(None, rows[3][1]), (None, rows[3][1]), (rows[4][0], rows[4][1]), (7, "same " * 400), (3, "same " * 130), (9, None), (10, "")]
    return rows


@pytest.mark.parametrize("together", [4096, 2])
def test_equals_brute_force(spark, docs, monkeypatch, together):
    """Also with claims summed by groups of bundles."""
    rows = passages()
    d = docs([(i, t, "a") for i, t in rows]).repartition(12)
    assert got(S.remove_repeats(d, together=together)) == plain(rows)


def test_hard_rows_and_texts(spark, docs):
    rows = [(i, t) for i, t, _ in HARD]
    out = S.remove_repeats(docs(HARD))
    assert got(out) == plain(rows)
    for r in out.collect():
        assert hashlib.sha256(bytes(r["kept"])).hexdigest() == r["kept_sha256"]


@pytest.mark.parametrize("window", [1, 2, 7])
def test_other_windows(spark, docs, window):
    rows = [(k, t) for k, (_, t) in enumerate(passages()[:60])]
    assert got(S.remove_repeats(docs([(i, t, "a") for i, t in rows]), window=window)) == plain(rows, window)


def test_op12_equals_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert got(QUERIES["op12_substring_dedup"](spark, SF)) == plain(rows)


def test_long_texts_are_hashed_in_pieces(monkeypatch):
    """Values and anchors do not depend on where a text is cut."""
    r = random.Random(2)
    body = " ".join(f"w{r.randrange(300)}" for _ in range(4000)).encode()
    whole = S.word_values(body, S._Digests())
    every = np.concatenate([S.anchors(v, 50) for _, v in S.blocks(whole, 50)])
    monkeypatch.setattr(S, "PIECE", 100)
    monkeypatch.setattr(S, "BLOCK", 64)
    monkeypatch.setattr(S, "KNOWN", 50)
    assert np.array_equal(S.word_values(body, S._Digests()), whole)
    assert np.array_equal(np.concatenate([S.anchors(v, 50) for _, v in S.blocks(whole, 50)]), every)
    assert S.single_spaced(" a\x0bb \n c\t" * 40) == b" ".join(40 * [b"a", b"b", b"c"])


def test_a_very_long_text(spark, docs):
    r = random.Random(4)
    words = [f"w{r.randrange(10**6)}" for _ in range(600_000)]
    rows = [(1, " ".join(words[300_000:300_060])), (2, " ".join(words)), (3, " ".join(words[:500_000]))]
    out = {r["doc_id"]: (r["n_words"], r["n_removed"], r["longest"]) for r in S.remove_repeats(docs([(i, t, "a") for i, t in rows]), texts=False).collect()}
    assert out == {1: (60, 0, 0), 2: (600_000, 60, 50), 3: (500_000, 500_000, 50 << 13)}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"b", b"c"]), min_size=8, max_size=60))
def test_equal_windows_have_equal_hashes(words):
    values = S.word_values(b" ".join(words), S._Digests())
    h, g = S._hash_pair(*S.window_sums(values, 8))
    assert len({(a, b) for a, b in zip(h.tolist(), g.tolist())}) == len({tuple(words[p : p + 8]) for p in range(len(words) - 7)})
    a, seen = S.anchors(values, 8), {}
    assert all(seen.setdefault(tuple(words[p : p + 8]), a[p]) == a[p] for p in range(len(words) - 7))


def test_hashes_that_agree_in_64_bits():
    h, g = np.array([5, 5, 5, 9], np.uint64), np.array([1, 2, 7, 1], np.uint32)
    assert S._found(np.array([5, 5, 5, 9, 9, 4], np.uint64), np.array([7, 2, 3, 1, 2, 1], np.uint32), h, g).tolist() == [2, 1, -1, 3, -1, -1]
    back = S._settle(S._table([(0, 0, S._packed(h, g, np.array([3, 3, 3, 3]), np.zeros(4, bool))), (1, 0, S._packed(h[1:3], g[1:3], np.array([3, 2]), np.zeros(2, bool)))]))
    (bh, bg, least), _ = S._all_of(back, S.BACK)
    assert sorted(zip(bh.tolist(), bg.tolist(), least.tolist())) == [(5, 7, 2), (5, 7, 2)]


def test_empty_table(spark, docs):
    assert S.remove_repeats(docs([])).collect() == []
    assert got(S.remove_repeats(docs([(1, None, "a")]))) == plain([(1, None)])
