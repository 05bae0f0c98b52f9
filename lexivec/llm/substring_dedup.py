"""Substring dedup by level-wise doubling: word sequences that a document of smaller id has too are removed.

A window is so many consecutive words of one document. Windows repeated at one length alone are extended to twice that
length, until no candidates survive:

0. Documents are packed into bundles of some MiB, a row each. Whole texts that repeat are settled first.
1. Half the window's length (25 of 50 words). Of the half-length windows in a window only the least hashed one, its anchor,
   needs to be known: equal windows have equal anchors. Anchors that occur in different texts survive.
2. The window's length. Windows whose anchor survived are extended to it, those repeated survive, and each that a smaller
   document has is covered: this decides what is removed.
3. Twice that, and on: two surviving windows, one where the other ends, make a candidate of twice the length, which is known
   by its halves' hashes, without the texts. What survives tells how long a passage is that repeats (`longest`).

A level is one settlement: each bundle claims its candidates' hashes, once each, with the least id that it has for them;
the claims meet by hash, and the least id of all goes back to the bundles that claimed. A sequence that very many documents
have is one claim a bundle; where there are more bundles than `TOGETHER`, claims are first summed by groups of as many
bundles, so that no task has more than a group's claims, or the groups', of one sequence.

Windows are told apart by 96 bits of hashes of their words; two different ones are taken for equal with a probability of
some 2^-90 a pair. (An exact check would need each text again at each level.)

Defined results: a null text has no words; texts are taken as UTF-8; every row is a document of its own, so rows that
repeat an id never remove each other's words; a null id counts as the greatest (2^63 - 1); very long texts are bundles of
their own and hashed in pieces; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexivec.llm.common import durable, table, trim, with_python

WINDOW = 50
#: Bytes of text in a bundle, from which on it is closed; words of all texts for each part in which claims meet.
BUNDLE_BYTES, WORDS_PER_PART = 8 << 20, 2_000_000
#: Bundles whose claims meet at once.
TOGETHER = 4_096
#: Bytes of a text hashed at once, window starts treated at once, and words whose hashes are kept at hand.
PIECE, BLOCK, KNOWN = 1 << 22, 1 << 18, 1 << 20
LAST_ID = 2**63 - 1
#: What a row of a level holds: spans found, the bundle's candidates, or, from 0 on, claims of that part.
SPANS, STATE = -2, -1
ROWS = "bundle long, part int, body binary"

_FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_SPACE = re.compile(rb"[\x20\x09-\x0D]+")


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _hash_pair(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64 and 32 bits of two numbers in their order."""
    mixed = _mix(b + np.uint64(_FACTORS[0]))
    return _mix(a ^ mixed), (_mix(a * np.uint64(3) + mixed) >> np.uint64(32)).astype(np.uint32)


class _Digests(dict):
    """128-bit hashes of words."""

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= KNOWN:
            self.clear()
        d = self[word] = xxhash.xxh3_128_digest(word)
        return d


def word_values(body: bytes, known: _Digests) -> np.ndarray:
    """Two 64-bit numbers for each word of a text with single spaces."""
    found, at = [np.empty((0, 2), np.uint64)], 0
    while at < len(body):
        end = body.find(b" ", at + PIECE)
        end = len(body) if end < 0 else end
        found.append(np.frombuffer(b"".join([known[w] for w in body[at:end].split(b" ")]), "<u8").reshape(-1, 2))
        at = end + 1
    return np.concatenate(found)


def window_sums(values: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit numbers for each window of so many words: polynomials in odd factors, from differences of running sums."""
    out = []
    for k, factor in enumerate(_FACTORS):
        n = len(values)
        powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, factor, np.uint64)]))
        back = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - length, pow(factor, -1, 1 << 64), np.uint64)]))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values[:, k] * powers, dtype=np.uint64)])
        out.append((sums[length:] - sums[:-length]) * back)
    return out[0], out[1]


def least_of_each(a: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of `width` entries."""
    have = 1
    while have < width:
        step = min(have, width - have)
        a = np.minimum(a[:-step], a[step:])
        have += step
    return a


def blocks(values: np.ndarray, window: int):
    """A text's words in blocks that overlap, so that each window stands in one: (first start, values)."""
    for lo in range(0, len(values) - window + 1, BLOCK):
        yield lo, values[lo : lo + BLOCK + window - 1]


def anchors(values: np.ndarray, window: int) -> np.ndarray:
    """For each window of a block the hash of its least hashed half-length window."""
    half = (window + 1) // 2
    return least_of_each(_hash_pair(*window_sums(values, half))[0], window - half + 1)


def _packed(*arrays: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"".join([np.int64(len(arrays[0])).tobytes(), *[np.ascontiguousarray(a).tobytes() for a in arrays]]))


def _unpacked(body: bytes, *kinds) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(body)
    n, at, out = int(np.frombuffer(raw, np.int64, 1)[0]), 8, []
    for k in kinds:
        out.append(np.frombuffer(raw, k, n, at))
        at += n * np.dtype(k).itemsize
    return out


def _table(rows: list[tuple]) -> pa.Table:
    bundle, part, body = zip(*rows) if rows else ((), (), ())
    return pa.table({"bundle": pa.array(bundle, pa.int64()), "part": pa.array(part, pa.int32()), "body": pa.array(body, pa.binary())})


CLAIM = (np.uint64, np.uint32, np.int64, np.bool_)
BACK = (np.uint64, np.uint32, np.int64)
CANDIDATE = (np.uint64, np.uint32, np.int64, np.int64)


def _groups(h: np.ndarray, g: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by hash and rank, and where each hash begins in it."""
    order = np.lexsort((rank, g, h))
    h, g = h[order], g[order]
    return order, np.flatnonzero(np.concatenate([np.ones(min(1, len(h)), bool), (h[1:] != h[:-1]) | (g[1:] != g[:-1])]))


def _summed(h, g, rank, several) -> list[np.ndarray]:
    """Each hash once: with its least rank, and whether it has several."""
    if not len(h):
        return [h, g, rank, several]
    order, first = _groups(h, g, rank)
    last = np.append(first[1:], len(order)) - 1
    lo, hi = rank[order][first], rank[order][last]
    return [h[order][first], g[order][first], lo, np.logical_or.reduceat(several[order], first) | (lo < hi)]


def _claims(bundle: int, h: np.ndarray, g: np.ndarray, rank: np.ndarray, parts: int) -> list[tuple]:
    h, g, lo, several = _summed(h, g, rank, np.zeros(len(h), bool))
    part = (h % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    cuts = np.flatnonzero(np.diff(part[order])) + 1
    return [(bundle, int(part[at[0]]), _packed(h[at], g[at], lo[at], several[at])) for at in np.split(order, cuts) if len(at)]


def _all_of(t: pa.Table, kinds) -> tuple[list[np.ndarray], np.ndarray]:
    """The arrays of all rows' blobs, joined, and each entry's row."""
    blobs = [_unpacked(x.as_py(), *kinds) for x in t.column("body")]
    if not blobs:
        return [np.empty(0, k) for k in kinds], np.empty(0, np.int64)
    return [np.concatenate(c) for c in zip(*blobs)], np.repeat(np.arange(len(blobs)), [len(b[0]) for b in blobs])


def _settle(t: pa.Table) -> pa.Table:
    """For each claim whose hash has several ranks, its least rank, to the bundle that claimed."""
    (h, g, lo, several), row = _all_of(t, CLAIM)
    if not len(h):
        return _table([])
    order, first = _groups(h, g, lo)
    size = np.diff(np.append(first, len(order)))
    least, most = lo[order][first], lo[order][first + size - 1]
    repeated = np.repeat((least < most) | np.logical_or.reduceat(several[order], first), size)
    at, least, row = order[repeated], np.repeat(least, size)[repeated], row[order][repeated]
    by = np.argsort(row, kind="stable")
    at, least, row = at[by], least[by], row[by]
    cuts = np.flatnonzero(np.diff(row)) + 1
    bundle, part = t.column("bundle").to_pylist(), t.column("part")[0].as_py()
    out = _table([(bundle[int(row[k[0]])], part, _packed(h[at[k]], g[at[k]], least[k])) for k in np.split(np.arange(len(at)), cuts) if len(k)])
    trim()
    return out


def _sum_claims(t: pa.Table) -> pa.Table:
    """The claims of a group of bundles as one, under the group's number."""
    arrays, _ = _all_of(t, CLAIM)
    return _table([(t.column("salt")[0].as_py(), t.column("part")[0].as_py(), _packed(*_summed(*arrays)))])


def _hand_back(t: pa.Table, settled: pa.Table) -> pa.Table:
    """What was settled for a group of bundles, to each bundle that claimed it."""
    back, _ = _all_of(settled, BACK)
    order = np.lexsort((back[1], back[0]))
    back = [b[order] for b in back]
    out = []
    for bundle, part, body in zip(t.column("bundle").to_pylist(), t.column("part").to_pylist(), t.column("body")):
        h, g, _, _ = _unpacked(body.as_py(), *CLAIM)
        at = _found(h, g, back[0], back[1])
        if (at >= 0).any():
            out.append((bundle, part, _packed(h[at >= 0], g[at >= 0], back[2][at[at >= 0]])))
    return _table(out)


def settle(claims: DataFrame, bundles: int, together: int = TOGETHER) -> DataFrame:
    """(bundle, part, body): the repeated ones of each bundle's claims, with the least rank of all who claimed them."""
    groups = -(-bundles // together)
    if groups <= 1:
        return claims.groupBy("part").applyInArrow(_settle, ROWS)
    dealt = claims.withColumn("salt", F.pmod(F.xxhash64("bundle"), F.lit(groups)))
    sums = dealt.groupBy("part", "salt").applyInArrow(_sum_claims, ROWS)
    settled = sums.groupBy("part").applyInArrow(_settle, ROWS)
    return dealt.groupBy("part", "salt").cogroup(settled.groupBy("part", "bundle")).applyInArrow(_hand_back, ROWS)


def _found(h: np.ndarray, g: np.ndarray, in_h: np.ndarray, in_g: np.ndarray) -> np.ndarray:
    """Place of each (h, g) in the sorted (in_h, in_g), -1 where it is absent."""
    if not len(in_h):
        return np.full(len(h), -1)
    at = np.searchsorted(in_h, h)
    at[at == len(in_h)] = 0
    hit = in_h[at] == h
    # Of several entries with the same 64 bits, that with the same 32.
    wrong = np.flatnonzero(hit & (in_g[at] != g))
    while len(wrong):
        at[wrong] += 1
        inside = at[wrong] < len(in_h)
        same = np.zeros(len(wrong), bool)
        same[inside] = in_h[at[wrong[inside]]] == h[wrong[inside]]
        hit[wrong[~same]] = False
        wrong = wrong[same]
        wrong = wrong[in_g[at[wrong]] != g[wrong]]
    return np.where(hit, at, -1)


def _bundle(first: int, k: int, rows: list[tuple]) -> pa.RecordBatch:
    ids, bodies = [r[0] for r in rows], [r[1] for r in rows]
    words = [b.count(b" ") + 1 if b else 0 for b in bodies]
    digests = [hashlib.sha256(b).digest() for b in bodies]
    heads = pa.table({"doc_id": pa.array(ids, pa.int64()), "n_words": pa.array(words, pa.int64()), "n_bytes": pa.array([len(b) for b in bodies], pa.int64()), "digest": pa.array(digests, pa.binary(32))})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, heads.schema) as w:
        w.write_table(heads)
    body = zstandard.ZstdCompressor(level=3).compress(b"".join(bodies))
    return pa.RecordBatch.from_pydict({"bundle": pa.array([first + k], pa.int64()), "n_words": pa.array([sum(words)], pa.int64()), "heads": pa.array([sink.getvalue().to_pybytes()], pa.binary()), "texts": pa.array([body], pa.binary())})


def single_spaced(text: str | None) -> bytes:
    """A text's words in UTF-8, joined by one space."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return b" ".join(raw.split()) if len(raw) <= PIECE else _SPACE.sub(b" ", raw).strip(b" ")


def _bundled(batches):
    first, k, rows, size = TaskContext.get().partitionId() << 32, 0, [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            rows.append((doc_id, single_spaced(text.as_py())))
            size += len(rows[-1][1]) + 64
            if size >= BUNDLE_BYTES:
                yield _bundle(first, k, rows)
                k, rows, size = k + 1, [], 0
    if rows:
        yield _bundle(first, k, rows)
    trim()


class _Docs:
    """The documents of a bundle."""

    def __init__(self, heads: bytes, texts: bytes | None = None):
        h = pa.ipc.open_stream(heads).read_all()
        self.doc_id, self.n_words = h.column("doc_id").to_pylist(), h.column("n_words").to_numpy()
        self.rank = np.array([LAST_ID if i is None else i for i in self.doc_id], np.int64)
        self.digest = h.column("digest").to_pylist()
        numbers = np.frombuffer(b"".join(self.digest), "<u8").reshape(-1, 4)
        self.h, self.g = np.ascontiguousarray(numbers[:, 0]), (numbers[:, 1] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        self._ends = np.cumsum(h.column("n_bytes").to_numpy())
        self._texts = memoryview(zstandard.ZstdDecompressor().decompress(texts)) if texts else memoryview(b"")

    def text(self, row: int) -> bytes:
        return bytes(self._texts[0 if row == 0 else self._ends[row - 1] : self._ends[row]])


def _whole_claims(batches, window: int, parts: int):
    for batch in batches:
        rows = []
        for bundle, heads in zip(batch.column(0).to_pylist(), batch.column(1)):
            d = _Docs(heads.as_py())
            long = d.n_words >= window
            rows += _claims(bundle, d.h[long], d.g[long], d.rank[long], parts)
        yield from _table(rows).to_batches()


def _anchor_claims(batches, window: int, parts: int):
    """Anchors by text: of two documents with one text an anchor is known once."""
    known = _Digests()
    for batch in batches:
        for bundle, heads, texts in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
            d, found, of = _Docs(heads.as_py(), texts.as_py()), [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
            seen = set()
            for row in np.flatnonzero(d.n_words >= window).tolist():
                if d.digest[row] in seen:
                    continue
                seen.add(d.digest[row])
                for _, values in blocks(word_values(d.text(row), known), window):
                    found.append(np.unique(anchors(values, window)))
                    of.append(np.full(len(found[-1]), d.h[row].view(np.int64)))
            h = np.concatenate(found)
            yield from _table(_claims(bundle, h, np.zeros(len(h), np.uint32), np.concatenate(of), parts)).to_batches()
    trim()


def _first_level(bundles: pa.Table, backs: pa.Table, window: int, parts: int) -> pa.Table:
    """Candidates of the window's length, by the anchors that survived; rows that repeat a whole text are spans at once."""
    if not bundles.num_rows:
        return _table([])
    bundle = bundles.column("bundle")[0].as_py()
    d = _Docs(bundles.column("heads")[0].as_py(), bundles.column("texts")[0].as_py())
    kind = np.array(backs.column("kind").to_pylist(), np.int64)
    (h, g, least), _ = _all_of(backs.filter(pa.array(kind == 0)), BACK)
    order = np.lexsort((g, h))
    at = _found(d.h, d.g, h[order], g[order])
    again = (d.n_words >= window) & (at >= 0)
    again[again] = d.rank[again] > least[order][at[again]]
    (live, _, _), _ = _all_of(backs.filter(pa.array(kind == 1)), BACK)
    live, known, found = np.sort(live), _Digests(), []
    for row in np.flatnonzero((d.n_words >= window) & ~again).tolist() if len(live) else ():
        for lo, values in blocks(word_values(d.text(row), known), window):
            a = anchors(values, window)
            p = np.searchsorted(live, a)
            p[p == len(live)] = 0
            starts = np.flatnonzero(live[p] == a)
            if len(starts):
                hs, gs = _hash_pair(*[s[starts] for s in window_sums(values, window)])
                found.append((hs, gs, (row << 32) + lo + starts, np.full(len(starts), d.rank[row])))
    out = []
    if again.any():
        rows = np.flatnonzero(again)
        longest = window << np.floor(np.log2(d.n_words[rows] / window)).astype(np.int64)
        out.append((bundle, SPANS, _packed(rows, np.zeros(len(rows), np.int64), d.n_words[rows], longest)))
    if found:
        state = [np.concatenate(c) for c in zip(*found)]
        out += [(bundle, STATE, _packed(*state)), *_claims(bundle, state[0], state[1], state[3], parts)]
    trim()
    return _table(out)


def _next_level(states: pa.Table, backs: pa.Table, length: int, window: int, parts: int) -> pa.Table:
    """Spans of the candidates that a smaller document has, and the candidates of twice the length."""
    if not states.num_rows or not backs.num_rows:
        return _table([])
    bundle = states.column("bundle")[0].as_py()
    (h, g, at, rank), _ = _all_of(states, CANDIDATE)
    (in_h, in_g, least), _ = _all_of(backs, BACK)
    order = np.lexsort((in_g, in_h))
    place = _found(h, g, in_h[order], in_g[order])
    live = place >= 0
    h, g, at, rank, least = h[live], g[live], at[live], rank[live], least[order][place[live]]
    out, covered = [], at[rank > least]
    if len(covered):
        row, start = covered >> 32, covered & 0xFFFFFFFF
        if length > window:
            row, start, end = np.unique(row), 0, 0
        else:
            first = np.concatenate([[True], (row[1:] != row[:-1]) | (start[1:] > start[:-1] + window)])
            end = start[np.append(np.flatnonzero(first)[1:], len(start)) - 1] + window
            row, start = row[first], start[first]
        ones = np.ones(len(row), np.int64)
        out.append((bundle, SPANS, _packed(row, start * ones, end * ones, length * ones)))
    other = np.searchsorted(at, at + length)
    other[other == len(at)] = 0
    pair = np.flatnonzero(at[other] == at + length) if len(at) else np.empty(0, np.int64)
    if len(pair):
        a, b = pair, other[pair]
        wide = lambda k: h[k] ^ (g[k].astype(np.uint64) << np.uint64(32))
        both = _hash_pair(_mix(wide(a)) + g[a], _mix(wide(b)) + g[b])
        out += [(bundle, STATE, _packed(*both, at[a], rank[a])), *_claims(bundle, *both, rank[a], parts)]
    return _table(out)


def _level_after(length: int, window: int, parts: int):
    return lambda states, backs: _next_level(states, backs, length, window, parts)


def _cut(bundles: pa.Table, spans: pa.Table, texts: bool) -> pa.Table:
    """Each document of a bundle without the words of its spans."""
    d = _Docs(bundles.column("heads")[0].as_py(), bundles.column("texts")[0].as_py())
    (row, lo, hi, length), _ = _all_of(spans, 4 * (np.int64,))
    longest = np.zeros(len(d.doc_id), np.int64)
    np.maximum.at(longest, row, length)
    removed, digest, kept = np.zeros(len(d.doc_id), np.int64), list(d.digest), [None] * len(d.doc_id)
    order = np.lexsort((lo, row))
    order = order[lo[order] < hi[order]]
    for k in np.split(order, np.flatnonzero(np.diff(row[order])) + 1) if len(order) else ():
        r = int(row[k[0]])
        body = d.text(r)
        spaces = np.flatnonzero(np.frombuffer(body, np.uint8) == 32)
        first, end = np.append(0, spaces + 1), np.append(spaces, len(body))
        runs, at = [], 0
        for a, b in zip(lo[k].tolist(), hi[k].tolist()):
            if a > at:
                runs.append((at, a))
            removed[r] += max(0, b - max(a, at))
            at = max(at, b)
        if at < len(first):
            runs.append((at, len(first)))
        left = b" ".join([body[first[a] : end[b - 1]] for a, b in runs])
        digest[r], kept[r] = hashlib.sha256(left).digest(), left if texts else None
    columns = {"doc_id": pa.array(d.doc_id, pa.int64()), "n_words": pa.array(d.n_words), "n_removed": pa.array(removed), "longest": pa.array(longest), "kept_sha256": pa.array([x.hex() for x in digest])}
    if texts:
        columns["kept"] = pa.array([d.text(r) if k is None else k for r, k in enumerate(kept)], pa.binary())
    trim()
    return pa.table(columns)


def remove_repeats(docs: DataFrame, window: int = WINDOW, texts: bool = True, together: int = TOGETHER) -> DataFrame:
    """doc_id, n_words, n_removed, longest, kept_sha256 and, if asked for, kept (the words left, joined by one space, as
    bytes) of every row of docs (doc_id, text).

    longest: the greatest of window, twice that, and so on, of which the document has a window that a smaller one has too;
    0 for none. together: bundles whose claims meet at once; the result is the same.
    """
    d = with_python(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    bundles = durable(d.mapInArrow(_bundled, "bundle long, n_words long, heads binary, texts binary"), "bundles")
    n, words = bundles.agg(F.count("*"), F.sum("n_words")).first()
    parts = max(8, -(-(words or 0) // WORDS_PER_PART))
    whole = bundles.select("bundle", "heads").mapInArrow(lambda it: _whole_claims(it, window, parts), ROWS)
    anchor = bundles.select("bundle", "heads", "texts").mapInArrow(lambda it: _anchor_claims(it, window, parts), ROWS)
    backs = settle(whole, n, together).withColumn("kind", F.lit(0)).union(settle(anchor, n, together).withColumn("kind", F.lit(1)))
    by = lambda x: x.groupBy("bundle")
    level = durable(by(bundles).cogroup(by(backs)).applyInArrow(lambda a, b: _first_level(a, b, window, parts), ROWS), "level")
    spans, length = level.filter(F.col("part") == SPANS), window
    while not level.filter("part >= 0").isEmpty():
        back = settle(level.filter("part >= 0"), n, together)
        states = level.filter(F.col("part") == STATE)
        level = durable(by(states).cogroup(by(back)).applyInArrow(_level_after(length, window, parts), ROWS), "level")
        spans, length = spans.union(level.filter(F.col("part") == SPANS)), 2 * length
    schema = "doc_id long, n_words long, n_removed long, longest long, kept_sha256 string" + (", kept binary" if texts else "")
    return by(bundles).cogroup(by(spans)).applyInArrow(lambda a, b: _cut(a, b, texts), schema)


def op12_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), texts=False)
