r"""Suffix-array dedup: byte strings of 50 that a document of smaller id has too are removed.

Anchors. Of the 35 sixteen-byte grams in a window of 50 bytes, the one with the least hash, leftmost of equals, is the
window's anchor. Equal windows have equal anchors at equal places, so windows need comparing only within an anchor's
group. Whole texts that repeat are settled beforehand by their hashes.

1. Which anchors occur in two documents? Hashes are counted per range of hashes; only documents with such an anchor go on.
2. Each occurrence of such an anchor gives its context: 34 bytes before it, its 16, and 34 after. Of equal contexts only
   that of the least document needs comparing: every other one is covered whole. That is settled per task before the
   shuffle, and again after it, so a passage that many documents share stays one row a task. Anchors that very many
   documents have give their windows instead, which are dealt out by their own hashes and settled in the same two steps.
3. The contexts of a range of anchors form a sparse suffix array: the suffixes that begin at anchors, and the reversed
   prefixes that end there, sorted by multikey quicksort to a shallow depth, 16 bytes at a time of 8, then groups that
   still agree by blind tries. From an order and its common prefixes each suffix's node at any depth is a running count;
   a window of a context, l bytes left of the anchor and 50 - l from there, is a pair of nodes, exactly, and its least
   document the least in the pair's group.
4. Each document's covered bytes are cut out of its text.

Hashes only bring strings together; bytes decide which are equal (whole texts: SHA-256).

Defined results: a null text is empty; texts are taken as UTF-8 bytes; every row is a document of its own with a number of
its own, ids serve the comparison only, so rows that repeat an id never remove each other's bytes; a null id counts as the
greatest (2^63 - 1); extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexivec.llm.common import durable, hinted, salted_join, table, trim, with_python

WINDOW, GRAM = 50, 16
SIDE = WINDOW - GRAM
CONTEXT = WINDOW + SIDE
#: Bytes that a group of documents has at least and at most, and anchors of a range and of a group's part of it, about.
GROUP_BYTES, MOST_GROUP_BYTES, PER_RANGE, PER_BUNDLE = 2 << 20, 16 << 20, 1_000_000, 1_000
#: Bytes of contexts that are settled and shuffled together.
CONTEXT_BYTES = 8 << 20
#: An anchor that more documents have than this is compared window by window, so that no group of one anchor grows with the
#: corpus: its windows are dealt out by their own hashes. So many contexts fill a part of a range by themselves.
HOT = 131_072
#: Rows whose spans are gathered together, as a power of 2: about 128 MiB of texts of 2 KB.
BUCKET_BITS = 16
#: Parts of a range in which contexts are compared, so that one task's contexts stay small.
PARTS = 12
#: Texts, and code points of each, from which a dictionary of so many bytes is made for their compression.
SAMPLE_ROWS, SAMPLE_CHARS, DICTIONARY_BYTES = 1_000, 4_000, 112_640
#: Windows of a long text treated at once.
BLOCK = 1 << 20
#: Bytes sorted by words before blind tries take over, beyond the anchor itself.
SHALLOW = 16


def _mix(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(29)
    return h


def _slide(a: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Minimum or maximum of each run of `width` entries."""
    pick, have = (np.minimum if least else np.maximum), 1
    while have < width:
        step = min(have, width - have)
        a = pick(a[:-step], a[step:])
        have += step
    return a


def _block_anchors(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(text) - GRAM + 1
    raw = np.ndarray((n + 8,), "<u8", text, 0, (1,))
    h = _mix(raw[:n] * np.uint64(0x9E3779B97F4A7C15) ^ _mix(raw[8:] * np.uint64(0xBF58476D1CE4E5B9)))
    width = SIDE + 1
    least = _slide(h, width, True)
    # A gram is an anchor if it is the least of some window that has it; of equal ones in a window the leftmost.
    padded = np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)])
    places = np.flatnonzero(_slide(padded, width, False) == h)
    # Of equal hashes in reach of one window, a later one counts only if some window has it and none of the earlier.
    same = np.flatnonzero((h[places[1:]] == h[places[:-1]]) & (np.diff(places) < width)) + 1
    keep = np.ones(len(places), bool)
    for i in same.tolist():
        q, before = int(places[i]), int(places[i - 1])
        lo, hi = max(before + 1, q - width + 1), min(q, len(least) - 1)
        keep[i] = lo <= hi and bool((least[lo : hi + 1] == h[q]).any())
    return places[keep], h[places[keep]]


def anchors(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors of a text's windows; none if it is shorter than a window."""
    if len(text) < WINDOW:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    found = []
    for lo in range(0, len(text) - WINDOW + 1, BLOCK):
        places, h = _block_anchors(text[lo : lo + BLOCK + WINDOW - 1])
        found.append((places + lo, h))
    if len(found) == 1:
        return found[0]
    places, first = np.unique(np.concatenate([p for p, _ in found]), return_index=True)
    return places, np.concatenate([h for _, h in found])[first]


def _bytes_of(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _dictionary(docs: DataFrame) -> bytes | None:
    """A dictionary that makes short texts compress well, from a bounded sample; results don't depend on it."""
    some = [_bytes_of(r["t"]) for r in docs.select(F.substring("text", 1, SAMPLE_CHARS).alias("t")).limit(SAMPLE_ROWS).collect()]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, [b for b in some if b]).as_bytes()
    except zstandard.ZstdError:  # too few texts, or too much alike
        return None


class Codec:
    """Compresses and restores texts, with a dictionary if there is one."""

    def __init__(self, dictionary: bytes | None):
        known = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
        self.pack = zstandard.ZstdCompressor(level=3, **known).compress
        self.unpack = zstandard.ZstdDecompressor(**known).decompress


def _packed_rows(batches, dictionary: bytes | None):
    """doc_id, length, hash of the whole text and the text's bytes, compressed, as they are read and shuffled again."""
    codec = Codec(dictionary)
    for batch in batches:
        bodies = [_bytes_of(v.as_py()) for v in batch.column(1)]
        columns = (pa.array([len(b) for b in bodies], pa.int64()), pa.array([hashlib.sha256(b).digest() for b in bodies], pa.binary()), pa.array(map(codec.pack, bodies), pa.binary()))
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "n_bytes", "whole", "body"])
    trim()


def _groups(batches, most: int, codec: Codec):
    """Numbers of rows and texts as bytes, of about `most` bytes together."""
    rows, bodies, held = [], [], 0
    for batch in batches:
        for row, value in zip(batch.column(0).to_pylist(), batch.column(1)):
            rows.append(row)
            bodies.append(codec.unpack(value.as_py()))
            held += len(bodies[-1])
            if held >= most:
                yield rows, bodies
                rows, bodies, held = [], [], 0
    if rows:
        yield rows, bodies
    trim()


def _range_of(h: np.ndarray, ranges: int) -> np.ndarray:
    return (((h >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)).astype(np.int64)


def _anchor_rows(batches, ranges: int, most: int, dictionary: bytes | None):
    """One row per group of documents and range of hashes: the rows' numbers, how many anchors of each, and their lower 32 bits."""
    for rows, bodies in _groups(batches, most, Codec(dictionary)):
        found = [np.unique(anchors(b)[1]) for b in bodies]
        h = np.concatenate(found)
        owner = np.repeat(np.arange(len(found)), [len(x) for x in found])
        r = _range_of(h, ranges)
        order = np.argsort(r, kind="stable")
        r, owner, h, numbers = r[order], owner[order], h[order].astype(np.uint32), np.array(rows, np.int64)
        out = []
        for part in np.split(np.arange(len(r)), np.flatnonzero(np.diff(r)) + 1) if len(r) else []:
            own, counts = np.unique(owner[part], return_counts=True)
            out.append((int(r[part[0]]), numbers[own].tobytes(), counts.astype(np.uint32).tobytes(), h[part].tobytes()))
        columns = list(zip(*out)) if out else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *[pa.array(c, pa.binary()) for c in columns[1:]]], names=["span", "rows", "counts", "low"])


def _joined(t: pa.Table, column: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_py() for x in t.column(column)), kind)


def _shared_anchors(t: pa.Table, hot: int = HOT) -> pa.Table:
    """row, key: one row for each document's anchor of this range that another document has too.

    The key is the range and the hash's lower 32 bits; that of an anchor which more than `hot` documents have is negative.
    """
    low, rows, counts = _joined(t, "low", np.uint32), _joined(t, "rows", np.int64), _joined(t, "counts", np.uint32)
    order = np.argsort(low, kind="stable")
    ordered = low[order]
    start = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(low) else np.empty(0, np.int64)
    n = np.diff(np.append(start, len(low)))
    times = np.empty(len(low), np.int64)
    times[order] = np.repeat(n, n)
    keep = times > 1
    key = (np.int64(t.column("span")[0].as_py()) << np.int64(32)) | low[keep].astype(np.int64)
    return pa.table({"row": pa.array(np.repeat(rows, counts)[keep]), "key": pa.array(np.where(times[keep] > hot, ~key, key))})


def _in(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which keys are among the known ones, which are sorted."""
    return known[np.minimum(np.searchsorted(known, keys), len(known) - 1)] == keys if len(known) else np.zeros(len(keys), bool)


def _context_rows(batches, ranges: int, parts: int, dictionary: bytes | None):
    """What the shared anchors bring to compare: one row per part and group of documents, and the settled spans.

    In: row, rank (the id's, for the comparison of ids), compressed text, live (keys of the document's shared anchors).
    Out: kind, part, and compressed: of kind 0 contexts (anchor, rank, row, place, bytes left and right; context), of kind 1
    windows of hot anchors (rank, row, place; window), of kind 2 the spans (row, first byte, end byte) of those settled.
    """
    codec = Codec(dictionary)
    heads, blobs, windows, held = [], [], [], 0
    for batch in batches:
        for row, rank, packed, live in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
            body = codec.unpack(packed.as_py())
            places, h = anchors(body)
            keys = (_range_of(h, ranges) << np.int64(32)) | (h & np.uint64(0xFFFFFFFF)).astype(np.int64)
            known = np.sort(live.values.to_numpy(zero_copy_only=False))
            hot = np.flatnonzero(_in(keys, ~known[known < 0][::-1]))
            keep = np.flatnonzero(_in(keys, known[known >= 0]))
            text = np.frombuffer(bytes(SIDE) + body + bytes(SIDE), np.uint8)
            if len(keep):
                left, right = np.minimum(places[keep], SIDE), np.minimum(len(body) - GRAM - places[keep], SIDE)
                heads.append(np.column_stack([h[keep].view(np.int64), np.full(len(keep), rank), np.full(len(keep), row), places[keep], left, right]).astype(np.int64))
                blobs.append(np.lib.stride_tricks.sliding_window_view(text, CONTEXT)[places[keep]])
            if len(hot):
                # All windows that hold one of the hot anchors.
                starts = np.unique((places[hot][:, None] - np.arange(SIDE + 1)).ravel())
                starts = starts[(starts >= 0) & (starts <= len(body) - WINDOW)]
                windows.append((np.column_stack([np.full(len(starts), rank), np.full(len(starts), row), starts]).astype(np.int64), np.lib.stride_tricks.sliding_window_view(text, WINDOW)[starts + SIDE]))
                held += len(starts) * WINDOW
            held += len(keep) * CONTEXT
            if held >= CONTEXT_BYTES:
                yield _bundles(heads, blobs, windows, parts)
                heads, blobs, windows, held = [], [], [], 0
    if heads or windows:
        yield _bundles(heads, blobs, windows, parts)
    trim()


def _dealt(kind: int, h: np.ndarray, m: np.ndarray, c: np.ndarray, parts: int, pack):
    """(kind, part, numbers, bytes) of the rows of m and c, by the part of their hash."""
    part = _range_of(h, parts)
    order = np.argsort(part, kind="stable")
    part, m, c = part[order], m[order], c[order]
    for p in np.split(np.arange(len(part)), np.flatnonzero(np.diff(part)) + 1) if len(part) else []:
        yield kind, int(part[p[0]]), pack.compress(np.ascontiguousarray(m[p].T).tobytes()), pack.compress(c[p].tobytes())


def _bundles(heads, blobs, windows, parts: int) -> pa.RecordBatch:
    pack, out, settled = zstandard.ZstdCompressor(level=1), [], []
    if heads:
        m, c = np.concatenate(heads), np.concatenate(blobs)
        first, spans = _settle(m, c)
        settled.append(spans)
        out += _dealt(0, m[first, 0].copy().view(np.uint64), m[first], c[first], parts, pack)
    if windows:
        m, c = np.concatenate([x for x, _ in windows]), np.concatenate([x for _, x in windows])
        h = _hashes(c)
        first, spans = _settle_windows(m, c, h)
        settled.append(spans)
        out += _dealt(1, h[first], m[first], c[first], parts, pack)
    # Spans go to a part by their bucket, so that no single one gets them all.
    spans = merged(np.concatenate(settled))
    part = (spans[:, 0] >> BUCKET_BITS) % parts
    out += [(2, int(part[p[0]]), pack.compress(np.ascontiguousarray(spans[p]).tobytes()), b"") for p in (np.split(np.arange(len(part)), np.flatnonzero(np.diff(part)) + 1) if len(part) else [])]
    columns = list(zip(*out)) if out else [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), *[pa.array(x, pa.binary()) for x in columns[2:]]], names=["kind", "part", "heads", "contexts"])


def _hashes(strings: np.ndarray) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, np.ascontiguousarray(strings)), np.uint64, len(strings))


def _first_of_equal(strings: np.ndarray, h: np.ndarray, rank: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order in which equal strings stand together by rank, and the least rank among each one's equals.

    Hashes bring equal strings together, bytes decide. Strings that differ but share a hash may split their runs, so that
    some equal ones are not seen as such; none are ever taken for equal that differ.
    """
    order = np.lexsort((place, rank, h))
    s = strings[order]
    start = np.concatenate([[True], (h[order][1:] != h[order][:-1]) | (s[1:] != s[:-1]).any(axis=1)])
    return order, rank[order][np.flatnonzero(start)][np.cumsum(start) - 1]


def _settle(m: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which contexts are the first of their kind, of the least document, and the full spans of the others.

    A context equal to one of a smaller document is covered by each window that fits into the text.
    """
    if not len(m):
        return np.empty(0, np.int64), np.empty((0, 3), np.int64)
    strings = np.column_stack([np.ascontiguousarray(m[:, [4, 5]]).astype(np.uint8), c])
    order, least = _first_of_equal(strings, _hashes(strings), m[:, 1], m[:, 3])
    later = m[order, 1] > least
    covered = m[order][later]
    # One row stands for a context of its least document; that document's repeats of it go along, but are rare.
    return order[~later], _spans(covered, SIDE - covered[:, 5], covered[:, 4])


def _settle_windows(m: np.ndarray, c: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which windows (rank, row, place) are the first of their kind, and the spans of the others."""
    order, least = _first_of_equal(c, h, m[:, 0], m[:, 2])
    later = m[order, 0] > least
    covered = m[order][later]
    return order[~later], np.column_stack([covered[:, 1], covered[:, 2], covered[:, 2] + WINDOW])


def compare_windows(m: np.ndarray, c: np.ndarray) -> np.ndarray:
    """(row, first byte, end byte) covered, of all windows of one part."""
    if not len(m):
        return np.empty((0, 3), np.int64)
    h = _hashes(c)
    order = np.argsort(h, kind="stable")
    odd = (h[order][1:] == h[order][:-1]) & (c[order][1:] != c[order][:-1]).any(axis=1)
    if odd.any():
        # Windows of one hash that differ: those of such hashes by their bytes alone.
        _, h = np.unique(np.ascontiguousarray(c).view(f"V{WINDOW}").ravel(), return_inverse=True)
        h = h.astype(np.uint64)
    return _settle_windows(m, c, h)[1]


def _spans(m: np.ndarray, l_least: np.ndarray, l_most: np.ndarray) -> np.ndarray:
    """(row, first byte, end byte) covered by the windows from l_least to l_most bytes left of an anchor."""
    ok = l_least <= l_most
    return np.column_stack([m[:, 2], m[:, 3] - l_most, m[:, 3] + WINDOW - l_least])[ok]


class BlindTrie:
    """Orders strings that share a prefix: inner nodes have only the place of the first differing byte.

    A string descends without comparing, is compared with the leaf it reaches, and is put in where they differ.
    """

    __slots__ = ("root", "strings")

    def __init__(self, strings):
        self.strings = strings
        self.root = None
        for i in range(len(strings)):
            self._add(i)

    def _leaf(self, node, s):
        while isinstance(node, list):
            kids = node[1]
            node = kids.get(s[node[0]]) if node[0] < len(s) else None
            if node is None:
                node = next(iter(kids.values()))
        return node

    def _add(self, i: int) -> None:
        s = self.strings[i]
        if self.root is None:
            self.root = i
            return
        other = self.strings[self._leaf(self.root, s)]
        depth = next((k for k, (a, b) in enumerate(zip(s, other)) if a != b), min(len(s), len(other)))
        holder, key, node = None, None, self.root
        while isinstance(node, list) and node[0] < depth:
            holder, key = node, s[node[0]]
            node = node[1][key]
        if isinstance(node, list) and node[0] == depth:
            node[1][s[depth]] = i
            return
        split = [depth, {other[depth]: node, s[depth]: i}]
        if holder is None:
            self.root = split
        else:
            holder[1][key] = split

    def order(self) -> list[int]:
        out, stack = [], [self.root]
        while stack:
            node = stack.pop()
            if isinstance(node, list):
                stack += [node[1][k] for k in sorted(node[1], reverse=True)]
            else:
                out.append(node)
        return out


def multikey_quicksort(order: np.ndarray, bounds: np.ndarray, words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The order sorted within its segments (bounds: their first places, and the end) by the words, and the new segments.

    All segments are parted at once: each by the word of its middle row into less, equal and greater, of which the equal
    part goes on with the next word. A segment of one row, or without a word left, is done.
    """
    order = order.copy()
    depth = np.zeros(len(bounds) - 1, np.int64)
    stacked = np.stack(words) if words else np.empty((0, len(order)), np.uint64)
    cuts = [bounds]
    while True:
        size = np.diff(bounds)
        live = np.flatnonzero((size > 1) & (depth < len(words)))
        if not len(live):
            return order, np.unique(np.concatenate(cuts))
        lo, n, at = bounds[:-1][live], size[live], depth[live]
        segment = np.repeat(np.arange(len(live)), n)
        places = np.arange(len(segment)) - np.repeat(np.cumsum(n) - n, n) + lo[segment]
        rows = order[places]
        word = stacked[at[segment], rows]
        pivot = word[np.cumsum(n) - n + n // 2][segment]
        side = 3 * segment + (word > pivot).astype(np.int64) + (word >= pivot)
        by = np.argsort(side, kind="stable")
        order[places] = rows[by]
        side = side[by]
        first = np.flatnonzero(np.concatenate([[True], side[1:] != side[:-1]]))
        # Segments that go on, in their places; what lies between two of them is nobody's, and done.
        starts, ends = places[first], np.append(places[first[1:] - 1], places[-1]) + 1
        cuts.append(starts)
        depth_of = at[side[first] // 3] + (side[first] % 3 == 1)
        gap = np.concatenate([starts[1:] != ends[:-1], [True]])
        bounds = np.insert(starts, np.flatnonzero(gap) + 1, ends[gap])
        depth = np.insert(depth_of, np.flatnonzero(gap) + 1, len(words))[: len(bounds) - 1]


def deep_shallow_sort(group: np.ndarray, strings: np.ndarray, shallow: int = SHALLOW) -> np.ndarray:
    """Order of the rows of `strings` (fixed width bytes) by group, then by bytes.

    Multikey quicksort by words of 8 bytes, all groups at once, to the shallow depth; what then still agrees goes to blind
    tries, which see distinct strings only.
    """
    n = len(strings)
    words = [np.ascontiguousarray(strings[:, k : k + 8]).view(">u8").ravel().astype(np.uint64) for k in range(0, shallow, 8)]
    order = np.argsort(group, kind="stable")
    bounds = np.append(np.flatnonzero(np.concatenate([[True], group[order][1:] != group[order][:-1]])), n) if n else np.zeros(1, np.int64)
    order, bounds = multikey_quicksort(order, bounds, words)
    bounds = np.append(bounds[bounds < n], n)
    tails = np.ascontiguousarray(strings[:, shallow:])
    for k in np.flatnonzero(np.diff(bounds) > 1).tolist():
        rows = order[bounds[k] : bounds[k + 1]]
        some = tails[rows]
        if (some == some[0]).all():
            continue
        alike: dict[bytes, list[int]] = {}
        for row, tail in zip(rows.tolist(), map(bytes, some)):
            alike.setdefault(tail, []).append(row)
        tails_of = list(alike)
        order[bounds[k] : bounds[k + 1]] = [row for i in BlindTrie(tails_of).order() for row in alike[tails_of[i]]]
    return order


def common_prefixes(strings: np.ndarray, order: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Common bytes of each row with the one before it in the order; -1 where a group begins."""
    if not len(order):
        return np.empty(0, np.int64)
    differs = strings[order][1:] != strings[order][:-1]
    lcp = np.where(differs.any(axis=1), differs.argmax(axis=1), strings.shape[1])
    lcp[group[order][1:] != group[order][:-1]] = -1
    return np.concatenate([[-1], lcp])


def compare_contexts(m: np.ndarray, c: np.ndarray) -> np.ndarray:
    """(row, first byte, end byte) covered, of contexts of whole groups of anchors."""
    first, settled = _settle(m, c)
    m, c = m[first], c[first]
    # An anchor of one document alone covers nothing.
    order = np.argsort(m[:, 0], kind="stable")
    m, c = m[order], c[order]
    _, group = np.unique(m[:, 0], return_inverse=True)
    low = np.full(group.max() + 1 if len(group) else 0, np.iinfo(np.int64).max)
    high = np.full(len(low), np.iinfo(np.int64).min)
    np.minimum.at(low, group, m[:, 1])
    np.maximum.at(high, group, m[:, 1])
    several = low[group] < high[group]
    m, c, group = m[several], c[several], group[several]
    if not len(m):
        return settled
    right, left = np.ascontiguousarray(c[:, SIDE + GRAM :]), np.ascontiguousarray(c[:, SIDE - 1 :: -1])
    r_order, l_order = deep_shallow_sort(group, right), deep_shallow_sort(group, left)
    r_lcp, l_lcp = common_prefixes(right, r_order, group), common_prefixes(left, l_order, group)
    l_least, l_most = np.full(len(m), SIDE + 1), np.full(len(m), -1)
    node_r, node_l = np.empty(len(m), np.int64), np.empty(len(m), np.int64)
    for l in range(SIDE + 1):  # noqa: E741
        able = np.flatnonzero((m[:, 4] >= l) & (m[:, 5] >= SIDE - l))
        if not len(able):
            continue
        node_r[r_order] = np.cumsum(r_lcp < SIDE - l)
        node_l[l_order] = np.cumsum(l_lcp < l)
        key = node_r[able] * (len(m) + 1) + node_l[able]
        by = np.lexsort((m[able, 1], key))
        start = np.concatenate([[True], key[by][1:] != key[by][:-1]])
        least = m[able[by], 1][np.flatnonzero(start)][np.cumsum(start) - 1]
        hit = able[by][m[able[by], 1] > least]
        l_least[hit] = np.minimum(l_least[hit], l)
        l_most[hit] = np.maximum(l_most[hit], l)
    return np.concatenate([settled, _spans(m, l_least, l_most)])


def merged(spans: np.ndarray) -> np.ndarray:
    """(row, first, end) of spans that touch or overlap, joined; sorted."""
    if not len(spans):
        return spans
    row, lo, hi = spans[np.lexsort((spans[:, 1], spans[:, 0]))].T
    # Rows one after another on a single axis, far enough apart that no span reaches the next row.
    base = np.cumsum(np.concatenate([[0], row[1:] != row[:-1]])) * (int(hi.max()) + 2)
    reach = np.maximum.accumulate(base + hi)
    first = np.flatnonzero(np.concatenate([[True], (base + lo)[1:] > reach[:-1]]))
    last = np.append(first[1:], len(row)) - 1
    return np.column_stack([row[first], lo[first], reach[last] - base[last]])


def _span_table(spans: np.ndarray) -> pa.Table:
    """Spans of a part as one blob (row, first, end) for each bucket of rows."""
    spans = merged(spans).astype(np.int64)
    at = np.flatnonzero(np.diff(spans[:, 0] >> BUCKET_BITS)) + 1 if len(spans) else []
    parts = np.split(spans, at) if len(spans) else []
    return pa.table({"bucket": pa.array([int(p[0, 0]) >> BUCKET_BITS for p in parts], pa.int64()), "spans": pa.array([p.tobytes() for p in parts], pa.binary())})


def _by_row(t: pa.Table) -> pa.Table:
    """row and its merged spans as one blob of pairs, from all blobs of its bucket."""
    spans = merged(_joined(t, "spans", np.int64).reshape(-1, 3))
    rows, starts = np.unique(spans[:, 0], return_index=True)
    return pa.table({"row": pa.array(rows), "spans": pa.array([x[:, 1:].tobytes() for x in np.split(spans, starts[1:])], pa.binary())})


def _compare(t: pa.Table) -> pa.Table:
    unpack, kind = zstandard.ZstdDecompressor(), t.column("kind")[0].as_py()
    heads = [np.frombuffer(unpack.decompress(x.as_py()), np.int64) for x in t.column("heads")]
    if kind == 2:
        return _span_table(np.concatenate([x.reshape(-1, 3) for x in heads]))
    width, numbers, compare = ((CONTEXT, 6, compare_contexts), (WINDOW, 3, compare_windows))[kind]
    strings = np.concatenate([np.frombuffer(unpack.decompress(x.as_py()), np.uint8).reshape(-1, width) for x in t.column("contexts")])
    out = _span_table(compare(np.ascontiguousarray(np.concatenate([x.reshape(numbers, -1).T for x in heads])), strings))
    trim()
    return out


def _cut_rows(batches, dictionary: bytes | None):
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
    codec = Codec(dictionary)
    for batch in batches:
        out = []
        for doc_id, value, again, pairs in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            body = codec.unpack(value.as_py())
            if again and len(body) >= WINDOW:
                spans, kept = [[0, len(body)]], b""
            else:
                spans = np.frombuffer(pairs or b"", np.int64).reshape(-1, 2).tolist()
                ends = [0, *[e for _, e in spans]]
                kept = b"".join(body[a:b] for a, b in zip(ends, [*[s for s, _ in spans], len(body)]))
            out.append((doc_id, len(body), len(body) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept))
        columns = list(zip(*out)) if out else [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()))], names=names)


def remove_repeats(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes left) of every row of docs (doc_id, text).

    hot: anchors of more documents are compared window by window; the result is the same.
    """
    d = with_python(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = _dictionary(d)
    # Each row gets a number of its own, and the table is written, so that the numbers hold.
    d = d.mapInArrow(lambda it: _packed_rows(it, known), "doc_id long, n_bytes long, whole binary, body binary")
    rank = F.coalesce("doc_id", F.lit(2**63 - 1)).alias("rank")
    d = durable(d.select(F.monotonically_increasing_id().alias("row"), "doc_id", rank, "n_bytes", "whole", "body"), "packed")
    firsts = d.groupBy("whole").agg(F.min("rank").alias("first"), F.max("rank").alias("last")).filter("first < last").select("whole", "first")
    again = salted_join(d.select("row", "whole", "rank"), durable(firsts, "firsts"), ["whole"], "row").filter("rank > first")
    again = hinted(durable(again.select(F.col("row").alias("again_row")), "whole_repeats"), 16)
    is_again = F.col("row") == F.col("again_row")
    fresh = d.join(again, is_again, "left_anti")
    total = d.agg(F.sum("n_bytes")).first()[0] or 0
    # About one anchor for 18 bytes; groups grow with the ranges, so that a group's part of a range stays about PER_BUNDLE.
    ranges = max(8, -(-total // (18 * PER_RANGE)))
    most = min(MOST_GROUP_BYTES, max(GROUP_BYTES, 18 * PER_BUNDLE * ranges))
    live = fresh.select("row", "body").mapInArrow(lambda it: _anchor_rows(it, ranges, most, known), "span int, rows binary, counts binary, low binary")
    live = live.groupBy("span").applyInArrow(lambda t: _shared_anchors(t, hot), "row long, key long")
    live = live.groupBy(F.col("row").alias("live_row")).agg(F.collect_list("key").alias("live"))
    contexts = fresh.select("row", "rank", "body").join(live, F.col("row") == F.col("live_row")).select("row", "rank", "body", "live")
    contexts = contexts.mapInArrow(lambda it: _context_rows(it, ranges, ranges * PARTS, known), "kind int, part int, heads binary, contexts binary")
    spans = contexts.groupBy("kind", "part").applyInArrow(_compare, "bucket long, spans binary")
    spans = spans.groupBy("bucket").applyInArrow(_by_row, "row long, spans binary").withColumnRenamed("row", "span_row")
    # Rows that repeat a whole text are covered whole; only the others need their spans.
    cut = fresh.select("row", "doc_id", "body").join(spans, F.col("row") == F.col("span_row"), "left").select("doc_id", "body", F.lit(False).alias("again"), "spans")
    gone = d.join(again, is_again, "left_semi").select("doc_id", "body", F.lit(True).alias("again"), F.lit(None).cast("binary").alias("spans"))
    return cut.union(gone).mapInArrow(lambda it: _cut_rows(it, known), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def op1_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")
