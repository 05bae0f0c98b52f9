"""Exact dedup: counting quotient filters, merged by sorted remainders, then verification of the bytes.

A text's fingerprint of 64 bits names a range by its uppermost bits; the others split into a quotient, the home slot, and a
remainder. Each partition builds one counting quotient filter per range, without loss. A reducer merges the filters of a
range by one pass over their sorted remainders and adds the counts. Only documents whose fingerprint counts more than one
have their texts compared, byte by byte, by a grouping that is aggregated before it is shuffled.

Defined results: a null text counts as empty; texts are equal when identical without space and U+0009 to U+000D; of
equal texts the one with the most code points stays, then that with the smallest id (null id last); rows that repeat
with one id, or with null, count each, share a group, and one of them is kept. Extra columns are ignored by
`duplicates`; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexivec.llm.common import durable, hinted, one_row_each, row_key, salted_join, table, with_python

SPACE_BYTES = b" \t\n\x0b\x0c\r"
#: Bits of a fingerprint. The uppermost name the range that a filter covers; there are so many ranges that each holds about
#: `PER_RANGE` fingerprints at any size.
P_BITS, PER_RANGE = 64, 1 << 16


def normalised(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").translate(None, SPACE_BYTES)


def _digests(batches):
    """Texts to fingerprint, SHA-256 and length in code points, beside the text and the columns that follow."""
    for batch in batches:
        fps, shas, chars = [], [], []
        for value in batch.column(0):
            text = value.as_py()
            body = normalised(text)
            fps.append(xxhash.xxh3_64_intdigest(body) - (1 << 63))
            shas.append(hashlib.sha256(body).hexdigest())
            chars.append(len(text or ""))
        yield pa.RecordBatch.from_arrays([pa.array(fps, pa.int64()), pa.array(shas), pa.array(chars, pa.int64()), *batch.columns], names=["fp", "text_sha256", "n_code_points", *batch.schema.names])


class CountingQuotientFilter:
    """A multiset of fingerprints below 2**bits in slots.

    The upper bits of a fingerprint are its quotient, whose home is the slot of that number; the lower bits, the remainder,
    stand in the quotient's run: the remainders of one quotient in order, from its home or from where the run before ends.
    `occupied` tells which quotients have a run, `runend` in which slot a run ends, so that the k-th occupied quotient has
    the k-th run. A count over 1 follows its remainder as digits of count - 1 in slots of their own, which `digit` marks;
    so counters are as long as they need to be. There are 2**q homes for at most LOAD times as many fingerprints, and slots
    beyond for the last runs. Nothing is lost: quotient and remainder are the whole fingerprint.
    """

    LOAD, DIGIT_BITS = 0.75, 8

    def __init__(self, fingerprints: np.ndarray, counts: np.ndarray, bits: int):
        """fingerprints: distinct, sorted uint64."""
        n = len(fingerprints)
        self.bits, self.q = bits, max(1, min(bits, int(np.ceil(np.log2(max(n, 1) / self.LOAD)))))
        self.r = bits - self.q
        home = (fingerprints >> np.uint64(self.r)).astype(np.int64)
        more = counts.astype(np.uint64) - np.uint64(1)
        width = np.zeros(n, np.int64)
        for k in range(64 // self.DIGIT_BITS):
            width += (more >> np.uint64(k * self.DIGIT_BITS)) > 0
        before = np.cumsum(width + 1) - (width + 1)
        # Linear probing of sorted entries: each starts at its home, or where the one before it ends.
        start = np.maximum.accumulate(home - before) + before if n else home
        end = start + width
        slots = max(1 << self.q, int(end[-1]) + 1 if n else 0)
        self.occupied, self.runend, self.digit = np.zeros(1 << self.q, bool), np.zeros(slots, bool), np.zeros(slots, bool)
        self.slots = np.zeros(slots, np.uint64)
        self.occupied[home] = True
        self.runend[end[np.concatenate([home[1:] != home[:-1], [True]])] if n else []] = True
        self.slots[start] = fingerprints & np.uint64((1 << self.r) - 1)
        for k in range(int(width.max()) if n else 0):
            has = width > k
            self.digit[start[has] + 1 + k] = True
            self.slots[start[has] + 1 + k] = (more[has] >> np.uint64(k * self.DIGIT_BITS)) & np.uint64((1 << self.DIGIT_BITS) - 1)

    @classmethod
    def of(cls, fingerprints: np.ndarray, bits: int = P_BITS) -> CountingQuotientFilter:
        return cls(*np.unique(fingerprints, return_counts=True), bits)

    def _runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Occupied quotients, and the first and last slots of their runs."""
        home, last = np.flatnonzero(self.occupied), np.flatnonzero(self.runend)
        return home, np.maximum(home, np.concatenate([[0], last[:-1] + 1])) if len(home) else home, last

    def entries(self) -> tuple[np.ndarray, np.ndarray]:
        """Fingerprints, in order, and their counts."""
        home, first, last = self._runs()
        n = last - first + 1
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
        of = np.repeat(home, n)
        entry = np.flatnonzero(~self.digit[at])
        fingerprints = (of[entry].astype(np.uint64) << np.uint64(self.r)) | self.slots[at[entry]]
        # A digit's place is its distance from the remainder before it.
        owner = np.cumsum(~self.digit[at]) - 1
        place = (np.arange(len(at)) - entry[owner] - 1) if len(at) else at
        counts = np.ones(len(entry), np.int64)
        digits = np.flatnonzero(self.digit[at])
        np.add.at(counts, owner[digits], (self.slots[at[digits]] << (place[digits] * self.DIGIT_BITS).astype(np.uint64)).astype(np.int64))
        return fingerprints, counts

    def count(self, fingerprint: int) -> int:
        """How often the fingerprint is in the filter: its run is found by rank and select."""
        home = fingerprint >> self.r
        if not self.occupied[home]:
            return 0
        k = int(self.occupied[:home].sum())
        _, first, last = self._runs()
        i = int(first[k])
        while i <= last[k]:
            j = i + 1
            while j <= last[k] and self.digit[j]:
                j += 1
            if int(self.slots[i]) == fingerprint & ((1 << self.r) - 1):
                return 1 + sum(int(d) << (self.DIGIT_BITS * p) for p, d in enumerate(self.slots[i + 1 : j]))
            i = j
        return 0

    def to_bytes(self) -> bytes:
        """Head, the three bit vectors, and of each slot as many bytes as a remainder needs."""
        wide = max(1, -(-max(self.r, self.DIGIT_BITS) // 8))
        head = np.array([self.bits, self.q, len(self.slots)], np.int64)
        return b"".join((head.tobytes(), *(np.packbits(v).tobytes() for v in (self.occupied, self.runend, self.digit)), np.ascontiguousarray(self.slots.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :wide]).tobytes()))

    @classmethod
    def from_bytes(cls, blob: bytes) -> CountingQuotientFilter:
        out = cls.__new__(cls)
        out.bits, out.q, n = (int(x) for x in np.frombuffer(blob, np.int64, 3))
        out.r, at = out.bits - out.q, 24
        for name, size in (("occupied", 1 << out.q), ("runend", n), ("digit", n)):
            setattr(out, name, np.unpackbits(np.frombuffer(blob, np.uint8, -(-size // 8), at), count=size).astype(bool))
            at += -(-size // 8)
        wide = max(1, -(-max(out.r, cls.DIGIT_BITS) // 8))
        slots = np.zeros((n, 8), np.uint8)
        slots[:, :wide] = np.frombuffer(blob, np.uint8, n * wide, at).reshape(n, wide)
        out.slots = slots.view("<u8").ravel().astype(np.uint64)
        return out

    def merge(self, other: CountingQuotientFilter) -> CountingQuotientFilter:
        """Both filters' entries, which are in order, woven into one order; those of one fingerprint add their counts."""
        (a, n), (b, m) = self.entries(), other.entries()
        both, counts = np.empty(len(a) + len(b), np.uint64), np.empty(len(a) + len(b), np.int64)
        to = np.searchsorted(a, b) + np.arange(len(b))
        mine = np.ones(len(both), bool)
        mine[to] = False
        both[to], counts[to], both[mine], counts[mine] = b, m, a, n
        if not len(both):
            return CountingQuotientFilter(both, counts, self.bits)
        first = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]]))
        return CountingQuotientFilter(both[first], np.add.reduceat(counts, first), self.bits)

    def repeated(self) -> np.ndarray:
        fingerprints, counts = self.entries()
        return fingerprints[counts > 1]


def _build(batches, range_bits: int):
    """One partition's filters, one row per range that it has entries of: sorted once, cut where a range begins."""
    parts = [b.column(0).to_numpy(zero_copy_only=False).view(np.uint64) ^ np.uint64(1 << 63) for b in batches]
    fps, counts = np.unique(np.concatenate(parts) if parts else np.empty(0, np.uint64), return_counts=True)
    bits = P_BITS - range_bits
    spans, own = (fps >> np.uint64(bits)).astype(np.int64), fps & np.uint64((1 << bits) - 1)
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(spans)) + 1, [len(fps)]]) if len(fps) else np.zeros(1, np.int64)
    rows = [(int(spans[lo]), CountingQuotientFilter(own[lo:hi], counts[lo:hi], bits).to_bytes()) for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
    yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int32()), pa.array([b for _, b in rows], pa.binary())], names=["span", "filter"])


def _merge(filters: pa.Table) -> pa.Table:
    """The filters of one range merged two by two, as in a tournament; the fingerprints that count more than once."""
    parts = [CountingQuotientFilter.from_bytes(blob.as_py()) for blob in filters.column("filter")]
    while len(parts) > 1:
        parts = [a.merge(b) for a, b in zip(parts[::2], parts[1::2])] + parts[len(parts) & ~1 :]
    fp = parts[0].repeated() | (np.uint64(filters.column("span")[0].as_py()) << np.uint64(parts[0].bits))
    return pa.table({"fp": pa.array((fp ^ np.uint64(1 << 63)).view(np.int64), pa.int64())})


def _bodies(batches):
    """Normalised texts beside the columns that follow."""
    for batch in batches:
        bodies = [normalised(v.as_py()) for v in batch.column(0)]
        yield pa.RecordBatch.from_arrays([pa.array(bodies, pa.binary()), *batch.columns[1:]], names=["body", *batch.schema.names[1:]])


def _members(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Digests of every row, with a number of its own and its key; groups of equal texts, with the row that stays."""
    d = with_python(docs).select(F.col(text).alias("text"), F.col(doc_id).cast("long").alias("doc_id"), *row_key(text))
    kinds = "fp long, text_sha256 string, n_code_points long"
    digests = d.mapInArrow(lambda it: (b.drop_columns(["text"]) for b in _digests(it)), f"{kinds}, doc_id long, _h1 long, _h2 long")
    digests = durable(digests.withColumn("row", F.monotonically_increasing_id()), "digests")
    range_bits = max(1, (digests.count() // PER_RANGE).bit_length())
    filters = digests.select("fp").mapInArrow(lambda it: _build(it, range_bits), "span int, filter binary")
    repeated = hinted(durable(filters.groupBy("span").applyInArrow(_merge, "fp long"), "repeated"), 16)
    # Byte verification: the texts of repeated fingerprints only, each with its own digests, equal ones merged before the shuffle.
    routed = d.select("text").mapInArrow(_digests, f"{kinds}, text string").join(repeated, "fp", "left_semi")
    bodies = routed.select("text", "fp", "text_sha256").mapInArrow(_bodies, "body binary, fp long, text_sha256 string")
    sizes = bodies.groupBy("fp", "text_sha256", "body").agg(F.count("*").alias("group_size")).filter("group_size > 1").drop("body")
    best = F.min(F.struct(-F.col("n_code_points"), F.col("doc_id").isNull(), "doc_id", "_h1", "_h2", "row"))
    first = digests.join(repeated, "fp", "left_semi").groupBy("fp", "text_sha256").agg(best.alias("best"))
    return digests, durable(sizes.join(first, ["fp", "text_sha256"]).select("fp", "text_sha256", "group_size", "best"), "groups")


def duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row of docs."""
    digests, groups = _members(docs, doc_id, text)
    out = salted_join(digests, groups, ["fp", "text_sha256"], "row", "left")
    keep = F.when(F.col("group_size").isNotNull(), F.col("best.doc_id")).otherwise(F.col("doc_id"))
    kept = F.col("group_size").isNull() | (F.col("best.row") == F.col("row"))
    return out.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.coalesce(kept, F.lit(True)).alias("kept"), "text_sha256")


def drop_duplicates(docs: DataFrame) -> DataFrame:
    """docs with one row of each text, the one that `duplicates` keeps."""
    digests, groups = _members(docs, "doc_id", "text")
    d = salted_join(digests, groups, ["fp", "text_sha256"], "row")
    stays = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("_h1") == F.col("best._h1")) & (F.col("_h2") == F.col("best._h2"))
    return one_row_each(docs, durable(d.select("doc_id", "_h1", "_h2", stays.alias("stays")), "members"))


def op8_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return duplicates(table(spark, sf_dir, "documents"))


OP8_SQL = """
with n as (select doc_id, coalesce(text, '') t, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') body from documents)
select doc_id, first_value(doc_id) over w keep_id, count(*) over (partition by body) group_size,
       doc_id = first_value(doc_id) over w kept, sha256(body) text_sha256
from n window w as (partition by body order by length(t) desc, doc_id)
"""
