"""Best-fit packing by exact complements.

Documents become token ids with a closing id each; those over the sequence length are cut, the odd piece first. Only the
counts of pieces per length reach the plan. An index holds the sums of single lengths, pairs and triples; the gap that a
piece leaves is looked up there, and each combination that fills it exactly is consumed as often as the counts allow. What
then remains is packed best-fit decreasing, by counts too. Index and plan are bounded by the sequence length (half a million
entries for 1024), not by the corpus. Each piece then finds its slot by its number among the pieces of its length.

Defined results: a null text is empty, so its only piece is the closing id; a very long text is cut into as many pieces as
it needs; rows that repeat, null ids and pieces of equal length (ties) are packed each, by id, piece and ids; extra columns
are ignored; an empty table gives an empty result. Ids come from `tiktoken` with the vocabulary's ranks and the
added tokens of the `tokenizers` file beside it, which equals that library's result: a text is cut at added tokens, each
of which is one id, and what lies between them is encoded on its own.
"""

from __future__ import annotations

import base64
import json
import sys
import zlib
from array import array
from collections import Counter, defaultdict
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexivec.llm.common import durable, hinted, table, with_python

LENGTH, CLOSING_ID = 1024, 2
#: Salts of the numbering within a length, so that a frequent length is numbered by many tasks: at least so many, and
#: more for more pieces, one for about PER_SALT.
SALTS, PER_SALT = 64, 1_000_000


def added_tokens(ranks_path: str) -> dict[str, int]:
    """Added tokens of the tokenizer's json beside the ranks; none if there is no such file."""
    path = Path(ranks_path).with_suffix(".json")
    return {t["content"]: t["id"] for t in json.loads(path.read_text(encoding="utf-8"))["added_tokens"]} if path.exists() else {}


class Encoder:
    """Ids of texts by a vocabulary's ranks and its added tokens."""

    def __init__(self, ranks_path: str, pattern: str):
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens=added_tokens(ranks_path))

    def encode(self, text: str) -> array:
        return array("I", self.encoding.encode(text, allowed_special="all"))


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def _encoder(ranks_path: str | None) -> Encoder:
    import public_tokenizers

    key = (ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(*key)
    return _ENCODERS[key]


def cut(n_ids: int, length: int = LENGTH) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole sequences, and before them what is left over."""
    head = n_ids % length or min(n_ids, length)
    return [(0, head)] + [(s, length) for s in range(head, n_ids, length)]


def _piece_rows(batches, ranks_path: str | None, length: int):
    encoder = _encoder(ranks_path)
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    for batch in batches:
        rows: list[tuple] = []
        for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1)):
            ids = encoder.encode(value.as_py() or "")
            ids.append(CLOSING_ID)
            if sys.byteorder == "big":
                ids.byteswap()
            view = memoryview(ids).cast("B")
            for k, (start, n) in enumerate(cut(len(ids), length)):
                rows.append((doc_id, k, start, n, zlib.crc32(view[4 * start : 4 * (start + n)])))
        columns = zip(*rows) if rows else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=names)


def pieces(docs: DataFrame, ranks_path: str | None = None, length: int = LENGTH) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of docs."""
    d = with_python(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return d.mapInArrow(lambda it: _piece_rows(it, ranks_path, length), "doc_id long, piece int, start long, length long, ids_crc32 long")


class SumIndex:
    """Counts of pieces per length, and an index of the sums of one, two and three of these lengths.

    `pairs` has, for each sum, the pairs (a, b) with a >= b, greatest a first; `triples` the lengths a whose partners make a
    pair of what a leaves, none longer than a. Lengths only run out, so a combination that is passed over as it needs one
    that has run out never comes back, and each sum's list is read once: from where the last search of it stopped.
    """

    def __init__(self, counts: dict[int, int], length: int):
        self.counts = Counter({k: v for k, v in counts.items() if v > 0})
        lengths = sorted(self.counts, reverse=True)
        self.pairs: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.triples: dict[int, list[int]] = defaultdict(list)
        for i, a in enumerate(lengths):
            for b in lengths[i:]:
                if a + b < length:
                    self.pairs[a + b].append((a, b))
        for rest, found in self.pairs.items():
            least = found[-1][0]
            for a in lengths:
                if a < least:
                    break
                if a + rest < length:
                    self.triples[a + rest].append(a)
        for found in self.triples.values():
            found.sort(reverse=True)

    def times(self, lengths: tuple[int, ...]) -> int:
        """How often the lengths can be taken together."""
        return min(self.counts[k] // n for k, n in Counter(lengths).items())

    def take(self, lengths: tuple[int, ...], times: int) -> None:
        for k in lengths:
            self.counts[k] -= times

    def _pairs_of(self, total: int, most: int):
        for a, b in self.pairs.get(total, ()):
            if a <= most and self.counts[a] and self.counts[b]:
                yield a, b

    def combinations(self, gap: int, parts: int):
        """Combinations of so many lengths that sum to the gap, of what is left, longest first."""
        if parts == 1:
            if self.counts[gap]:
                yield (gap,)
        elif parts == 2:
            yield from self._pairs_of(gap, gap)
        else:
            for a in self.triples.get(gap, ()):
                if self.counts[a]:
                    for pair in self._pairs_of(gap - a, a):
                        yield (a, *pair)


def exact_fills(index: SumIndex, length: int, over: int = 0) -> list[tuple[tuple[int, ...], int]]:
    """Sequences that are filled exactly: the gap of each piece longer than `over`, longest first, is looked up in the index
    and each combination found consumed as often as the counts allow; those of fewer parts for all pieces first."""
    out = []
    if index.counts[length]:
        out.append(((length,), index.counts[length]))
        index.take((length,), index.counts[length])
    for parts in (1, 2, 3):
        for first in sorted((k for k, n in index.counts.items() if n > 0 and k > over), reverse=True):
            if index.counts[first] <= 0:
                continue
            for found in index.combinations(length - first, parts):
                together = (first, *found)
                if times := index.times(together):
                    index.take(together, times)
                    out.append((together, times))
                    if not index.counts[first]:
                        break
    return out


def best_fit(counts: dict[int, int], length: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, decreasing: open sequences by the room that they leave, alike ones counted together."""
    rooms: Counter = Counter()
    for n in sorted(counts, reverse=True):
        have = counts[n]
        while have > 0:
            fits = min(((room, kept) for room, kept in rooms if room >= n), default=None)
            if fits:
                room, kept = fits
                times = min(have, rooms[fits])
                rooms[fits] -= times
                if not rooms[fits]:
                    del rooms[fits]
                rooms[room - n, (*kept, n)] += times
                have -= times
            elif have >= (each := length // n):
                rooms[length - each * n, (n,) * each] += have // each
                have %= each
            else:
                rooms[length - have * n, (n,) * have] += 1
                have = 0
    return [(kept, times) for (_, kept), times in rooms.items()]


def plan(counts: dict[int, int], length: int = LENGTH) -> list[tuple[tuple[int, ...], int]]:
    """(lengths packed together, how many sequences) of all pieces, given their counts per length.

    Combinations for pieces with wide gaps spend short pieces that narrow gaps miss at the end. So the plan is made with
    exact fills of all pieces, and of those over some shares of the length only; of the plans the one of fewest sequences
    holds, of equal ones that with the most exact fills.
    """
    index, plans = SumIndex(counts, length), []
    for eighths in (0, 4, 5, 6, 7):
        index.counts = Counter({k: v for k, v in counts.items() if v > 0})
        filled = exact_fills(index, length, eighths * length // 8)
        plans.append(filled + best_fit(+index.counts, length))
    return min(plans, key=lambda p: sum(n for _, n in p))


def slots(planned: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first number, next number, first sequence, offset): which pieces of a length sit where."""
    used: Counter = Counter()
    out, sequence = [], 0
    for lengths, times in planned:
        offset = 0
        for n in lengths:
            out.append((n, used[n], used[n] + times, sequence, offset))
            used[n] += times
            offset += n
        sequence += times
    return out


def pack(docs: DataFrame, ranks_path: str | None = None, length: int = LENGTH) -> DataFrame:
    """The pieces of docs with sequence_id and offset."""
    spark = docs.sparkSession
    d = durable(pieces(docs, ranks_path, length), "pieces")
    salt = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(max(SALTS, d.count() // PER_SALT)))
    per_salt = d.groupBy("length", salt.alias("salt")).count()
    # A row per length and salt; their sums over lengths, at most `length` numbers, are what the plan needs.
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = durable(per_salt.withColumn("base", F.coalesce(F.sum("count").over(before), F.lit(0))), "starts")
    counts = {r["length"]: r["n"] for r in starts.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    rows = slots(plan(counts, length))
    schema = "length long, lo long, hi long, sequence long, offset long"
    where = spark.createDataFrame(rows, schema) if rows else spark.createDataFrame([], schema)
    number = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    d = d.withColumn("salt", salt).withColumn("k", F.row_number().over(number) - 1)
    d = d.join(hinted(starts.drop("count"), 24), ["length", "salt"]).withColumn("k", F.col("k") + F.col("base"))
    # Slots of a length lie in order and without gaps; each piece finds its own in its length's list of first numbers.
    lists = where.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("lo", "hi", "sequence", "offset"))).alias("slots"))
    d = d.join(F.broadcast(lists), "length")
    mine = F.element_at(F.filter("slots", lambda s: (s["lo"] <= F.col("k")) & (F.col("k") < s["hi"])), 1)
    d = d.withColumn("slot", mine)
    return d.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("slot.sequence") + F.col("k") - F.col("slot.lo")).alias("sequence_id"), F.col("slot.offset").alias("offset"))


def op9_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
