"""Which of many literals a text has: one Aho-Corasick automaton for all of them, run over Arrow's string buffers.

The automaton is a table of whole transitions, built once on the driver. A batch's texts are cut into lanes of equal length,
each begun a literal's length early, and all lanes take a step at a time, so a step is a few array operations for
thousands of places at once. What a text has is a set of bits beside it; patterns then run only where a literal that they
need was seen.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexivec.compat import ship_package

#: Bytes of a lane, besides its early begin.
LANE = 1_024
BITS = 64


class Automaton:
    """The literals' automaton. Literals are in lower case; A-Z of a text count as a-z."""

    def __init__(self, literals: tuple[str, ...]):
        words = [w.encode() for w in literals]
        used = sorted({b for w in words for b in w})
        self.kinds = np.zeros(256, np.int32)
        for k, b in enumerate(used):
            self.kinds[b] = k + 1
        for b in range(ord("A"), ord("Z") + 1):
            self.kinds[b] = self.kinds[b + 32]
        width = len(used) + 1
        goto, out = [[-1] * width], [0]
        for k, w in enumerate(words):
            state = 0
            for b in w:
                c = int(self.kinds[b])
                if goto[state][c] < 0:
                    goto[state][c] = len(goto)
                    goto.append([-1] * width)
                    out.append(0)
                state = goto[state][c]
            out[state] |= 1 << k
        # Breadth first: where a state has no way on, that of its longest proper suffix holds, which is known already.
        suffix, queue = [0] * len(goto), deque([0])
        while queue:
            state = queue.popleft()
            for c in range(width):
                to = goto[state][c]
                back = 0 if state == 0 else goto[suffix[state]][c]
                if to < 0:
                    goto[state][c] = back
                else:
                    suffix[to] = back
                    out[to] |= out[back]
                    queue.append(to)
        # States that end a literal come last, so that one comparison finds them.
        order = sorted(range(len(goto)), key=lambda s: out[s] != 0)
        place = np.empty(len(goto), np.int32)
        place[order] = np.arange(len(goto), dtype=np.int32)
        self.steps = (place[np.array([goto[s] for s in order])] * width).astype(np.int32).ravel()
        self.start, self.width = int(place[0]) * width, width
        self.first_end = (len(goto) - sum(x != 0 for x in out)) * width
        self.longs = max(1, -(-len(words) // BITS))
        split = lambda x: [(x >> (BITS * k)) & (2**BITS - 1) for k in range(self.longs)]
        self.out = np.array([split(out[s]) for s in order], np.uint64)
        self.longest = max(map(len, words), default=1)

    def scan(self, texts: pa.Array) -> np.ndarray:
        """For each text its bits, as rows of `longs` numbers; a null text has none."""
        found = np.zeros((len(texts), self.longs), np.uint64)
        wide = pa.types.is_large_string(texts.type)
        _, at, data = texts.buffers()
        if data is None or not len(texts):
            return found
        ends = np.frombuffer(at, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        raw = np.frombuffer(data, np.uint8)
        size = np.diff(ends)
        if texts.null_count:
            size = np.where(texts.is_null().to_numpy(zero_copy_only=False), 0, size)
        lanes = -(-size // LANE)
        text = np.repeat(np.arange(len(texts)), lanes)
        number = np.arange(len(text)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        early = np.where(number > 0, self.longest - 1, 0)
        early = np.minimum(early, number * LANE)
        first = ends[:-1][text] + number * LANE - early
        length = np.minimum(size[text] - number * LANE, LANE) + early
        order = np.argsort(-length, kind="stable")
        text, first, length = text[order], first[order], length[order]
        # How many lanes are as long as each step asks for; the others have ended.
        live = np.searchsorted(-length, -np.arange(1, (length[0] if len(length) else 0) + 1), side="right")
        state = np.full(len(text), self.start, np.int32)
        who, what = [], []
        for step, n in enumerate(live.tolist()):
            state[:n] = self.steps[state[:n] + self.kinds[raw[first[:n] + step]]]
            hit = np.flatnonzero(state[:n] >= self.first_end)
            if len(hit):
                who.append(text[hit])
                what.append(state[hit] // self.width)
        if who:
            pair = np.unique(np.concatenate(who) * len(self.out) + np.concatenate(what))
            np.bitwise_or.at(found, pair // len(self.out), self.out[pair % len(self.out)])
        return found


class Seen:
    """Stands for a text where literals are looked for: tells by its bits which of them the text has."""

    def __init__(self, column: str, literals: tuple[str, ...]):
        self.column, self.place = F.col(column), {w: k for k, w in enumerate(literals)}

    def any(self, literals) -> Column:
        """Whether the text has one of the literals at least."""
        masks: dict[int, int] = {}
        for w in literals:
            k = self.place[w]
            masks[k // BITS] = masks.get(k // BITS, 0) | 1 << k % BITS
        signed = lambda m: m - 2**BITS if m >= 2 ** (BITS - 1) else m
        out = None
        for k, m in sorted(masks.items()):
            one = F.get(self.column, F.lit(k)).bitwiseAND(F.lit(signed(m)).cast("long")) != 0
            out = one if out is None else out | one
        return F.lit(False) if out is None else out


def with_seen(df: DataFrame, text: Column, literals, to: str = "_seen") -> tuple[DataFrame, Seen]:
    """df with array<bigint> `to`, the literals that the text has, and what tells them apart."""
    literals = tuple(dict.fromkeys(literals))
    ship_package(df.sparkSession)
    automaton = Automaton(literals)

    @F.arrow_udf("array<bigint>")
    def bits(texts: pa.Array) -> pa.Array:
        rows = automaton.scan(texts).astype(np.uint64).view(np.int64)
        # Offsets may hold nulls, which make the list null; the last one may not.
        null = np.append(texts.is_null().to_numpy(zero_copy_only=False), False) if texts.null_count else None
        starts = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * automaton.longs, mask=null)
        return pa.ListArray.from_arrays(starts, pa.array(rows.ravel()))

    return df.withColumn(to, bits(text)), Seen(to, literals)
