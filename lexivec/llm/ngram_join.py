r"""N-gram Jaccard join by vertical partitioning.

A document is the set of its word five-grams, each a 64-bit hash; the order of the hashes is the global n-gram order, cut
into fragments of equal width. A fragment holds, of every document, the segment of its set that lies there; what
documents share is counted per fragment and summed per pair.

1. Documents of one set become one representative, so copies meet once.
2. Per fragment: which n-grams do two representatives have? A document whose shared n-grams, summed over the fragments,
   are under 80 % of its set can't be linked. Those left are searched further.
3. Per fragment: exact document frequencies among those. Each document's rarest n-grams, as many as any partner must
   share one of, tie it to the least document that has the n-gram there too. The components of these ties hold all links.
4. Each component has a leader, its least document p. Overlaps with p are counted per fragment and summed; what is left
   over are the n-grams that x lacks of p, and those it adds: its difference D(x). Members linked with p need no pairs.
5. Members not linked with p elect leaders among themselves, in rounds: each is compared with the one lesser open member
   that leads most of its rarest n-grams, if that leads more than a few; who is linked with it, or led, is open no more. The components of the links
   found so far are contracted, so a group of copies around any leader needs no pairs among its members either.
6. A link between x and y of which x is not linked with p needs |D(x) & D(y)| >= s = (a(x) + a(y) - 0.2 |p|) / 1.8, where
   a = 0.8 added + lacking, and then s > a(y) / 1.8 and s >= a(x) - 0.2 |p|, as a(y) >= 0.8 s. So differences are joined by their rarest
   elements in turn: only documents of different components, and only elements that two components have; of an
   element's documents those outside its greatest component meet all. Of two the one of smaller a searches, with the few
   elements that its own a leaves, and what is left of both behind a common element has to suffice; so pages of one
   template that differ too much to be linked hardly meet. The pairs found are counted exactly.
7. Components of the links; copies get their representative's.

So a group whose members are linked emits no pairs, however large, and no link between different sets is lost. (With
s = 0, J(x, y) <= J(x, p).) What remains are pairs of documents of different components that come near the threshold.

Defined results: a text without words, or null, has an empty set and is linked with nothing; with fewer than five words
the whole sequence is the only n-gram; texts of any length are read whole, their segments by fragment; ties of the least
id or of votes go to the smaller id; extra columns are ignored; an empty table gives an empty result. Where a doc_id
repeats or is null, the join is one of distinct sets, each under a number of its own in the order of their least ids, null
last; rows of one set are copies, and a group has the least doc_id of its rows, null if they have none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexivec.llm.common import durable, hinted, one_row_each, row_key, salted_join, table, trim, whole_row, with_python
from lexivec.llm.components import components

WORDS, PERCENT = 5, 80
#: Documents are treated in groups of so many words; n-grams of about so many form a fragment: of all documents where
#: repeated ones are told apart, and of those that are searched further.
GROUP_WORDS, PER_WIDE_FRAGMENT, PER_FRAGMENT = 200_000, 2_000_000, 3_000_000
#: Most rounds of electing leaders (what they leave over meets in pairs), how many documents a leader must lead to be
#: worth a round, of how many led one at least must be linked for another round, and members of a leader that share a task.
ROUNDS, FEW, WORTH, PER_LEADER = 8, 32, 8, 4096

#: Fixed odd multipliers, one per place in an n-gram.
_PLACES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None, size: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of a text's word n-grams."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    if not len(w):
        return w
    n = min(size, len(w))
    h = np.full(len(w) - n + 1, n, np.uint64)
    for k in range(n):
        h += w[k : len(w) - n + 1 + k] * _PLACES[k % len(_PLACES)] + np.uint64(k)
    return np.unique(_mix(h))


def _sketches(batches):
    """Size and digest of the texts' sets, beside the columns but the text, which is the second."""
    for batch in batches:
        sets = [shingles(v.as_py()) for v in batch.column(1)]
        rest, names = [batch.column(0), *batch.columns[2:]], [batch.schema.names[0], *batch.schema.names[2:]]
        yield pa.RecordBatch.from_arrays([rest[0], pa.array([len(s) for s in sets], pa.int64()), pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), *rest[1:]], names=[names[0], "n", "key", *names[1:]])
        del sets
        trim()


def _fragment_of(h: np.ndarray, fragments: int) -> np.ndarray:
    return (((h >> np.uint64(32)) * np.uint64(fragments)) >> np.uint64(32)).astype(np.uint32)


def _by_fragment(owner: np.ndarray, h: np.ndarray, fragments: int):
    """(fragment, owners, hashes) of each fragment that has some."""
    f = _fragment_of(h, fragments)
    order = np.argsort(f, kind="stable")
    f, owner, h = f[order], owner[order], h[order]
    for part in np.split(np.arange(len(f)), np.flatnonzero(np.diff(f)) + 1) if len(f) else []:
        yield int(f[part[0]]), owner[part], h[part]


def _sets(batches):
    """Ids and sets of documents, in groups of about GROUP_WORDS n-grams."""
    for batch in batches:
        ids, sets, held = [], [], 0
        for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1)):
            ids.append(doc_id)
            sets.append(shingles(value.as_py()))
            held += len(sets[-1])
            if held >= GROUP_WORDS:
                yield np.array(ids, np.int64), sets
                ids, sets, held = [], [], 0
        if ids:
            yield np.array(ids, np.int64), sets
        ids, sets = [], []
        trim()


def _segments(batches, fragments: int):
    """One row per group of documents and fragment: ids, set sizes, segment sizes, and the segments one after another."""
    for ids, sets in _sets(batches):
        sizes = np.array([len(s) for s in sets], np.int64)
        out = []
        for f, owner, h in _by_fragment(np.repeat(np.arange(len(sets)), sizes), np.concatenate(sets), fragments):
            own, counts = np.unique(owner, return_counts=True)
            out.append((f, ids[own].tobytes(), sizes[own].astype(np.uint32).tobytes(), counts.astype(np.uint32).tobytes(), h.tobytes()))
        columns = list(zip(*out)) if out else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *[pa.array(c, pa.binary()) for c in columns[1:]]], names=["fragment", "ids", "sizes", "counts", "grams"])


def _occurrences(batches, fragments: int):
    """Rows to tell which n-grams two documents have, n-grams by their lower 32 bits.

    What repeats within a group of documents is settled there: under a negative fragment go the documents' counts of them.
    Each fragment gets the others by document, and those that repeat once, so a frequent one is one entry a group. Two
    n-grams of a fragment may look alike by 32 bits, but equal ones never look different.
    """
    for ids, sets in _sets(batches):
        owner, h = np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.concatenate(sets)
        alike = (_fragment_of(h, fragments).astype(np.uint64) << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF))
        _, first, inverse, n = np.unique(alike, return_index=True, return_inverse=True, return_counts=True)
        twice = n[inverse] > 1
        per = np.bincount(owner[twice], minlength=len(sets))
        held = np.flatnonzero(per)
        group = int(ids[0])
        out = [(-1 - group % fragments, group, ids[held].tobytes(), per[held].astype(np.uint32).tobytes(), b"", b"")]
        once = {f: x.astype(np.uint32) for f, _, x in _by_fragment(first[n > 1], h[first[n > 1]], fragments)}
        for f, own, x in _by_fragment(owner[~twice], h[~twice], fragments):
            docs, counts = np.unique(own, return_counts=True)
            out.append((f, group, ids[docs].tobytes(), counts.astype(np.uint32).tobytes(), x.astype(np.uint32).tobytes(), once.pop(f, np.empty(0, np.uint32)).tobytes()))
        out += [(f, group, b"", b"", b"", x.tobytes()) for f, x in once.items()]
        columns = list(zip(*out))
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int64()), *[pa.array(c, pa.binary()) for c in columns[2:]]], names=["fragment", "grp", "ids", "counts", "grams", "settled"])


_SEGMENT = "fragment int, ids binary, sizes binary, counts binary, grams binary"
_OCCURRENCE = "fragment int, grp long, ids binary, counts binary, grams binary, settled binary"


def _joined(t: pa.Table, column: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_py() for x in t.column(column)), kind)


def _repeated_counts(t: pa.Table) -> pa.Table:
    """Per group of documents, as blobs: their ids, and how many n-grams of their segments occur in a document of another
    group too, or are known to repeat."""
    grams, counts, ids = _joined(t, "grams", np.uint32), _joined(t, "counts", np.uint32), _joined(t, "ids", np.int64)
    if t.column("fragment")[0].as_py() < 0:
        per = counts
    else:
        ordered = np.sort(np.concatenate([grams, _joined(t, "settled", np.uint32)]))
        twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        if len(twice) and len(counts):
            at = np.minimum(np.searchsorted(twice, grams), len(twice) - 1)
            per = np.add.reduceat((twice[at] == grams).astype(np.uint32), np.cumsum(counts, dtype=np.int64) - counts)
        else:
            per = np.zeros(len(counts), np.uint32)
    some = per > 0
    ends = np.cumsum([len(x.as_py()) // 8 for x in t.column("ids")])
    out = [(g, ids[lo:hi][some[lo:hi]].tobytes(), per[lo:hi][some[lo:hi]].astype(np.uint32).tobytes()) for g, lo, hi in zip(t.column("grp").to_pylist(), np.append(0, ends[:-1]).tolist(), ends.tolist()) if some[lo:hi].any()]
    columns = list(zip(*out)) if out else [[]] * 3
    return pa.table({"grp": pa.array(columns[0], pa.int64()), "ids": pa.array(columns[1], pa.binary()), "counts": pa.array(columns[2], pa.binary())})


def _summed_counts(t: pa.Table) -> pa.Table:
    """doc_id, repeated of a group of documents, summed over the fragments."""
    ids, inverse = np.unique(_joined(t, "ids", np.int64), return_inverse=True)
    return pa.table({"doc_id": pa.array(ids), "repeated": pa.array(np.bincount(inverse, _joined(t, "counts", np.uint32), len(ids)).astype(np.int64))})


def _frequencies(t: pa.Table) -> pa.Table:
    """Per document its n-grams of this fragment that two or more have, with their document frequencies."""
    grams, counts, ids, sizes = (_joined(t, c, k) for c, k in (("grams", np.uint64), ("counts", np.uint32), ("ids", np.int64), ("sizes", np.uint32)))
    _, inverse, n = np.unique(grams, return_inverse=True, return_counts=True)
    df = n[inverse].astype(np.uint32)
    ends = np.cumsum(counts, dtype=np.int64)
    out = []
    for doc, size, lo, hi in zip(ids.tolist(), sizes.tolist(), (ends - counts).tolist(), ends.tolist()):
        keep = df[lo:hi] > 1
        if keep.any():
            out.append((doc, size, grams[lo:hi][keep].tobytes(), df[lo:hi][keep].tobytes()))
    columns = list(zip(*out)) if out else [[]] * 4
    return pa.table({"doc_id": pa.array(columns[0], pa.int64()), "n": pa.array(columns[1], pa.int64()), "grams": pa.array(columns[2], pa.binary()), "dfs": pa.array(columns[3], pa.binary())})


def _prefixes(t: pa.Table) -> pa.Table:
    """doc_id, gram of the documents' rarest n-grams: so many that each link shares one."""
    docs = t.column("doc_id").to_numpy()
    order = np.argsort(docs, kind="stable")
    ids, grams = [], []
    for part in np.split(order, np.flatnonzero(np.diff(docs[order])) + 1):
        rows = t.take(pa.array(part))
        g, df = _joined(rows, "grams", np.uint64), _joined(rows, "dfs", np.uint32)
        n = rows.column("n")[0].as_py()
        # The n-grams of this document alone come first in the order, and match nothing.
        take = n - -(-PERCENT * n // 100) + 1 - (n - len(g))
        if take > 0:
            chosen = g[np.lexsort((g, df))[:take]]
            grams.append(chosen)
            ids.append(np.full(len(chosen), docs[part[0]]))
    both = [np.concatenate(x) if x else np.empty(0, k) for x, k in ((ids, np.int64), (grams, np.uint64))]
    return pa.table({"doc_id": pa.array(both[0].astype(np.int64)), "gram": pa.array(both[1].view(np.int64))})


def _exploded_segments(batches):
    """Per document and fragment: doc_id, fragment, n, grams (sorted)."""
    for batch in batches:
        out = []
        for f, ids, sizes, counts, grams in zip(*[c.to_pylist() for c in batch.columns]):
            ends = np.cumsum(c := np.frombuffer(counts, np.uint32), dtype=np.int64)
            out += [(f, d, n, grams[8 * lo : 8 * hi]) for d, n, lo, hi in zip(np.frombuffer(ids, np.int64).tolist(), np.frombuffer(sizes, np.uint32).tolist(), (ends - c).tolist(), ends.tolist())]
        columns = list(zip(*out)) if out else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.binary()))], names=["fragment", "doc_id", "n", "grams"])


def _differences(batches):
    """Per document and fragment: n-grams shared with the leader, and the difference; lacking elements are odd, added ones even."""
    for batch in batches:
        out = []
        for mine, theirs in zip(*[c.to_pylist() for c in batch.columns[3:]]):
            x, p = np.frombuffer(mine or b"", np.uint64), np.frombuffer(theirs or b"", np.uint64)
            more, less = np.setdiff1d(x, p, assume_unique=True), np.setdiff1d(p, x, assume_unique=True)
            out.append((len(x) - len(more), len(more), len(less), np.concatenate([more & ~np.uint64(1), less | np.uint64(1)]).tobytes()))
        columns = list(zip(*out)) if out else [[]] * 4
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], *[pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.binary()))]], names=["doc_id", "leader", "n", "shared", "added", "lacking", "diff"])


def _overlaps(batches):
    """Of two segments, the last columns, how many n-grams they share."""
    for batch in batches:
        n = [len(np.intersect1d(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), assume_unique=True)) for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(n, pa.int64())], names=["doc_id", "leader", "shared"])


def _elements(batches):
    for batch in batches:
        blobs = [np.frombuffer(b.as_py(), np.int64) for b in batch.column(2)]
        at = np.repeat(np.arange(len(blobs)), [len(b) for b in blobs])
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), pa.array(np.concatenate(blobs) if blobs else np.empty(0, np.int64))], names=["doc_id", "leader", "element"])


def _common(batches):
    """x, y and how many elements their differences share, summed over the fragments."""
    for batch in batches:
        n = []
        for mine, theirs in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            other = {d["fragment"]: d["diff"] for d in theirs}
            n.append(sum(len(np.intersect1d(np.frombuffer(d["diff"], np.int64), np.frombuffer(other.get(d["fragment"], b""), np.int64), assume_unique=True)) for d in mine))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], names=["x", "y", "common"])


def _is_link(shared, one, other):
    return 100 * shared >= PERCENT * (one + other - shared)


_SKETCH = "doc_id long, n long, key binary"


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, n (size of its set), key (digest of its set), _h1, _h2 (key of its text); a written table."""
    return durable(docs.select("doc_id", "text", *row_key()).mapInArrow(_sketches, f"{_SKETCH}, _h1 long, _h2 long"), "sketches")


def representatives(sketch: DataFrame) -> DataFrame:
    """doc_id, n, rep (least document of the same set); a written table."""
    many = sketch.filter("n > 0").groupBy("key", "n").agg(F.min("doc_id").alias("rep"), F.count("*").alias("c")).filter("c > 1").drop("c")
    d = salted_join(sketch.select("doc_id", "n", "key"), durable(many, "sets"), ["key", "n"], "doc_id", "left")
    return durable(d.select("doc_id", "n", F.coalesce("rep", "doc_id").alias("rep")), "representatives")


def _ids_suffice(sketch: DataFrame) -> bool:
    """Whether no doc_id repeats or is null."""
    return sketch.groupBy("doc_id").count().filter("count > 1 or doc_id is null").isEmpty()


def _only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs with these ids."""
    return docs.join(hinted(ids.select(F.col("doc_id").alias("_id")), 16), F.col("doc_id") == F.col("_id"), "left_semi")


def _dealt_by_leader(pairs: DataFrame) -> DataFrame:
    """pairs (doc_id, leader) with salts, and one of them for each row: a leader of many is copied to as many tasks."""
    sizes = pairs.groupBy("leader").agg(F.ceil(F.count("*") / F.lit(PER_LEADER)).cast("int").alias("salts")).filter("salts > 1")
    d = pairs.join(hinted(durable(sizes, "leaders_of_many"), 16), "leader", "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
    return d.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.col("salts")).cast("int"))


def _leader_segments(dealt: DataFrame, parts: DataFrame) -> DataFrame:
    """fragment, leader, salt, leader_grams: the leaders' segments, once for each salt."""
    p = dealt.select("leader", "salts").distinct().join(parts.select(F.col("doc_id").alias("leader"), "fragment", F.col("grams").alias("leader_grams")), "leader")
    return p.select("fragment", "leader", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "leader_grams")


def _links_in_rounds(parts: DataFrame, rare: DataFrame, sums: DataFrame) -> DataFrame | None:
    """u, v: links among documents that are not linked with their group's leader, found by electing leaders in rounds.

    None if there is no leader of many.
    """
    left = durable(sums.filter(~_is_link(F.col("shared"), F.col("n"), F.col("leader_n"))).select("doc_id", "n"), "open")
    sizes, found, mine = left, None, rare
    for _ in range(ROUNDS):
        # Only the open members' n-grams, which get fewer from round to round.
        mine = durable(_only(mine, left), "open_grams")
        least = mine.groupBy("gram").agg(F.min("doc_id").alias("leader"), F.count("*").alias("c")).filter("c > 1").drop("c")
        votes = mine.join(least, "gram").filter("doc_id != leader").groupBy("doc_id", "leader").agg(F.count("*").alias("votes"))
        led = durable(votes.groupBy("doc_id").agg(F.max_by("leader", F.struct("votes", -F.col("leader"))).alias("leader")), "led")
        # Those of a leader of few may meet in pairs: that is a bounded number for each of them.
        many = led.groupBy("leader").agg(F.count("*").alias("c")).filter(F.col("c") > FEW).select("leader")
        led = durable(led.join(hinted(durable(many, "leaders"), 16), "leader", "left_semi").select("doc_id", "leader"), "led_by_leaders_of_many")
        if led.isEmpty():
            break
        dealt = _dealt_by_leader(led)
        both = dealt.join(parts.select("doc_id", "fragment", "grams"), "doc_id").join(_leader_segments(dealt, parts), ["fragment", "leader", "salt"])
        shared = both.select("doc_id", "leader", "grams", "leader_grams").mapInArrow(_overlaps, "doc_id long, leader long, shared long")
        shared = shared.groupBy("doc_id", "leader").agg(F.sum("shared").alias("shared"))
        d = shared.join(sizes, "doc_id").join(sizes.select(F.col("doc_id").alias("leader"), F.col("n").alias("leader_n")), "leader")
        linked = durable(d.filter(_is_link(F.col("shared"), F.col("n"), F.col("leader_n"))).select(F.col("doc_id").alias("u"), F.col("leader").alias("v")), "round")
        found = linked if found is None else found.union(linked)
        # Where leaders of many are linked with few, there are no groups of copies left that would make many pairs.
        if linked.count() * WORTH < led.count():
            break
        done = linked.select(F.col("u").alias("doc_id")).union(led.select(F.col("leader").alias("doc_id")))
        left = durable(led.select("doc_id").join(done, "doc_id", "left_anti"), "open")
    return found


def _links_by_difference(diffs: DataFrame, sums: DataFrame, so_far: DataFrame | None) -> DataFrame:
    """Links x, y beside those with the leader and those so far. diffs: per document and fragment; sums: per document."""
    tenth = 10  # a and its bounds in tenths, as whole numbers
    s = sums.withColumn("a10", 8 * F.col("added") + tenth * F.col("lacking")).withColumn("size", F.col("added") + F.col("lacking"))
    s = s.withColumn("linked", _is_link(F.col("shared"), F.col("n"), F.col("leader_n")))
    apart = F.ceil((F.col("a10") - 2 * F.col("leader_n")) / F.lit(10.0))
    s = s.withColumn("least", F.greatest(F.lit(1), F.when(F.col("linked"), F.ceil(F.col("a10") / F.lit(18.0))).otherwise(apart)).cast("long"))
    # A leader whose members are all linked with it needs no more.
    open_leaders = s.filter("not linked").select("leader").distinct()
    s = s.join(open_leaders, "leader", "left_semi").filter("size >= least")
    # Members linked with the leader are one component; the others have that of their links so far, or their own.
    if so_far is None:
        s = s.withColumn("root", F.col("doc_id"))
    else:
        roots = durable(components(so_far).select(F.col("node").alias("doc_id"), "root"), "roots_so_far")
        s = s.join(hinted(roots, 24), "doc_id", "left")
    s = s.withColumn("part", F.when(F.col("linked"), F.col("leader")).otherwise(F.coalesce("root", "doc_id"))).drop("root")
    s = durable(s, "members")
    e = diffs.select("doc_id", "leader", "diff").join(s.select("doc_id"), "doc_id", "left_semi").mapInArrow(_elements, "doc_id long, leader long, element long")
    e = durable(e.join(s.select("doc_id", "part"), "doc_id"), "elements")
    # Elements of one component alone are in no difference that another component shares.
    df = e.groupBy("leader", "element").agg(F.count("*").alias("df"), F.min("part").alias("lo"), F.max("part").alias("hi")).filter("lo < hi").drop("lo", "hi")
    e = e.join(df, ["leader", "element"])
    # The others come first in the order of rarity: they only use up places. Of a pair, that with the smaller a (then id)
    # searches with few elements: both a are at least its own, so s >= (2 a - 0.2 |p|) / 1.8. The larger offers those for
    # which the smaller may have any a.
    odd = F.col("element").bitwiseAND(F.lit(1).cast("long"))
    e = e.withColumn("k", F.row_number().over(_by_rarity())).join(e.groupBy("doc_id").agg(F.count("*").alias("shared_size"), F.sum(odd).alias("shared_lacking")), "doc_id")
    e = e.join(s.select("doc_id", "a10", "size", "least", "leader_n", "linked"), "doc_id")
    # How many of the difference come after the element in that order.
    e = e.withColumn("after", F.col("shared_size") - F.col("k"))
    few = F.greatest(F.col("least"), F.ceil((2 * F.col("a10") - 2 * F.col("leader_n")) / F.lit(18.0)))
    e = e.filter(F.col("after") + 1 >= F.col("least")).withColumn("searches", F.col("after") + 1 >= few)
    e = durable(e.select("leader", "element", "doc_id", "part", "linked", "a10", "after", "searches", (F.col("shared_size") - F.col("shared_lacking")).alias("more"), F.col("shared_lacking").alias("less"), "leader_n"), "rarest")
    # Any two components differ from an element's greatest one, or one of them is it: documents outside it meet all.
    per = e.groupBy("leader", "element", "part").agg(F.count("*").alias("c"))
    great = per.groupBy("leader", "element").agg(F.max_by("part", F.struct("c", "part")).alias("great"), F.count("*").alias("parts")).filter("parts > 1").drop("parts")
    e = durable(e.join(great, ["leader", "element"]).withColumn("inside", F.col("part") == F.col("great")).drop("great"), "rarest_shared")
    x = e.filter("searches").select("leader", "element", "inside", F.col("doc_id").alias("x"), F.col("part").alias("x_part"), F.col("a10").alias("xa"), F.col("after").alias("x_after"), F.col("more").alias("x_more"), F.col("less").alias("x_less"), "leader_n")
    # Were the larger linked with the leader, both would be.
    y = e.filter("not linked").select(F.col("leader").alias("_l"), F.col("element").alias("_e"), F.col("inside").alias("_inside"), F.col("doc_id").alias("y"), F.col("part").alias("y_part"), F.col("a10").alias("ya"), F.col("after").alias("y_after"), F.col("more").alias("y_more"), F.col("less").alias("y_less"))
    # What two must share has to fit into the elements of either kind that each shares with another component, and after
    # their first common element into what either has left; the bounds are part of the join's condition, so pairs beyond
    # them don't arise.
    fits = F.expr("""x_part != y_part and struct(xa, x) < struct(ya, y) and xa + ya - 2 * leader_n <= 18 * (least(x_more, y_more) + least(x_less, y_less))
        and xa + ya - 2 * leader_n <= 18 * (1 + least(x_after, y_after))""")
    met = lambda some, others: some.join(others, (F.col("leader") == F.col("_l")) & (F.col("element") == F.col("_e")) & fits)
    pairs = met(x.filter("not inside"), y).union(met(x.filter("inside"), y.filter("not _inside")))
    pairs = durable(pairs.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct(), "pairs")
    whole = diffs.join(pairs.select(F.explode(F.array("x", "y")).alias("doc_id")).distinct(), "doc_id", "left_semi")
    whole = durable(whole.groupBy("doc_id").agg(F.collect_list(F.struct("fragment", "diff")).alias("parts")), "whole_differences")
    part = lambda name: whole.select(F.col("doc_id").alias(name), F.col("parts").alias(f"{name}_parts"))
    both = pairs.join(part("x"), "x").join(part("y"), "y").select("x", "y", "x_parts", "y_parts")
    common = both.mapInArrow(_common, "x long, y long, common long")
    m = lambda name: s.select(F.col("doc_id").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in ("n", "lacking", "leader_n")])
    d = common.join(m("x"), "x").join(m("y").drop("y_leader_n"), "y")
    shared = F.col("x_leader_n") - F.col("x_lacking") - F.col("y_lacking") + F.col("common")
    return d.filter(_is_link(shared, F.col("x_n"), F.col("y_n"))).select(F.col("x").alias("u"), F.col("y").alias("v"))


def _trimmed(of_group):
    """The function of a group, after which its worker gives memory back."""

    def run(t: pa.Table) -> pa.Table:
        out = of_group(t)
        trim()
        return out

    return run


def _by_rarity():
    from pyspark.sql import Window

    return Window.partitionBy("doc_id").orderBy("df", "element")


def links(docs: DataFrame, reps: DataFrame) -> DataFrame:
    """u, v: links between representatives, enough of them that their components are those of all links."""
    total = reps.filter("doc_id = rep").agg(F.sum("n")).first()[0] or 0
    wide = max(8, -(-total // PER_WIDE_FRAGMENT))
    mine = docs.select("doc_id", "text")
    others = reps.filter("doc_id != rep or n = 0").select(F.col("doc_id").alias("_id"))
    first = mine.join(hinted(others, 16), F.col("doc_id") == F.col("_id"), "left_anti")
    seen = first.mapInArrow(lambda it: _occurrences(it, wide), _OCCURRENCE)
    rep = seen.groupBy("fragment").applyInArrow(_trimmed(_repeated_counts), "grp long, ids binary, counts binary")
    rep = rep.groupBy("grp").applyInArrow(_summed_counts, "doc_id long, repeated long")
    left = durable(rep.join(reps.select("doc_id", "n"), "doc_id").filter(100 * F.col("repeated") >= PERCENT * F.col("n")).select("doc_id", "n"), "searched")
    count, searched = left.agg(F.count("*"), F.sum("n")).first()
    fragments = max(8, -(-(searched or 0) // PER_FRAGMENT))
    seg = durable(_only(mine, left).mapInArrow(lambda it: _segments(it, fragments), _SEGMENT), "segments")
    freq = seg.groupBy("fragment").applyInArrow(_trimmed(_frequencies), "doc_id long, n long, grams binary, dfs binary")
    buckets = max(32, count // 2000)
    rare = freq.groupBy(F.pmod(F.xxhash64("doc_id"), F.lit(buckets))).applyInArrow(_trimmed(_prefixes), "doc_id long, gram long")
    rare = durable(rare, "rare")
    least = rare.groupBy("gram").agg(F.min("doc_id").alias("v"), F.count("*").alias("c")).filter("c > 1").select("gram", "v")
    ties = rare.join(least, "gram").filter("doc_id != v").select(F.col("doc_id").alias("u"), "v").distinct()
    groups = durable(components(ties).select(F.col("node").alias("doc_id"), F.col("root").alias("leader")), "groups")
    parts = seg.mapInArrow(_exploded_segments, "fragment int, doc_id long, n long, grams binary")
    parts = durable(parts.join(hinted(groups, 24), "doc_id"), "parts")
    x = parts.filter("doc_id != leader")
    # A document may have nothing in a fragment where its leader has, and the other way round.
    dealt = durable(_dealt_by_leader(groups.filter("doc_id != leader")), "dealt")
    every = dealt.join(hinted(left, 24), "doc_id").select("doc_id", "leader", "salt", "n", F.explode(F.sequence(F.lit(0), F.lit(fragments - 1))).alias("fragment"))
    d = every.join(x.select("fragment", "doc_id", "grams"), ["fragment", "doc_id"], "left").join(_leader_segments(dealt, parts), ["fragment", "leader", "salt"], "left")
    d = d.select("doc_id", "leader", "n", "grams", "leader_grams", "fragment")
    diffs = d.select("doc_id", "leader", F.struct("n", "fragment").alias("n"), "grams", "leader_grams").mapInArrow(_differences, "doc_id long, leader long, n struct<n:long,fragment:int>, shared long, added long, lacking long, diff binary")
    diffs = durable(diffs.select("doc_id", "leader", "n.n", "n.fragment", "shared", "added", "lacking", "diff"), "differences")
    sums = diffs.groupBy("doc_id", "leader", "n").agg(F.sum("shared").alias("shared"), F.sum("added").alias("added"), F.sum("lacking").alias("lacking"))
    sums = durable(sums.withColumn("leader_n", F.col("shared") + F.col("lacking")), "sums")
    to_leader = sums.filter(_is_link(F.col("shared"), F.col("n"), F.col("leader_n"))).select(F.col("doc_id").alias("u"), F.col("leader").alias("v"))
    elected = _links_in_rounds(parts, rare, sums)
    found = to_leader if elected is None else to_leader.union(elected)
    return found.union(_links_by_difference(diffs, sums, elected))


def _rows(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) as the join reads them."""
    return with_python(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _classes(d: DataFrame, sketch: DataFrame) -> DataFrame:
    """Classes of documents whose ids are unique and not null."""
    reps = representatives(sketch)
    roots = durable(components(links(d, reps)), "roots")
    out = reps.join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "rep").alias("component_id"))


def _set_classes(d: DataFrame, sketch: DataFrame) -> DataFrame:
    """Every row of sketch with n_shingles, component_id and root, the number of its group's first set; for any ids."""
    sets = sketch.filter("n > 0").groupBy("key", "n").agg(F.min("doc_id").alias("least"))
    sets = durable(sets.orderBy(F.col("least").asc_nulls_last(), "key").withColumn("node", F.monotonically_increasing_id()), "sets")
    keyed = d.select("doc_id", "text", "text").toDF("doc_id", "_t", "text").mapInArrow(_sketches, f"{_SKETCH}, text string").filter("n > 0")
    texts = keyed.groupBy("key", "n").agg(F.min("text").alias("text"))
    clean = durable(texts.join(sets, ["key", "n"]).select(F.col("node").alias("doc_id"), "text"), "one_of_each_set")
    reps = sets.select(F.col("node").alias("doc_id"), "n", F.col("node").alias("rep"))
    roots = durable(components(links(clean, reps)), "roots")
    named = sets.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = named.join(sets.select(F.col("node").alias("root"), F.col("least").alias("component_id")), "root").select("key", "n", "root", "component_id")
    out = sketch.join(named, ["key", "n"], "left")
    own = F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), "root", "_h1", "_h2")


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs (doc_id, text)."""
    d = _rows(docs)
    sketch = sketches(d)
    if _ids_suffice(sketch):
        return _classes(d, sketch)
    return _set_classes(d, sketch).select("doc_id", "n_shingles", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs without the rows that an earlier document of their group stands for."""
    d = _rows(docs)
    sketch = sketches(d)
    if _ids_suffice(sketch):
        gone = durable(_classes(d, sketch).filter("doc_id != component_id").select(F.col("doc_id").alias("_gone")), "near_copies")
        rows = docs.select(whole_row(docs), F.col("doc_id").cast("long").alias("id"))
        return rows.join(hinted(gone, 16), F.col("id") == F.col("_gone"), "left_anti").select("row.*")
    members = durable(_set_classes(d, sketch).filter("root is not null"), "members")
    first = members.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_h1", "_h2")).alias("first"))
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("_h1") == F.col("first._h1")) & (F.col("_h2") == F.col("first._h2"))
    return one_row_each(docs, durable(members.join(first, "root").select("doc_id", "_h1", "_h2", stays.alias("stays")), "near_copies"))


def op10_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))
