"""Merkle manifest: a plain tree on hard rows, several tiers, empty tables."""

import hashlib
import random
import zlib
from collections import Counter

import pytest

from lexivec.llm import merkle as M

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, root string"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def climbed(nodes):
    """The top of a list of nodes, and of each node its siblings with their side (True: left)."""
    at, ways = list(range(len(nodes))), [[] for _ in nodes]
    while len(nodes) > 1:
        for k, i in enumerate(at):
            pair = nodes[i // 2 * 2 : i // 2 * 2 + 2]
            ways[k].append((pair[1 - i % 2] if len(pair) == 2 else "", i % 2 == 1))
        nodes, at = [H(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)], [i // 2 for i in at]
    return nodes[0], ways


def plain(rows):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda i, s, g, n, t: H(*map(field, (i, s, g, n, t)))
    per, out = {}, []
    for i, t, g, s, n in rows:
        hit = i is not None and n is not None and zlib.crc32(str(i).encode()) % 7 == 0
        per.setdefault(g, []).append((i is not None, i or 0, leaf(i, s, g, n, t), leaf(i, s, g, n + 1, t) if hit else leaf(i, s, g, n, t)))
    langs = sorted(per, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: climbed([x[2] for x in sorted(per[g])]) for g in langs}
    root, tops = climbed([trees[g][0] for g in langs]) if langs else (None, [])
    for g, last in zip(langs, tops):
        for (known, i, own, start), way in zip(sorted(per[g]), trees[g][1]):
            folded = start
            for s, left in way + last:
                folded = H(s, folded) if left else H(folded, s)
            out.append((i if known else None, own, trees[g][0], root, H(*[s for s, _ in way + last]), folded, folded == root))
    return Counter(out)


def written(spark, tmp_path, rows, levels=M.LEVELS):
    spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    return Counter(tuple(x) for x in M.checked(spark.read.parquet(f"{tmp_path}/documents.parquet"), levels).collect())


r = random.Random(1)
ROWS = [(k, f"text é {k}" * (k % 5), r.choice(["en", "en", "en", "de", "ü", "z" * 400]), r.choice(["s", None]), k % 11) for k in range(300)]
ROWS += [(None, "a", "en", "s", 1), (None, None, None, None, None), (5, "again", "en", "s", 3), (7, None, "en", None, None), (12, "", "", "", 2**63 - 1), (-4, "x" * 300_000, "only", "s", 4)] + 9 * [(1, "same", "en", "s", 4)] + ROWS[:3]


@pytest.mark.parametrize("levels", [10, 3, 2])
def test_equals_a_plain_tree(spark, tmp_path, levels):
    """With small buckets the same rows need several tiers."""
    assert written(spark, tmp_path, ROWS, levels) == plain(ROWS)


@pytest.mark.parametrize("rows", [[], ROWS[:1], [ROWS[0], (9, "b", "fr", None, 2)], ROWS[:2]])
def test_small_tables(spark, tmp_path, rows):
    assert written(spark, tmp_path, rows) == plain(rows)


def test_tampering_is_found(spark, tmp_path):
    """Rows that were tampered with fail, the others fold to the root."""
    rows = [x for x in ROWS if x[0] is not None and x[4] is not None]
    got = written(spark, tmp_path, rows)
    assert {(zlib.crc32(str(g[0]).encode()) % 7 != 0, g[6]) for g in got} == {(True, True), (False, False)}
