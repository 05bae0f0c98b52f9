"""Point-in-time join: brute force on hard rows, the walk itself, empty tables."""

import hashlib
import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lexivec.llm import as_of_join as J
from lexivec.llm.queries import QUERIES

VERSIONS = "entity string, event long, arrival long, expiry long, version long, features struct<n: long, s: string>"


def winner(versions, entity, t, life):
    """Plain version: the usable version of latest event, earliest arrival, largest id and features."""
    key = lambda f: tuple((x is not None, x if x is not None else 0) for x in f)
    usable = [v for v in versions if entity is not None and v[0] == entity and v[4] is not None and t is not None and v[1] <= t and v[2] <= t < min(v[3], v[1] + life)]
    best = max(usable, key=lambda v: (v[1], -v[2], v[4], key(v[5])), default=None)
    return None if best is None else (best[1], best[4], *best[5])


def test_equals_brute_force(spark):
    r = random.Random(3)
    versions = []
    for k in range(1500):
        event = r.randrange(300)
        versions.append((r.choice(["hot", "hot", "a", "b", None]), event, event + r.randrange(-5, 30), event + r.randrange(45), r.choice([k, k, k // 7, None]), (r.choice([None, r.randrange(9)]), r.choice("xyz"))))
    versions += versions[:200]
    asks = [(k, r.choice(["hot", "hot", "a", "nowhere", None]), r.choice([r.randrange(400), r.randrange(400), None])) for k in range(800)]
    asks += asks[:50]
    d = J.as_of_join(spark.createDataFrame(asks, "id long, entity string, time long"), spark.createDataFrame(versions, VERSIONS), 40)
    got = Counter((x["id"], None if x["version"] is None else (x["event"], x["version"], x["features"]["n"], x["features"]["s"])) for x in d.collect())
    assert got == Counter((i, winner(versions, e, t, 40)) for i, e, t in asks)
    assert sum(n for (_, w), n in got.items() if w) > 200


def test_walk_follows_predecessors_to_the_end_of_a_life():
    v = pd.DataFrame({"event": [0, 5, 6, 6, 7], "arrival": [0, 5, 9, 8, 20], "expiry": [9, 7, 30, 12, 40]})
    t = pd.DataFrame({"time": [0, 6, 7, 8, 9, 12, 13, 19, 20, 47]})
    assert J.walk(t, v, 10).tolist() == [0, 1, 0, 3, 3, 2, 2, -1, -1, -1]
    assert J.walk(t, v[:0], 10).tolist() == [-1] * len(t)
    assert np.array_equal(J.walk(t[:0], v, 10), [])


def test_versions_that_cannot_win_go(spark):
    """What is left of one entity and event is bounded by its lifetimes, not by its rows."""
    rows = spark.range(20_000).select(F.lit("hot").alias("entity"), F.lit(7).cast("long").alias("event"), (F.col("id") % 20).alias("arrival"), (F.col("id") % 30 + 8).alias("expiry"), F.col("id").alias("version"), F.lit(1).alias("features"))
    assert J.foremost(rows).count() <= 30


def test_documents_that_repeat_and_nulls(spark):
    docs = spark.createDataFrame(
        [(1, "t", "en", "a", 5, 1), (1, "t", "de", "a", 5, 1), (1, None, None, "b", None, 1), (None, "x", "en", "a", 1, 1), *[(k, "t", "en", "a", k, 1) for k in range(2, 4000)], (9999, "t", "fr", None, 3, 1)],
        "doc_id long, text string, lang string, source string, n_chars long, version long",
    )
    labels = spark.createDataFrame([(1, 0), (1, 0), (None, 1), (9999, 0), (77777, 1), *[(k, 0) for k in range(2, 900)]], "doc_id long, event int")

    def plain():
        number = lambda i: [int(hashlib.sha256(str(i).encode()).hexdigest()[8 * k : 8 * k + 8], 16) for k in range(4)]
        rows = [(x["doc_id"], x["source"], x["n_chars"], x["lang"]) for x in docs.collect()]
        versions, source = [], {}
        for i, s, n, lang in rows:
            if i is None:
                continue
            a, b, c, _ = number(i)
            e = a % 50000
            versions.append((s, e, e - 60 + b % 600, e + c % 900, i, (n, lang)))
            if s is not None:
                source[i] = min(s, source.get(i, s))
        for x in labels.collect():
            i = x["doc_id"]
            t = None if i is None else number(i)[3] % 50000
            w = winner(versions, source.get(i), t, 900)
            status = "none" if w is None else "stale" if t - w[0] > 120 else "fresh"
            yield (i, t, w and w[1], w and t - w[0], status, *((w[2], w[3]) if status == "fresh" else (None, None)))

    d = J.as_of_join(J.label_asks(labels, docs), J.document_versions(docs), J.LIFE)
    got = J.reported(d).collect()
    assert Counter(tuple(x) for x in got) == Counter(plain())
    assert {x["status"] for x in got} == {"none", "fresh", "stale"}


@pytest.mark.parametrize("empty", [{"documents"}, {"labels"}, {"documents", "labels"}])
def test_empty_tables(spark, tmp_path, empty):
    from .conftest import SF

    for t in ("documents", "labels"):
        d = spark.read.parquet(f"{SF}/{t}.parquet")
        (d.limit(0) if t in empty else d).write.parquet(f"{tmp_path}/{t}.parquet")
    got = QUERIES["op13_as_of_join"](spark, str(tmp_path)).collect()
    assert (len(got) == 0) == ("labels" in empty) and {x["status"] for x in got} <= {"none"}
