"""Order statistics and rate limits on skewed and hot input, against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from lexivec.operators import guard, stats


def plain_limit(rows, most, window):
    """Rows (user, id, ms): which requests pass."""
    out, state = {}, {}
    for user, i, at in sorted(set(rows), key=lambda r: (r[2] is not None, r[2] or 0, r[1])):
        if at is None:
            out[user, i, at] = True
            continue
        reset, n = state.get(user, (None, 0))
        if reset is None or at > reset:
            state[user] = (at + window, 1)
            out[user, i, at] = True
        else:
            out[user, i, at] = n < most
            state[user] = (reset, n + (n < most))
    return out


@pytest.mark.parametrize(("most", "window"), [(2, 100), (5, 37), (1, 1), (3, 5000)])
def test_rate_limit(spark, most, window):
    """Users with gaps and without, ties, times before 1970, a user that is null, requests without a time."""
    r = random.Random(most)
    rows = []
    for user in (1, 2, 3, None):
        at = r.randrange(-3000, 3000)
        for k in range(250):
            at += r.choice([0, 1, 2, 30, 36, 37, 38, 90, 100, 101, 400]) if user != 3 else r.choice([0, 1, 3])
            rows.append((user, k if user != 2 else -k, at))
    rows += [(1, 9000, None), (3, 9001, None)]
    d = spark.createDataFrame(rows, "user_id long, event_id long, ms long").repartition(3)
    got = guard.rate_limit(d.withColumn("ts", F.timestamp_millis("ms")), most, window)
    want = plain_limit(rows, most, window)
    assert sorted((r["user_id"] or 0, r["event_id"], r["passed"]) for r in got.collect()) == sorted((u or 0, i, p) for (u, i, _), p in want.items())


def test_rate_limit_of_a_hot_user(spark):
    """Requests of one user without a gap, some twenty times as many as windows."""
    rows = [(7, k, k * 50 + (k * 7919) % 40) for k in range(60_000)]
    d = spark.createDataFrame(rows, "user_id long, event_id long, ms long")
    got = {r["event_id"]: r["passed"] for r in guard.rate_limit(d.withColumn("ts", F.timestamp_millis("ms")), 4, 1000).collect()}
    assert got == {i: p for (_, i, _), p in plain_limit(rows, 4, 1000).items()}
    with pytest.raises(ValueError):
        guard.rate_limit(d, 4, 0)


def spread_of(name, r):
    return {
        "even": lambda k: k * 1.0, "heavy": lambda k: 10 ** r.uniform(-9, 15) * r.choice([-1, 1]), "outlier": lambda k: 1e18 if k == 17 else r.uniform(0, 1000), "ties": lambda k: float(r.choice([1, 1, 1, 2, 3])), "one": lambda k: 5.0,
    }[name]


def test_places(spark, monkeypatch):
    """Any place of any distribution, groups of one and of none; and few values are told apart for it."""
    r = random.Random(4)
    rows = [(name, spread_of(name, r)(k)) for name in ("even", "heavy", "outlier", "ties", "one") for k in range(20_000)]
    rows += [("single", 3.5), ("pair", 1.0), ("pair", 2.0), ("empty", None), ("even", None), (None, 4.0), (None, 6.0)]
    d = spark.createDataFrame(rows, "g string, x double")
    at = {"first": lambda n: F.lit(0), "low": lambda n: F.floor((n - 1) / 2), "high": lambda n: F.floor(n / 2), "p99": lambda n: F.floor(n * 0.99), "last": lambda n: n - 1, "none": lambda n: n}
    got = {x["g"]: x for x in stats.at_places(d, ["g"], "x", at).collect()}
    groups = {}
    for g, x in rows:
        if x is not None:
            groups.setdefault(g, []).append(x)
    assert set(got) == set(groups)
    for g, xs in groups.items():
        xs.sort()
        n = len(xs)
        assert [got[g][k] for k in at] == [xs[0], xs[(n - 1) // 2], xs[n // 2], xs[int(n * 0.99)], xs[-1], None], g
    (row,) = stats.at_places(d.filter("g = 'heavy'"), [], "x", {"m": lambda n: F.floor(n / 2)}).collect()
    assert row["m"] == groups["heavy"][10_000] and row["n"] == 20_000


def test_a_bracket_that_misses_its_place_fails(spark, monkeypatch):
    d = spark.range(5000).select(F.lit(1).alias("g"), F.col("id").cast("double").alias("x"))
    monkeypatch.setattr(stats.F, "percentile_approx", lambda *a: F.array(*[F.lit(float(4000 + k)) for k in range(stats.CUTS + 1)]))
    with pytest.raises(Exception, match="outside its bracket"):
        stats.at_places(d, ["g"], "x", {"m": lambda n: F.floor(n / 2)}).collect()
