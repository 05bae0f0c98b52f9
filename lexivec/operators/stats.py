"""Statistics as aggregates: description, t-tests, ANOVA, post-hoc tests, intervals, bootstrap, correlation.

Everything is grouped aggregation over rows; the step functions for p-values are those of the step tables.
"""

from __future__ import annotations

import hashlib
import operator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexivec.compat import ship_package
from lexivec.functions import lexicon as L


#: Cuts of equal depth between which a place is looked for, and the accuracy of the sketch that gives them.
CUTS, ACCURACY = 1024, 20_000


def at_places(df: DataFrame, by: list[str], x: str, places: dict) -> DataFrame:
    """by, n and, per name, the value at a place of the group's sorted values; places: name to a function of n, from 0.

    A mergeable quantile sketch gives cuts of equal depth, whatever the distribution. The value of a place lies between the
    cuts around it, so only the values there are told apart; all below are one count. Such a bracket has some three
    thousandths of a group's distinct values, and the sketch's error is twenty times less than a cut's depth. Should a
    bracket not hold its place, the query fails rather than give another value.
    """
    d = df.filter(F.col(x).isNotNull()).select(*by, F.col(x).cast("double").alias("_x"))
    b = d.groupBy(*by).agg(F.count("*").alias("n"), F.percentile_approx("_x", [k / CUTS for k in range(CUTS + 1)], ACCURACY).alias("_g"))

    def bracket(name: str, make) -> Column:
        place = make(F.col("n")).cast("long")
        cut = F.floor(place * CUTS / F.col("n")).cast("int")
        end = lambda k: F.get("_g", k)
        # Not a number sorts last, and so would be beyond any cut; the outermost brackets are open.
        return F.struct(F.lit(name).alias("name"), place.alias("place"), F.when(cut >= 2, end(cut - 1)).alias("lo"), F.when(cut <= CUTS - 3, end(cut + 2)).alias("hi"))

    b = b.select(*[F.col(c).alias(f"_by_{k}") for k, c in enumerate(by)], "n", F.array(*[bracket(*p) for p in places.items()]).alias("_places"))
    same = reduce(operator.and_, [F.col(c).eqNullSafe(F.col(f"_by_{k}")) for k, c in enumerate(by)], F.lit(True))
    e = d.join(b, same).select(*by, "n", "_x", F.explode("_places").alias("_p")).filter(F.col("_p.hi").isNull() | (F.col("_x") <= F.col("_p.hi")))
    below = F.col("_p.lo").isNotNull() & (F.col("_x") < F.col("_p.lo"))
    t = e.groupBy(*by, "n", F.col("_p.name").alias("_name"), F.col("_p.place").alias("_place"), F.when(~below, F.col("_x")).alias("_v")).agg(F.count("*").alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy(*by, "_name").orderBy(F.col("_v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))
    t = t.withColumn("_upto", upto).filter(F.col("_upto") > F.col("_place"))
    # Where the first one is what lies below, or none is left, the sketch was wrong.
    first = t.groupBy(*by, "n", "_name").agg(F.min_by("_v", "_upto").alias("_v"), F.min_by(F.col("_v").isNull(), "_upto").alias("_lost"))
    held = F.when(F.col("_lost"), F.raise_error(F.lit("a place lies outside its bracket")).cast("double")).otherwise(F.col("_v"))
    return first.withColumn("_v", held).groupBy(*by, "n").agg(*[F.max(F.when(F.col("_name") == name, F.col("_v"))).alias(name) for name in places])


def describe(df: DataFrame, by: list[str], x: str) -> DataFrame:
    """n, mean, median, variance, sd, min, max, range, sem, skewness and kurtosis (bias-corrected) per group."""
    n = F.count(x).cast("double")
    g1, g2 = F.skewness(x), F.kurtosis(x)
    skew = F.when(n > 2, g1 * F.sqrt(F.greatest(n * (n - 1), F.lit(0.0))) / F.nullif(n - 2, F.lit(0.0))).otherwise(0.0)
    kurt = F.when(n > 3, (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0.0)) * ((n + 1) * g2 + 6)).otherwise(0.0)
    d = df.groupBy(*by).agg(
        F.count(x).alias("n"), F.avg(x).alias("mean"), F.var_samp(x).alias("variance"), F.stddev_samp(x).alias("sd"),
        F.min(x).alias("min"), F.max(x).alias("max"), (F.max(x) - F.min(x)).alias("range"), (F.stddev_samp(x) / F.sqrt(n)).alias("sem"), skew.alias("skewness"), kurt.alias("kurtosis"),
    )
    middle = at_places(df, by, x, {"_a": lambda n: F.floor((n - 1) / 2), "_b": lambda n: F.floor(n / 2)})
    middle = middle.select(*by, ((F.col("_a") + F.col("_b")) / 2).alias("median"))
    return d.join(middle, by, "left").select(*by, "n", "mean", "median", "variance", "sd", "min", "max", "range", "sem", "skewness", "kurtosis")


def t_critical(df: Column, table=L.T_05) -> Column:
    """Critical value of the largest tabled degrees of freedom not above df; below 1 that of 1."""
    out = F.lit(table[-1][1])
    for d, v in reversed(table):
        out = F.when(df >= d, v).otherwise(out)
    return out


def t_p(t: Column, df: Column) -> Column:
    """p of t: a closed form over 30 degrees of freedom, else steps."""
    a = F.abs(t)
    steps = F.when(a > 4, 0.001).when(a > 3, 0.01).when(a > 2, 0.05).when(a > 1.5, 0.15).otherwise(0.5)
    return F.when(df > 30, 2 * F.exp(-a * a / 2) / 2.5066282746310002 * (1 + 0.2316419 * a)).otherwise(steps)


def f_p(f: Column) -> Column:
    return F.when(f < 1, 0.5).when(f > 10, 0.001).when(f > 5, 0.01).when(f > 3, 0.05).when(f > 2, 0.15).otherwise(0.3)


def q_p(q: Column) -> Column:
    return F.when(q > 5, 0.001).when(q > 4, 0.01).when(q > 3.5, 0.05).when(q > 3, 0.1).otherwise(0.5)


def d_label(d: Column) -> Column:
    a = F.abs(d)
    return F.when(a < 0.2, "negligible").when(a < 0.5, "small").when(a < 0.8, "medium").otherwise("large")


def eta_label(e: Column) -> Column:
    return F.when(e < 0.01, "negligible").when(e < 0.06, "small").when(e < 0.14, "medium").otherwise("large")


def paired_t(df: DataFrame, by: list[str], a: str, b: str, alpha: float = 0.05) -> DataFrame:
    """t, p, d and interval of the mean difference of two columns of one row."""
    d = df.withColumn("_d", F.col(a) - F.col(b)).groupBy(*by).agg(F.count("_d").alias("n"), F.avg("_d").alias("mean"), F.stddev_samp("_d").alias("sd"))
    sem = F.col("sd") / F.sqrt(F.col("n").cast("double"))
    d = d.withColumn("t", F.try_divide(F.col("mean"), sem)).withColumn("df", F.col("n") - 1)
    margin = t_critical(F.col("df"), L.T_01 if alpha == 0.01 else L.T_05) * sem
    return d.select(*by, "n", "t", "df", t_p(F.col("t"), F.col("df")).alias("p"), F.try_divide(F.col("mean"), F.col("sd")).alias("d"), (F.col("mean") - margin).alias("lower"), (F.col("mean") + margin).alias("upper"))


def welch_t(df: DataFrame, group: str, x: str, first, second) -> DataFrame:
    """Welch's test of two groups: t, degrees of freedom, p, pooled d and interval."""
    def of(which, g):
        c = F.when(F.col(group) == g, F.col(x))
        return [F.count(c).cast("double").alias(f"n{which}"), F.avg(c).alias(f"m{which}"), F.var_samp(c).alias(f"s{which}")]

    d = df.agg(*of(1, first), *of(2, second)).withColumn("v1", F.expr("s1 / n1")).withColumn("v2", F.expr("s2 / n2"))
    d = d.withColumn("diff", F.expr("m1 - m2")).withColumn("se", F.expr("sqrt(v1 + v2)"))
    d = d.withColumn("t", F.expr("try_divide(diff, se)")).withColumn("df", F.expr("pow(v1 + v2, 2) / (v1 * v1 / (n1 - 1) + v2 * v2 / (n2 - 1))"))
    margin = t_critical(F.round("df")) * F.col("se")
    return d.select("t", "df", t_p(F.col("t"), F.col("df")).alias("p"), F.expr("diff / sqrt(((n1 - 1) * s1 + (n2 - 1) * s2) / (n1 + n2 - 2))").alias("d"), (F.col("diff") - margin).alias("lower"), (F.col("diff") + margin).alias("upper"))


def group_moments(df: DataFrame, group: str, x: str) -> DataFrame:
    """n, mean and sum of squared deviations per group: all that ANOVA and post-hoc tests need of the rows."""
    return df.groupBy(F.col(group).alias("g")).agg(F.count(x).cast("double").alias("n"), F.avg(x).alias("m"), F.coalesce(F.var_pop(x) * F.count(x), F.lit(0.0)).alias("ss"))


def anova(df: DataFrame, group: str, x: str) -> DataFrame:
    m = group_moments(df, group, x)
    a = m.agg(F.count("*").alias("k"), F.sum("n").alias("n"), (F.sum(F.expr("n * m * m")) - F.expr("pow(sum(n * m), 2) / sum(n)")).alias("ssb"), F.sum("ss").alias("ssw"))
    a = a.withColumn("df_between", F.col("k") - 1).withColumn("df_within", (F.col("n") - F.col("k")).cast("long"))
    f = F.try_divide(F.col("ssb") / F.col("df_between"), F.col("ssw") / F.col("df_within"))
    a = a.withColumn("f", f).withColumn("eta2", F.try_divide(F.col("ssb"), F.col("ssb") + F.col("ssw")))
    return a.select("k", "df_between", "df_within", "f", f_p(F.col("f")).alias("p"), "eta2", eta_label(F.col("eta2")).alias("effect"))


def tukey(df: DataFrame, group: str, x: str) -> DataFrame:
    """a, b, q, p of each pair of groups a < b."""
    m = group_moments(df, group, x)
    w = m.agg((F.sum("ss") / (F.sum("n") - F.count("*"))).alias("msw"))
    a, b = m.select(F.col("g").alias("a"), F.col("n").alias("na"), F.col("m").alias("ma")), m.select(F.col("g").alias("b"), F.col("n").alias("nb"), F.col("m").alias("mb"))
    d = a.join(b, F.col("a") < F.col("b")).crossJoin(F.broadcast(w))
    q = F.try_divide(F.abs(F.col("ma") - F.col("mb")), F.sqrt(F.col("msw") * (1 / F.col("na") + 1 / F.col("nb")) / 2))
    return d.select("a", "b", q.alias("q"), q_p(q).alias("p"))


def mean_interval(df: DataFrame, by: list[str], x: str, exact: bool = False) -> DataFrame:
    """n, mean, margin, lower, upper at 95 %; exact: at 99 %, with that level's table."""
    d = df.groupBy(*by).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), (F.stddev_samp(x) / F.sqrt(F.count(x).cast("double"))).alias("sem"))
    d = d.withColumn("margin", t_critical(F.col("n") - 1, L.T_01 if exact else L.T_05) * F.col("sem"))
    return d.select(*by, "n", "mean", "margin", (F.col("mean") - F.col("margin")).alias("lower"), (F.col("mean") + F.col("margin")).alias("upper"))


#: MD5: shifts of the four rounds, the constants of its steps, and the state it begins with.
SHIFTS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
SINES = tuple(int(abs(np.sin(k + 1.0)) * 4294967296) for k in range(64))
BEGIN = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
#: Numbers that are hashed at a time, so that they stay in a core's cache; groups whose sums a task holds.
AT_ONCE, GROUPS_HELD = 32_768, 1_000


def md5_heads(prefixes: np.ndarray, suffixes: np.ndarray) -> np.ndarray:
    """The first four bytes, as a number, of the MD5 of every prefix followed by every suffix.

    prefixes, suffixes: uint8, a text a row, all of a table of one length; together 55 bytes at most, one block of MD5.
    """
    n, length = prefixes.shape[1], prefixes.shape[1] + suffixes.shape[1]

    def words(rows: np.ndarray, at: int) -> np.ndarray:
        block = np.zeros((len(rows), 64), np.uint8)
        block[:, at : at + rows.shape[1]] = rows
        return block.view("<u4").astype(np.uint32)

    end = np.zeros((1, 64), np.uint8)
    end[0, length], end[0, 56:58] = 0x80, (8 * length & 0xFF, 8 * length >> 8)
    p, s = words(prefixes, 0), words(suffixes, n) | end.view("<u4").astype(np.uint32)
    # A word that no prefix, or no suffix, has a part in is a number a suffix, or a prefix, not one a pair.
    m = [np.atleast_1d(np.bitwise_or(p[:, k, None] if 4 * k < n else np.uint32(0), s[None, :, k] if 4 * k + 4 > n and 4 * k < length else s[0, k])) for k in range(16)]
    shape = (len(prefixes), len(suffixes))
    a, b, c, d = (np.full(shape, x, np.uint32) for x in BEGIN)
    f, t = np.empty(shape, np.uint32), np.empty(shape, np.uint32)
    # The first four bytes are done when three steps are left.
    for k in range(61):
        turn = k // 16
        if turn == 0:
            np.bitwise_xor(c, d, out=f); f &= b; f ^= d; g = k  # noqa: E702
        elif turn == 1:
            np.bitwise_xor(b, c, out=f); f &= d; f ^= c; g = (5 * k + 1) % 16  # noqa: E702
        elif turn == 2:
            np.bitwise_xor(b, c, out=f); f ^= d; g = (3 * k + 5) % 16  # noqa: E702
        else:
            np.invert(d, out=f); f |= b; f ^= c; g = 7 * k % 16  # noqa: E702
        f += a
        f += m[g] + np.uint32(SINES[k])
        r = SHIFTS[turn][k % 4]
        np.right_shift(f, np.uint32(32 - r), out=t)
        f <<= np.uint32(r)
        f |= t
        f += b
        a, b, c, d, f = d, f, b, c, a
    return (b + np.uint32(BEGIN[0])).byteswap()


def _heads(prefixes: list[bytes], numbers: list[bytes]) -> np.ndarray:
    """`md5_heads` of texts of any length, by the lengths of both."""
    out = np.empty((len(prefixes), len(numbers)), np.uint32)
    for n in set(map(len, prefixes)):
        rows = [k for k, p in enumerate(prefixes) if len(p) == n]
        table = np.frombuffer(b"".join(prefixes[k] for k in rows), np.uint8).reshape(len(rows), n)
        for w in sorted(set(map(len, numbers))):
            at = [k for k, x in enumerate(numbers) if len(x) == w]
            if n + w > 55:
                out[np.ix_(rows, at)] = [[int.from_bytes(hashlib.md5(prefixes[k] + numbers[i]).digest()[:4], "big") for i in at] for k in rows]
                continue
            suffixes = np.frombuffer(b"".join(numbers[i] for i in at), np.uint8).reshape(len(at), w)
            for lo in range(0, len(rows), step := max(1, AT_ONCE // len(at))):
                # Numbers of one length follow one another.
                out[rows[lo : lo + step], at[0] : at[-1] + 1] = md5_heads(table[lo : lo + step], suffixes)
    return out


def bootstrap_mean(df: DataFrame, by: list[str], x: str, key: str, times: int = 1000, level: float = 0.95) -> DataFrame:
    """Percentile interval of the mean by `times` resamples.

    Draws are weights instead of places: each row's weight in resample i is the number of cuts of a Poisson(1) law under
    a hash of its key and i, so no row needs to be looked up by number and all resamples are one aggregation. A task adds
    up its rows' weights for all resamples, a group at a time, so that no row per draw is made.
    """
    ship_package(df.sparkSession)
    cuts = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119)
    least = [int(np.ceil(c * 4294967296)) for c in cuts]
    prefix = F.coalesce(F.concat(F.col(key).cast("string"), F.lit(":")), F.lit("")).cast("binary")
    d = df.select(*by, prefix.alias("_prefix"), F.col(x).cast("double").alias("_x"))
    schema = T.StructType([*d.select(*by).schema.fields, *[T.StructField(c, T.ArrayType(T.DoubleType())) for c in ("_w", "_wx")], T.StructField("_n", T.LongType())])
    numbers = [str(i).encode() for i in range(times)]

    def summed(batches):
        held: dict = {}

        def told():
            columns = [pa.array([g[k] for g in held], t) for k, t in enumerate(types)]
            sums = [pa.array([v[k].tolist() for v in held.values()], pa.list_(pa.float64())) for k in (0, 1)]
            return pa.RecordBatch.from_arrays([*columns, *sums, pa.array([v[2] for v in held.values()], pa.int64())], names=[*by, "_w", "_wx", "_n"])

        for batch in batches:
            types = [batch.schema.field(k).type for k in range(len(by))]
            groups: dict = {}
            for k, g in enumerate(zip(*[batch.column(i).to_pylist() for i in range(len(by))]) if by else [()] * batch.num_rows):
                groups.setdefault(g, []).append(k)
            prefixes, value = batch.column(len(by)).to_pylist(), batch.column(len(by) + 1)
            valid = value.is_valid().to_numpy(zero_copy_only=False)
            value = value.fill_null(0.0).to_numpy(zero_copy_only=False)
            for g, places in groups.items():
                sums = held.setdefault(g, [np.zeros(times), np.zeros(times), 0])
                for lo in range(0, len(places), 512):
                    at = places[lo : lo + 512]
                    h = _heads([prefixes[k] for k in at], numbers)
                    w = np.zeros(h.shape, np.uint8)
                    for c in least:
                        w += h >= c
                    w = w.astype(np.float64)
                    sums[0] += w.sum(axis=0)
                    sums[1] += value[at] @ w
                    sums[2] += int(valid[at].sum())
                if len(held) >= GROUPS_HELD:
                    yield told()
                    held = {}
        if held:
            yield told()

    # A resample's sums are added up over the tasks as numbers of one place.
    d = d.mapInArrow(summed, schema).select(*by, "_n", F.posexplode(F.arrays_zip("_w", "_wx")).alias("i", "_s"))
    d = d.groupBy(*by, "i").agg(F.when(F.sum("_n") > 0, F.try_divide(F.sum("_s._wx"), F.sum("_s._w"))).alias("m"))
    lo, hi = int((1 - level) / 2 * times), int((1 - (1 - level) / 2) * times)
    s = F.sort_array(F.collect_list("m"))
    return d.groupBy(*by).agg(F.get(s, F.lit(lo)).alias("lower"), F.get(s, F.lit(hi)).alias("upper")).join(df.groupBy(*by).agg(F.avg(x).alias("estimate")), by)


def pearson(df: DataFrame, columns: list[str]) -> DataFrame:
    """a, b, r, n of each pair of columns over rows that have both, three at least. One aggregation."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    both = lambda a, b: F.col(a).isNotNull() & F.col(b).isNotNull()
    one = df.agg(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(a, b).alias("r"), F.count_if(both(a, b)).alias("n")).alias(f"_{a}_{b}") for a, b in pairs])
    return one.select(F.inline(F.array(*[F.col(f"_{a}_{b}") for a, b in pairs]))).filter("n >= 3")


def cronbach(df: DataFrame, items: list[str]) -> DataFrame:
    k, total = len(items), sum((F.col(c) for c in items[1:]), F.col(items[0]))
    return df.agg((k / (k - 1) * (1 - sum((F.var_samp(c) for c in items[1:]), F.var_samp(items[0])) / F.var_samp(total))).alias("alpha"))
