"""Sparse products: weighted queries against postings, in parts of a bounded size, of which only the best rows come out.

Scores of all pairs are rows times queries, so they are neither moved nor kept: a part of the rows meets a block of the
queries in a task, terms that many of both have as a matrix product, the others posting by posting.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexivec.compat import ship_package

#: Postings of a part and bytes of queries that meet in one task, about; postings worth a task; numbers of a block of scores.
PER_PART, QUERY_BYTES, LEAST_PART, BLOCK = 2_000_000, 16 << 20, 50_000, 2_000_000
#: A posting that is met alone costs as much as so many numbers of a matrix product.
DEAR = 200
#: Decimal places of a score.
PLACES = 6


def rounded(s: np.ndarray, places: int) -> np.ndarray:
    """Rounded to some places, halves away from zero, as Spark rounds."""
    out = np.round(s, places) + 0.0
    for i in np.flatnonzero(np.abs(np.abs(s * 10.0**places) % 1 - 0.5) < 1e-3):
        out[i] = float(Decimal(repr(float(s[i]))).quantize(Decimal(1).scaleb(-places), ROUND_HALF_UP)) + 0.0
    return out


def best(rows: int, row: np.ndarray, term: np.ndarray, x: np.ndarray, queries: int, asked: np.ndarray, wanted: np.ndarray, weight: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of queries and of rows, scores: of each query the k rows of greatest sum of x * weight over common terms, if it is
    over 0; ties go to the first row.

    row, term, x: the postings, a row and term once; asked, wanted, weight: the queries' terms, by query.
    """
    known, wanted = np.unique(wanted, return_inverse=True)
    at = np.minimum(np.searchsorted(known, term), max(0, len(known) - 1))
    both = known[at] == term if len(known) else np.zeros(len(term), bool)
    row, term, x = row[both], at[both], x[both]
    order = np.argsort(term, kind="stable")
    row, term, x = row[order], term[order], x[order]
    held, sought = np.bincount(term, minlength=len(known)), np.bincount(wanted, minlength=len(known))
    start, gain = np.cumsum(held) - held, held * sought
    dense = np.argsort(-gain, kind="stable")[: 2 * BLOCK // max(1, rows)]
    dense = dense[gain[dense] * DEAR >= rows * queries] if rows * queries else dense[:0]
    place = np.full(len(known), -1)
    place[dense] = np.arange(len(dense))
    m = np.zeros((len(dense), rows))
    full = place[term] >= 0
    m[place[term[full]], row[full]] = x[full]
    full = place[wanted] >= 0
    d_asked, d_place, d_weight = asked[full], place[wanted[full]], weight[full]
    asked, wanted, weight = asked[~full], wanted[~full], weight[~full]
    # A step's queries have a block of scores, and meet a block of postings, or are one query.
    met = np.concatenate([[0], np.cumsum(np.bincount(asked, held[wanted], minlength=queries))])
    found, lo = ([], [], []), 0
    while lo < queries:
        hi = max(lo + 1, min(queries, lo + BLOCK // max(1, rows), int(np.searchsorted(met, met[lo] + BLOCK, "right")) - 1))
        e, d = slice(*np.searchsorted(asked, [lo, hi])), slice(*np.searchsorted(d_asked, [lo, hi]))
        n = held[wanted[e]]
        at = np.repeat(start[wanted[e]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        s = np.bincount(np.repeat((asked[e] - lo) * rows, n) + row[at], np.repeat(weight[e], n) * x[at], minlength=(hi - lo) * rows).astype(float, copy=False).reshape(hi - lo, rows)
        if len(dense):
            w = np.zeros((hi - lo, len(dense)))
            w[d_asked[d] - lo, d_place[d]] = d_weight[d]
            s += w @ m
        if rows > k:
            least = np.partition(s, rows - k, axis=1)[:, rows - k, None] - 2 * 10.0**-PLACES
            of_q, of_m = np.nonzero((s >= least) & (s > 0))
        else:
            of_q, of_m = np.nonzero(s > 0)
        score = rounded(s[of_q, of_m], PLACES)
        order = np.lexsort((of_m, -score, of_q))
        of_q, of_m, score = of_q[order], of_m[order], score[order]
        first = np.arange(len(order)) - np.searchsorted(of_q, of_q) < k
        for to, v in zip(found, (of_q[first] + lo, of_m[first], score[first])):
            to.append(v)
        lo = hi
    of_q, of_m, score = (np.concatenate(v) if v else np.zeros(0) for v in found)
    return of_q.astype(np.int64), of_m.astype(np.int64), score


def flat(rows: pa.Table, asked: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Ids in order, and the postings' rows, terms and x, of a table (id, t, x)."""
    coded = rows.column("id").combine_chunks().dictionary_encode("encode")
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    order = pc.sort_indices(coded.dictionary, null_placement="at_start").to_numpy()
    to = np.empty(len(order), np.int64)
    to[order] = np.arange(len(order))
    return coded.dictionary.take(pa.array(order)), to[coded.indices.to_numpy()], rows.column("t").to_numpy(), rows.column("x").to_numpy()


def best_products(posts: DataFrame, weights: DataFrame, k: int, n: int, id_type: T.DataType, by: tuple[str, ...] = ("id",), read: Callable = flat, more: tuple[str, ...] = ()) -> DataFrame:
    """query_id, id, score: the k best rows of each query (query_id, t, weight, more) in each part of the postings, n in all.

    posts: a posting a row (id, t, x), or what `read` makes postings of; rows that share `by` come to one part. Rows that have
    no term of a query are left out.
    """
    spark = posts.sparkSession
    ship_package(spark)
    q = weights.groupBy("query_id", *more).agg(F.collect_list(F.struct("t", "weight")).alias("terms"))
    sent = q.agg(F.sum(32 + 16 * F.size("terms"))).first()[0] or 0
    parts = max(1, -(-n // PER_PART), min(2 * spark.sparkContext.defaultParallelism, n // LEAST_PART))
    blocks = max(1, -(-sent // QUERY_BYTES))
    out = T.StructType([q.schema["query_id"], T.StructField("id", id_type), T.StructField("score", T.DoubleType())])

    def meet(rows: pa.Table, asked: pa.Table) -> pa.Table:
        of = asked.column("query_id")
        if not rows.num_rows or not asked.num_rows:
            return pa.Table.from_pylist([], out_schema)
        ids, row, t, x = read(rows, asked)
        terms = asked.column("terms").combine_chunks()
        size = pc.list_value_length(terms).to_numpy()
        wanted, weight = (terms.flatten().field(c).to_numpy() for c in ("t", "weight"))
        of_q, of_m, score = best(len(ids), row, t, x, len(asked), np.repeat(np.arange(len(asked)), size), wanted, weight, k)
        return pa.table([of.take(of_q), ids.take(pa.array(of_m)), pa.array(score)], names=["query_id", "id", "score"])

    from pyspark.sql.pandas.types import to_arrow_schema

    out_schema = to_arrow_schema(out)
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    p = posts.withColumn("part", F.pmod(F.xxhash64(*by), F.lit(parts)).cast("int")).withColumn("block", each(blocks))
    q = q.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).withColumn("part", each(parts))
    return p.groupBy("part", "block").cogroup(q.groupBy("part", "block")).applyInArrow(meet, out)
