"""Inverted file of vectors: rows lie by their nearest of a few thousand centroids, and a search reads the nearest lists only.

Centroids are fitted on a bounded sample, every row is assigned and written, each list in a folder of its own. A query
probes the lists of its nearest centroids; within a list, vectors and queries meet in blocks as matrix products. Lists are
dealt out in parts of a bounded size, so one with a third of all rows is many tasks. Probing all lists is exact search.
"""

from __future__ import annotations

import json
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexivec.compat import shared_folder, ship_package
from lexivec.operators.retrieval import ranked

#: Bytes of vectors that centroids are fitted on, at most about.
SAMPLE_BYTES = 128 << 20
#: Rows that centroids are fitted on, at most about; rounds of fitting; most lists; rows of a list that meet in one task.
SAMPLE, ROUNDS, MOST_LISTS, PER_PART = 65_536, 12, 4_096, 50_000
#: Numbers of a block of scores.
BLOCK = 4_000_000


def _matrix(column) -> np.ndarray:
    """Rows of unit length from an Arrow column of vectors; a vector of zeros stays."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    m = flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)
    size = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, size, out=np.zeros_like(m), where=size > 0)


def _nearest(m: np.ndarray, centroids: np.ndarray, n: int) -> np.ndarray:
    """Numbers of the n centroids of greatest cosine of each row, best first."""
    out, step = [], max(1, BLOCK // len(centroids))
    for lo in range(0, len(m), step):
        s = m[lo : lo + step] @ centroids.T
        # The nearest alone needs no sorting; both take the first of equals.
        out.append(np.argmax(s, axis=1)[:, None] if n == 1 else np.argsort(-s, axis=1, kind="stable")[:, :n])
    return np.concatenate(out) if out else np.empty((0, n), np.int64)


def fitted(m: np.ndarray, lists: int, rounds: int = ROUNDS, seed: int = 7) -> np.ndarray:
    """Spherical k-means: at most `lists` centroids of unit length."""
    m = np.unique(m, axis=0)
    draw = np.random.default_rng(seed)
    c = m[draw.choice(len(m), min(lists, len(m)), replace=False)]
    for _ in range(rounds):
        near = _nearest(m, c, 1)[:, 0]
        sums = np.zeros_like(c)
        np.add.at(sums, near, m)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        # A centroid without rows, or whose rows cancel out, begins anew at some row.
        c = np.where(size > 1e-12, np.divide(sums, size, out=np.zeros_like(sums), where=size > 1e-12), m[draw.integers(len(m), size=len(c))])
    return c


class VectorIndex:
    """A written index: `path` holds its rows by list, and its centroids."""

    def __init__(self, spark: SparkSession, path: str, centroids: np.ndarray):
        self.spark, self.path, self.centroids = spark, path, centroids

    @classmethod
    def build(cls, chunks: DataFrame, path: str | None = None, lists: int | None = None, sample: int = SAMPLE, id_col: str = "vec_id", vector: str = "embedding") -> VectorIndex:
        """Fits centroids on about `sample` rows (fewer if wide), told by hashes of their ids, and writes all rows of chunks that have a vector.

        lists: how many; by default the root of the number of rows, up to 4,096.
        """
        spark = chunks.sparkSession
        d = chunks.filter(F.col(vector).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("vector"))
        n, width = d.agg(F.count("*"), F.max(F.size("vector"))).first()
        sample = max(1, min(sample, SAMPLE_BYTES // (8 * max(1, width or 1))))
        share = min(1.0, sample / max(1, n))
        some = d.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30))).limit(2 * sample).select("vector").toArrow().column(0)
        m = _matrix(some)
        index = cls(spark, path or f"{shared_folder(spark)}/lexivec/index-{uuid.uuid4().hex}", fitted(m, lists or min(MOST_LISTS, max(1, round(n**0.5)))) if len(m) else np.zeros((1, 1)))
        spark.createDataFrame([(json.dumps(index.centroids.tolist()),)], "centroids string").coalesce(1).write.mode("overwrite").parquet(f"{index.path}/centroids")
        index._write(d, "overwrite")
        return index

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> VectorIndex:
        return cls(spark, path, np.array(json.loads(spark.read.parquet(f"{path}/centroids").first()["centroids"])))

    def _write(self, rows: DataFrame, mode: str) -> None:
        ship_package(self.spark)
        centroids = self.centroids

        def assign(batches):
            for b in batches:
                near = _nearest(_matrix(b.column(1)), centroids, 1)[:, 0] if b.num_rows else np.empty(0, np.int64)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near.astype(np.int32))], names=["id", "vector", "list"])

        d = rows.mapInArrow(assign, "id long, vector array<double>, list int")
        # A list is written by a few tasks, so a hot one is no single file.
        d.repartition("list", F.pmod(F.xxhash64("id"), F.lit(4))).write.mode(mode).partitionBy("list").parquet(f"{self.path}/rows")

    def append(self, chunks: DataFrame, id_col: str = "vec_id", vector: str = "embedding") -> None:
        """Adds rows under the centroids that there are."""
        self._write(chunks.filter(F.col(vector).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("vector")), "append")

    @property
    def rows(self) -> DataFrame:
        return self.spark.read.schema("id long, vector array<double>, list int").parquet(f"{self.path}/rows")

    def _probed(self, queries: DataFrame, probes: int) -> DataFrame:
        """query_id, query_vector, list, place: each query with its nearest lists, the nearest at place 0."""
        ship_package(self.spark)
        centroids, n = self.centroids, min(probes, len(self.centroids))

        def probed(batches):
            for b in batches:
                near = _nearest(_matrix(b.column(1)), centroids, n) if b.num_rows else np.empty((0, n), np.int64)
                at = pa.array(np.repeat(np.arange(b.num_rows), n))
                columns = [b.column(0).take(at), b.column(1).take(at), pa.array(near.ravel().astype(np.int32)), pa.array(np.tile(np.arange(n, dtype=np.int32), b.num_rows))]
                yield pa.RecordBatch.from_arrays(columns, names=["query_id", "query_vector", "list", "place"])

        q = queries.filter(F.col("query_vector").isNotNull()).select("query_id", F.col("query_vector").cast("array<double>").alias("query_vector"))
        return q.mapInArrow(probed, "query_id long, query_vector array<double>, list int, place int")

    def probes_for(self, queries: DataFrame, exact: DataFrame, target: float = 0.9) -> int:
        """The fewest lists to probe so that `target` of the exact rows (query_id, id) of these queries are found.

        One pass: a row is found as soon as its list is probed, so the places of the rows' lists in their queries' order
        tell recall for every number of probes; they are counted, a number per place.
        """
        centroids = self.centroids

        def placed(batches):
            for b in batches:
                m, own, step = _matrix(b.column(0)), b.column(1), max(1, BLOCK // len(centroids))
                for lo in range(0, b.num_rows, step):
                    near = _nearest(m[lo : lo + step], centroids, len(centroids))
                    places = np.empty_like(near)
                    np.put_along_axis(places, near, np.arange(near.shape[1])[None, :], axis=1)
                    some = own.slice(lo, step)
                    which = np.repeat(np.arange(len(some)), some.value_lengths().to_numpy())
                    yield pa.RecordBatch.from_arrays([pa.array(places[which, some.flatten().to_numpy()].astype(np.int32))], names=["place"])

        own = exact.select("query_id", F.col("id").alias("_id")).join(self.rows.select("id", F.col("list").alias("own")), F.col("_id") == F.col("id"))
        q = queries.filter(F.col("query_vector").isNotNull()).select("query_id", F.col("query_vector").cast("array<double>").alias("query_vector"))
        # A query meets the lists of its own rows alone, not a row for each list that there is.
        d = q.join(own.groupBy("query_id").agg(F.collect_list("own").alias("own")), "query_id").select("query_vector", "own").mapInArrow(placed, "place int")
        found, counts = 0, {r["place"]: r["count"] for r in d.groupBy("place").count().collect()}
        for place in sorted(counts):
            found += counts[place]
            if found >= target * sum(counts.values()):
                return place + 1
        return len(self.centroids)

    def search(self, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
        """query_id, id, score, rank: the k nearest rows to each query (query_id, query_vector) in its `probes` nearest lists;
        of all lists without a number, which is exact. Ties go by id."""
        def meet(rows: pa.Table, asked: pa.Table) -> pa.Table:
            found = ([], [], [])
            if rows.num_rows and asked.num_rows:
                ids, m, q, names = rows.column("id").to_numpy(), _matrix(rows.column("vector")), _matrix(asked.column("query_vector")), asked.column("query_id").to_numpy()
                for lo in range(0, len(q), step := max(1, BLOCK // len(m))):
                    for name, s in zip(names[lo : lo + step], np.round(m @ q[lo : lo + step].T, 9).T):
                        best = np.flatnonzero(s >= np.partition(s, -k)[-k]) if len(s) > k else np.arange(len(s))
                        best = best[np.lexsort((ids[best], -s[best]))[:k]]
                        found[0].append(np.full(len(best), name))
                        found[1].append(ids[best])
                        found[2].append(s[best])
            columns = [np.concatenate(x) if x else np.empty(0, t) for x, t in zip(found, (np.int64, np.int64, np.float64))]
            return pa.table(dict(zip(("query_id", "id", "score"), columns)))

        q = self._probed(queries, probes or len(self.centroids))
        # A row per list: as many as there are centroids.
        sizes = self.rows.groupBy(F.col("list").alias("_list")).agg(F.ceil(F.count("*") / F.lit(PER_PART)).cast("int").alias("_parts"))
        wanted = q.select(F.col("list").alias("_wanted")).distinct()
        rows = self.rows.join(F.broadcast(wanted), F.col("list") == F.col("_wanted"), "left_semi").join(F.broadcast(sizes), F.col("list") == F.col("_list"))
        rows = rows.select("id", "vector", F.col("list").alias("near"), F.pmod(F.xxhash64("id"), F.col("_parts")).cast("int").alias("part"))
        q = q.join(F.broadcast(sizes), F.col("list") == F.col("_list")).select("query_id", "query_vector", "list", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("part"))
        d = rows.groupBy("near", "part").cogroup(q.groupBy("list", "part")).applyInArrow(meet, "query_id long, id long, score double")
        return ranked(d, "score", "id", ["query_id"]).filter(F.col("rank") <= k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """queries and recall: the share of the exact rows (query_id, id) that were found."""
    d = exact.select("query_id", "id").join(found.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    return d.agg(F.countDistinct("query_id").alias("queries"), F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
