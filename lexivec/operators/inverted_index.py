"""Stored inverted index: postings in blocks with bounds, appended batch by batch, searched by block-max pruning.

A block holds a term's postings of one small group of documents, with the greatest frequency and the least length in it;
from these the greatest score that any document of the group can have under a query follows, whatever was appended since.
The groups of greatest bounds are scored first; their kth score is a floor, and groups whose bound lies under it are never
read. The result is that of scoring everything.

Groups are made where the texts are read, so neither texts nor postings are moved to be stored. A posting is a document's place
in its group and a frequency; a row without a term, in a folder of its own, has the group's ids and lengths.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexivec.compat import shared_folder, ship_package, written
from lexivec.functions.text import _word_counts
from lexivec.operators.retrieval import _idf, _qtf, _query_terms, _tfn, ranked, sent_if_few
from lexivec.operators.sparse import best_products

#: Documents of a group, at most; folders of terms; groups scored before any is left out, per query.
PER_GROUP, FOLDERS, FIRST = 256, 64, 8
BLOCK = "term string, grp bigint, at array<smallint>, tf array<int>, ids array<bigint>, most bigint, least bigint"
#: Folder of the groups' ids and lengths.
GROUPS = -1


def _blocks_of(number: int, ids: pa.Array, texts: pa.Array) -> pa.RecordBatch:
    """The blocks of a group of documents, texts in lower case, and the row of its ids and lengths."""
    counts = _word_counts(texts, True)
    words, row = counts.flatten(), np.repeat(np.arange(len(counts)), pc.list_value_length(counts).to_numpy())
    tf = words.field("tf").to_numpy()
    size = np.bincount(row, tf, minlength=len(counts)).astype(np.int64)
    coded = words.field("term").dictionary_encode()
    code = coded.indices.to_numpy()
    order = np.lexsort((row, code))
    code, row, tf = code[order], row[order], tf[order]
    first = np.flatnonzero(np.diff(code, prepend=-1))
    n, ends = len(first), np.append(first, len(code)).astype(np.int32)
    lists = lambda values, kind: pa.ListArray.from_arrays(pa.array(ends), pa.array(values, kind))
    one = lambda values, kind: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values.cast(kind))
    none = lambda k, kind: pa.nulls(k, kind)
    whole = lambda a, b: pa.concat_arrays([a, b])
    small, ints, longs = (pa.list_(t) for t in (pa.int16(), pa.int32(), pa.int64()))
    most, least = (f.reduceat(v, first) if n else v[:0] for f, v in ((np.maximum, tf), (np.minimum, size[row])))
    columns = {
        "term": whole(coded.dictionary.take(pa.array(code[first])), none(1, pa.string())), "grp": pa.array(np.full(n + 1, number), pa.int64()),
        "at": whole(lists(row, pa.int16()), none(1, small)), "tf": whole(lists(tf, pa.int32()), one(pa.array(size), pa.int32())),
        "ids": whole(none(n, longs), one(ids, pa.int64())), "most": whole(pa.array(most, pa.int64()), none(1, pa.int64())), "least": whole(pa.array(least, pa.int64()), none(1, pa.int64())),
    }
    return pa.RecordBatch.from_pydict(columns)


class Asked(NamedTuple):
    """What a search scores: blocks of its terms (t), groups' ids and lengths, weights (query_id, t, weight, avgdl), how many rows of
    each query are wanted, and the number of postings."""

    blocks: DataFrame
    groups: DataFrame
    weights: DataFrame
    top_k: int
    postings: int


def _postings(rows: pa.Table, asked: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Ids in order, and the rows, terms and parts of scores of the postings in blocks, beside the groups' ids and lengths."""
    batch = rows.column("batch").combine_chunks().dictionary_encode()
    batch = batch.combine_chunks() if isinstance(batch, pa.ChunkedArray) else batch
    grp, group = np.unique(rows.column("grp").to_numpy(), return_inverse=True)
    group = batch.indices.to_numpy().astype(np.int64) * len(grp) + group
    rows = rows.append_column("group", pa.array(group))
    docs, blocks = rows.filter(pc.is_valid(rows.column("ids"))), rows.filter(pc.is_valid(rows.column("t")))
    flat = lambda d, c: d.column(c).combine_chunks().flatten().to_numpy()
    size = pc.list_value_length(docs.column("ids").combine_chunks()).to_numpy()
    start = np.full(len(grp) * len(batch.dictionary), -1)
    start[docs.column("group").to_numpy()] = np.cumsum(size) - size
    held = pc.list_value_length(blocks.column("at").combine_chunks()).to_numpy()
    row = np.repeat(start[blocks.column("group").to_numpy()], held) + flat(blocks, "at")
    x = _tfn(flat(blocks, "tf").astype(float), flat(docs, "tf")[row], asked.column("avgdl")[0].as_py())
    ids = flat(docs, "ids")
    order = np.argsort(ids, kind="stable")
    to = np.empty(len(order), np.int64)
    to[order] = np.arange(len(order))
    return pa.array(ids[order]), to[row], np.repeat(blocks.column("t").to_numpy(), held), x


class InvertedIndex:
    """An index under `path`: postings by folder of terms, document frequencies, and sizes of the batches.

    Without a path it lies in the shared folder, and is deleted when the driver ends.
    """

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or f"{shared_folder(spark)}/lexivec/postings-{uuid.uuid4().hex}"
        if path is None:
            where = spark._jvm.org.apache.hadoop.fs.Path(self.path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)

    def append(self, docs: DataFrame, batch: str | None = None) -> InvertedIndex:
        """Adds docs (id, text), each text tokenised once; an id is in one batch. A batch that is written again under its name
        replaces itself, so a repeated run leaves no second copy."""
        ship_package(self.spark)
        name, most, docs = batch or uuid.uuid4().hex, PER_GROUP, docs.select("id", "text")
        twice = docs.groupBy("id").count().filter("count > 1").select("id")
        texts = docs
        if not twice.isEmpty():
            # The texts of one id count as one.
            twice = sent_if_few(twice, "id")
            one = docs.join(twice, "id", "left_semi").groupBy("id").agg(F.array_join(F.collect_list("text"), " ").alias("text"))
            texts = docs.join(twice, "id", "left_anti").unionByName(one)

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            number = TaskContext.get().partitionId() << 32
            for b in batches:
                for lo in range(0, b.num_rows, most):
                    yield _blocks_of(number, b.column(0).slice(lo, most), b.column(1).slice(lo, most))
                    number += 1

        p = texts.select("id", F.lower("text").alias("text")).mapInArrow(cut, BLOCK)
        p = p.withColumn("folder", F.when(F.col("term").isNull(), GROUPS).otherwise(F.pmod(F.xxhash64("term"), F.lit(FOLDERS))).cast("int"))
        p.sortWithinPartitions("folder", "term").write.mode("overwrite").partitionBy("folder").parquet(f"{self.path}/postings/batch={name}")
        # From here on only what was written is read, so texts are tokenised once.
        posted = self.spark.read.schema(BLOCK + ", folder int").parquet(f"{self.path}/postings/batch={name}")
        posted.filter(F.col("folder") != GROUPS).groupBy("term").agg(F.sum(F.size("tf")).alias("df")).write.mode("overwrite").parquet(f"{self.path}/terms/batch={name}")
        words = posted.filter(F.col("folder") == GROUPS).select(F.explode("tf").alias("dl")).agg(F.coalesce(F.sum("dl"), F.lit(0)).alias("words"))
        docs.agg(F.count("*").alias("n")).crossJoin(words).write.mode("overwrite").parquet(f"{self.path}/sizes/batch={name}")
        return self

    def _read(self, what: str, schema: str) -> DataFrame:
        return self.spark.read.option("basePath", f"{self.path}/{what}").schema(schema + ", batch string" + (", folder int" if what == "postings" else "")).parquet(f"{self.path}/{what}")

    @property
    def postings(self) -> DataFrame:
        """term, grp, at, tf, most, least, batch, folder: places in the group, and frequencies."""
        return self._read("postings", BLOCK).filter(F.col("folder") != GROUPS).drop("ids")

    @property
    def groups(self) -> DataFrame:
        """batch, grp, ids, tf: the documents of each group by their places, and their lengths."""
        return self._read("postings", BLOCK).filter(F.col("folder") == GROUPS).select("batch", "grp", "ids", "tf")

    def search(self, queries: DataFrame, top_k: int, stemmed: bool = True) -> DataFrame:
        """query_id, id, score, rank: the best top_k documents that match, under each query (query_id, query_text)."""
        q = written(_query_terms(queries, stemmed), "terms")
        size = self._read("sizes", "n bigint, words bigint").agg(F.sum("n").alias("n"), (F.sum("words") / F.nullif(F.sum("n"), F.lit(0))).alias("avgdl"))
        df = self._read("terms", "term string, df bigint").join(sent_if_few(q.select("term").distinct(), "term"), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
        # Terms have numbers, which are written, so that they stay.
        terms = df.withColumn("t", F.monotonically_increasing_id()).withColumn("folder", F.pmod(F.xxhash64("term"), F.lit(FOLDERS)).cast("int"))
        terms = written(terms, "numbers")
        w = written(q.join(terms, "term").crossJoin(F.broadcast(size)).select("query_id", "t", "avgdl", (F.col("qf") * _idf(F.col("n"), F.col("df")) * _qtf(F.col("qf"))).alias("weight")), "weights")
        blocks = self.postings.join(sent_if_few(terms.select("folder", "term", "t"), "term"), ["folder", "term"])
        # The bounds need the blocks' two numbers alone, so the scan leaves the postings out; a group's bounds are added up where it is.
        bound = blocks.select("batch", "grp", "t", "most", "least").repartition("batch", "grp").join(sent_if_few(w, "t"), "t")
        bound = written(bound.groupBy("query_id", "batch", "grp").agg(F.sum(F.col("weight") * _tfn(F.col("most"), F.col("least"), F.col("avgdl"))).alias("bound")), "bounds")
        order = ranked(bound.withColumn("at", F.struct("batch", "grp")), "bound", "at", ["query_id"], "place")
        first = order.filter(F.col("place") <= FIRST)
        asked = Asked(blocks, self.groups, w, top_k, terms.agg(F.sum("df")).first()[0] or 0)
        floor = ranked(self._scored(asked, first), "score", "id", ["query_id"]).filter(F.col("rank") == top_k).select("query_id", F.col("score").alias("floor"))
        # Scores are rounded to six places, the bounds are not: half of the last one keeps ties at the floor.
        able = bound.join(written(floor, "floors"), "query_id", "left").filter(F.col("floor").isNull() | (F.col("bound") >= F.col("floor") - 1e-6))
        return ranked(self._scored(asked, able), "score", "id", ["query_id"]).filter(F.col("rank") <= top_k)

    @staticmethod
    def _scored(asked: Asked, groups: DataFrame) -> DataFrame:
        """query_id, id, score of the best documents of these groups (query_id, batch, grp), under all queries."""
        here = sent_if_few(groups.select("batch", "grp").distinct(), "grp")
        rows = asked.blocks.select("batch", "grp", "t", "at", "tf").unionByName(asked.groups, allowMissingColumns=True)
        return best_products(rows.join(here, ["batch", "grp"], "left_semi"), asked.weights, asked.top_k, asked.postings, T.LongType(), ("batch", "grp"), _postings, ("avgdl",))
