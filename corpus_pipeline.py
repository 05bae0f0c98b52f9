"""From raw documents to packed sequences: five stages, each a table that the next one reads.

Quality rules, exact dedup, near dedup by n-gram Jaccard join, mixing, packing. All but the last return the columns of
documents. Mixing repeats documents: each copy is packed as a row of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexivec.llm.common import durable, table
from lexivec.llm.exact_dedup import drop_duplicates
from lexivec.llm.mixing import mixed
from lexivec.llm.ngram_join import one_of_each
from lexivec.llm.packing import pack
from lexivec.llm.quality import keep_good


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that pass every rule."""
    return keep_good(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text."""
    return drop_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, its smallest doc_id."""
    return one_of_each(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixed(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all rows, copies included, in their sequences."""
    return pack(docs)


STAGES = [("quality rules", quality), ("exact dedup", exact_dedup), ("n-gram Jaccard join", near_dedup), ("mixing", mixing), ("best-fit packing", packing)]

#: Token ids and packing have no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = durable(docs, "stage")
    return docs
