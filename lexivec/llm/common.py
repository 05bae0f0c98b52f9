"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import sys
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexivec.compat import shared_folder, ship_package, spread

#: The white space that separates words: space and the characters U+0009 to U+000D.
SPACE_CHARS = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

#: Parts into which a hot key's rows are dealt.
SALTS = 16

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as read, on all cores even where its files have few parts."""
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def with_python(df: DataFrame) -> DataFrame:
    """df, once its executors can import this package: for what goes through Python functions."""
    ship_package(df.sparkSession)
    return df


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir, which driver and executors share; see `shared_folder`."""
    return shared_folder(spark)


def _gone_at_the_end(spark: SparkSession, path: str) -> None:
    """Lets the path's file system delete it when the driver ends."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)


def durable(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read back: its lineage ends there, and a lost executor costs nothing.

    The table stays until the driver ends, as plans that read it may run at any time before.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lexivec/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _gone_at_the_end(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def trim() -> None:
    """Gives a Python worker's unused memory back to the system, so that workers which wait don't hold their peak."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def with_words(df: DataFrame, text: str, to: str) -> DataFrame:
    """df with array<string> `to`: the words of the non-null text, none if it is blank.

    A space put in front makes the first piece of the split empty in any text; of the others only the last may be empty.
    The split stands in a projection of its own, as it is used more than once.
    """
    d = df.withColumn(to, F.split(F.concat(F.lit(" "), F.col(text)), SPACE_RUN))
    parts = F.col(to)
    return d.withColumn(to, F.slice(parts, 2, F.size(parts) - 1 - F.when(F.element_at(parts, -1) == "", 1).otherwise(0)))


def small_enough(df: DataFrame, bytes_per_row: int, bound: int = 64 << 20) -> bool:
    """Whether df's rows, counted, stay under a byte bound and so may be broadcast."""
    return df.count() * bytes_per_row <= bound


def hinted(df: DataFrame, bytes_per_row: int) -> DataFrame:
    """df with a broadcast hint if its counted size allows one; else as it is, for a shuffled join."""
    return F.broadcast(df) if small_enough(df, bytes_per_row) else df


def salted_join(many: DataFrame, few: DataFrame, keys: list[str], spread: str, how: str = "inner", salts: int = SALTS) -> DataFrame:
    """Join on keys of which one may be that of a third of the rows of `many`; `few` has each key once.

    A row of `many` meets one of `salts` copies of its partner, told by the hash of its column `spread`, so a hot key's rows
    are dealt to as many tasks. Few enough partners are broadcast instead, once they are counted.
    """
    if small_enough(few, 64):
        return many.join(F.broadcast(few), keys, how)
    left = many.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    right = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def null_dealt(*keys: str) -> Column:
    """0, or, for a row that has a null among its keys and so joins with nothing, a number that deals such rows out.

    As one more key of an outer join (0 on the other side) it keeps the rows of null keys from meeting in one task.
    """
    none = F.greatest(*[F.col(k).isNull() for k in keys]) if len(keys) > 1 else F.col(keys[0]).isNull()
    return F.when(none, F.monotonically_increasing_id() % 4093).otherwise(0)


def row_key(text: str = "text") -> list[Column]:
    """_h1, _h2: 128 bits of the text, which with its doc_id tell a row from all but its repetitions; null is as empty."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return [F.xxhash64(t).alias("_h1"), F.xxhash64(F.lit(1), t).alias("_h2")]


def whole_row(docs: DataFrame) -> Column:
    """row: all columns of docs as one struct, so that none clashes with a column on the way; `row.*` gives them back."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")


def one_row_each(docs: DataFrame, members: DataFrame) -> DataFrame:
    """docs without the members (doc_id, _h1, _h2, stays) that don't stay, and with one row of those that repeat.

    Rows that are no members are left alone. Of rows that repeat an id and a text but differ elsewhere, that with the least
    hash of all its columns stays, whatever their types are. Repetitions are reduced before they are shuffled.
    """
    keys = ["doc_id", "_h1", "_h2"]
    same = lambda d: F.col("id").eqNullSafe(d["_id"]) & (F.col("_h1") == d["_g1"]) & (F.col("_h2") == d["_g2"])
    named = lambda d: hinted(d.select(*[F.col(a).alias(b) for a, b in zip(keys, ("_id", "_g1", "_g2"))]), 40)
    gone = named(durable(members.filter("not stays").select(*keys).distinct(), "gone"))
    again = durable(members.filter("stays").groupBy(*keys).count().filter("count > 1"), "again")
    d = docs.select(whole_row(docs), F.col("doc_id").cast("long").alias("id"), *row_key()).join(gone, same(gone), "left_anti")
    if again.isEmpty():
        return d.select("row.*")
    again = named(again)
    one = d.join(again, same(again), "left_semi").groupBy("id", "_h1", "_h2").agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row"))
    return d.join(again, same(again), "left_anti").select("row").union(one.select("row")).select("row.*")
