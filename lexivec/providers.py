"""Stand-ins for external models: deterministic and offline. Their results bear the name `lexical` where they are scores.

`embed` hashes words into a signed vector; `overlap` is the F1 of shared words; `answer` is the best sentence by BM25.
A user with a model replaces them by a function of the same shape.
"""

from __future__ import annotations

import hashlib
import math
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexivec.compat import ship_package
from lexivec.functions.text import tokens

DIMENSIONS = 64


def embed_text(text: str | None, dimensions: int = DIMENSIONS) -> list[float]:
    out = [0.0] * dimensions
    for w in re.findall(r"\w{3,}", (text or "").lower()):
        h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
        out[h % dimensions] += 1.0 if h >> 63 else -1.0
    length = math.sqrt(sum(x * x for x in out))
    return [x / length for x in out] if length else out


def embed(df: DataFrame, text: str, to: str, dimensions: int = DIMENSIONS) -> DataFrame:
    """df with an embedding of a text column, by Arrow batches."""
    ship_package(df.sparkSession)
    schema = T.StructType([*df.schema.fields, T.StructField(to, T.ArrayType(T.FloatType()))])

    def rows(batches):
        for batch in batches:
            v = [embed_text(x, dimensions) for x in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(v, pa.list_(pa.float32()))], names=[*batch.schema.names, to])

    return df.mapInArrow(rows, schema)


def overlap(a: Column, b: Column) -> Column:
    """F1 of the words that two texts share; 0 if either has none. Stands for a cross-encoder (`cross_lexical`)."""
    return overlap_of(F.array_distinct(tokens(a)), F.array_distinct(tokens(b)))


def overlap_of(x: Column, y: Column) -> Column:
    """`overlap` of two texts' distinct words."""
    both = F.size(F.array_intersect(x, y))
    return F.coalesce(F.try_divide(2.0 * both, F.size(x) + F.size(y)), F.lit(0.0))


def support(answer: Column, context: Column) -> Column:
    """Share of an answer's words that the context has: stands for a judge of faithfulness (`support_lexical`)."""
    x = F.array_distinct(tokens(answer))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(x, tokens(context))).cast("double"), F.size(x)), F.lit(0.0))


def judged(reply: Column, default: float) -> Column:
    """Score of a judge's reply, JSON or the first number in it, between 0 and 1; the default if there is none."""
    clean = F.regexp_replace(reply, r"```(?:json)?", "")
    score = F.coalesce(F.get_json_object(clean, "$.score").try_cast("double"), F.nullif(F.regexp_extract(clean, r"-?[0-9]*\.?[0-9]+", 0), F.lit("")).try_cast("double"))
    return F.when(score.isNull(), F.lit(default)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)))


def sub_questions(reply: Column, query: Column) -> Column:
    """array<string> of a decomposition's JSON reply, or the query alone."""
    clean = F.trim(F.regexp_replace(reply, r"```(?:json)?", ""))
    parsed = F.from_json(clean, "array<string>")
    return F.when(F.size(F.coalesce(parsed, F.array().cast("array<string>"))) > 0, parsed).otherwise(F.array(query))
