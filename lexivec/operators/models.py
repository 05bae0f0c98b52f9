"""Calls of models as an operator: one model a worker, rows in batches, retries, and a null where a row's call fails.

A reply is what decides a score later, so a caller that uses it twice writes it first (`compat.written`): the model is then
asked once, also when executors are lost.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from lexivec.compat import ship_package

#: A model takes a list of rows, each a tuple of the inputs' values, and gives as many replies in their order.
Model = Callable[[list[tuple]], list]

#: Models that this worker made, by the call that wanted them: workers outlive their tasks. The oldest goes when there are many.
_MADE: dict[str, Model] = {}
_KEPT = 4


def _model(key: str, make: Callable[[], Model]) -> Model:
    if key not in _MADE:
        while len(_MADE) >= _KEPT:
            _MADE.pop(next(iter(_MADE)))
        _MADE[key] = make()
    return _MADE[key]


def _replies(model: Model, rows: list[tuple], tries: int, wait: float) -> list:
    """The model's replies; an error if all tries fail, or if it gives more or fewer than it was asked for."""
    for k in range(tries):
        try:
            out = list(model(rows))
            if len(out) == len(rows):
                return out
            problem: Exception = ValueError(f"{len(out)} replies to {len(rows)} rows")
        except Exception as e:  # noqa: BLE001
            problem = e
        if k + 1 < tries:
            time.sleep(wait * 2**k)
    raise problem


def _typed(reply, kind: pa.DataType) -> tuple[object, str | None]:
    """A reply of the wanted type and no error, or null and what is wrong with it."""
    try:
        return pa.scalar(reply, kind).as_py(), None
    except (pa.ArrowInvalid, pa.ArrowTypeError, OverflowError) as e:
        return None, str(e)


def _asked(model: Model, rows: list[tuple], kind: pa.DataType, tries: int, wait: float) -> list[tuple[object, str | None]]:
    """Reply and error of each row: the batch at once, and row by row once its tries are used up."""
    if not rows:
        return []
    try:
        return [_typed(r, kind) for r in _replies(model, rows, tries, wait)]
    except Exception as e:  # noqa: BLE001
        if len(rows) == 1:
            return [(None, f"{type(e).__name__}: {e}")]
    return [x for r in rows for x in _asked(model, [r], kind, 1, wait)]


def call(df: DataFrame, inputs: list[str], make: Callable[[], Model], to: str = "reply", kind: str = "string", batch: int = 32, tries: int = 3, wait: float = 0.5) -> DataFrame:
    """df with the model's reply to each row, and `<to>_error`, null where the call succeeded; columns of these names go.

    make() gives the model; each worker process makes one and keeps it. It is asked `batch` rows at a time, as tuples of
    the input columns, at most `tries` times with waits that double; a batch that fails throughout is asked once more row by
    row, so that one bad row spoils no other. A row with a null input is not asked, and has neither reply nor error. Equal
    rows are asked each for itself. An error in make() ends the task, as no row could be answered; Spark tries it again.
    """
    ship_package(df.sparkSession)
    error = f"{to}_error"
    d = df.drop(to, error)
    wanted = T._parse_datatype_string(kind)
    schema = T.StructType([*d.schema.fields, T.StructField(to, wanted), T.StructField(error, T.StringType())])
    arrow, key = to_arrow_type(wanted), uuid.uuid4().hex

    def rows(batches):
        for b in batches:
            columns = [b.column(b.schema.get_field_index(c)).to_pylist() for c in inputs]
            asked = [(k, r) for k, r in enumerate(zip(*columns)) if None not in r]
            out: list[tuple[object, str | None]] = [(None, None)] * b.num_rows
            for at in range(0, len(asked), batch):
                part = asked[at : at + batch]
                for (k, _), x in zip(part, _asked(_model(key, make), [r for _, r in part], arrow, tries, wait)):
                    out[k] = x
            new = [pa.array([r for r, _ in out], arrow), pa.array([e for _, e in out], pa.string())]
            yield pa.RecordBatch.from_arrays([*b.columns, *new], names=[*b.schema.names, to, error])

    return d.mapInArrow(rows, schema)


def failures(called: DataFrame, to: str = "reply") -> DataFrame:
    """error, n of a call's rows that failed."""
    return called.filter(F.col(f"{to}_error").isNotNull()).groupBy(F.col(f"{to}_error").alias("error")).agg(F.count("*").alias("n"))
