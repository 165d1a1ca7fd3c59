"""Folds: columns that depend on every row before, within a key.

Rows are dealt by key and sorted in their partition (Spark spills what doesn't fit), and stream through a small step function that carries
the state. Time is linear in the rows and memory is one batch, however many rows a key has. A key is one task's work: such a
fold is serial by its meaning.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

from granary.session import importable


def scan(df: DataFrame, keys: list[str], order: list[Column], read: dict[str, Column], start, step: Callable, out: dict[str, T.DataType]) -> DataFrame:
    """df with the columns of `out` appended: step(state, values of `read`) gives the next state and the row's values, from `start` on for each key."""
    importable(df.sparkSession)
    names = df.columns
    given = df.select("*", *[c.alias(f"__read_{n}") for n, c in read.items()])
    dealt = given.repartition(*keys) if keys else given.repartition(1)
    dealt = dealt.sortWithinPartitions(*keys, *order)
    schema = T.StructType([*df.schema.fields, *[T.StructField(n, t) for n, t in out.items()]])
    kinds = [pa_type(t) for t in out.values()]
    columns = [f"__read_{n}" for n in read]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, start
        for batch in batches:
            found: list[list] = [[] for _ in kinds]
            at = batch.schema.names.index
            of = zip(*[batch.column(at(c)).to_pylist() for c in keys], strict=True) if keys else [()] * batch.num_rows
            for k, *values in zip(of, *[batch.column(at(c)).to_pylist() for c in columns], strict=True):
                if k != key:
                    key, state = k, start
                state, row = step(state, *values)
                for column, x in zip(found, row, strict=True):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([*[batch.column(at(c)) for c in names], *[pa.array(x, t) for x, t in zip(found, kinds, strict=True)]], names=[*names, *out])

    return dealt.mapInArrow(work, schema)


def pa_type(t: T.DataType) -> pa.DataType:
    return {"string": pa.string(), "boolean": pa.bool_(), "bigint": pa.int64()}[t.simpleString()]
