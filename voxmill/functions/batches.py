"""Python functions over Arrow batches, a slice at a time, so that a worker's memory follows the slice and not the table."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Bytes of a slice of a batch, whose values are Python objects at once; a longer row is a slice of its own.
SLICE_BYTES = 1 << 18


def slices(*columns: pa.Array) -> Iterator[tuple[int, int]]:
    """(start, length) of runs of rows of some ``SLICE_BYTES`` each; a batch without rows is one run."""
    rows = len(columns[0])
    size = sum(c.nbytes for c in columns)
    # rows of uneven length are cut again, so that none of the runs has many of the long ones
    stack = [(0, rows, size)]
    while stack:
        start, length, size = stack.pop()
        if length < 2 or size <= SLICE_BYTES:
            yield start, length
            continue
        half = length // 2
        left = sum(c.slice(start, half).nbytes for c in columns)
        stack += [(start + half, length - half, size - left), (start, half, left)]


def mapped(f: Callable[..., Any], kind: pa.DataType, batches: Iterator[tuple[pa.Array, ...]], nulls: bool = False) -> Iterator[pa.Array]:
    """``f`` of each row of batches of columns, an array for each slice."""
    for batch in batches:
        for start, length in slices(*batch):
            rows = zip(*(a.slice(start, length).to_pylist() for a in batch))
            yield pa.array([f(*row) if nulls or not any(x is None for x in row) else None for row in rows], kind)


def each(f: Callable[..., Any], kind: T.DataType, *columns: Column, nulls: bool = False) -> Column:
    """``f`` of each row's values; null where one of them is null, unless ``nulls`` are for ``f`` to see."""
    arrow = to_arrow_type(kind)

    # the hints choose the kind of UDF
    def one(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return mapped(f, arrow, ((batch,) for batch in batches), nulls)

    def many(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        return mapped(f, arrow, batches, nulls)

    return F.arrow_udf(many if len(columns) > 1 else one, kind)(*columns)
