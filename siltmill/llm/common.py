"""Shared plumbing of the corpus operators: Arrow maps over texts, scratch tables, small codecs."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..scratch import written  # noqa: F401 - for the other modules here

#: Rows that a worker turns into Python objects at a time. Arrow batches themselves are bounded in bytes by Spark
#: (spark.sql.execution.arrow.maxBytesPerBatch, 64 MB unless set).
BATCH_ROWS = 1000


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The non-empty batches in slices of at most BATCH_ROWS rows."""
    for batch in batches:
        for i in range(0, batch.num_rows, BATCH_ROWS):
            yield batch.slice(i, BATCH_ROWS)


def texts_of(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only (doc_id, text) of a table, whatever else it holds."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], dict]], schema: str) -> DataFrame:
    """Maps Arrow batches to dictionaries of output columns.

    ``make`` runs once in each task and returns the function for a batch, so what it builds (automata,
    caches) lives as long as the task and no longer.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for batch in slices(batches):
            yield pa.RecordBatch.from_pydict(each(batch), schema=arrow)

    return df.mapInArrow(run, schema)


def append_columns(df: DataFrame, column: str, make: Callable[[], Callable[[list], dict]], added: str) -> DataFrame:
    """All columns of ``df`` and those of the DDL ``added``, computed from one string column in the same task.

    The added names must be free in ``df``: ``free_name`` gives such names.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    names = [*df.columns, *StructType.fromDDL(added).names]
    # Numbered names, since a map's columns are looked up by name and names may hold anything.
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    out = StructType([*plain.schema.fields, *StructType.fromDDL(added).fields])

    arrow = to_arrow_schema(StructType.fromDDL(added))
    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for batch in slices(batches):
            new = each(batch.column(at).to_pylist())
            arrays = [pa.array(new[f.name], f.type) for f in arrow]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], names=[*batch.schema.names, *arrow.names])

    return plain.mapInArrow(run, out).toDF(*names)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores before it as make it differ from every column, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


class Generations(dict):
    """A memo of bounded size: when it is full, what was not used since the last time goes.

    Subclasses or callers give ``compute``; lookups are ordinary dictionary lookups.
    """

    def __init__(self, compute: Callable, limit: int = 150_000):
        super().__init__()
        self.compute, self.limit, self.old = compute, limit, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


def crc32_combine(first: int, second: int, length: int) -> int:
    """CRC-32 of two concatenated strings from their CRCs and the second one's length in bytes."""
    if not length:
        return first

    def times(matrix: list[int], vector: int) -> int:
        out, i = 0, 0
        while vector:
            if vector & 1:
                out ^= matrix[i]
            vector >>= 1
            i += 1
        return out

    # The operator that appends one zero bit; squaring it doubles the number of bits.
    power = [0xEDB88320, *(1 << i for i in range(31))]
    for _ in range(3):
        power = [times(power, column) for column in power]
    while length:
        if length & 1:
            first = times(power, first)
        power = [times(power, column) for column in power]
        length >>= 1
    return first ^ second


def crc32(data: bytes) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF
