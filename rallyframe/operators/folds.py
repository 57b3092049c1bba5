"""Sequential folds: rows of a key stream through a task in order, with the fold's own state as the only memory."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Rows that leave a fold at a time, also those of its end.
ROWS = 10_000


def streamed(rows: DataFrame, pool: list[str], order: list[str], start: Callable, schema: T.StructType) -> DataFrame:
    """pool and the columns of schema: what a fold emits for the rows of each pool in order.

    start(key) makes the fold of a pool; its ``row(dict)`` and, after the last row, ``end()`` yield tuples of schema's columns.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    whole = T.StructType([*rows.select(*pool).schema, *schema])
    arrow = to_arrow_schema(whole)

    def emitted(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        key, fold = None, None
        for batch in batches:
            for row in batch.to_pylist():
                own = tuple(row[c] for c in pool)
                if fold is None or own != key:
                    if fold is not None:
                        yield from ((*key, *x) for x in fold.end())
                    key, fold = own, start(own)
                for x in fold.row(row):
                    yield (*key, *x)
        if fold is not None:
            yield from ((*key, *x) for x in fold.end())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = emitted(batches)
        while out := list(islice(found, ROWS)):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

    return rows.repartition(*pool).sortWithinPartitions(*pool, *order).mapInArrow(run, whole)
