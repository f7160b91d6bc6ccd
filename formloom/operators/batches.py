"""Groups of rows handed to Python many at a time: in order, none of them cut, without a call for each."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def map_whole(df: DataFrame, keys: list[str], order: list[Column], columns: list[str], function: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """function over tables of whole groups of rows with equal keys, each group's rows in order: `columns`, and k, which is 1 for a group's first row.

    The numbering deals rows by keys only if they are not dealt so yet, and leaves them sorted. A table has the groups
    that end in one of Arrow's batches, so no more than a batch and a group are held.
    """

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            begins = batch.column("k").to_numpy() == 1
            if begins.any():
                last = len(begins) - 1 - int(begins[::-1].argmax())
                if done := [b for b in (*held, batch.slice(0, last)) if len(b)]:
                    yield from function(pa.Table.from_batches(done).combine_chunks())
                held, batch = [], batch.slice(last)
            held.append(batch)
        if done := [b for b in held if len(b)]:
            yield from function(pa.Table.from_batches(done).combine_chunks())

    numbered = df.withColumn("k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return numbered.sortWithinPartitions(*keys, *order).select("k", *columns).mapInArrow(whole, schema)
