"""Folds over the rows of a document, in order: one shuffle by doc_id, then each task walks through its documents."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows of a batch that goes back to Spark.
TOGETHER = 2048


def by_document(rows: DataFrame, order: str, run: Callable[[list[tuple]], Iterator[tuple]], schema: str) -> DataFrame:
    """What run makes of each document's rows, sorted by `order`; doc_id is their first column. A task holds one document at a time."""
    made = to_arrow_schema(T._parse_datatype_string(schema))

    def batch(held: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), made.types, strict=True)], schema=made)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        all_rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        held: list[tuple] = []
        for _, group in groupby(all_rows, key=itemgetter(0)):
            held += run(list(group))
            for at in range(0, len(held) - TOGETHER + 1, TOGETHER):
                yield batch(held[at : at + TOGETHER])
            held = held[len(held) // TOGETHER * TOGETHER :]
        if held:
            yield batch(held)

    first = "doc_id"
    return rows.select(first, *[c for c in rows.columns if c != first]).repartition(first).sortWithinPartitions(first, order).mapInArrow(walk, schema)
