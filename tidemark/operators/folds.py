"""Folds over each key's rows in their order, with memory for one key's state and one batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def fold_sorted(rows: DataFrame, key: str, order: list[str], start: Callable[[], object], step: Callable[[object, dict], tuple], columns: str) -> DataFrame:
    """``step(state, row)`` for every row of a key in order, each giving one row of ``columns``; ``start()`` begins a key.

    Rows are dealt by key and sorted by key and order on disk, then read once: however many rows a key has, a task
    holds its state and one batch. A null key is a key.
    """
    schema = StructType.fromDDL(columns)
    kinds = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state, begun = None, None, False
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if not begun or row[key] != at:
                    at, state, begun = row[key], start(), True
                out.append(step(state, row))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind.type) for k, kind in enumerate(kinds)], schema.names)

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)
