"""Ordered scans: a small state per key, carried over the key's rows in order.

Recursive kernels, lot matching, backtests and limiters need the result of the row before. Rows are
clustered by key and sorted by Spark, and pass through Python in Arrow batches; the state of the
current key is all that is held, so a key may have any number of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any, Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


class Machine(Protocol):
    """State of one key."""

    def step(self, row: dict[str, Any]) -> Iterator[tuple]:
        """Output rows, without the keys, for the next row."""

    def finish(self) -> Iterator[tuple]:
        """Output rows after the last row."""


def ordered_scan(df: DataFrame, keys: list[str], order: list[Any], columns: list[str], machine: Callable[..., Machine], out: T.StructType, clustered: bool = False) -> DataFrame:
    """Runs a new ``machine(*key values)`` over the rows of each key, in ``order``.

    Machines see ``columns``; the result has the keys and the fields of ``out``. ``clustered`` says that all rows
    of a key are in one partition already, as after a window or aggregation by these keys. Null is a
    key like any other. An empty table gives an empty one.
    """
    schema = T.StructType([*(f for f in df.select(*keys).schema), *out])
    names, arrow = [f.name for f in schema], to_arrow_schema(schema)
    rows = df if clustered else df.repartition(*keys)
    rows = rows.sortWithinPartitions(*keys, *order).select(*keys, *[c for c in columns if c not in keys])

    def run(batches):
        current, state, found = None, None, []

        def flush() -> pa.RecordBatch:
            cols = list(zip(*found, strict=True)) if found else [()] * len(names)
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow, strict=True)], names=names)
            found.clear()
            return batch

        for batch in batches:
            for row in batch.to_pylist():
                key = tuple(row[k] for k in keys)
                if state is None or key != current:
                    if state is not None:
                        found.extend(current + x for x in state.finish())
                    current, state = key, machine(*key)
                found.extend(key + x for x in state.step(row))
            if found:
                yield flush()
        if state is not None:
            found.extend(current + x for x in state.finish())
        if found:
            yield flush()

    return rows.mapInArrow(run, schema)
