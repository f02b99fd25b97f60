"""Small bounded groups handed to a Python function inside tasks, without one pandas frame per group."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tallyloom.session import checkpointed


def to_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def map_groups(df: DataFrame, keys: list[str], order: list[str], f: Callable[[tuple, list[tuple]], Iterable[tuple]], schema: str | T.StructType) -> DataFrame:
    """``f(key, rows)`` for each group of ``keys``, its rows sorted by ``order``; rows hold ``keys``, then ``order``, then
    the other columns. A group is held in memory: callers pre-aggregate so that its size has a bound."""
    out = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    arrow, n = to_arrow_schema(out), len(keys)
    rest = [c for c in df.columns if c not in keys and c not in order]
    placed = df.select(*keys, *order, *rest).repartition(*keys).sortWithinPartitions(*keys, *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        stream = (row for b in batches for row in zip(*[c.to_pylist() for c in b.columns], strict=True))
        for key, group in groupby(stream, key=lambda r: r[:n]):
            rows.extend(f(key, list(group)))
            if len(rows) > 20_000:
                yield to_batch(rows, arrow)
                rows = []
        yield to_batch(rows, arrow)

    return placed.mapInArrow(run, out)


def small(df: DataFrame, most: int) -> DataFrame:
    """A table computed once and sent to all tasks of the join it is used in if it has at most ``most`` rows; a larger one
    is joined by its keys."""
    kept = checkpointed(df)
    return F.broadcast(kept) if kept.count() <= most else kept
