"""Small helpers that several operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def columns(df: DataFrame, **kinds: str) -> DataFrame:
    """Only the named columns, cast to the given types, so that other columns cannot clash with ours."""
    return df.select(*[F.col(f"`{name}`").cast(kind).alias(name) for name, kind in kinds.items()])


def arrow_map(df: DataFrame, work: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """`work` on each Arrow batch of `df`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from work(batch)

    return df.mapInArrow(run, schema)


def list_array(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    """One list per part."""
    offsets = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int32)
    values = np.concatenate(parts) if parts else np.empty(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64) if values.dtype == np.uint64 else values, kind))


def longs(values: np.ndarray) -> pa.Array:
    """Numbers of 64 bits as Spark's long."""
    return pa.array(values.view(np.int64) if values.dtype == np.uint64 else values, pa.int64())


def fold(column: Column, folds: int) -> Column:
    """A fixed pseudo-random whole number in [0, folds) for each value, spread evenly."""
    return F.pmod(F.xxhash64(column, F.lit(folds)), F.lit(folds))
