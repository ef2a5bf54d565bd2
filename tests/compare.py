"""Run a catalog query and its DuckDB form, and say where they differ."""

from __future__ import annotations

import glob
import os

import duckdb
import pandas as pd

from fleetpulse.catalog.oracles import ORACLES
from fleetpulse.catalog.queries import QUERIES


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path).split(".")[0]
        connection.execute(f"create view {name} as select * from read_parquet('{path}')")
    return connection


def _sorted(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)]
    return frame.sort_values(list(frame.columns), ignore_index=True)


def difference(spark, folder: str, name: str) -> str | None:
    """None if both sides agree in columns, row count and every value."""
    ours = _sorted(QUERIES[name](spark, folder).toPandas())
    theirs = _sorted(connect(folder).execute(ORACLES[name]).df())
    if list(ours.columns) != list(theirs.columns):
        return f"columns {list(ours.columns)} != {list(theirs.columns)}"
    if len(ours) != len(theirs):
        return f"rows {len(ours)} != {len(theirs)}"
    found = []
    for column in ours.columns:
        a, b = ours[column], theirs[column]
        kinds = {a.dtype.kind, b.dtype.kind}
        nullable = kinds == {"i", "f"} and (a.isna().any() or b.isna().any())  # pandas has no NULL integers
        if len(kinds) > 1 and not nullable and kinds - {"O", "T", "U"}:
            found.append(f"{column}: type {a.dtype} != {b.dtype}")
        unequal = ~((a == b) | (a.isna() & b.isna()))
        if unequal.any():
            first = unequal.idxmax()
            found.append(f"{column}: {int(unequal.sum())} differ, first {a[first]!r} != {b[first]!r}")
    return "; ".join(found) or None
