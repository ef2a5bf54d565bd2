"""Time-range scans of metric samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetpulse.functions.durations import time_range, utc_day


def scan_samples(samples: DataFrame, start_ts: int, end_ts: int, host: str | None = None) -> DataFrame:
    """Samples with `start_ts <= ts <= end_ts`, of one host if `host` is given and not empty.

    Filters only; rows are ordered where order matters (inside windows) or at a sink. If the table has
    the store's `date` partition column, the matching days are added so that other days are never listed.
    """
    rows = samples.filter(F.col("ts").between(start_ts, end_ts))
    if "date" in samples.columns:
        rows = rows.filter(F.col("date").between(utc_day(F.lit(start_ts)), utc_day(F.lit(end_ts))))
    if host:
        rows = rows.filter(F.col("host") == host)
    return rows


def scan_last(
    samples: DataFrame, duration: str, end_ts: int | None = None, host: str | None = None
) -> DataFrame:
    """Samples of the last `duration` (for example `7d`) before `end_ts`, by default the newest sample."""
    bounds = time_range(samples, duration, end_ts)
    if bounds is None:
        return samples.filter(F.lit(False))
    return scan_samples(samples, *bounds, host)
