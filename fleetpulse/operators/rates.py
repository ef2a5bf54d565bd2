"""Rates from cumulative counters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetpulse.plans.segments import SegmentPlan, core_rows, segmented


def counter_rates(rows: DataFrame, counters: Sequence[str], plan: SegmentPlan | None = None) -> DataFrame:
    """Replace each counter by `<counter>_rate` in units per second.

    0.0 on a host's first row, after a reset (the counter fell) and where no time has passed.
    """
    frame, keys = segmented(rows, plan, before=1)
    w = Window.partitionBy(*keys).orderBy("ts", "sample_id")
    elapsed = F.col("ts") - F.lag("ts").over(w)

    def rate(counter: str):
        per_second = (F.col(counter) - F.lag(counter).over(w)) / elapsed
        return F.when(elapsed > 0, F.greatest(F.lit(0.0), per_second)).otherwise(0.0)

    others = [c for c in rows.columns if c not in counters]
    rates = [rate(c).alias(f"{c}_rate") for c in counters]
    return core_rows(frame.select(*others, *[c for c in frame.columns if c in ("in_core", "segment")], *rates))
