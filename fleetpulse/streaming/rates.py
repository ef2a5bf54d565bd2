"""Counter rates on a stream."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from fleetpulse.streaming.ordered import DELAY_SECONDS, KEEP_SECONDS, Rows, in_order, on_clock


def counter_rate_stream(
    rows: DataFrame, counters: Sequence[str], delay: int = DELAY_SECONDS, keep: int = KEEP_SECONDS
) -> DataFrame:
    """`sample_id, ts, host, <counter>_rate.., late`, equal to `counter_rates` on the same rows, in whatever order they come.

    A host remembers time and counters of its last row.
    """
    counters = list(counters)

    def step(chunk: Rows, before: tuple | None) -> tuple[pd.DataFrame, tuple]:
        first = before or tuple(chunk[c][0] for c in ("ts", *counters))
        seconds = np.diff(chunk["ts"], prepend=first[0])
        found = {"at": np.arange(len(seconds))}
        for counter, value in zip(counters, first[1:]):
            change = np.diff(chunk[counter], prepend=value)
            rate = np.divide(change, seconds, out=np.zeros(len(seconds)), where=seconds > 0)
            found[f"{counter}_rate"] = np.maximum(0.0, rate)
        end = (int(chunk["ts"][-1]), *(float(chunk[c][-1]) for c in counters))
        return pd.DataFrame(found), end

    return in_order(
        on_clock(rows, delay, keep),
        ["host"],
        dict.fromkeys(counters, "double"),
        step,
        {f"{c}_rate": "double" for c in counters},
        ", ".join(["last_ts long", *[f"last_{c} double" for c in counters]]),
    )
