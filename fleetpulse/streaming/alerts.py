"""Alert cooldown on a stream, and delivery to a table."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fleetpulse.operators.alerts import COOLDOWN_SECONDS, Rule, raise_alerts
from fleetpulse.streaming.ordered import CLOCK, DELAY_SECONDS, KEEP_SECONDS, Rows, in_order, on_clock

TEXTS = {"rule_order": "int", "severity": "string", "message": "string"}


def alert_stream(
    rows: DataFrame,
    rules: Sequence[Rule],
    cooldown: int = COOLDOWN_SECONDS,
    delay: int = DELAY_SECONDS,
    keep: int = KEEP_SECONDS,
) -> DataFrame:
    """Alerts of a stream after the cooldown, equal to `apply_cooldown` on the same rows, plus late alerts marked as such.

    All rows move the watermark, but only alerts reach the state, in which a host and rule remembers when it last fired.
    """

    def step(chunk: Rows, before: tuple | None) -> tuple[pd.DataFrame, tuple]:
        fired_at, kept = before[0] if before else 0, []
        for place, second in enumerate(chunk["ts"].tolist()):
            if second - fired_at >= cooldown:
                kept.append(place)
                fired_at = second
        found = {c: chunk[c][kept] for c in TEXTS}
        return pd.DataFrame({"at": kept, **found}), (fired_at,)

    alerts = raise_alerts(on_clock(rows, delay, keep), rules, keep=[CLOCK])
    result = in_order(alerts, ["host", "rule"], TEXTS, step, TEXTS, "fired_at long", tie=["rule_order"])
    return result.select("sample_id", "host", "ts", "rule_order", "rule", "severity", "message", "late")


def deliver(stream: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Append a stream to a table. A repeated micro-batch replaces its own partition."""

    def store(batch: DataFrame, batch_id: int) -> None:
        writer = batch.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").partitionBy("batch")
        writer.option("partitionOverwriteMode", "dynamic").parquet(path)

    return (
        stream.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(**(trigger or {"processingTime": "1 second"}))
        .start()
    )
