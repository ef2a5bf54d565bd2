"""Continuous validated ingestion into the day-partitioned store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fleetpulse.functions.durations import utc_day
from fleetpulse.schema import SAMPLE_COLUMNS
from fleetpulse.sources.store import validate_samples


def ingest_stream(
    rows: DataFrame, path: str, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Write complete rows of a stream to `path` and the others to `<path>_rejected`.

    Each micro-batch overwrites its own `batch` partition, so a batch that is repeated after a failure
    leaves no duplicates. The source's rate limit (`maxFilesPerTrigger`, `maxOffsetsPerTrigger`) is the
    back-pressure: rows wait, none is dropped. The accepted and rejected counts of each micro-batch are in
    the query's progress under `observedMetrics["ingest"]`.
    """
    checked = validate_samples(rows).observe(
        "ingest",
        F.count_if(F.col("missing") == "").alias("accepted"),
        F.count_if(F.col("missing") != "").alias("rejected"),
    )
    columns = ["sample_id", *SAMPLE_COLUMNS]

    def store(batch: DataFrame, batch_id: int) -> None:
        batch = batch.withColumn("batch", F.lit(batch_id)).persist()  # two writes, one read of the source
        accepted = batch.filter("missing = ''").withColumn("date", utc_day(F.col("ts")))
        for part, extra, by, target in (
            (accepted, ["batch", "date"], ["date", "batch"], path),
            (batch.filter("missing != ''"), ["missing", "batch"], ["batch"], f"{path}_rejected"),
        ):
            writer = part.select(*columns, *extra).write.mode("overwrite").partitionBy(*by)
            writer.option("partitionOverwriteMode", "dynamic").parquet(target)
        batch.unpersist()

    return (
        checked.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "1 second"}))
        .start()
    )
