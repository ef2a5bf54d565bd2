"""Validated writes, event log, retention, statistics, model registry and export."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from fleetpulse.functions.durations import utc_day
from fleetpulse.schema import METRICS, REQUIRED_COLUMNS, SAMPLE_COLUMNS, SECONDS_PER_DAY
from fleetpulse.session import pinned


def missing_fields() -> Column:
    """Comma-joined names of the required columns that are NULL, empty if the row is complete."""
    return F.concat_ws(",", *[F.when(F.col(c).isNull(), F.lit(c)) for c in REQUIRED_COLUMNS])


def validate_samples(rows: DataFrame) -> DataFrame:
    """Add `missing`; a row is accepted where it is empty. A frame without `cpu_temp` gets a NULL one."""
    absent = [c for c in REQUIRED_COLUMNS if c not in rows.columns]
    if absent:
        raise ValueError(f"Missing required columns: {absent}")
    if "cpu_temp" not in rows.columns:
        rows = rows.withColumn("cpu_temp", F.lit(None).cast("double"))
    return rows.withColumn("missing", missing_fields())


def fill_defaults(rows: DataFrame) -> DataFrame:
    """Failed readings as 0; the temperature stays NULL. Opt-in, since 0 is not what was measured."""
    defaults = {**dict.fromkeys(METRICS, 0.0), "proc_count": 0}
    return rows.fillna({c: v for c, v in defaults.items() if c in rows.columns})


def sensor_temperature(sensors: Sequence[str] = ("coretemp", "k10temp", "zenpower", "cpu_thermal")) -> Column:
    """The first reading present, by sensor priority."""
    return F.coalesce(*[F.col(s) for s in sensors])


def sensor_map_temperature(
    readings: Column, sensors: Sequence[str] = ("coretemp", "k10temp", "zenpower", "cpu_thermal")
) -> Column:
    """As `sensor_temperature`, from a map of sensor name to reading."""
    return F.coalesce(*[F.try_element_at(readings, F.lit(s)) for s in sensors])


def write_samples(rows: DataFrame, path: str) -> int:
    """Append complete rows to the store, partitioned by day, and the others to `<path>_rejected`.

    Returns the number of rows appended, counted while they are written. Rows are clustered by day before the write
    so that each day gets few files; adaptive execution splits a day by its size.
    """
    checked = validate_samples(rows)
    key = [c for c in ("sample_id",) if c in rows.columns]
    columns = [*key, *SAMPLE_COLUMNS]
    accepted = checked.filter("missing = ''").select(*columns).withColumn("date", utc_day(F.col("ts")))
    written = Observation("written")
    spread = accepted.hint("rebalance", "date").observe(written, F.count("*").alias("rows"))
    spread.write.mode("append").partitionBy("date").parquet(path)
    rejected = checked.filter("missing != ''").select(*columns, "missing")
    rejected.write.mode("append").parquet(f"{path}_rejected")
    return written.get["rows"]


def stored_table(spark: SparkSession, path: str) -> DataFrame | None:
    """The Parquet table at `path`, or None if nothing is stored there."""
    context = spark.sparkContext
    root = context._jvm.org.apache.hadoop.fs.Path(path)
    there = root.getFileSystem(context._jsc.hadoopConfiguration()).exists(root)
    return spark.read.parquet(path) if there else None


def read_store(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def detection_rows(anomalies: DataFrame, event_type: str = "anomaly") -> DataFrame:
    """Events in the shape of the event log. The id depends on sample and type, so re-runs repeat it."""
    event_id = F.md5(F.concat_ws("|", F.col("sample_id").cast("string"), F.lit(event_type)).cast("binary"))
    return anomalies.select(
        event_id.alias("id"),
        "ts",
        F.lit(event_type).alias("type"),
        "score",
        "metric_tags",
        "explanation",
    )


def write_detections(events: DataFrame, path: str, written_at: int) -> int:
    """Append events with the time of writing to the log, partitioned by the day of `ts`; returns how many were new.

    An event that the log has already is not written again, so a repeated or overlapping run leaves one copy of each, the
    first. An id always has the same `ts`, so only the log's ids of the days from the first to the last event are read, and both
    sides meet by id in a join that adaptive execution splits or broadcasts by the sizes it measures.
    """
    spark = events.sparkSession
    fresh = pinned(events.dropDuplicates(["id"]).withColumn("date", utc_day(F.col("ts"))))
    known = stored_table(spark, path)
    if known is not None:
        first, last = fresh.agg(F.min("date"), F.max("date")).first()
        there = known.filter(F.col("date").between(F.lit(first), F.lit(last))).select("id")
        fresh = fresh.join(there, "id", "left_anti")
    written = Observation("events")
    rows = fresh.withColumn("written_at", F.lit(written_at).cast("bigint")).select(*events.columns, "written_at", "date")
    spread = rows.hint("rebalance", "date").observe(written, F.count("*").alias("rows"))
    spread.write.mode("append").partitionBy("date").parquet(path)
    return written.get["rows"]


def read_detections(spark: SparkSession, path: str) -> DataFrame:
    """The event log, without the column that it is partitioned by."""
    return spark.read.parquet(path).drop("date")


def scan_detections(
    events: DataFrame, start_ts: int, end_ts: int, event_type: str | None = None, newest_first: bool = True
) -> DataFrame:
    """Events with `start_ts <= ts <= end_ts`, of one type if given."""
    rows = events.filter(F.col("ts").between(start_ts, end_ts))
    if event_type:
        rows = rows.filter(F.col("type") == event_type)
    return rows.orderBy(F.desc("ts"), F.desc("id")) if newest_first else rows


def retention_cutoff(now: int, days: int) -> int:
    return now - days * SECONDS_PER_DAY


def retained(samples: DataFrame, now: int, days: int) -> DataFrame:
    """Samples younger than the cutoff, or exactly on it."""
    return samples.filter(F.col("ts") >= retention_cutoff(now, days))


def removed_count(samples: DataFrame, now: int, days: int) -> DataFrame:
    """One row: how many samples retention removes."""
    return samples.agg(F.count_if(F.col("ts") < retention_cutoff(now, days)).alias("removed"))


def prune_store(spark: SparkSession, path: str, now: int, days: int) -> int:
    """Remove samples older than `days` from a store written in batch or by a stream; returns how many.

    Only the boundary day is rewritten, in the folders the store has (days, or days and batches), and only its
    remaining rows are read. Whole days before it, and batches of that day without a remaining row, are dropped as folders. The rows to keep are written aside first, so the day is never read and
    overwritten in one job.
    """
    cutoff = retention_cutoff(now, days)
    cutoff_day = utc_day(F.lit(cutoff))
    store = spark.read.parquet(path)
    removed = store.filter((F.col("date") <= cutoff_day) & (F.col("ts") < cutoff)).count()
    if not removed:
        return 0
    keep = pinned(store.filter((F.col("date") == cutoff_day) & (F.col("ts") >= cutoff)))
    folders = [c for c in ("date", "batch") if c in store.columns]
    stay = {tuple(r) for r in keep.select(*folders).distinct().collect()}
    there = store.filter(F.col("date") <= cutoff_day).select(*folders).distinct().collect()
    if stay:
        keep.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*folders).parquet(path)
    context = spark.sparkContext
    root = context._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(context._jsc.hadoopConfiguration())
    for old in sorted({tuple(r) for r in there} - stay):
        folder = "/".join(f"{c}={v}" for c, v in zip(folders, old))
        files.delete(context._jvm.org.apache.hadoop.fs.Path(root, folder), True)
    spark.catalog.refreshByPath(path)
    return removed


def store_stats(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One row per table: `table_name, row_count`."""
    counts = [
        df.agg(F.count("*").alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        for name, df in tables.items()
    ]
    result = counts[0]
    for extra in counts[1:]:
        result = result.unionByName(extra)
    return result


def host_stats(samples: DataFrame) -> DataFrame:
    """Per host: number of samples, first and last second."""
    return samples.groupBy("host").agg(
        F.count("*").alias("samples"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    )


def stored_megabytes(spark: SparkSession, path: str) -> float:
    """Size of all files under a table's folder, in MB of 1024 * 1024 bytes: one summary asked of the file system, not one call per file."""
    context = spark.sparkContext
    root = context._jvm.org.apache.hadoop.fs.Path(path)
    return root.getFileSystem(context._jsc.hadoopConfiguration()).getContentSummary(root).getLength() / (1024 * 1024)


MODEL_SCHEMA = "model_id string, name string, algo string, version string, trained_at long, meta_json string"


def model_record(
    spark: SparkSession, model_id: str, name: str, algo: str, version: str, trained_at: int, meta: Mapping | None
) -> DataFrame:
    """One registry row. The model's parameters live in tables keyed by `model_id`."""
    meta_json = json.dumps(meta) if meta else None
    return spark.createDataFrame([(model_id, name, algo, version, trained_at, meta_json)], MODEL_SCHEMA)


def latest_models(registry: DataFrame) -> DataFrame:
    """The newest row of each name in an append-only registry; ties go to the larger model id.

    Aggregated before the shuffle, so a name with very many versions costs one row per task.
    """
    columns = [c for c in registry.columns if c != "name"]
    newest = F.max_by(F.struct(*columns), F.struct("trained_at", "model_id")).alias("newest")
    return registry.groupBy("name").agg(newest).select("name", "newest.*")


def export_samples(samples: DataFrame, path: str, file_format: str = "csv") -> None:
    """Write samples as CSV with a header or as JSON lines."""
    if file_format == "csv":
        samples.write.mode("errorifexists").option("header", True).csv(path)
    elif file_format == "json":
        samples.write.mode("errorifexists").option("ignoreNullFields", False).json(path)
    else:
        raise ValueError(f"Unknown format: {file_format}")
