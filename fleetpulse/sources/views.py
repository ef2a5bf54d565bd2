"""Metric samples and related tables derived from the benchmark's `events` table."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SAMPLES_SQL = """
select event_id as sample_id,
  cast(floor(unix_micros(cast(ts as timestamp)) / 1000000) as bigint) as ts,
  concat('h', cast(user_id % 8 as string)) as host,
  least(value, 100.0D) as cpu_pct,
  cast(cast(get_json_object(props, '$.k') as int) as double) as mem_pct,
  value * 1.0E5D as disk_read_bps,
  (100 - cast(get_json_object(props, '$.k') as int)) * 2.0E5D as disk_write_bps,
  value * value * 1.0E2D as net_up_bps,
  ((event_id * 7919) % 1000) * 2.0E4D as net_down_bps,
  (event_id % 21) * 5.0D as swap_pct,
  cast(150 + user_id as int) as proc_count,
  case when event_id % 3 = 0 then null
       else 40.0D + cast(get_json_object(props, '$.k') as int) / 2.0D end as cpu_temp,
  case when event_type = 'error' then 1 else 0 end as y_true
from {events}
"""


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the benchmark's tables. The session is set to UTC, on which the epoch arithmetic relies."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{folder}/{name}.parquet")


def samples_from_events(events: DataFrame) -> DataFrame:
    """Samples of eight hosts with a ground-truth label `y_true`; works on static and streaming events."""
    return events.sparkSession.sql(SAMPLES_SQL, events=events)


def load_samples(
    spark: SparkSession, folder: str, start_ts: int | None = None, end_ts: int | None = None
) -> DataFrame:
    """Samples of the table, or those with `start_ts <= ts <= end_ts`. These bounds are put on the column as it is
    stored, so that they reach the scan; on a sample's whole seconds they could not."""
    events = read_table(spark, folder, "events")
    kind = events.schema["ts"].dataType.simpleString()

    def second(ts: int):
        return F.expr(f"{kind} '{datetime.fromtimestamp(ts, timezone.utc):%Y-%m-%d %H:%M:%S}'")

    if start_ts is not None:
        events = events.filter(F.col("ts") >= second(start_ts))
    if end_ts is not None:
        events = events.filter(F.col("ts") < second(end_ts + 1))
    return samples_from_events(events)


def surrogate_scores(samples: DataFrame) -> DataFrame:
    """A simple score with many ties, which SQL can reproduce exactly: minus the whole cpu percent."""
    return samples.selectExpr(
        "sample_id", "host", "ts", "y_true", "-floor(cpu_pct) / 100.0D as score"
    )


def counters(samples: DataFrame) -> DataFrame:
    """Cumulative byte counters that wrap at 50,000,000, so that they sometimes fall."""
    return samples.selectExpr(
        "sample_id",
        "host",
        "ts",
        "(sample_id * 104729) % 50000000 as read_bytes",
        "(sample_id * 65537 + 17) % 50000000 as write_bytes",
        "(sample_id * 15487 + proc_count * 3) % 50000000 as sent_bytes",
        "(sample_id * 31337 + proc_count) % 50000000 as recv_bytes",
    )


def sensors(samples: DataFrame) -> DataFrame:
    """Temperatures under the names of four sensors, of which at most one of the first three is set."""
    return samples.selectExpr(
        "sample_id",
        "host",
        "ts",
        "case when sample_id % 4 = 0 then cpu_temp end as coretemp",
        "case when sample_id % 4 = 1 then cpu_temp end as k10temp",
        "case when sample_id % 4 = 2 then cpu_temp end as zenpower",
        "cpu_temp + 1.0D as cpu_thermal",
    )


def with_gaps(samples: DataFrame) -> DataFrame:
    """Samples of which some lack a required reading."""
    return samples.selectExpr(
        "sample_id",
        "ts",
        "case when sample_id % 50 = 7 then null else host end as host",
        "case when sample_id % 10 = 3 then null else cpu_pct end as cpu_pct",
        "mem_pct",
        "disk_read_bps",
        "disk_write_bps",
        "net_up_bps",
        "net_down_bps",
        "swap_pct",
        "case when sample_id % 17 = 5 then null else proc_count end as proc_count",
        "cpu_temp",
    )
