"""Tables behind a dashboard: recent history, current state, trends and distributions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetpulse.plans.joins import salted_join
from fleetpulse.schema import METRICS

# Series of the history with their column and divisor, and display limits.
HISTORY_SERIES = {
    "cpu": ("cpu_pct", 1.0),
    "mem": ("mem_pct", 1.0),
    "disk_read": ("disk_read_bps", 1e6),
    "disk_write": ("disk_write_bps", 1e6),
    "net_up": ("net_up_bps", 1e6),
    "net_down": ("net_down_bps", 1e6),
}
HISTORY_ROWS = 100
HIGH_PERCENT = 80
MAX_ALERTS = 10
STATE_ALERTS = 3
TREND_TOP = 8
TREND_FLAT = 4


def recent_history(samples: DataFrame, rows: int = HISTORY_ROWS) -> DataFrame:
    """The last `rows` samples of each host, `position` 1 being the oldest; I/O in MB/s.

    Spark prunes to the newest rows per host before the shuffle (window group limit).
    """
    newest = Window.partitionBy("host").orderBy(F.desc("ts"), F.desc("sample_id"))
    last = samples.withColumn("age", F.row_number().over(newest)).filter(F.col("age") <= rows)
    kept = F.count("*").over(Window.partitionBy("host"))
    series = [(F.col(c) / d if d != 1.0 else F.col(c)).alias(n) for n, (c, d) in HISTORY_SERIES.items()]
    return last.select("host", "ts", "sample_id", (kept - F.col("age") + 1).alias("position"), *series)


def latest_samples(samples: DataFrame) -> DataFrame:
    """The newest sample of each host, found by aggregation before the shuffle."""
    columns = [c for c in samples.columns if c != "host"]
    newest = F.max_by(F.struct(*columns), F.struct("ts", "sample_id")).alias("newest")
    return samples.groupBy("host").agg(newest).select("host", "newest.*")


def metric_status(value: Column, is_anomaly: Column, threshold: float | None = None) -> Column:
    """Colour of a value: red if anomalous, yellow at the threshold, orange from 80 on, else green."""
    status = F.when(is_anomaly, "red")
    if threshold:
        status = status.when(value >= threshold, "yellow")
    return status.when(value >= HIGH_PERCENT, "orange").otherwise("green")


def recent_alerts(events: DataFrame, max_alerts: int = MAX_ALERTS) -> DataFrame:
    """The newest events with their colour; `panel_state` is red if an anomaly is among the first three."""
    top = events.orderBy(F.desc("ts"), F.desc("id")).limit(max_alerts)
    position = F.row_number().over(Window.orderBy(F.desc("ts"), F.desc("id")))
    ranked = top.withColumn("position", position)
    alarming = F.max((F.col("position") <= STATE_ALERTS) & (F.col("type") == "anomaly"))
    state = F.when(alarming.over(Window.partitionBy(F.lit(1))), "red").otherwise("yellow")
    return ranked.select(
        "position",
        "ts",
        "type",
        "explanation",
        F.when(F.col("type") == "anomaly", "red").otherwise("yellow").alias("style"),
        state.alias("panel_state"),
    )


def alert_state(events: DataFrame) -> DataFrame:
    """One row: `green` without events, `red` if an anomaly is among the newest three, else `yellow`."""
    newest = events.orderBy(F.desc("ts"), F.desc("id")).limit(STATE_ALERTS)
    alarming = F.max(F.col("type") == "anomaly")
    state = F.when(F.count("*") == 0, "green").when(alarming, "red").otherwise("yellow")
    return newest.agg(state.alias("panel_state"))


def trend_levels(values: Column, low: float | None = None, high: float | None = None) -> Column:
    """Each value of an array as a level 0..8 between `low` and `high` (by default its own range).

    A single value or a constant series is level 4 throughout.
    """
    bottom = F.array_min(values) if low is None else F.lit(float(low))
    top = F.array_max(values) if high is None else F.lit(float(high))

    def level(value: Column) -> Column:
        scaled = ((value - bottom) / (top - bottom) * TREND_TOP).cast("int")
        return F.least(scaled, F.lit(TREND_TOP))

    flat = F.transform(values, lambda _: F.lit(TREND_FLAT))
    return F.when((F.size(values) <= 1) | (top == bottom), flat).otherwise(F.transform(values, level))


def host_trends(history: DataFrame, series: Sequence[str] = tuple(HISTORY_SERIES)) -> DataFrame:
    """Per host and series the levels of its recent history (at most 100 values), oldest first."""
    ordered = F.array_sort(F.collect_list(F.struct("position", *series)))
    per_host = history.groupBy("host").agg(ordered.alias("points"))
    entries = [
        F.struct(F.lit(s).alias("series"), trend_levels(F.col(f"points.{s}")).alias("levels")) for s in series
    ]
    return per_host.select("host", F.inline(F.array(*entries)))


def metric_histogram(samples: DataFrame, metrics: Sequence[str] = tuple(METRICS), bins: int = 10) -> DataFrame:
    """Rows `host, metric, bin, n` over each metric's own range on its host; the last bin is closed.

    A metric that is constant on a host gives no rows, and neither do empty bins.
    """
    bounds = [F.min(m).alias(f"low_{m}") for m in metrics] + [F.max(m).alias(f"high_{m}") for m in metrics]
    ranges = samples.groupBy("host").agg(*bounds)
    joined = salted_join(samples.select("sample_id", "host", *metrics), ranges, ["host"])

    def place(metric: str) -> Column:
        low, high = F.col(f"low_{metric}"), F.col(f"high_{metric}")
        bin_ = F.least(F.floor((F.col(metric) - low) / ((high - low) / bins)), F.lit(bins - 1))
        return F.when(high > low, bin_.cast("int"))

    entries = F.array(*[F.struct(F.lit(m).alias("metric"), place(m).alias("bin")) for m in metrics])
    return (
        joined.select("host", F.inline(entries))
        .filter(F.col("bin").isNotNull())
        .groupBy("host", "metric", "bin")
        .agg(F.count("*").alias("n"))
    )
