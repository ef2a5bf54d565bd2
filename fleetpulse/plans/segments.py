"""Ordered per-host windows that stay bounded when one host holds a large share of all rows.

A window over `partitionBy(host)` puts a whole host into one task. That is fine for an ordinary host
(30 days at 1 Hz are 2.6 million narrow rows) and fatal for one that holds a third of 100 TB. So the
row count per host is measured first, in one pass over two columns that is aggregated before its
shuffle. Hosts under the limit keep plain windows. Only the others are cut into segments of a fixed
number of consecutive rows; each segment also receives the rows just before and after it (its halo),
so every row-count frame that fits the halo sees exactly the rows it would see in an uncut host.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HOT_HOST_ROWS = 5_000_000
SEGMENT_ROWS = 1_000_000


@dataclass(frozen=True)
class SegmentPlan:
    """Which hosts have to be cut, and into segments of how many rows."""

    segment_rows: int
    hot_hosts: DataFrame | None


def plan_segments(
    samples: DataFrame, hot_rows: int = HOT_HOST_ROWS, segment_rows: int = SEGMENT_ROWS
) -> SegmentPlan:
    """Find the hosts with more than `hot_rows` rows.

    At most `rows / hot_rows` hosts qualify, whatever the data looks like, so the list is small enough
    for the driver and for a broadcast. `slot_s` is a width in seconds that would hold about
    `segment_rows` rows if the host's rows were spread evenly over its time span.
    """
    span = F.col("t1") - F.col("t0") + 1
    hot = (
        samples.groupBy("host")
        .agg(F.count("*").alias("n"), F.min("ts").alias("t0"), F.max("ts").alias("t1"))
        .filter(F.col("n") > hot_rows)
        .select("host", "t0", F.greatest(F.lit(1), F.ceil(span * segment_rows / F.col("n"))).alias("slot_s"))
    )
    rows = hot.collect()
    if not rows:
        return SegmentPlan(segment_rows, None)
    return SegmentPlan(segment_rows, samples.sparkSession.createDataFrame(rows, hot.schema))


def number_rows(hot: DataFrame, segment_rows: int) -> DataFrame:
    """Add `rn`, the 0-based position of each row within its host by `(ts, sample_id)`.

    `hot` carries `t0` and `slot_s`. Rows are first split by time slot. A slot that is crowded (many
    rows at one moment) is split again at rows picked by hash, one in `segment_rows`; their
    `(ts, sample_id)` are the cut points. Positions are counted inside the pieces and shifted by the
    number of rows in earlier pieces. Cut points and piece counts number about
    `rows / segment_rows`, which bounds both broadcasts.
    """
    order_key = F.struct("ts", "sample_id")
    slotted = hot.withColumn("slot", F.floor((F.col("ts") - F.col("t0")) / F.col("slot_s")))
    cuts = (
        slotted.filter(F.pmod(F.xxhash64("host", "ts", "sample_id"), F.lit(segment_rows)) == 0)
        .groupBy("host", "slot")
        .agg(F.array_sort(F.collect_list(order_key)).alias("cuts"))
    )
    passed = F.size(F.filter("cuts", lambda cut: cut <= order_key))
    pieces = (
        slotted.join(F.broadcast(cuts), ["host", "slot"], "left")
        .withColumn("piece", F.when(F.col("cuts").isNull(), 0).otherwise(passed))
        .drop("cuts")
    )
    earlier = Window.partitionBy("host").orderBy("slot", "piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        pieces.groupBy("host", "slot", "piece")
        .agg(F.count("*").alias("rows"))
        .select("host", "slot", "piece", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("offset"))
    )
    within = Window.partitionBy("host", "slot", "piece").orderBy("ts", "sample_id")
    return (
        pieces.withColumn("local", F.row_number().over(within))
        .join(F.broadcast(offsets), ["host", "slot", "piece"])
        .withColumn("rn", F.col("offset") + F.col("local") - 1)
        .drop("slot", "piece", "local", "offset", "t0", "slot_s")
    )


def segmented(
    samples: DataFrame, plan: SegmentPlan | None = None, before: int = 0, after: int = 0
) -> tuple[DataFrame, list[str]]:
    """`samples` ready for ordered windows, and the columns to partition those windows by.

    The result has a boolean `in_core`; rows where it is false are halo copies and must be dropped
    after the windows are computed. `before` and `after` are the rows a frame may reach back and ahead.
    """
    if plan is None:
        plan = plan_segments(samples)
    if plan.hot_hosts is None:
        return samples.withColumn("in_core", F.lit(True)), ["host"]
    size = max(plan.segment_rows, before, after, 1)
    hot_hosts = F.broadcast(plan.hot_hosts)
    cold = samples.join(hot_hosts, "host", "left_anti")
    numbered = number_rows(samples.join(hot_hosts, "host"), size)
    segment, position = F.floor(F.col("rn") / size), F.col("rn") % size
    copies = F.filter(
        F.array(
            segment,
            F.when(position >= size - before, segment + 1),
            F.when((position < after) & (segment > 0), segment - 1),
        ),
        lambda target: target.isNotNull(),
    )
    columns = samples.columns
    hot = (
        numbered.select(*columns, segment.alias("own_segment"), F.explode(copies).alias("segment"))
        .withColumn("in_core", F.col("segment") == F.col("own_segment"))
        .drop("own_segment")
    )
    cold = cold.select(*columns, F.lit(0).cast("bigint").alias("segment"), F.lit(True).alias("in_core"))
    return cold.unionByName(hot), ["host", "segment"]


def core_rows(df: DataFrame) -> DataFrame:
    """Drop halo copies and the helper columns."""
    return df.filter("in_core").drop("in_core", "segment")
