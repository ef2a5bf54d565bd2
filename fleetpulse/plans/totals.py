"""Running totals in a global order without moving all rows into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetpulse.session import pinned

ROWS_PER_BUCKET = 1_000_000
BUCKETS_PER_GROUP = 1_000


def _offsets(rows: DataFrame, place: str, sums: Sequence[str], following: Sequence[str], inside: Sequence[str] = ()) -> DataFrame:
    """For each row of `rows`, what the ones before it sum up to (`shift_<c>`) and the first value of the next (`after_<c>`)."""
    order = Window.partitionBy(*inside).orderBy(place)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    return rows.select(
        *inside,
        place,
        *[F.coalesce(F.sum(f"total_{c}").over(before), F.lit(0)).alias(f"shift_{c}") for c in sums],
        *[F.lead(f"first_{c}").over(order).alias(f"after_{c}") for c in following],
    )


def running_totals(
    df: DataFrame,
    order: str,
    sums: Sequence[str],
    following: Sequence[str] = (),
    buckets: int | None = None,
    buckets_per_group: int = BUCKETS_PER_GROUP,
) -> DataFrame:
    """Add `cum_<c>` (running sum, own row included) and `next_<c>` (value on the next row).

    `df` has one row per value of the column `order`; a row without one is left out. Its rows are stored in ranges of that column, about
    `ROWS_PER_BUCKET` to a range however many there are. Windows run inside the ranges, and each is shifted by the
    totals of the ones before it. These are worked out in two levels: ranges inside groups of `buckets_per_group`,
    and groups. Only the groups, one for a thousand million rows, meet in one task.
    """
    df = df.where(F.col(order).isNotNull())
    if buckets is None:
        buckets = 8 + df.count() // ROWS_PER_BUCKET
    ranged = df.repartitionByRange(buckets, order).withColumn("bucket", F.spark_partition_id())
    bucketed = pinned(ranged).withColumn("bucket_group", F.floor(F.col("bucket") / buckets_per_group))

    summary = bucketed.groupBy("bucket_group", "bucket").agg(
        *[F.sum(c).alias(f"total_{c}") for c in sums],
        *[F.min_by(c, order).alias(f"first_{c}") for c in following],
    )
    summary = pinned(summary)
    groups = summary.groupBy("bucket_group").agg(
        *[F.sum(f"total_{c}").alias(f"total_{c}") for c in sums],
        *[F.min_by(f"first_{c}", "bucket").alias(f"first_{c}") for c in following],
    )
    outer = _offsets(groups, "bucket_group", sums, following).alias("g")
    inner = _offsets(summary, "bucket", sums, following, ["bucket_group"]).alias("b")
    shifts = inner.join(outer, "bucket_group").select(
        "bucket",
        *[(F.col(f"b.shift_{c}") + F.col(f"g.shift_{c}")).alias(f"shift_{c}") for c in sums],
        *[F.coalesce(f"b.after_{c}", f"g.after_{c}").alias(f"after_{c}") for c in following],
    )
    inside = Window.partitionBy("bucket").orderBy(order)
    up_to = inside.rowsBetween(Window.unboundedPreceding, 0)
    return (
        bucketed.select(
            "bucket",
            *df.columns,
            *[F.sum(c).over(up_to).alias(f"local_{c}") for c in sums],
            *[F.lead(c).over(inside).alias(f"lead_{c}") for c in following],
        )
        .join(shifts, "bucket")
        .select(
            *df.columns,
            *[(F.col(f"local_{c}") + F.col(f"shift_{c}")).alias(f"cum_{c}") for c in sums],
            *[F.coalesce(f"lead_{c}", f"after_{c}").alias(f"next_{c}") for c in following],
        )
    )
