"""Exact order statistics by histograms, without sorting or collecting the data, for any number of ranks and groups at once.

One pass counts each group's values and finds the smallest and the largest. Each further pass deals the values that may still be meant
over BUCKETS equal parts of their range and takes count, minimum and maximum of each part, combined before the shuffle;
running counts over the parts tell which of them holds the rank. As a part brings its own ends along, the next range is as narrow as
the data allow, and a part of one value, or of two rows, is an answer. A range shrinks by the factor BUCKETS or more with each pass:
evenly spread values take two passes after the first for up to BUCKETS**2 rows in a group, whatever the number of rows.
While the ends differ by more than a factor of four or in sign, parts are equal in the logarithm, so that values of all
magnitudes take one pass more.

Dealing is monotone in the value, also where floats round, so results are exact. Values have to be finite; NULLs are left out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetpulse.session import pinned

BUCKETS = 1 << 14


def values_at_ranks(
    df: DataFrame, column: str, ranks: Sequence[Column], by: Sequence[str] = (), buckets: int = BUCKETS
) -> DataFrame:
    """One row per group and rank: the group, `n` (its number of values), `turn` (which of `ranks`), `rank`, `value`, and
    `below` (how many values are smaller). `ranks` are 0-based and may be worked out from `n`; a NULL or one out of range gives no row.

    Without groups the few ranks looked for are literals, whose range is pushed to the scan. Those of groups are a stored table.
    """
    rows = df.select(*by, F.col(column).alias("value")).where(F.col("value").isNotNull())
    ends = rows.groupBy(*by).agg(F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    wanted = F.posexplode(F.array(*[r.cast("long") for r in ranks])).alias("turn", "rank")
    targets = ends.select(*by, "n", "lo", "hi", wanted, F.lit(0).cast("long").alias("below")).where("rank >= 0 AND rank < n")
    if by:
        targets = pinned(targets)
        while not (still := targets.where("lo < hi")).isEmpty():
            same = [rows[c].eqNullSafe(F.col(f"t.{c}")) for c in by]
            met = rows.join(still.alias("t"), same).select("t.*", rows["value"])
            targets = pinned(targets.where("lo = hi").unionByName(_narrowed(met, list(by), buckets)))
    else:
        kind, found = targets.schema, targets.collect()
        while still := [t for t in found if t["lo"] < t["hi"]]:
            literals = [F.struct(*[F.lit(t[f.name]).cast(f.dataType).alias(f.name) for f in kind]) for t in still]
            reach = rows.where(F.col("value").between(min(t["lo"] for t in still), max(t["hi"] for t in still)))
            narrowed = _narrowed(reach.select("value", F.inline(F.array(*literals))), [], buckets)
            found = [t for t in found if t["lo"] == t["hi"]] + narrowed.select(*kind.names).collect()
        targets = df.sparkSession.createDataFrame(found, kind)
    return targets.select(*by, "n", "turn", "rank", F.col("lo").alias("value"), "below")


def _narrowed(met: DataFrame, by: list[str], buckets: int) -> DataFrame:
    """The targets with the ends of the part that holds their rank. A group of any size is counted before the shuffle."""
    value, low, high = F.col("value"), F.col("lo"), F.col("hi")
    wide = (low <= 0) & (high >= 0) | (F.greatest(F.abs(low), F.abs(high)) / 4.0 > F.least(F.abs(low), F.abs(high)))

    def size(x: Column) -> Column:
        return F.when(x == 0, 0.0).otherwise(F.signum(x) * (F.log2(F.abs(x)) + 1100.0))  # the smallest float is 2**-1074

    even = F.when(wide, (size(value) - size(low)) / (size(high) - size(low))).otherwise((value - low) / (high - low))
    part = F.least(F.lit(buckets - 1), F.floor(even * buckets)).alias("part")
    counts = (
        met.where(value.between(low, high))
        .groupBy(*by, "turn", "n", "rank", "below", part)
        .agg(F.count("*").alias("rows"), F.min("value").alias("least"), F.max("value").alias("most"))
    )
    order = Window.partitionBy(*by, "turn").orderBy("part")
    before = F.col("below") + F.sum("rows").over(order) - F.col("rows")
    place = F.col("rank") - F.col("before")
    two = (F.col("rows") == 2) & (F.col("least") < F.col("most"))  # the one or the other
    second = two & (place == 1)
    return (
        counts.withColumn("before", before)
        .where((F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("rows")))
        .select(
            *by,
            "n",
            F.when(second, F.col("most")).otherwise(F.col("least")).alias("lo"),
            F.when(two & ~second, F.col("least")).otherwise(F.col("most")).alias("hi"),
            "turn",
            "rank",
            (F.col("before") + F.when(second, 1).otherwise(0)).cast("long").alias("below"),
        )
    )


def value_at_rank(df: DataFrame, column: str, rank: int, buckets: int = BUCKETS):
    """The value at 0-based `rank` in ascending order; NULLs are left out, None if out of range."""
    found = values_at_ranks(df, column, [F.lit(rank)], buckets=buckets).first()
    return None if found is None else found["value"]


def percentiles(df: DataFrame, column: str, fraction: float, by: Sequence[str] = (), buckets: int = BUCKETS) -> DataFrame:
    """Per group the percentile with linear interpolation between the two neighbouring values, as `value`."""
    position = F.lit(float(fraction)) * (F.col("n") - 1)
    ranks = [F.floor(position), F.least(F.floor(position) + 1, F.col("n") - 1)]
    found = values_at_ranks(df, column, ranks, by, buckets)
    low, high = (F.max(F.when(F.col("turn") == k, F.col("value").cast("double"))) for k in (0, 1))
    share = F.max(position - F.floor(position))
    return found.groupBy(*by).agg((low + (high - low) * share).alias("value"))


def exact_percentile(df: DataFrame, column: str, fraction: float, buckets: int = BUCKETS) -> float | None:
    """Percentile of all values, None if there are none."""
    return percentiles(df, column, fraction, buckets=buckets).first()["value"]


def precedes_rank(df: DataFrame, column: str, tie_breaker: str, rank: int, buckets: int = BUCKETS) -> Column:
    """Predicate that holds for exactly the first `rank` rows by `(column, tie_breaker)`.

    The tie breaker must be unique among rows that share a value of `column`.
    """
    found = values_at_ranks(df, column, [F.lit(rank)], buckets=buckets).first()
    if found is None:
        return F.lit(rank > 0)
    cut = F.lit(found["value"])
    if found["below"] == rank:
        return F.col(column) < cut
    ties = df.filter(F.col(column) == cut)
    cut_id = value_at_rank(ties, tie_breaker, rank - found["below"], buckets)
    return (F.col(column) < cut) | ((F.col(column) == cut) & (F.col(tie_breaker) < F.lit(cut_id)))
