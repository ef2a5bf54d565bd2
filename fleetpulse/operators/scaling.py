"""Standardisation of features: statistics as a table, scaling as column arithmetic."""

from __future__ import annotations

import sys
from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

EPSILON = sys.float_info.epsilon


def point_moments(point: str = "point") -> Column:
    """Aggregate with count, mean and variance of every element of an array of doubles."""
    return Summarizer.metrics("count", "mean", "variance").summary(array_to_vector(F.col(point)))


def scaler_table(summary: DataFrame, names: Sequence[str], column: str = "moments") -> DataFrame:
    """One row per feature, `idx, feature, mean, scale`, from a one-row table with `point_moments`.

    `scale` is the population deviation; MLlib's summary has the sample variance, hence `(n - 1) / n`.
    A feature that is constant up to rounding error has scale 1.
    """
    moments = summary.select(
        F.col(f"{column}.count").alias("n"),
        vector_to_array(f"{column}.mean").alias("mean"),
        vector_to_array(f"{column}.variance").alias("variance"),
        F.array(*[F.lit(n) for n in names]).alias("feature"),
    )
    rows = moments.selectExpr("n", "posexplode(arrays_zip(feature, mean, variance)) as (idx, f)").selectExpr(
        "n", "idx", "f.feature", "f.mean", "f.variance * (n - 1) / n as var"
    )
    noise = f"n * {EPSILON}D * var + pow(n * mean * {EPSILON}D, 2)"
    return rows.filter("n > 0").selectExpr(
        "idx", "feature", "mean", f"if(var <= {noise}, 1D, sqrt(var)) as scale"
    )


def fit_scaler(features: DataFrame, names: Sequence[str]) -> DataFrame:
    """Mean and scale of each feature, from a single aggregation pass."""
    points = features.select(F.array(*names).alias("point"))
    return scaler_table(points.agg(point_moments().alias("moments")), names)


def scaler_rows(scaler: DataFrame) -> list[Row]:
    """The statistics on the driver, in feature order: as many rows as there are features."""
    rows = scaler.orderBy("idx").collect()
    if not rows:
        raise RuntimeError("Scaler not fitted")
    return rows


def scaled_columns(available: Sequence[str], stats: Sequence[Row]) -> dict[str, str]:
    """SQL of the scaled features in training order; a feature that is not available counts as 0.0."""
    known = set(available)
    return {
        s.feature: f"({f'`{s.feature}`' if s.feature in known else '0D'} - {s['mean']!r}D) / {s['scale']!r}D"
        for s in stats
    }


def apply_scaler(features: DataFrame, scaler: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """`keep` and the scaled features, in training order."""
    scaled = scaled_columns(features.columns, scaler_rows(scaler))
    return features.selectExpr(*keep, *[f"{sql} as `{name}`" for name, sql in scaled.items()])


def feature_catalog(features: DataFrame, names: Sequence[str], noise: float = 1e-6) -> DataFrame:
    """Ordered feature names with their index and how many rows hold a value that is not 0 up to `noise`."""
    counts = features.selectExpr(*[f"count_if(abs(`{n}`) > {noise!r}D) as `{n}`" for n in names])
    entries = ", ".join(f"struct({i} as idx, '{n}' as feature, `{n}` as nonzero_rows)" for i, n in enumerate(names))
    return counts.selectExpr(f"inline(array({entries}))")
