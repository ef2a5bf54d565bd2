"""When a metric will reach its threshold: labels, per-host linear fits, intervals, boosted trees."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetpulse.functions.durations import format_duration
from fleetpulse.operators.boosting import BoostedTrees, fit_boosted_trees
from fleetpulse.plans.joins import salted_join
from fleetpulse.plans.segments import SegmentPlan, plan_segments, segmented

# Default thresholds, interval factors and urgency limits in minutes.
THRESHOLDS = {"cpu_pct": 90.0, "mem_pct": 90.0, "swap_pct": 80.0}
Z_95, Z_90 = 1.96, 1.645
URGENT_MINUTES, SOON_MINUTES = 60, 1440

# Share of a feature's variance below which it counts as explained by the features before it.
TOLERANCE = 1e-9


def time_to_threshold(
    samples: DataFrame,
    thresholds: Mapping[str, float] = THRESHOLDS,
    plan: SegmentPlan | None = None,
) -> DataFrame:
    """Add `ttt_<metric>`: minutes from a row to the next row of its host at or over the threshold.

    0 on such a row itself, NULL if none follows. The window runs backwards, where the answer is a
    running minimum; looking ahead row by row would be quadratic. Segments of a hot host are finished
    with the first breach of any later segment, from a table with one row per segment.
    """
    plan = plan or plan_segments(samples)
    frame, keys = segmented(samples, plan)
    backwards = Window.partitionBy(*keys).orderBy(F.desc("ts"), F.desc("sample_id"))
    to_here = backwards.rowsBetween(Window.unboundedPreceding, 0)
    breach = {m: F.when(F.col(m) >= t, F.col("ts")) for m, t in thresholds.items()}
    result = frame.select("*", *[F.min(b).over(to_here).alias(f"next_{m}") for m, b in breach.items()])
    if "segment" in keys:
        after = (
            Window.partitionBy("host").orderBy(F.desc("segment")).rowsBetween(Window.unboundedPreceding, -1)
        )
        later = (
            frame.join(F.broadcast(plan.hot_hosts.select("host")), "host")
            .groupBy("host", "segment")
            .agg(*[F.min(b).alias(m) for m, b in breach.items()])
            .select("host", "segment", *[F.min(m).over(after).alias(f"later_{m}") for m in breach])
        )
        result = result.join(F.broadcast(later), ["host", "segment"], "left")
        next_ts = {m: F.coalesce(f"next_{m}", f"later_{m}") for m in breach}
    else:
        next_ts = {m: F.col(f"next_{m}") for m in breach}
    return result.select(
        *samples.columns, *[((t - F.col("ts")) / 60.0).alias(f"ttt_{m}") for m, t in next_ts.items()]
    )


def training_rows(labelled: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Long form `sample_id, host, ts, metric, x, y`: a metric's value and its minutes to threshold.

    Rows whose threshold is never reached have no label and are left out.
    """
    pairs = F.array(
        *[
            F.struct(F.lit(m).alias("metric"), F.col(m).alias("x"), F.col(f"ttt_{m}").alias("y"))
            for m in metrics
        ]
    )
    return labelled.select("sample_id", "host", "ts", F.inline(pairs)).filter(F.col("y").isNotNull())


def fit_linear(rows: DataFrame, by: Sequence[str] = ("host", "metric"), min_rows: int = 1) -> DataFrame:
    """Least-squares line of `y` on `x` per group: `slope, intercept, residual_std, n`.

    All from moments gathered in one pass that is aggregated before its shuffle, so group size does not
    matter. `residual_std` is the population deviation of the residuals. Groups whose `x` does not
    vary get slope 0; groups under `min_rows` are left out.
    """
    n, sxx, sxy, syy = F.col("n"), F.col("sxx"), F.col("sxy"), F.col("syy")
    moments = rows.groupBy(*by).agg(
        F.regr_count("y", "x").alias("n"),
        F.regr_avgx("y", "x").alias("mx"),
        F.regr_avgy("y", "x").alias("my"),
        F.regr_sxx("y", "x").alias("sxx"),
        F.regr_sxy("y", "x").alias("sxy"),
        F.regr_syy("y", "x").alias("syy"),
    )
    slope = F.when(sxx > 0, sxy / sxx).otherwise(0.0)
    left_over = F.greatest(F.lit(0.0), syy - F.when(sxx > 0, sxy * sxy / sxx).otherwise(0.0))
    return moments.filter(n >= min_rows).select(
        *by,
        slope.alias("slope"),
        (F.col("my") - slope * F.col("mx")).alias("intercept"),
        F.sqrt(left_over / n).alias("residual_std"),
        n.alias("n"),
    )


def interval(prediction: Column, residual_std: Column, confidence: float = 0.95) -> tuple[Column, Column]:
    """Bounds `prediction -+ z * residual_std`; the lower one is not below 0. Without spread both equal it."""
    z = Z_95 if confidence >= 0.95 else Z_90
    margin = z * residual_std
    lower = F.when(residual_std.isNull(), prediction).otherwise(F.greatest(F.lit(0.0), prediction - margin))
    upper = F.when(residual_std.isNull(), prediction).otherwise(prediction + margin)
    return lower, upper


def _forecast_columns(prediction: Column, residual_std: Column, confidence: float) -> list[Column]:
    lower, upper = interval(prediction, residual_std, confidence)
    return [
        prediction.alias("time_to_threshold_minutes"),
        lower.alias("confidence_lower"),
        upper.alias("confidence_upper"),
    ]


def predict_linear(
    rows: DataFrame, fits: DataFrame, by: Sequence[str] = ("host", "metric"), confidence: float = 0.95
) -> DataFrame:
    """Forecast for rows with `x`; rows of a group without a fit are left out."""
    joined = salted_join(rows, fits, list(by)).filter(F.col("slope").isNotNull())
    prediction = F.col("intercept") + F.col("slope") * F.col("x")
    return joined.select(*rows.columns, *_forecast_columns(prediction, F.col("residual_std"), confidence))


def current_values(latest: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Latest samples in long form, ready for `predict_linear`."""
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("x")) for m in metrics])
    return latest.select("sample_id", "host", "ts", F.inline(pairs))


@dataclass(frozen=True)
class Forecaster:
    """A fitted regression on several features and the spread of its residuals."""

    model: PipelineModel
    residual_std: float | None
    confidence: float = 0.95

    def predict(self, rows: DataFrame) -> DataFrame:
        predicted = self.model.transform(rows)
        columns = _forecast_columns(F.col("prediction"), F.lit(self.residual_std), self.confidence)
        return predicted.select(*rows.columns, *columns)


@dataclass(frozen=True)
class LinearForecaster:
    """A linear regression: the prediction is a plain column expression. A feature without a coefficient is not looked at."""

    coefficients: Mapping[str, float]
    intercept: float
    residual_std: float | None
    confidence: float = 0.95

    def prediction(self) -> Column:
        total = F.lit(self.intercept)
        for feature, coefficient in self.coefficients.items():
            total = total + F.lit(coefficient) * F.col(feature)
        return total

    def predict(self, rows: DataFrame) -> DataFrame:
        return rows.select(*rows.columns, *_forecast_columns(self.prediction(), F.lit(self.residual_std), self.confidence))


@dataclass(frozen=True)
class BoostedForecaster:
    """Boosted trees on histograms; the prediction is a plain column expression."""

    trees: BoostedTrees
    residual_std: float | None
    confidence: float = 0.95

    def predict(self, rows: DataFrame) -> DataFrame:
        return rows.select(*rows.columns, *_forecast_columns(self.trees.prediction(), F.lit(self.residual_std), self.confidence))


def solve_normal_equations(products: np.ndarray, targets: np.ndarray, ridge: float = 0.0) -> np.ndarray:
    """Coefficients b with products @ b = targets, by elimination in the order of the features on the scale of correlations.

    A feature that the ones before it explain up to TOLERANCE of its variance, or that does not vary, gets 0; so exact linear
    dependencies need no `ridge` (which is added to every variance, as a share of it).
    """
    scale = np.sqrt(np.diag(products))
    safe = np.where(scale > 0, scale, 1.0)
    left = products / safe / safe[:, None] + ridge * np.eye(len(products))
    right, used = targets / safe, []
    for k in range(len(left)):
        pivot = left[k, k]
        if scale[k] == 0 or pivot <= TOLERANCE:
            continue
        used.append(k)
        factor = left[:, k] / pivot
        factor[k] = 0.0
        left, right = left - np.outer(factor, left[k]), right - factor * right[k]
    out = np.zeros(len(left))
    for k in used:
        out[k] = right[k] / left[k, k] / safe[k]
    return out


def _fit_linear_features(
    rows: DataFrame, features: Sequence[str], label: str, ridge: float, confidence: float
) -> LinearForecaster:
    """One pass gathers means and covariances of all pairs, combined before its only shuffle; then a system of as many equations as
    there are features is solved, whatever the number of rows. A second pass takes the spread of the residuals."""
    names = [*features, label]
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    known = rows.select(*[F.col(c).cast("double").alias(c) for c in names]).dropna()
    moments = known.agg(
        F.count("*").alias("n"),
        *[F.avg(c).alias(f"m{i}") for i, c in enumerate(names)],
        *[F.covar_pop(names[i], names[j]).alias(f"c{i}_{j}") for i, j in pairs],
    ).first()
    if not moments["n"]:
        raise ValueError(f"No rows with {label} and all features")
    covariances = np.zeros((len(names), len(names)))
    for i, j in pairs:
        covariances[i, j] = covariances[j, i] = moments[f"c{i}_{j}"]
    products, targets = covariances[:-1, :-1], covariances[:-1, -1]
    found = solve_normal_equations(products, targets, ridge)
    intercept = moments[f"m{len(features)}"] - sum(b * moments[f"m{i}"] for i, b in enumerate(found))
    fit = LinearForecaster(dict(zip(features, map(float, found))), float(intercept), None, confidence)
    # From the residuals themselves: as a difference of variances a good fit's spread would drown in rounding.
    spread = known.agg(F.stddev_pop(F.col(label) - fit.prediction())).first()[0]
    return replace(fit, residual_std=spread)


def fit_forecaster(
    rows: DataFrame,
    features: Sequence[str],
    label: str,
    algo: str = "linear",
    confidence: float = 0.95,
    seed: int = 42,
    max_iter: int = 100,
    ridge: float = 0.0,
) -> Forecaster | LinearForecaster | BoostedForecaster:
    """Fit `label` on `features`. Rows with a null take no part.

    `linear`: normal equations from one pass; `gbr`: `max_iter` boosted trees of depth 3 on histograms; `gbr_mllib`: MLlib's boosted trees.
    """
    if algo == "linear":
        return _fit_linear_features(rows, features, label, ridge, confidence)
    if algo == "gbr":
        trees = fit_boosted_trees(rows, features, label, max_iter)
        spread = rows.agg(F.stddev_pop(F.col(label) - trees.prediction())).first()[0]
        return BoostedForecaster(trees, spread, confidence)
    if algo != "gbr_mllib":
        raise ValueError(f"Unknown algo: {algo}")
    regression = GBTRegressor(
        featuresCol="inputs", labelCol=label, maxIter=max_iter, maxDepth=3, stepSize=0.1, seed=seed
    )
    assembler = VectorAssembler(inputCols=list(features), outputCol="inputs")
    known = rows.filter(F.col(label).isNotNull())
    model = Pipeline(stages=[assembler, regression]).fit(known)
    residual = F.col(label) - F.col("prediction")
    spread = model.transform(known).agg(F.stddev_pop(residual)).first()[0]
    return Forecaster(model, spread, confidence)


def fit_forecasters(
    labelled: DataFrame, thresholds: Mapping[str, float], features: Sequence[str], algo: str = "linear", **options
) -> dict[str, Forecaster | LinearForecaster | BoostedForecaster]:
    """One forecaster per metric, each on its own label. A metric without threshold column is an error."""
    unknown = [m for m in thresholds if f"ttt_{m}" not in labelled.columns]
    if unknown:
        raise ValueError(f"Unknown metric: {unknown}")
    return {m: fit_forecaster(labelled, features, f"ttt_{m}", algo, **options) for m in thresholds}


def critical_forecasts(forecasts: DataFrame, horizon_hours: int = 24) -> DataFrame:
    """Forecasts that fall strictly within the horizon."""
    return forecasts.filter(F.col("time_to_threshold_minutes") < horizon_hours * 60)


def forecast_table(forecasts: DataFrame) -> DataFrame:
    """Display rows: readable time, half width of the interval, urgency colour."""
    minutes = F.col("time_to_threshold_minutes")
    half_width = (F.col("confidence_upper") - F.col("confidence_lower")) * 60 / 2
    urgency = F.when(minutes < URGENT_MINUTES, "red").when(minutes < SOON_MINUTES, "yellow").otherwise("green")
    return forecasts.select(
        "host",
        "metric",
        format_duration(minutes * 60).alias("time_text"),
        F.concat(F.lit("±"), format_duration(half_width)).alias("confidence_text"),
        urgency.alias("urgency"),
    )
