"""Training, batch detection, tagging and explanation of anomalies."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from fleetpulse.functions.text import fixed_point
from fleetpulse.operators.features import FeatureSettings, feature_table
from fleetpulse.operators.forest import (
    ForestScorer,
    below_threshold,
    calibrate_threshold,
    contamination_offset,
    forest_sample,
    grow_trees,
    whole_points,
)
from fleetpulse.operators.scaling import point_moments, scaler_rows, scaler_table
from fleetpulse.plans.ranks import precedes_rank
from fleetpulse.session import pinned
from fleetpulse.schema import FOREST_SCHEMA, SCALER_SCHEMA
from fleetpulse.sources.samples import scan_samples
from fleetpulse.sources.store import latest_models, model_record, stored_table

# Limits above which a metric is named in tags and explanations.
HIGH_PERCENT = 80
HIGH_BYTES_PER_SECOND = 10**7
TAGGED_PERCENT = ["cpu_pct", "mem_pct"]
TAGGED_BYTES = ["disk_read_bps", "disk_write_bps", "net_up_bps", "net_down_bps"]

MODEL_NAME = "isolation_forest"


@dataclass(frozen=True)
class AnomalyModel:
    """A fitted scaler and forest with their thresholds. Its size depends on parameters only."""

    scaler: Sequence[Row]
    nodes: Sequence[Row]
    drawn: int
    settings: FeatureSettings = field(default_factory=FeatureSettings)
    threshold: float | None = None
    offset: float | None = None

    def with_threshold(self, threshold: float) -> AnomalyModel:
        return replace(self, threshold=threshold)

    def scorer(self, spark: SparkSession) -> ForestScorer:
        return ForestScorer(spark, self.nodes, self.drawn)


def chronological_split(samples: DataFrame, val_split: float = 0.2) -> tuple[DataFrame, DataFrame]:
    """The first `int(n * (1 - val_split))` rows by `(ts, sample_id)`, and the rest.

    The cut is an order statistic found by aggregation; nothing is sorted.
    """
    is_train = precedes_rank(samples, "ts", "sample_id", int(samples.count() * (1 - val_split)))
    return samples.filter(is_train), samples.filter(~is_train)


def score_features(features: DataFrame, model: AnomalyModel) -> DataFrame:
    """Add `score` to a feature table; works on static and streaming tables. A feature that the table lacks is 0."""
    scorer = model.scorer(features.sparkSession)
    known = whole_points([s.feature for s in model.scaler if s.feature in features.columns])
    at = dict(zip([s.feature for s in model.scaler if s.feature in features.columns], known))
    return features.withColumn("score", scorer.score([at.get(s.feature, F.lit(0.0)) for s in model.scaler]))


def _fitted(
    features: DataFrame, settings: FeatureSettings, n_trees: int, max_samples: int, seed: int, rows: DataFrame
) -> AnomalyModel:
    """Scaler and forest of a feature table, whose rows are those of `rows`.

    One pass over the features yields both their moments and the points the trees are grown from
    (`n_trees * max_samples` at most, so the pinned row has a size set by the parameters).
    """
    names = settings.feature_names()
    trees = (
        forest_sample(rows.select("sample_id"), n_trees, max_samples, seed)
        .groupBy("sample_id")
        .agg(F.collect_list("tree_id").alias("trees"))
    )
    points = features.select("sample_id", F.array(*names).alias("point"), F.array(*whole_points(names)).alias("whole"))
    drawn = F.when(F.col("trees").isNotNull(), F.struct("sample_id", "trees", "whole"))
    summary = pinned(
        points.join(F.broadcast(trees), "sample_id", "left").agg(
            point_moments().alias("moments"), F.collect_list(drawn).alias("points")
        )
    )
    stats = scaler_rows(scaler_table(summary, names))
    drawn = summary.select(F.inline("points")).select("sample_id", F.col("whole").alias("point"), F.explode("trees").alias("tree_id"))
    nodes = grow_trees(drawn, max_samples, seed).collect()
    return AnomalyModel(stats, nodes, max(n["size"] for n in nodes), settings)


def fit_model(
    train: DataFrame,
    settings: FeatureSettings = FeatureSettings(),
    n_trees: int = 100,
    max_samples: int = 256,
    contamination: float | None = 0.05,
    seed: int = 42,
) -> AnomalyModel:
    """Fit scaler and forest on samples. `contamination=None` skips scoring the training rows."""
    features = feature_table(train, settings, keep=["sample_id"])
    model = _fitted(features, settings, n_trees, max_samples, seed, train)
    if contamination is None:
        return model
    scores = pinned(score_features(features, model).select("score"))
    return replace(model, offset=contamination_offset(scores, contamination))


def train(
    samples: DataFrame,
    start_ts: int,
    end_ts: int,
    host: str | None = None,
    val_split: float = 0.2,
    target_fpr: float = 0.05,
    **fit_options,
) -> tuple[AnomalyModel, DataFrame]:
    """Fit on the earlier part of a time range, calibrate on the later part.

    The range's few columns are stored once, and all passes read that. Returns the model and a one-row summary
    `train_samples, val_samples, threshold, features`.
    """
    settings = fit_options.get("settings", FeatureSettings())
    narrow = list(dict.fromkeys(["sample_id", "host", "ts", *settings.metrics]))
    rows = pinned(scan_samples(samples, start_ts, end_ts, host).select(*narrow))
    n = rows.count()
    if n == 0:
        raise ValueError("No training data available")
    n_train = int(n * (1 - val_split))
    is_train = precedes_rank(rows, "ts", "sample_id", n_train)
    model = fit_model(rows.filter(is_train), **fit_options)
    val_features = feature_table(rows.filter(~is_train), model.settings, keep=["sample_id"])
    scores = pinned(score_features(val_features, model).select("score"))
    model = replace(model, threshold=calibrate_threshold(scores, target_fpr))
    summary = samples.sparkSession.createDataFrame(
        [(n_train, n - n_train, model.threshold, len(model.scaler))],
        "train_samples long, val_samples long, threshold double, features int",
    )
    return model, summary


def detect(
    samples: DataFrame,
    model: AnomalyModel,
    start_ts: int,
    end_ts: int,
    host: str | None = None,
    warmup_s: int = 0,
) -> DataFrame:
    """Samples of the range with `score` and `is_anomaly`.

    By default windows start cold at `start_ts`. `warmup_s` also reads that many seconds before it, so
    that the first rows have a history; those rows are not returned.
    """
    rows = scan_samples(samples, start_ts - warmup_s, end_ts, host)
    features = feature_table(rows, model.settings, keep=rows.columns)
    scored = score_features(features, model).filter(F.col("ts") >= start_ts)
    return scored.select(
        *rows.columns, "score", below_threshold(F.col("score"), model.threshold).alias("is_anomaly")
    )


def metric_tags() -> Column:
    """Comma-joined names of the metrics that stand out, or `general`."""
    percent = F.concat_ws(",", *[F.when(F.col(m) > HIGH_PERCENT, F.lit(m)) for m in TAGGED_PERCENT])
    io = F.concat_ws(",", *[F.when(F.col(m) > HIGH_BYTES_PER_SECOND, F.lit(m)) for m in TAGGED_BYTES])
    return F.when(percent != "", percent).when(io != "", io).otherwise("general")


def explanation(score: Column | None = None) -> Column:
    """One sentence on why a row was flagged."""
    score = F.col("score") if score is None else score

    def clause(metric: str, limit: int, text: str, unit: str, divisor: float = 1.0) -> Column:
        shown = fixed_point(F.col(metric) / divisor, 1)
        return F.when(F.col(metric) > limit, F.concat(F.lit(f"{text} ("), shown, F.lit(f"{unit})")))

    parts = F.concat_ws(
        ", ",
        clause("cpu_pct", HIGH_PERCENT, "high CPU", "%"),
        clause("mem_pct", HIGH_PERCENT, "high memory", "%"),
        clause("disk_write_bps", HIGH_BYTES_PER_SECOND, "high disk write", " MB/s", 1e6),
        clause("net_down_bps", HIGH_BYTES_PER_SECOND, "high network download", " MB/s", 1e6),
    )
    reason = F.when(parts != "", parts).otherwise("unusual pattern detected")
    return F.concat(F.lit("Anomaly score "), fixed_point(score, 3), F.lit(": "), reason)


def extract_anomalies(detections: DataFrame) -> DataFrame:
    """Flagged rows as events: `sample_id, host, ts, score, metric_tags, explanation`."""
    return detections.filter("is_anomaly").select(
        "sample_id",
        "host",
        "ts",
        "score",
        metric_tags().alias("metric_tags"),
        explanation().alias("explanation"),
    )


def detection_summary(detections: DataFrame) -> DataFrame:
    """One row: rows, anomalies and their percentage (NULL without rows)."""
    rows, anomalies = F.count("*"), F.count_if("is_anomaly")
    return detections.agg(
        rows.alias("samples"),
        anomalies.alias("anomalies"),
        F.try_divide(100.0 * anomalies, rows).alias("anomaly_pct"),
    )


def save_model(spark: SparkSession, root: str, model: AnomalyModel, name: str = MODEL_NAME) -> str:
    """Append the model's parameter tables and its registry row under `root`; returns the model id.

    The registry row is written last, so a model that can be found is complete.
    """
    model_id = uuid.uuid4().hex
    for table, rows, schema in (
        ("scaler", model.scaler, SCALER_SCHEMA),
        ("forest", model.nodes, FOREST_SCHEMA),
    ):
        frame = spark.createDataFrame([tuple(r) for r in rows], schema)
        tagged = frame.withColumn("model_id", F.lit(model_id)).coalesce(1)
        tagged.write.mode("append").partitionBy("model_id").parquet(f"{root}/{table}")
    settings = model.settings
    meta = {
        "threshold": model.threshold,
        "offset": model.offset,
        "drawn": model.drawn,
        "metrics": list(settings.metrics),
        "io_metrics": list(settings.io_metrics),
        "short_window": settings.short_window,
        "long_window": settings.long_window,
        "lag_periods": list(settings.lag_periods),
        "alphas": list(settings.alphas),
        "slope_window": settings.slope_window,
        "burst_window": settings.burst_window,
    }
    record = model_record(spark, model_id, name, "IsolationForest", "1.0", int(time.time()), meta)
    record.coalesce(1).write.mode("append").parquet(f"{root}/models")
    return model_id


def load_model(spark: SparkSession, root: str, name: str = MODEL_NAME) -> AnomalyModel | None:
    """The newest model of that name; None if there is no such model or a part of it is missing."""
    registry = stored_table(spark, f"{root}/models")
    found = registry and latest_models(registry).filter(F.col("name") == name).first()
    if found is None:
        return None

    def rows(table: str, *order: str) -> list[Row]:
        frame = stored_table(spark, f"{root}/{table}")
        if frame is None:
            return []
        return frame.filter(F.col("model_id") == found.model_id).drop("model_id").orderBy(*order).collect()

    scaler, nodes = rows("scaler", "idx"), rows("forest", "tree_id", "node_id")
    if not scaler or not nodes:
        return None

    meta = json.loads(found.meta_json)
    knobs = {k: meta[k] for k in FeatureSettings.__dataclass_fields__}
    return AnomalyModel(
        scaler,
        nodes,
        meta["drawn"],
        FeatureSettings(**knobs),
        meta["threshold"],
        meta["offset"],
    )
