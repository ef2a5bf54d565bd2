"""One query per operator: `(session, folder of the tables) -> DataFrame`.

Doubles are passed through `snap` so that two engines that differ in the last bits give equal results.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetpulse.functions.durations import epoch_to_local, epoch_to_utc, format_duration, parse_duration, utc_to_epoch
from fleetpulse.operators import alerts, detection, evaluation, features, forecasting, forest, rates, scaling, summaries
from fleetpulse.plans.segments import plan_segments
from fleetpulse.schema import FOREST_SCHEMA, METRICS, SAMPLE_COLUMNS
from fleetpulse.session import scratch_path
from fleetpulse.sources import samples as scans
from fleetpulse.sources import store, views
from fleetpulse.streaming.alerts import alert_stream, deliver
from fleetpulse.streaming.detection import detect_stream, feature_stream
from fleetpulse.streaming.ingest import ingest_stream
from fleetpulse.streaming.ordered import heartbeat, with_heartbeats
from fleetpulse.streaming.rates import counter_rate_stream

Query = Callable[[SparkSession, str], DataFrame]

# Parameters of the queries; the SQL side reads the same values.
RANGE_START, RANGE_END = 1704412800, 1706140799
NOW, RETENTION_DAYS = 1706659200, 14
SCORE_THRESHOLD = -0.3
FLAG_THRESHOLD = -0.9
TARGET_FPR = 0.05
VAL_SPLIT = 0.2
SEED = 42
LONG_COOLDOWN = 21600
BOOSTED_TREES = 10
LOCAL_ZONE = "America/New_York"
FORECAST_METRICS = {"cpu_pct": 90.0, "mem_pct": 90.0, "swap_pct": 80.0}
DURATION_UNITS = ["s", "m", "h", "d", "w", "", " H", "x", ".5h"]
FAMILIES = {
    "feat_lags": lambda m: [f"{m}_lag{k}" for k in (1, 2, 3, 5)],
    "feat_rolling": lambda m: [f"{m}_{s}" for s in ("rmean_s", "rstd_s", "rmean_l", "rstd_l")],
    "feat_ema": lambda m: [f"{m}_ema1", f"{m}_ema3"],
    "feat_slope": lambda m: [f"{m}_slope"],
    "feat_burst": lambda m: [f"{m}_burst"],
}

QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


digits_of = forest.quantum_digits  # decimals worth comparing


def snap(value: Column | str, digits: int = 6) -> Column:
    """Round to `digits`; the break point is just off the half, where exact ties would be engine luck."""
    value = F.col(value) if isinstance(value, str) else value
    scale = float(10**digits)
    return F.floor(value * scale + 0.4999).cast("double") / scale


def snapped(names: Sequence[str], digits: int | None = None) -> list[Column]:
    """`snap` for many columns, as SQL text."""

    def text(name: str) -> str:
        scale = f"{float(10 ** (digits or digits_of(name)))!r}D"
        return f"cast(floor(`{name}` * {scale} + 0.4999D) as double) / {scale} as `{name}`"

    return [F.expr(text(n)) for n in names]


def scored_samples(spark: SparkSession, folder: str) -> DataFrame:
    return views.surrogate_scores(views.load_samples(spark, folder))


def flagged_scores(spark: SparkSession, folder: str) -> DataFrame:
    return scored_samples(spark, folder).withColumn("is_anomaly", F.col("score") < SCORE_THRESHOLD)


def flagged_samples(spark: SparkSession, folder: str) -> DataFrame:
    """Samples with the surrogate score and a flag on it."""
    rows = views.load_samples(spark, folder).withColumn("score", F.expr("-floor(cpu_pct) / 100.0D"))
    return rows.withColumn("is_anomaly", F.col("score") < SCORE_THRESHOLD)


def alert_input(spark: SparkSession, folder: str) -> DataFrame:
    rows = views.load_samples(spark, folder).withColumn("score", F.expr("-floor(cpu_pct) / 100.0D"))
    return rows.withColumn("is_anomaly", F.col("score") < FLAG_THRESHOLD)


def event_log(spark: SparkSession, folder: str) -> DataFrame:
    """Events as the detector would write them: anomalies, and forecasts for rows with high swap."""
    rows = flagged_samples(spark, folder)
    anomalies = store.detection_rows(detection.extract_anomalies(rows))
    nearing = rows.filter("swap_pct >= 80").select(
        "sample_id", "ts", "score", F.lit("swap_pct").alias("metric_tags"), F.lit("swap is filling").alias("explanation")
    )
    return anomalies.unionByName(store.detection_rows(nearing, "forecast"))


def event_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The events table read as a stream; a few files at a time where the table has several."""
    table = views.read_table(spark, folder, "events")
    source = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 64)
    return source.option("pathGlobFilter", "*.parquet").parquet(f"{folder}/events.parquet*")


def finished(spark: SparkSession, start: Callable[[str, str], object], label: str) -> DataFrame:
    """Run a stream over all that is there, into the shared folder, and read the result."""
    path = scratch_path(spark, label)
    start(f"{path}/table", f"{path}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{path}/table")


AVAILABLE_NOW = {"availableNow": True}
# Files of the unordered stream, and by how many seconds its rows may be out of order: the whole month.
STREAM_FILES, STREAM_DELAY = 128, 31 * 86400


def in_time_order(spark: SparkSession, folder: str, build: Callable[[DataFrame], DataFrame], label: str) -> DataFrame:
    """The result of a stream over samples that come in no order: the events lie in many files, dealt by hash, and a quarter
    of the files is read at a time. A heartbeat ends the stream."""
    path = scratch_path(spark, label)
    events = views.read_table(spark, folder, "events")
    events.repartition(STREAM_FILES, F.xxhash64("event_id")).write.parquet(f"{path}/events")
    source = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", STREAM_FILES // 4).parquet(f"{path}/events")
    stream = build(with_heartbeats(views.samples_from_events(source), f"{path}/beats"))
    deliver(stream, f"{path}/table", f"{path}/checkpoint", AVAILABLE_NOW).awaitTermination()
    last = views.load_samples(spark, folder).agg(F.max("ts")).first()[0]
    heartbeat(spark, f"{path}/beats", (last or 0) + STREAM_DELAY + 1)
    deliver(stream, f"{path}/table", f"{path}/checkpoint", AVAILABLE_NOW).awaitTermination()
    return spark.read.parquet(f"{path}/table").drop("batch")


# ---- scans, writes, retention -------------------------------------------------------------------


@query
def ingest_validate(spark, folder):
    checked = store.validate_samples(views.with_gaps(views.load_samples(spark, folder)))
    return checked.select("sample_id", "ts", (F.col("missing") == "").alias("accepted"), "missing")


@query
def ingest_counts(spark, folder):
    checked = store.validate_samples(views.with_gaps(views.load_samples(spark, folder)))
    return checked.groupBy("missing").agg(F.count("*").alias("n"))


@query
def store_roundtrip(spark, folder):
    path = scratch_path(spark, "store")
    store.write_samples(views.with_gaps(views.load_samples(spark, folder)), path)
    return store.read_store(spark, path).select("sample_id", *SAMPLE_COLUMNS)


@query
def scan_range(spark, folder):
    rows = scans.scan_samples(views.load_samples(spark, folder, RANGE_START, RANGE_END), RANGE_START, RANGE_END, host="h3")
    return rows.select("sample_id", *SAMPLE_COLUMNS)


@query
def scan_all_hosts(spark, folder):
    rows = scans.scan_samples(views.load_samples(spark, folder, RANGE_START, RANGE_END), RANGE_START, RANGE_END, host="")
    return rows.select("sample_id", *SAMPLE_COLUMNS)


@query
def scan_last(spark, folder):
    return scans.scan_last(views.load_samples(spark, folder), "7d").select("sample_id", *SAMPLE_COLUMNS)


@query
def detections_write(spark, folder):
    path = scratch_path(spark, "detections")
    store.write_detections(event_log(spark, folder), path, written_at=NOW)
    return store.read_detections(spark, path).withColumn("score", snap("score"))


@query
def detections_rewrite(spark, folder):
    """A first run writes the events up to a moment, a later one all events, and it is repeated: each event is there once."""
    path, events = scratch_path(spark, "detections"), event_log(spark, folder)
    store.write_detections(events.filter(F.col("ts") <= RANGE_END), path, written_at=NOW)
    store.write_detections(events.unionByName(events), path, written_at=NOW + 60)
    store.write_detections(events, path, written_at=NOW + 120)
    return store.read_detections(spark, path).withColumn("score", snap("score"))


@query
def detections_scan(spark, folder):
    rows = store.scan_detections(event_log(spark, folder), RANGE_START, RANGE_END, "anomaly")
    return rows.withColumn("score", snap("score"))


@query
def retention_keep(spark, folder):
    return store.retained(views.load_samples(spark, folder), NOW, RETENTION_DAYS).select("sample_id", "host", "ts")


@query
def retention_removed(spark, folder):
    return store.removed_count(views.load_samples(spark, folder), NOW, RETENTION_DAYS)


@query
def retention_store(spark, folder):
    """A store written in batch and one written by a stream, both pruned at noon of a day and read back."""
    root = scratch_path(spark, "retention")
    store.write_samples(views.with_gaps(views.load_samples(spark, folder)), f"{root}/batch")
    rows = views.with_gaps(views.samples_from_events(event_stream(spark, folder)))
    ingest_stream(rows, f"{root}/stream", f"{root}/checkpoint", AVAILABLE_NOW).awaitTermination()
    kept = []
    for name in ("batch", "stream"):
        removed = store.prune_store(spark, f"{root}/{name}", NOW + 43200, RETENTION_DAYS)
        left = store.read_store(spark, f"{root}/{name}").select("sample_id", *SAMPLE_COLUMNS)
        kept.append(left.withColumn("store", F.lit(name)).withColumn("removed", F.lit(removed).cast("long")))
    return kept[0].unionByName(kept[1])


@query
def store_stats(spark, folder):
    return store.store_stats(
        {
            "samples": views.load_samples(spark, folder),
            "models": model_registry(spark, folder),
            "detections": event_log(spark, folder),
        }
    )


@query
def host_stats(spark, folder):
    return store.host_stats(views.load_samples(spark, folder))


def model_registry(spark: SparkSession, folder: str) -> DataFrame:
    """A registry with one version per event: a model per event type and host."""
    events = views.read_table(spark, folder, "events")
    return events.selectExpr(
        "cast(event_id as string) as model_id",
        "concat(event_type, '_h', cast(user_id % 8 as string)) as name",
        "'IsolationForest' as algo",
        "concat('1.', cast(event_id % 7 as string)) as version",
        "cast(floor(unix_micros(cast(ts as timestamp)) / 1000000) as bigint) as trained_at",
        "props as meta_json",
    )


@query
def registry_latest(spark, folder):
    latest = store.latest_models(model_registry(spark, folder))
    return latest.withColumn("meta_k", F.from_json("meta_json", "k int").getField("k"))


@query
def export_roundtrip(spark, folder):
    path = scratch_path(spark, "export")
    rows = scans.scan_samples(views.load_samples(spark, folder, RANGE_START, RANGE_END), RANGE_START, RANGE_END)
    rows = rows.select("sample_id", *SAMPLE_COLUMNS)
    store.export_samples(rows, f"{path}/csv", "csv")
    store.export_samples(rows, f"{path}/json", "json")
    csv = spark.read.schema(rows.schema).option("header", True).csv(f"{path}/csv")
    json = spark.read.schema(rows.schema).json(f"{path}/json")
    return csv.withColumn("format", F.lit("csv")).unionByName(json.withColumn("format", F.lit("json")))


@query
def stream_ingest(spark, folder):
    rows = views.with_gaps(views.samples_from_events(event_stream(spark, folder)))
    result = finished(spark, lambda path, ck: ingest_stream(rows, path, ck, AVAILABLE_NOW), "ingest")
    return result.select("sample_id", *SAMPLE_COLUMNS)


COUNTERS = ["read_bytes", "write_bytes", "sent_bytes", "recv_bytes"]
RATES = [f"{c}_rate" for c in COUNTERS]


@query
def counter_rates(spark, folder):
    result = rates.counter_rates(views.counters(views.load_samples(spark, folder)), COUNTERS)
    return result.select("sample_id", "host", "ts", *[snap(c).alias(c) for c in RATES])


@query
def counter_rates_stream(spark, folder):
    result = in_time_order(spark, folder, lambda rows: counter_rate_stream(views.counters(rows), COUNTERS, STREAM_DELAY), "rates")
    return result.select("sample_id", "host", "ts", *[snap(c).alias(c) for c in RATES], "late")


@query
def fill_defaults(spark, folder):
    filled = store.fill_defaults(views.with_gaps(views.load_samples(spark, folder)))
    return filled.select("sample_id", *SAMPLE_COLUMNS)


@query
def sensor_coalesce(spark, folder):
    rows = views.sensors(views.load_samples(spark, folder))
    names = ["coretemp", "k10temp", "zenpower", "cpu_thermal"]
    readings = F.create_map(*[x for n in names for x in (F.lit(n), F.col(n))])
    return rows.select(
        "sample_id",
        "host",
        "ts",
        store.sensor_temperature().alias("cpu_temp"),
        store.sensor_map_temperature(readings).alias("cpu_temp_of_map"),
    )


# ---- time and text ------------------------------------------------------------------------------


def duration_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Duration strings, good and bad, made from each sample's id and memory reading."""
    unit = F.element_at(F.array(*[F.lit(u) for u in DURATION_UNITS]), (F.col("sample_id") % len(DURATION_UNITS) + 1).cast("int"))
    text = F.concat(F.lit(" "), F.col("mem_pct").cast("int").cast("string"), unit, F.lit(" "))
    return views.load_samples(spark, folder).select("sample_id", text.alias("text"))


@query
def parse_duration_text(spark, folder):
    return duration_texts(spark, folder).withColumn("seconds", parse_duration(F.col("text")))


@query
def format_duration_text(spark, folder):
    seconds = F.col("disk_read_bps") / 50.0
    return views.load_samples(spark, folder).select(
        "sample_id", F.floor(seconds).alias("seconds"), format_duration(seconds).alias("text")
    )


@query
def epoch_convert(spark, folder):
    rows = views.load_samples(spark, folder)
    return rows.select(
        "sample_id",
        epoch_to_utc(F.col("ts")).alias("utc"),
        epoch_to_local(F.col("ts"), LOCAL_ZONE).alias("local"),
        utc_to_epoch(epoch_to_utc(F.col("ts"))).alias("epoch"),
    )


# ---- features -----------------------------------------------------------------------------------


@query
def feat_lags(spark, folder):
    names = [n for m in METRICS for n in FAMILIES["feat_lags"](m)]
    return features.add_lags(views.load_samples(spark, folder)).select("sample_id", *snapped(names))


@query
def feat_rolling(spark, folder):
    names = [n for m in METRICS for n in FAMILIES["feat_rolling"](m)]
    return features.add_rolling_stats(views.load_samples(spark, folder)).select("sample_id", *snapped(names))


@query
def feat_ema(spark, folder):
    names = [n for m in METRICS for n in FAMILIES["feat_ema"](m)]
    return features.add_ema(views.load_samples(spark, folder)).select("sample_id", *snapped(names))


@query
def feat_slope(spark, folder):
    names = [n for m in METRICS for n in FAMILIES["feat_slope"](m)]
    return features.add_slope(views.load_samples(spark, folder)).select("sample_id", *snapped(names))


@query
def feat_burst(spark, folder):
    names = [n for m in features.IO_METRICS for n in FAMILIES["feat_burst"](m)]
    return features.add_burstiness(views.load_samples(spark, folder)).select("sample_id", *snapped(names))


FEATURES = features.FeatureSettings().feature_names()


@query
def features_all(spark, folder):
    table = features.feature_table(views.load_samples(spark, folder))
    return table.select("sample_id", "host", "ts", *snapped(FEATURES))


@query
def features_all_hot_hosts(spark, folder):
    """The same table with limits so low that every host counts as hot and is cut into segments."""
    rows = views.load_samples(spark, folder)
    plan = plan_segments(rows, hot_rows=100, segment_rows=500)
    return features.feature_table(rows, plan=plan).select("sample_id", "host", "ts", *snapped(FEATURES))


@query
def scaler_fit(spark, folder):
    fitted = scaling.fit_scaler(features.feature_table(views.load_samples(spark, folder)), FEATURES)
    wide = F.col("feature").contains("_bps") & ~F.col("feature").endswith("_burst")
    return fitted.select(
        "idx",
        "feature",
        *[F.when(wide, snap(c, 2)).otherwise(snap(c, 6)).alias(c) for c in ("mean", "scale")],
    )


@query
def scaler_apply(spark, folder):
    table = features.feature_table(views.load_samples(spark, folder))
    scaled = scaling.apply_scaler(table, scaling.fit_scaler(table, FEATURES), keep=["sample_id"])
    return scaled.select("sample_id", *snapped(FEATURES, digits=6))


@query
def feature_catalog(spark, folder):
    return scaling.feature_catalog(features.feature_table(views.load_samples(spark, folder)), FEATURES)


# ---- detection ----------------------------------------------------------------------------------


@query
def chrono_split(spark, folder):
    train, val = detection.chronological_split(views.load_samples(spark, folder), VAL_SPLIT)
    columns = ["sample_id", "host", "ts"]
    return train.select(*columns, F.lit("train").alias("side")).unionByName(
        val.select(*columns, F.lit("validation").alias("side"))
    )


@query
def forest_sample(spark, folder):
    return forest.forest_sample(views.load_samples(spark, folder), seed=SEED)


@query
def forest_sample_dealt(spark, folder):
    """Few small trees."""
    return forest.forest_sample(views.load_samples(spark, folder), n_trees=8, max_samples=32, seed=SEED)


@query
def forest_fit(spark, folder):
    table = features.feature_table(views.load_samples(spark, folder), keep=["sample_id"])
    return forest.fit_forest(table, FEATURES, seed=SEED, whole=True).withColumn("threshold", snap("threshold", 2))


def metric_forest(spark: SparkSession, folder: str) -> DataFrame:
    """Small trees over the metrics themselves."""
    return forest.fit_forest(views.load_samples(spark, folder), METRICS, n_trees=8, max_samples=32, seed=SEED)


@query
def forest_fit_metrics(spark, folder):
    return metric_forest(spark, folder).withColumn("threshold", snap("threshold", 2))


@query
def forest_score_metrics(spark, folder):
    nodes = metric_forest(spark, folder).collect()  # 8 trees of at most 63 nodes
    score = forest.ForestScorer(spark, nodes, max(n["size"] for n in nodes)).score(METRICS)
    return views.load_samples(spark, folder).select("sample_id", snap(score, 9).alias("score"))


def trained(spark: SparkSession, folder: str) -> tuple[DataFrame, detection.AnomalyModel, DataFrame]:
    rows = views.load_samples(spark, folder)
    bounds = rows.agg(F.min("ts"), F.max("ts")).first()
    model, summary = detection.train(rows, *bounds, val_split=VAL_SPLIT, target_fpr=TARGET_FPR, seed=SEED, contamination=None)
    return rows, model, summary


@query
def train_summary(spark, folder):
    return trained(spark, folder)[2].withColumn("threshold", snap("threshold"))


@query
def forest_score(spark, folder):
    rows, model, _ = trained(spark, folder)
    scored = detection.score_features(features.feature_table(rows), model)
    return scored.select("sample_id", "host", "ts", snap("score").alias("score"))


@query
def detect_batch(spark, folder):
    rows, model, _ = trained(spark, folder)
    flagged = detection.detect(rows, model, RANGE_START, RANGE_END)
    return detection.extract_anomalies(flagged).withColumn("score", snap("score"))


@query
def model_roundtrip(spark, folder):
    rows, model, _ = trained(spark, folder)
    path = scratch_path(spark, "models")
    detection.save_model(spark, path, model)
    restored = detection.load_model(spark, path)
    before = detection.detect(rows, model, RANGE_START, RANGE_END).select("sample_id", "score", "is_anomaly")
    after = detection.detect(rows, restored, RANGE_START, RANGE_END).select(
        "sample_id", F.col("score").alias("restored_score"), F.col("is_anomaly").alias("restored_flag")
    )
    return before.join(after, "sample_id").agg(
        F.count("*").alias("rows"),
        F.count_if((F.col("score") != F.col("restored_score")) | (F.col("is_anomaly") != F.col("restored_flag"))).alias("differences"),
    )


@query
def detect_streaming(spark, folder):
    _, model, _ = trained(spark, folder)
    result = in_time_order(spark, folder, lambda rows: detect_stream(rows, model, STREAM_DELAY), "detect")
    return result.select("sample_id", "host", "ts", snap("score").alias("score"), "is_anomaly", "late")


@query
def features_stream(spark, folder):
    """The features of all rows, from a stream in no order."""
    result = in_time_order(spark, folder, lambda rows: feature_stream(rows, delay=STREAM_DELAY), "features")
    return result.select("sample_id", "host", "ts", *snapped(FEATURES))


# Two small trees over cpu_pct (feature 0) and mem_pct (feature 1), grown from 256 rows.
FIXED_FOREST = [
    (0, 0, 0, 90.0, 1, 2, 256, 0),
    (0, 1, None, None, None, None, 240, 1),
    (0, 2, 1, 50.0, 3, 4, 16, 1),
    (0, 3, None, None, None, None, 15, 2),
    (0, 4, None, None, None, None, 1, 2),
    (1, 0, 1, 97.0, 1, 2, 256, 0),
    (1, 1, None, None, None, None, 254, 1),
    (1, 2, None, None, None, None, 2, 1),
]


@query
def forest_score_fixed(spark, folder):
    nodes = spark.createDataFrame(FIXED_FOREST, FOREST_SCHEMA).collect()
    score = forest.ForestScorer(spark, nodes, 256).score([F.col("cpu_pct"), F.col("mem_pct")])
    return views.load_samples(spark, folder).select("sample_id", snap(score, 9).alias("score"))


@query
def predict_contamination(spark, folder):
    scores = scored_samples(spark, folder)
    offset = forest.contamination_offset(scores, 0.05)
    return scores.select("sample_id", forest.contamination_label(F.col("score"), offset).alias("label"))


@query
def calibrate_threshold(spark, folder):
    rows = views.load_samples(spark, folder).withColumn("score", -F.col("cpu_pct") / 100.0)
    threshold = forest.calibrate_threshold(rows, TARGET_FPR)
    flagged = rows.agg(F.count("*").alias("rows"), F.count_if(F.col("score") < threshold).alias("below"))
    return flagged.select(snap(F.lit(threshold)).alias("threshold"), "rows", "below")


@query
def calibrate_by_host(spark, folder):
    """Each host's own threshold, and how many of its rows it flags."""
    rows = views.load_samples(spark, folder).withColumn("score", -F.col("cpu_pct") / 100.0)
    flagged = forest.below_thresholds(rows, forest.calibrate_thresholds(rows, TARGET_FPR))
    told = flagged.groupBy("host").agg(F.max("threshold").alias("threshold"), F.count("*").alias("rows"), F.count_if("is_anomaly").alias("below"))
    return told.withColumn("threshold", snap("threshold"))


@query
def threshold_predict(spark, folder):
    scores = scored_samples(spark, folder)
    return scores.select("sample_id", forest.below_threshold(F.col("score"), SCORE_THRESHOLD).alias("is_anomaly"))


@query
def anomaly_tags(spark, folder):
    rows = flagged_samples(spark, folder).filter("is_anomaly")
    return rows.select("sample_id", "ts", detection.metric_tags().alias("metric_tags"))


@query
def anomaly_explain(spark, folder):
    found = detection.extract_anomalies(flagged_samples(spark, folder))
    return found.select("sample_id", "host", "ts", snap("score").alias("score"), "metric_tags", "explanation")


@query
def detect_summary(spark, folder):
    return detection.detection_summary(flagged_samples(spark, folder)).withColumn("anomaly_pct", snap("anomaly_pct"))


# ---- evaluation ---------------------------------------------------------------------------------


@query
def fpr_tpr_at(spark, folder):
    return evaluation.fpr_tpr_at(scored_samples(spark, folder), SCORE_THRESHOLD).select(
        snap("fpr").alias("fpr"), snap("tpr").alias("tpr")
    )


@query
def prec_recall_at(spark, folder):
    return evaluation.precision_recall_at(scored_samples(spark, folder), SCORE_THRESHOLD).select(
        snap("precision").alias("precision"), snap("recall").alias("recall")
    )


@query
def classification_report(spark, folder):
    report = evaluation.classification_report(flagged_scores(spark, folder))
    return report.select(*[snap(c).alias(c) for c in report.columns])


@query
def roc_auc(spark, folder):
    return evaluation.roc_auc(scored_samples(spark, folder)).select(snap("auc").alias("auc"))


@query
def roc_curve(spark, folder):
    curve = evaluation.roc_curve(scored_samples(spark, folder))
    return curve.select(*[snap(c).alias(c) for c in ("fpr", "tpr", "threshold")])


@query
def pr_curve(spark, folder):
    curve = evaluation.pr_curve(scored_samples(spark, folder))
    return curve.select(*[snap(c).alias(c) for c in ("precision", "recall", "threshold")])


@query
def roc_curve_fine(spark, folder):
    """Scores with few ties, so that the curve has about as many points as distinct values."""
    rows = views.load_samples(spark, folder).withColumn("score", -F.col("disk_read_bps") / 1e7)
    curve = evaluation.roc_curve(rows, drop_collinear=False)
    return curve.select(*[snap(c).alias(c) for c in ("fpr", "tpr", "threshold")])


@query
def lead_time_runs(spark, folder):
    return evaluation.lead_time_runs(flagged_scores(spark, folder))


@query
def lead_time(spark, folder):
    delays = evaluation.lead_time(evaluation.lead_time_runs(flagged_scores(spark, folder)))
    return delays.select(*[snap(c).alias(c) for c in delays.columns])


@query
def score_histogram(spark, folder):
    table = evaluation.score_histogram(scored_samples(spark, folder))
    return table.select("y_true", "bin", snap("bin_low").alias("bin_low"), "n", snap("density").alias("density"))


@query
def inject_anomalies(spark, folder):
    injected = evaluation.inject_anomalies(views.load_samples(spark, folder), tuple(evaluation.INJECTIONS), 0.05, SEED)
    return injected.select("sample_id", "y_true", *snapped(METRICS))


@query
def evaluation_report(spark, folder):
    _, _, report = evaluation.run_evaluation(views.load_samples(spark, folder), contamination=0.05, seed=SEED)
    return report.select("test_samples", *[snap(c).alias(c) for c in report.columns if c != "test_samples"])


@query
def evaluation_tables(spark, folder):
    """Both curves of a back-test, as they were written to its folder."""
    path = scratch_path(spark, "evaluation")
    model, scored, _ = evaluation.run_evaluation(views.load_samples(spark, folder), contamination=0.05, seed=SEED)
    evaluation.write_evaluation(scored, model.threshold, path)
    parts = {"roc": ("fpr", "tpr"), "pr": ("recall", "precision")}
    roc, pr = (
        spark.read.parquet(f"{path}/{name}").select(F.lit(name).alias("curve"), snap(x).alias("x"), snap(y).alias("y"), snap("threshold").alias("threshold"))
        for name, (x, y) in parts.items()
    )
    return roc.unionByName(pr)


# ---- forecasts ----------------------------------------------------------------------------------


def labelled_rows(spark: SparkSession, folder: str) -> DataFrame:
    labelled = forecasting.time_to_threshold(views.load_samples(spark, folder), FORECAST_METRICS)
    return forecasting.training_rows(labelled, list(FORECAST_METRICS))


def forecasts(spark: SparkSession, folder: str) -> DataFrame:
    """Forecasts for every sample from the linear fits of its host."""
    fits = forecasting.fit_linear(labelled_rows(spark, folder))
    rows = forecasting.current_values(views.load_samples(spark, folder), list(FORECAST_METRICS))
    return forecasting.predict_linear(rows, fits)


FORECAST_COLUMNS = ["time_to_threshold_minutes", "confidence_lower", "confidence_upper"]


@query
def ttt_label(spark, folder):
    labelled = forecasting.time_to_threshold(views.load_samples(spark, folder), FORECAST_METRICS)
    return labelled.select("sample_id", "host", "ts", *[snap(f"ttt_{m}").alias(f"ttt_{m}") for m in FORECAST_METRICS])


@query
def forecast_linear_fit(spark, folder):
    return forecasting.fit_linear(labelled_rows(spark, folder)).select(
        "host", "metric", snap("slope").alias("slope"), snap("intercept").alias("intercept"), "n"
    )


@query
def forecast_residual_std(spark, folder):
    fits = forecasting.fit_linear(labelled_rows(spark, folder))
    return fits.select("host", "metric", snap("residual_std").alias("residual_std"))


@query
def forecast_multi_metric(spark, folder):
    return forecasting.fit_linear(labelled_rows(spark, folder), min_rows=2).select(
        "host", "metric", *[snap(c).alias(c) for c in ("slope", "intercept", "residual_std")], "n"
    )


@query
def forecast_predict(spark, folder):
    return forecasts(spark, folder).select("sample_id", "host", "metric", *[snap(c).alias(c) for c in FORECAST_COLUMNS])


@query
def forecast_critical(spark, folder):
    near = forecasting.critical_forecasts(forecasts(spark, folder), horizon_hours=24)
    return near.select("sample_id", "metric", snap("time_to_threshold_minutes").alias("time_to_threshold_minutes"))


@query
def forecast_table(spark, folder):
    fits = forecasting.fit_linear(labelled_rows(spark, folder))
    latest = summaries.latest_samples(views.load_samples(spark, folder))
    current = forecasting.current_values(latest, list(FORECAST_METRICS))
    return forecasting.forecast_table(forecasting.predict_linear(current, fits))


@query
def forecast_gbt_fit(spark, folder):
    labelled = forecasting.time_to_threshold(views.load_samples(spark, folder), {"cpu_pct": 90.0})
    fitted = forecasting.fit_forecaster(labelled, METRICS, "ttt_cpu_pct", algo="gbr", max_iter=BOOSTED_TREES)
    return fitted.predict(labelled).select("sample_id", *[snap(c, 4).alias(c) for c in FORECAST_COLUMNS])


@query
def forecast_linear_two(spark, folder):
    """Linear regression on two metrics, few enough for a closed form."""
    labelled = forecasting.time_to_threshold(views.load_samples(spark, folder), {"cpu_pct": 90.0})
    fitted = forecasting.fit_forecaster(labelled, ["cpu_pct", "mem_pct"], "ttt_cpu_pct", algo="linear")
    return fitted.predict(labelled).select("sample_id", *[snap(c, 4).alias(c) for c in FORECAST_COLUMNS])


@query
def forecast_linear_features(spark, folder):
    """Linear regression on all metrics at once, for each of three thresholds; some metrics depend linearly on others."""
    labelled = forecasting.time_to_threshold(views.load_samples(spark, folder), FORECAST_METRICS)
    fitted = forecasting.fit_forecasters(labelled, FORECAST_METRICS, METRICS)
    parts = [
        fit.predict(labelled).select("sample_id", F.lit(metric).alias("metric"), *[snap(c, 4).alias(c) for c in FORECAST_COLUMNS])
        for metric, fit in fitted.items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# ---- alerts -------------------------------------------------------------------------------------


@query
def rule_threshold(spark, folder):
    rows = views.load_samples(spark, folder)
    rule = alerts.threshold_rule("temp_high", "cpu_temp", 80.0, "critical")
    return alerts.raise_alerts(rows, [rule])


@query
def rule_anomaly(spark, folder):
    return alerts.raise_alerts(alert_input(spark, folder), [alerts.anomaly_rule()])


@query
def rule_forecast(spark, folder):
    labelled = forecasting.time_to_threshold(views.load_samples(spark, folder), FORECAST_METRICS)
    rules = [
        alerts.forecast_rule(f"{m}_soon", m, F.col(f"ttt_{m}"), horizon_hours=1) for m in FORECAST_METRICS
    ]
    return alerts.raise_alerts(labelled, rules)


def all_rules() -> list[alerts.Rule]:
    custom = alerts.sql_rule("busy_disk", "disk_read_bps >= 2e7", "concat('disk busy on ', host)", "info")
    return [*alerts.default_rules(), custom]


@query
def alerts_raw(spark, folder):
    return alerts.raise_alerts(alert_input(spark, folder), all_rules())


@query
def alerts_cooldown(spark, folder):
    return alerts.apply_cooldown(alerts.raise_alerts(alert_input(spark, folder), all_rules()))


@query
def alerts_long_cooldown(spark, folder):
    """Six hours instead of a minute: waits that often reach into the next day."""
    raised = alerts.raise_alerts(alert_input(spark, folder), all_rules())
    return alerts.apply_cooldown(raised, cooldown=LONG_COOLDOWN)


@query
def alerts_stream(spark, folder):
    def build(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("score", F.expr("-floor(cpu_pct) / 100.0D"))
        rows = rows.withColumn("is_anomaly", F.col("score") < FLAG_THRESHOLD)
        return alert_stream(rows, all_rules(), LONG_COOLDOWN, STREAM_DELAY)

    return in_time_order(spark, folder, build, "alerts")


# ---- dashboard tables ---------------------------------------------------------------------------


@query
def history_last_n(spark, folder):
    history = summaries.recent_history(views.load_samples(spark, folder))
    series = [snap(s).alias(s) for s in summaries.HISTORY_SERIES]
    return history.select("host", "ts", "sample_id", "position", *series)


@query
def latest_sample(spark, folder):
    return summaries.latest_samples(views.load_samples(spark, folder)).select("host", "sample_id", "ts", *METRICS)


@query
def metric_status(spark, folder):
    rows = alert_input(spark, folder)
    return rows.select(
        "sample_id",
        summaries.metric_status(F.col("cpu_pct"), F.col("is_anomaly"), 90.0).alias("cpu_status"),
        summaries.metric_status(F.col("mem_pct"), F.lit(False), 90.0).alias("mem_status"),
        summaries.metric_status(F.col("swap_pct"), F.lit(False)).alias("swap_status"),
    )


@query
def recent_alerts(spark, folder):
    return summaries.recent_alerts(event_log(spark, folder))


@query
def alert_state(spark, folder):
    return summaries.alert_state(event_log(spark, folder))


@query
def trend_levels(spark, folder):
    trends = summaries.host_trends(summaries.recent_history(views.load_samples(spark, folder)))
    return trends.select("host", "series", F.array_join("levels", ",").alias("levels"))


@query
def metric_histogram(spark, folder):
    return summaries.metric_histogram(views.load_samples(spark, folder))
