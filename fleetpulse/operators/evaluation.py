"""How good a detector is: confusion metrics, curves, detection delay, injected anomalies.

Scores are lower for more anomalous rows. Inputs have `score`, `y_true` (0 or 1) and, where predictions
matter, a boolean `is_anomaly`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetpulse.functions.hashing import hash_number, hash_uniform
from fleetpulse.operators.detection import AnomalyModel, chronological_split, detect, fit_model, score_features
from fleetpulse.operators.features import feature_table
from fleetpulse.operators.forest import calibrate_threshold
from fleetpulse.plans.ranks import precedes_rank
from fleetpulse.plans.segments import SegmentPlan, core_rows, segmented
from fleetpulse.plans.totals import running_totals
from fleetpulse.session import pinned

# What each kind of injected anomaly sets, as (column, low, high).
INJECTIONS = {
    "cpu_spike": [("cpu_pct", 90, 100)],
    "memory_leak": [("mem_pct", 85, 100)],
    "io_storm": [("disk_read_bps", 10**8, 10**9), ("disk_write_bps", 10**8, 10**9)],
    "network_flood": [("net_up_bps", 10**8, 10**9), ("net_down_bps", 10**8, 10**9)],
    "swap_pressure": [("swap_pct", 80, 100)],
}
EVALUATED_INJECTIONS = ["cpu_spike", "memory_leak", "io_storm", "network_flood"]
DETECTION_ROWS = 100


def _ratio(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole), F.lit(0.0))


def _confusion(flagged: Column) -> dict[str, Column]:
    actual = F.col("y_true") == 1
    return {
        "tp": F.count_if(flagged & actual),
        "fp": F.count_if(flagged & ~actual),
        "tn": F.count_if(~flagged & ~actual),
        "fn": F.count_if(~flagged & actual),
    }


def fpr_tpr_at(scores: DataFrame, threshold: float) -> DataFrame:
    """One row `fpr, tpr` when scores below `threshold` are flagged; 0 where a class is empty."""
    c = _confusion(F.col("score") < F.lit(threshold))
    return scores.agg(
        _ratio(c["fp"], c["fp"] + c["tn"]).alias("fpr"), _ratio(c["tp"], c["tp"] + c["fn"]).alias("tpr")
    )


def precision_recall_at(scores: DataFrame, threshold: float) -> DataFrame:
    """One row `precision, recall` when scores below `threshold` are flagged."""
    c = _confusion(F.col("score") < F.lit(threshold))
    return scores.agg(
        _ratio(c["tp"], c["tp"] + c["fp"]).alias("precision"),
        _ratio(c["tp"], c["tp"] + c["fn"]).alias("recall"),
    )


def _by_score(scores: DataFrame, *extra: Column) -> DataFrame:
    """Positives and negatives per distinct score, stored for several passes; ties meet here, before anything is ordered."""
    return pinned(
        scores.groupBy(F.col("score").cast("double").alias("score"))
        .agg(F.count_if(F.col("y_true") == 1).alias("pos"), F.count_if(F.col("y_true") == 0).alias("neg"), *extra)
    )


def _auc() -> Column:
    """Area under the curve from per-score counts and running positives; ties count half, no class 0."""
    wins = F.sum(F.col("neg") * (F.col("cum_pos") - F.col("pos") / 2.0))
    return F.coalesce(F.try_divide(wins, F.sum("pos").cast("double") * F.sum("neg")), F.lit(0.0))


def roc_auc(scores: DataFrame) -> DataFrame:
    """One row `auc`: the chance that an anomaly scores below a normal row."""
    return running_totals(_by_score(scores), "score", ["pos"]).agg(_auc().alias("auc"))


def classification_report(detections: DataFrame) -> DataFrame:
    """One row `accuracy, precision, recall, fpr, auc`."""
    counts = _confusion(F.col("is_anomaly"))
    table = running_totals(_by_score(detections, *[c.alias(n) for n, c in counts.items()]), "score", ["pos"])
    tp, fp, tn, fn = (F.sum(n) for n in counts)
    return table.agg(
        _ratio(tp + tn, tp + fp + tn + fn).alias("accuracy"),
        _ratio(tp, tp + fp).alias("precision"),
        _ratio(tp, tp + fn).alias("recall"),
        _ratio(fp, fp + tn).alias("fpr"),
        _auc().alias("auc"),
    )


def _with_class_totals(table: DataFrame, by_score: DataFrame) -> DataFrame:
    totals = by_score.agg(F.sum("pos").alias("positives"), F.sum("neg").alias("negatives")).first()
    return table.withColumns(
        {"positives": F.lit(totals["positives"] or 0), "negatives": F.lit(totals["negatives"] or 0)}
    )


def _end_point(scores: DataFrame, curve: DataFrame, first: float = 0.0) -> DataFrame:
    """The curve's point without a threshold; its columns may be NULL even where those of `curve` may not."""
    values = (first, 0.0, None)
    row = [F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(values, curve.schema)]
    return scores.sparkSession.range(1).select(*row)


def roc_curve(scores: DataFrame, drop_collinear: bool = True) -> DataFrame:
    """Rows `fpr, tpr, threshold`, one per distinct score plus the origin.

    Thresholds are on the inverted score (higher means more anomalous); the origin's is NULL.
    `drop_collinear` leaves out points in the middle of a straight stretch: those whose own counts
    equal the next point's.
    """
    by_score = _by_score(scores)
    points = running_totals(by_score, "score", ["pos", "neg"], following=["pos", "neg"])
    points = _with_class_totals(points, by_score)
    if drop_collinear:
        first = F.col("cum_pos") + F.col("cum_neg") == F.col("pos") + F.col("neg")
        bend = (F.col("next_pos") != F.col("pos")) | (F.col("next_neg") != F.col("neg"))
        points = points.filter(first | F.col("next_pos").isNull() | bend)
    curve = points.select(
        (F.col("cum_neg") / F.col("negatives")).alias("fpr"),
        (F.col("cum_pos") / F.col("positives")).alias("tpr"),
        (-F.col("score")).alias("threshold"),
    )
    return curve.unionByName(_end_point(scores, curve))


def pr_curve(scores: DataFrame) -> DataFrame:
    """Rows `precision, recall, threshold`, one per distinct score plus the end point (1, 0, NULL)."""
    by_score = _by_score(scores)
    points = _with_class_totals(running_totals(by_score, "score", ["pos", "neg"]), by_score)
    curve = points.select(
        (F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))).alias("precision"),
        (F.col("cum_pos") / F.col("positives")).alias("recall"),
        (-F.col("score")).alias("threshold"),
    )
    return curve.unionByName(_end_point(scores, curve, 1.0))


def lead_time_runs(detections: DataFrame, plan: SegmentPlan | None = None) -> DataFrame:
    """One row per start of an anomalous run: `sample_id, host, start_ts, detected_ts, lead_time`.

    `detected_ts` is the first flagged row among the 100 rows from the start on, NULL if there is none.
    Read backwards, the next flagged row is a running value; a frame of 100 rows would be visited anew
    for every row.
    """
    frame, keys = segmented(detections, plan, before=1, after=DETECTION_ROWS - 1)
    backwards = Window.partitionBy(*keys).orderBy(F.desc("ts"), F.desc("sample_id"))
    to_here = backwards.rowsBetween(Window.unboundedPreceding, 0)
    numbered = frame.select(
        "*",
        F.row_number().over(backwards).alias("place"),
        (F.col("y_true") - F.lead("y_true", 1, 0).over(backwards) == 1).alias("starts"),
    )
    flagged = F.when(F.col("is_anomaly"), F.struct("place", "ts"))
    runs = numbered.withColumn("next", F.last(flagged, ignorenulls=True).over(to_here))
    soon_enough = F.col("place") - F.col("next.place") < DETECTION_ROWS
    return (
        core_rows(runs)
        .filter("starts")
        .withColumn("detected_ts", F.when(soon_enough, F.col("next.ts")))
        .select(
            "sample_id",
            "host",
            F.col("ts").alias("start_ts"),
            "detected_ts",
            (F.col("detected_ts") - F.col("ts")).alias("lead_time"),
        )
    )


def lead_time(runs: DataFrame) -> DataFrame:
    """One row: mean and median delay in seconds over detected runs, 0 if none was detected.

    Delays are counted per second first, so the median works on distinct delays, not on runs.
    """
    delays = runs.filter(F.col("lead_time").isNotNull()).groupBy("lead_time").agg(F.count("*").alias("n"))
    mean = F.try_divide(F.sum(F.col("lead_time") * F.col("n")).cast("double"), F.sum("n"))
    return delays.agg(
        F.coalesce(mean, F.lit(0.0)).alias("mean_lead_time"),
        F.coalesce(F.percentile("lead_time", 0.5, F.col("n")), F.lit(0.0)).alias("median_lead_time"),
    )


def score_histogram(scores: DataFrame, bins: int = 50) -> DataFrame:
    """Rows `y_true, bin, bin_low, n, density` over each class's own range; the last bin is closed.

    The per-class ranges are two rows, hence the broadcast.
    """
    half = F.when(F.max("score") == F.min("score"), 0.5).otherwise(0.0)
    ranges = scores.groupBy("y_true").agg(
        (F.min("score") - half).alias("low"), (F.max("score") + half).alias("high"), F.count("*").alias("total")
    )
    width = (F.col("high") - F.col("low")) / bins
    place = F.least(F.floor((F.col("score") - F.col("low")) / width), F.lit(bins - 1)).cast("int")
    counted = (
        scores.join(F.broadcast(ranges), "y_true")
        .groupBy("y_true", place.alias("bin"), "low", "high", "total")
        .agg(F.count("*").alias("n"))
    )
    return counted.select(
        "y_true",
        "bin",
        (F.col("low") + F.col("bin") * width).alias("bin_low"),
        "n",
        (F.col("n") / (F.col("total") * width)).alias("density"),
    )


def inject_anomalies(
    samples: DataFrame,
    anomaly_types: Sequence[str] = tuple(EVALUATED_INJECTIONS),
    contamination: float = 0.05,
    seed: int = 42,
) -> DataFrame:
    """Overwrite metrics of `int(n * contamination)` rows and label them in `y_true`.

    The rows are those with the smallest hashes; kind and values come from hashes too. So the result is
    the same under any partitioning, and picking the rows takes aggregation passes only, no sort.
    """
    wanted = int(samples.count() * contamination)
    hashed = samples.withColumn("pick", hash_number(seed, "pick", F.col("sample_id")))
    chosen = precedes_rank(hashed, "pick", "sample_id", wanted)
    kind = F.pmod(hash_number(seed, "kind", F.col("sample_id")), F.lit(len(anomaly_types)))
    marked = hashed.withColumn("injected", F.when(chosen, kind))
    replaced: dict[str, Column] = {}
    for index, name in enumerate(anomaly_types):
        for column, low, high in INJECTIONS[name]:
            drawn = hash_uniform(low, high, seed, column, F.col("sample_id"))
            replaced[column] = F.when(F.col("injected") == index, drawn).otherwise(
                replaced.get(column, F.col(column))
            )
    return (
        marked.withColumns(replaced)
        .withColumn("y_true", F.col("injected").isNotNull().cast("int"))
        .drop("pick", "injected")
    )


def run_evaluation(
    samples: DataFrame,
    test_share: float = 0.2,
    contamination: float = 0.05,
    target_fpr: float = 0.05,
    anomaly_types: Sequence[str] = tuple(EVALUATED_INJECTIONS),
    **fit_options,
) -> tuple[AnomalyModel, DataFrame, DataFrame]:
    """Back-test on given samples: train on the earlier part, inject anomalies into the rest, detect.

    Returns the model, the scored test rows (kept in the shared folder, since several reports read
    them) and a one-row report.
    """
    past, recent = chronological_split(samples, test_share)
    train_rows, val_rows = chronological_split(past, 0.2)
    model = fit_model(train_rows, **fit_options)
    val_scores = pinned(score_features(feature_table(val_rows, model.settings), model).select("score"))
    model = model.with_threshold(calibrate_threshold(val_scores, target_fpr))
    test = inject_anomalies(recent, anomaly_types, contamination)
    bounds = test.agg(F.min("ts"), F.max("ts")).first()
    scored = pinned(detect(test, model, *bounds))
    return model, scored, evaluation_report(scored, model.threshold)


def evaluation_report(scored: DataFrame, threshold: float) -> DataFrame:
    """Classification metrics and detection delay of scored rows, in one row."""
    delay = lead_time(lead_time_runs(scored)).first()
    return classification_report(scored).select(
        F.lit(scored.count()).cast("long").alias("test_samples"),
        F.lit(float(threshold)).alias("threshold"),
        "*",
        F.lit(delay["mean_lead_time"]).alias("mean_lead_time"),
        F.lit(delay["median_lead_time"]).alias("median_lead_time"),
    )


def write_evaluation(scored: DataFrame, threshold: float, path: str, bins: int = 50) -> None:
    """Write a back-test's results to the folder `path`, each as a Parquet table: `report` (one row), `roc`, `pr` and `histogram`."""
    tables = {
        "report": evaluation_report(scored, threshold),
        "roc": roc_curve(scored),
        "pr": pr_curve(scored),
        "histogram": score_histogram(scored, bins),
    }
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{path}/{name}")
