import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from fleetpulse.operators.detection import (
    detect,
    detection_summary,
    explanation,
    extract_anomalies,
    load_model,
    metric_tags,
    save_model,
    train,
)
from fleetpulse.operators.evaluation import evaluation_report, inject_anomalies, lead_time, lead_time_runs
from fleetpulse.plans.segments import plan_segments
from fleetpulse.schema import SAMPLE_SCHEMA
from fleetpulse.sources.store import detection_rows, scan_detections, write_detections
from fleetpulse.sources.views import load_samples


def resting(spark, first, count, start):
    """`count` samples of the given tables as one host that samples each second, with loads halved."""
    rows = load_samples(spark, "/root/testdata/sf0.01")
    place = F.row_number().over(Window.orderBy("ts", "sample_id")) - 1
    rows = rows.withColumn("place", place).filter(F.col("place").between(first, first + count - 1))
    second = F.col("place") - first + start
    rows = rows.withColumns({"sample_id": second, "ts": second, "host": F.lit("one")})
    halved = {c: F.col(c) / 2 for c in ("cpu_pct", "mem_pct")}
    return rows.withColumns(halved).select([F.col(f.name).cast(f.dataType) for f in SAMPLE_SCHEMA])


@pytest.fixture(scope="module")
def workflow(spark, tmp_path_factory):
    """1,000 normal rows, then 200 with 10 % injected anomalies."""
    path = str(tmp_path_factory.mktemp("w") / "samples")
    test = inject_anomalies(resting(spark, 1000, 200, 1_001_000), ["cpu_spike", "memory_leak"], 0.1)
    normal = resting(spark, 0, 1000, 1_000_000).withColumn("y_true", F.lit(0))
    normal.unionByName(test).coalesce(2).write.parquet(path)
    samples = spark.read.parquet(path)
    model, summary = train(samples, 1_000_000, 1_000_999, n_trees=50)
    detected = detect(samples, model, 1_001_000, 1_001_199).cache()
    return samples, model, summary.first(), detected


def test_workflow(spark, workflow, tmp_path):
    _, model, summary, detected = workflow
    assert (summary.train_samples, summary.val_samples, summary.features) == (800, 200, 88)
    assert summary.threshold == model.threshold and model.offset is not None
    flagged = detected.filter("is_anomaly").count()
    assert detected.count() == 200 and 0 < flagged < 200
    anomalies = extract_anomalies(detected)
    assert anomalies.count() == flagged
    write_detections(detection_rows(anomalies), str(tmp_path / "log"), written_at=5)
    saved = scan_detections(spark.read.parquet(str(tmp_path / "log")), 0, 2_000_000_000)
    assert saved.count() == flagged and saved.select("id").distinct().count() == flagged


def test_injected_rows_score_lower(workflow):
    *_, detected = workflow
    medians = {r.y_true: r.m for r in detected.groupBy("y_true").agg(F.median("score").alias("m")).collect()}
    assert medians[1] < medians[0]
    report = evaluation_report(detected, -0.5).first()
    assert report.test_samples == 200 and report.auc > 0.5


def test_save_and_load(spark, workflow, tmp_path):
    samples, model, _, detected = workflow
    save_model(spark, str(tmp_path), model)
    restored = load_model(spark, str(tmp_path))
    assert restored.threshold == model.threshold and restored.settings.feature_names() == model.settings.feature_names()
    again = detect(samples, restored, 1_001_000, 1_001_199)
    assert sorted(r.score for r in again.collect()) == sorted(r.score for r in detected.collect())
    assert load_model(spark, str(tmp_path), "other") is None


def test_empty_ranges(workflow):
    samples, model, *_ = workflow
    nothing = detect(samples, model, 5, 6)
    assert nothing.count() == 0
    summary = detection_summary(nothing).first()
    assert (summary.samples, summary.anomaly_pct) == (0, None)
    with pytest.raises(ValueError):
        train(samples, 5, 6)


def test_warm_start_sees_earlier_rows(workflow):
    samples, model, *_ = workflow
    warm = detect(samples, model, 1_001_000, 1_001_199, warmup_s=600)
    whole = detect(samples, model, 1_000_000, 1_001_199).filter("ts >= 1001000")
    assert warm.count() == 200
    a = {r.sample_id: r.score for r in warm.collect()}
    assert all(a[r.sample_id] == pytest.approx(r.score, abs=1e-9) for r in whole.collect())


def test_tag_edges(spark):
    columns = ["cpu_pct", "mem_pct", "disk_read_bps", "disk_write_bps", "net_up_bps", "net_down_bps", "score"]
    rows = [
        (80.0, 0.0, 0.0, 0.0, 0.0, 0.0, -0.5),
        (80.1, 81.0, 2e7, 0.0, 0.0, 0.0, -0.5),
        (0.0, 0.0, 1e7, 1e7 + 1, 0.0, 3e7, -0.6126),
    ]
    frame = spark.createDataFrame(rows, columns)
    tags = [r[0] for r in frame.select(metric_tags()).collect()]
    assert tags == ["general", "cpu_pct,mem_pct", "disk_write_bps,net_down_bps"]
    texts = [r[0] for r in frame.select(explanation()).collect()]
    assert texts[0] == "Anomaly score -0.500: unusual pattern detected"
    assert texts[1] == "Anomaly score -0.500: high CPU (80.1%), high memory (81.0%)"
    assert texts[2] == "Anomaly score -0.613: high disk write (10.0 MB/s), high network download (30.0 MB/s)"


def test_lead_time_by_hand(spark):
    """Runs start at rows 2 and 6; the first is flagged two rows on, the second never."""
    truth, flags = [0, 0, 1, 1, 1, 0, 1, 0], [0, 1, 0, 0, 1, 0, 0, 0]
    rows = [(i, "a", i * 10, y, bool(p)) for i, (y, p) in enumerate(zip(truth, flags))]
    frame = spark.createDataFrame(rows, "sample_id long, host string, ts long, y_true int, is_anomaly boolean")
    runs = lead_time_runs(frame)
    found = {r.start_ts: r.lead_time for r in runs.collect()}
    assert found == {20: 20, 60: None}
    assert tuple(lead_time(runs).first()) == (20.0, 20.0)
    assert tuple(lead_time(runs.filter("lead_time is null")).first()) == (0.0, 0.0)


def test_lead_time_reaches_100_rows_on_any_host_size(spark):
    """Random labels against a direct reading of the definition, on whole and on cut hosts."""
    rng = np.random.default_rng(3)
    rows = [(i, "ab"[i % 2], i // 4, int(y), bool(p)) for i, (y, p) in enumerate(zip(rng.random(2000) < 0.3, rng.random(2000) < 0.012))]
    frame = spark.createDataFrame(rows, "sample_id long, host string, ts long, y_true int, is_anomaly boolean")
    expected = set()
    for host in "ab":
        own = [r for r in rows if r[1] == host]
        for i, (sample, _, ts, y, _) in enumerate(own):
            if y - (own[i - 1][3] if i else 0) == 1:
                hits = [r[2] for r in own[i : i + 100] if r[4]]
                expected.add((sample, hits[0] if hits else None))
    for plan in (None, plan_segments(frame, hot_rows=100, segment_rows=150)):
        runs = lead_time_runs(frame, plan).collect()
        assert {(r.sample_id, r.detected_ts) for r in runs} == expected and len(runs) == len(expected)
    assert any(found is None for _, found in expected)
