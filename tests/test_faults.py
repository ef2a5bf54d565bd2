"""One test for each fault that was found after the first round."""

import pytest
from pyspark.sql import functions as F

from fleetpulse.operators.alerts import apply_cooldown
from fleetpulse.operators.detection import load_model
from fleetpulse.operators.evaluation import pr_curve, roc_curve
from fleetpulse.operators.features import FeatureSettings
from fleetpulse.sources.store import prune_store, read_store, write_samples
from fleetpulse.sources.views import load_samples
from fleetpulse.streaming.ingest import ingest_stream


def test_curves_of_a_score_that_is_never_null(spark):
    scores = spark.range(6).select((-F.col("id").cast("double")).alias("score"), (F.col("id") % 2).cast("int").alias("y_true"))
    assert not scores.schema["score"].nullable
    assert roc_curve(scores).filter("threshold is null").count() == 1
    assert pr_curve(scores).filter("threshold is null").count() == 1


def test_no_model_is_stored(spark, tmp_path):
    assert load_model(spark, str(tmp_path / "nothing")) is None


def test_alphas_with_equal_names():
    with pytest.raises(ValueError, match="equal feature names"):
        FeatureSettings(alphas=(0.1, 0.15))


def test_cooldown_keeps_alerts_without_a_host(spark):
    rows = [(i, h, "r", t, 0) for i, (h, t) in enumerate([(None, 100), (None, 130), (None, 170), ("a", 100)])]
    alerts = spark.createDataFrame(rows, "sample_id long, host string, rule string, ts long, rule_order int")
    assert sorted((r.host or "", r.ts) for r in apply_cooldown(alerts, 60).collect()) == [("", 100), ("", 170), ("a", 100)]


@pytest.mark.parametrize("streamed", [False, True])
def test_retention_in_the_middle_of_a_day(spark, tmp_path, streamed):
    samples = load_samples(spark, "/root/testdata/sf0.001")
    path, source = str(tmp_path / "store"), str(tmp_path / "source")
    if streamed:
        samples.repartition(3).write.parquet(source)
        stream = spark.readStream.schema(samples.schema).option("maxFilesPerTrigger", 1).parquet(source)
        ingest_stream(stream, path, str(tmp_path / "check"), {"availableNow": True}).awaitTermination()
    else:
        write_samples(samples, path)
    now = 1705276800 + 43_200 + 86_400
    old = samples.filter(F.col("ts") < now - 86_400).count()
    assert 0 < old < samples.count()
    assert prune_store(spark, path, now, 1) == old
    left = read_store(spark, path)
    assert left.count() == samples.count() - old and left.agg(F.min("ts")).first()[0] >= now - 86_400
    assert prune_store(spark, path, now, 1) == 0
