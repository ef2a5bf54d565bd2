import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from fleetpulse.functions.durations import duration_seconds, epoch_to_local, format_duration, parse_duration, time_range
from fleetpulse.operators.forecasting import fit_forecaster, interval, time_to_threshold
from fleetpulse.operators.summaries import alert_state, trend_levels
from fleetpulse.plans.segments import plan_segments
from fleetpulse.schema import DETECTION_SCHEMA, SAMPLE_SCHEMA
from fleetpulse.sources.samples import scan_last, scan_samples
from fleetpulse.sources.store import (
    export_samples,
    host_stats,
    latest_models,
    model_record,
    prune_store,
    read_store,
    sensor_map_temperature,
    store_stats,
    stored_megabytes,
    validate_samples,
    write_samples,
)
from fleetpulse.sources.views import load_samples


def ten(spark, start=1_000_000, step=1):
    rows = [(i, start + i * step, "test", 50.0 + i, 60.0, 1e3, 2e3, 5e2, 1.5e3, 5.0, 200, None) for i in range(10)]
    return spark.createDataFrame(rows, SAMPLE_SCHEMA)


def test_write_and_read(spark, tmp_path):
    path = str(tmp_path / "samples")
    assert write_samples(ten(spark).drop("cpu_temp"), path) == 10
    rows = scan_samples(read_store(spark, path), 1_000_000, 1_000_005).orderBy("ts").collect()
    assert len(rows) == 6 and rows[0].cpu_pct == 50.0
    assert store_stats({"samples": read_store(spark, path)}).first().row_count == 10
    assert 0 < stored_megabytes(spark, path) < 10
    assert tuple(host_stats(read_store(spark, path)).first()) == ("test", 10, 1_000_000, 1_000_009)


def test_only_matching_days_are_read(spark, tmp_path):
    path = str(tmp_path / "samples")
    write_samples(ten(spark, step=86400), path)
    rows = scan_samples(read_store(spark, path), 1_000_000, 1_000_000 + 86400)
    assert rows.count() == 2
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan


def test_incomplete_rows_are_set_aside(spark, tmp_path):
    path = str(tmp_path / "samples")
    bad = ten(spark).withColumn("host", F.when(F.col("sample_id") >= 3, F.col("host")))
    assert write_samples(bad, path) == 7
    assert [r.missing for r in spark.read.parquet(f"{path}_rejected").collect()] == ["host"] * 3
    with pytest.raises(ValueError):
        validate_samples(ten(spark).drop("cpu_pct"))


def test_empty_batch(spark, tmp_path):
    assert write_samples(ten(spark).limit(0), str(tmp_path / "none")) == 0


def test_prune(spark, tmp_path):
    path = str(tmp_path / "samples")
    write_samples(ten(spark, step=20_000), path)
    now = 1_000_000 + 100_000 + 86400
    assert prune_store(spark, path, now, days=1) == 5
    left = read_store(spark, path)
    assert sorted(r.ts for r in left.collect()) == [1_100_000 + i * 20_000 for i in range(5)]
    assert prune_store(spark, path, now, days=1) == 0


def test_registry(spark):
    records = [model_record(spark, f"id{i}", n, "IsolationForest", "1.0", t, m) for i, (n, t, m) in enumerate(
        [("a", 5, {"k": 1}), ("a", 9, {"k": 2}), ("b", 1, None)]
    )]
    registry = records[0].unionByName(records[1]).unionByName(records[2])
    found = {r.name: (r.model_id, r.meta_json) for r in latest_models(registry).collect()}
    assert found == {"a": ("id1", '{"k": 2}'), "b": ("id2", None)}


def test_export(spark, tmp_path):
    export_samples(ten(spark), str(tmp_path / "c"), "csv")
    back = spark.read.schema(SAMPLE_SCHEMA).option("header", True).csv(str(tmp_path / "c"))
    assert sorted(back.collect()) == sorted(ten(spark).collect())
    with pytest.raises(ValueError):
        export_samples(ten(spark), str(tmp_path / "x"), "xlsx")


def test_durations(spark):
    texts = {"1h": 3600, "7d": 604800, "30m": 1800, "45": 45, "90s": 90, " 2W ": 1209600}
    assert {t: duration_seconds(t) for t in texts} == texts
    for bad in ("x", "", "10x", "1.5h", "h"):
        with pytest.raises(ValueError):
            duration_seconds(bad)
    frame = spark.createDataFrame([(t,) for t in [*texts, "x", "", "10x", "1.5h"]], "t string")
    assert [r[0] for r in frame.select(parse_duration(F.col("t"))).collect()] == [*texts.values(), *[None] * 4]
    shown = {0: "0s", 59: "59s", 60: "1m", 3599: "59m", 3600: "1h", 5400: "1h 30m", 86399: "23h 59m", 86400: "1d", 90000: "1d 1h"}
    frame = spark.createDataFrame([(float(s) + 0.9,) for s in shown], "s double")
    assert [r[0] for r in frame.select(format_duration(F.col("s"))).collect()] == list(shown.values())


def test_ranges_and_zones(spark):
    assert time_range(ten(spark), "5s") == (1_000_004, 1_000_009)
    assert time_range(ten(spark).limit(0), "5s") is None
    assert scan_last(ten(spark), "5s").count() == 6
    local = spark.range(1).select(epoch_to_local(F.lit(1720000000), "Asia/Tokyo").alias("t")).first().t
    assert str(local) == "2024-07-03 18:46:40"


def test_sensor_map(spark):
    frame = spark.createDataFrame([({"k10temp": 41.0, "cpu_thermal": 50.0},), ({"other": 1.0},)], "m map<string,double>")
    assert [r[0] for r in frame.select(sensor_map_temperature(F.col("m"))).collect()] == [41.0, None]


def test_trend_levels(spark):
    frame = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0, 5.0],), ([7.0],), ([2.0, 2.0],), ([],)], "v array<double>")
    assert [r[0] for r in frame.select(trend_levels(F.col("v"))).collect()] == [[0, 2, 4, 6, 8], [4], [4, 4], []]


def test_quiet_alert_panel(spark):
    assert alert_state(spark.createDataFrame([], DETECTION_SCHEMA)).first().panel_state == "green"


def test_forecasts(spark, samples):
    hot = plan_segments(samples, hot_rows=100, segment_rows=20)
    limits = {"cpu_pct": 90.0, "swap_pct": 80.0}
    columns = ["sample_id", "ttt_cpu_pct", "ttt_swap_pct"]
    plain = time_to_threshold(samples, limits).select(columns)
    cut = time_to_threshold(samples, limits, hot).select(columns)
    assert sorted(plain.collect(), key=str) == sorted(cut.collect(), key=str)

    line = spark.range(200).selectExpr("cast(id as double) as x", "cast(pmod(hash(id), 50) as double) as z")
    line = line.selectExpr("x", "z", "3 * x - 2 * z + 7 as y")
    fitted = fit_forecaster(line, ["x", "z"], "y")
    assert fitted.residual_std == pytest.approx(0, abs=1e-6)
    row = fitted.predict(line.filter("x = 10")).first()
    assert row.time_to_threshold_minutes == pytest.approx(row.y, abs=1e-6)
    trees = fit_forecaster(line, ["x", "z"], "y", algo="gbr", max_iter=5)
    bounds = trees.predict(line).first()
    assert bounds.confidence_lower >= 0 and bounds.confidence_upper > bounds.time_to_threshold_minutes
    with pytest.raises(ValueError):
        fit_forecaster(line, ["x"], "y", algo="other")
    low, high = spark.range(1).select(*interval(F.lit(5.0), F.lit(2.0), 0.9)).first()
    assert (low, high) == pytest.approx((1.71, 8.29))
    assert tuple(spark.range(1).select(*interval(F.lit(-5.0), F.lit(None).cast("double"))).first()) == (-5.0, -5.0)


def test_bounds_on_a_table_reach_its_scan(spark, plan_of):
    ranged = load_samples(spark, SMALL, 1704412800, 1706140799)
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in plan_of(ranged)
    assert ranged.count() == load_samples(spark, SMALL).filter("ts between 1704412800 and 1706140799").count()
