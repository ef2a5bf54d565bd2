import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fleetpulse.operators.features import FeatureSettings, add_burstiness, add_ema, add_lags, add_rolling_stats, add_slope, feature_table
from fleetpulse.operators.scaling import apply_scaler, fit_scaler
from fleetpulse.plans.segments import plan_segments
from fleetpulse.schema import METRICS
from fleetpulse.sources.samples import scan_samples

NAMES = FeatureSettings().feature_names()


@pytest.fixture(scope="module")
def uniform(spark):
    rng = np.random.default_rng(42)
    ranges = [(20, 80), (30, 70), (0, 1e7), (0, 1e7), (0, 1e6), (0, 1e6), (0, 10)]
    frame = pd.DataFrame({m: rng.uniform(*r, 100) for m, r in zip(METRICS, ranges)})
    frame.insert(0, "ts", np.arange(1_000_000, 1_000_100))
    frame.insert(0, "host", "test")
    frame.insert(0, "sample_id", np.arange(100))
    return spark.createDataFrame(frame)


def by_id(df):
    return df.toPandas().sort_values("sample_id", ignore_index=True)


def by_hand(raw, name):
    """A feature worked out row by row from its definition."""
    metric = next(m for m in METRICS if name.startswith(m))
    x, tag = raw[metric].tolist(), name[len(metric) + 1 :]
    out = []
    for i, value in enumerate(x):
        last = lambda n: x[max(0, i - n + 1) : i + 1]  # noqa: E731, B023
        if not tag:
            out.append(value)
        elif tag.startswith("lag"):
            out.append(x[i - int(tag[3:])] if i >= int(tag[3:]) else 0.0)
        elif tag.startswith("rmean"):
            out.append(np.mean(last(5 if tag.endswith("s") else 30)))
        elif tag.startswith("rstd"):
            rows = last(5 if tag.endswith("s") else 30)
            out.append(np.std(rows, ddof=1) if len(rows) > 1 else 0.0)
        elif tag.startswith("ema"):
            alpha = int(tag[3:]) / 10
            out.append(alpha * value + (1 - alpha) * out[-1] if i else value)
        elif tag == "slope":
            out.append(np.polyfit(range(10), last(10), 1)[0] if i >= 9 else 0.0)
        else:
            out.append(max(last(10)) / (np.mean(last(10)) + 1e-6))
    return out


def test_names():
    assert len(NAMES) == 88 and len(set(NAMES)) == 88
    assert NAMES[:7] == METRICS and NAMES[-1] == "net_down_bps_burst"


def test_shape_and_families(uniform):
    table = by_id(feature_table(uniform))
    assert len(table) == 100 and not table.isna().any().any()
    for part in ("cpu_pct", "lag", "rmean", "ema", "slope", "burst"):
        assert any(part in c for c in table.columns)


def test_values_against_pandas(uniform):
    table, raw = by_id(feature_table(uniform)), by_id(uniform)
    expected = pd.DataFrame({name: by_hand(raw, name) for name in NAMES})
    np.testing.assert_allclose(table[NAMES], expected[NAMES], rtol=1e-9, atol=1e-6)
    slope = np.polyfit(np.arange(10), raw["mem_pct"][5:15], 1)[0]
    assert table["mem_pct_slope"][14] == pytest.approx(slope)
    assert table["mem_pct_slope"][8] == 0


def test_transform_keeps_width_and_order(uniform):
    scaler = fit_scaler(feature_table(scan_samples(uniform, 0, 1_000_049)), NAMES)
    rest = feature_table(scan_samples(uniform, 1_000_050, 2_000_000))
    scaled = apply_scaler(rest.drop("cpu_pct_lag5"), scaler)
    assert scaled.columns == NAMES
    stats = {r.feature: r for r in scaler.collect()}["cpu_pct_lag5"]
    assert scaled.first()["cpu_pct_lag5"] == pytest.approx(-stats["mean"] / stats["scale"])


def test_constant_feature_has_scale_one(spark):
    rows = spark.createDataFrame([(0.1 + 0.2, 1.0), (0.3, 3.0), (0.3, 5.0)], "a double, b double")
    a, b = fit_scaler(rows, ["a", "b"]).orderBy("idx").collect()
    assert a["scale"] == 1.0 and b["mean"] == 3.0 and b["scale"] == pytest.approx((8 / 3) ** 0.5)


def test_single_row_ties_and_hosts(spark):
    rows = [(2, "a", 10, 5.0), (1, "a", 10, 3.0), (3, "b", 9, 8.0)]
    frame = spark.createDataFrame(rows, "sample_id long, host string, ts long, cpu_pct double")
    lagged = by_id(add_lags(frame, ["cpu_pct", "unknown"], [1]))
    assert lagged["cpu_pct_lag1"].fillna(-1).tolist() == [-1, 3.0, -1]
    assert by_id(add_slope(frame, ["cpu_pct"]))["cpu_pct_slope"].tolist() == [0, 0, 0]


@pytest.mark.parametrize("alphas", [(0.1, 0.3), (0.9, 0.01), (1.0,)])
def test_ema_over_block_edges(spark, alphas):
    frame = spark.range(6000).selectExpr(
        "id as sample_id", "'h' as host", "id * 2 as ts", "cast(hash(id) % 1000 as double) as cpu_pct"
    )
    ours = by_id(add_ema(frame, ["cpu_pct"], alphas))
    for alpha in alphas:
        expected = ours["cpu_pct"].ewm(alpha=alpha, adjust=False).mean()
        np.testing.assert_allclose(ours[f"cpu_pct_ema{int(alpha * 10)}"], expected, rtol=1e-9, atol=1e-9)


def test_missing_metric_is_an_error(uniform):
    with pytest.raises(ValueError):
        feature_table(uniform.drop("swap_pct"))


def test_hot_host_equals_plain(spark, samples):
    """One host holds most rows, many of them at one moment; segments give what an uncut host gives."""
    crowd = samples.withColumn("host", F.when(F.col("sample_id") % 10 < 7, "hot").otherwise(F.col("host")))
    crowd = crowd.withColumn("ts", F.when(F.col("sample_id").between(300, 700), 1704900000).otherwise(F.col("ts")))
    plan = plan_segments(crowd, hot_rows=300, segment_rows=50)
    assert [r.host for r in plan.hot_hosts.collect()] == ["hot"]
    plain, cut = by_id(feature_table(crowd)), by_id(feature_table(crowd, plan=plan))
    np.testing.assert_allclose(cut[NAMES], plain[NAMES], rtol=1e-9, atol=1e-6)


def test_one_shuffle(samples, plan_of):
    plan = plan_of(feature_table(samples))
    plan = plan[: plan.index("Initial Plan")] if "Initial Plan" in plan else plan
    assert plan.count("Exchange hashpartitioning") == 1
    assert "SinglePartition" not in plan


def test_range_reaches_the_scan(spark, samples, tmp_path, capsys):
    path = str(tmp_path / "s")
    samples.write.parquet(path)
    rows = scan_samples(spark.read.parquet(path), 1704412800, 1706140799, "h3").select("sample_id", "cpu_pct")
    rows.explain("formatted")
    plan = capsys.readouterr().out
    assert "GreaterThanOrEqual(ts,1704412800)" in plan and "EqualTo(host,h3)" in plan
    assert "mem_pct" not in plan


@pytest.mark.parametrize("batch", [7, 10_000])
def test_table_equals_windows(spark, plan_of, batch):
    """The table goes through ordered rows instead of windows; NULLs, hosts without a name, short hosts and edges of batches do not matter."""
    metrics = [
        f"if(hash(sample_id, {i}) % 9 = 0 or host = 'h1' and ts < 250, null, cast(pmod(hash(sample_id, '{m}'), 1000) as double) / 7) as {m}"
        for i, m in enumerate(METRICS)
    ]
    rows = spark.range(4000).selectExpr("id", "case when id % 3 = 0 then 'h1' when id % 3 = 1 then 'long' when id % 50 = 2 then null else concat('s', id % 199) end as host")
    rows = rows.selectExpr("id as sample_id", "host", "pmod(hash(id), 500) as ts").selectExpr("*", *metrics).cache()
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        table = feature_table(rows, keep=["sample_id"])
        assert "Window" not in plan_of(table)
        ours = by_id(table)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    windows = by_id(add_burstiness(add_ema(add_slope(add_rolling_stats(add_lags(rows))))).select("sample_id", *NAMES).na.fill(0.0))
    np.testing.assert_allclose(ours[NAMES], windows[NAMES], rtol=1e-9, atol=1e-9)
    empty = feature_table(rows.limit(0), keep=["sample_id"])
    assert empty.columns == ["sample_id", *NAMES] and empty.count() == 0
