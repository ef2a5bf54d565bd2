import random

import pytest
from pyspark.sql import functions as F

from fleetpulse.operators.alerts import anomaly_rule, apply_cooldown, default_rules, raise_alerts, threshold_rule

SCHEMA = "sample_id long, host string, ts long, rule_order int, rule string, severity string, message string"


def alerts(spark, seconds, host="a", rule="cpu_high"):
    rows = [(i, host, s, 0, rule, "warning", f"m{i}") for i, s in enumerate(seconds)]
    return spark.createDataFrame(rows, SCHEMA)


def greedy(seconds, cooldown):
    fired, last = [], 0
    for s in sorted(seconds):
        if s - last >= cooldown:
            fired.append(s)
            last = s
    return fired


def fired(df):
    return [r.ts for r in df.orderBy("ts").collect()]


def test_edge_series(spark):
    kept = apply_cooldown(alerts(spark, [59, 100, 130, 159, 160, 200, 220, 400]))
    assert fired(kept) == [100, 160, 220, 400]
    assert kept.columns == [f.split()[0] for f in SCHEMA.split(", ")]


@pytest.mark.parametrize(
    "cooldown,chunk,span,fan", [(60, 100, 3000, 512), (60, 60, 2000, 2), (60, 60, 2000, 3), (7, 20, 400, 4), (500, 86400, 300000, 2)]
)
def test_waits_reach_into_later_chunks(spark, cooldown, chunk, span, fan):
    draw = random.Random(cooldown + chunk)
    dense = [s for s in range(0, span, max(1, span // 600)) if draw.random() < 0.7]
    sparse = [draw.randrange(span) for _ in range(25)]
    both = alerts(spark, dense).unionByName(alerts(spark, sparse + sparse[:5], "b", "mem_high"))
    kept = apply_cooldown(both, cooldown, chunk, fan).cache()
    assert fired(kept.filter("host = 'a'")) == greedy(dense, cooldown)
    assert fired(kept.filter("host = 'b'")) == greedy(sparse, cooldown)


def test_ten_years_of_one_key(spark):
    """Eight blocks of days, waits that span days, and a gap of a year."""
    draw = random.Random(10)
    seconds = sorted({draw.randrange(10 * 365 * 86400) for _ in range(20_000)})
    seconds = [s for s in seconds if not 3 * 365 <= s // 86400 < 4 * 365]
    assert fired(apply_cooldown(alerts(spark, seconds), 30_000)) == greedy(seconds, 30_000)


def test_first_of_a_second_fires(spark):
    kept = apply_cooldown(alerts(spark, [500, 500, 500]))
    assert [(r.sample_id, r.message) for r in kept.collect()] == [(0, "m0")]


def test_rules(spark):
    rows = spark.createDataFrame(
        [(1, "a", 5, 95.06, None, 80.0, None, None), (2, "a", 6, 10.0, 10.0, 10.0, True, -0.61249)],
        "sample_id long, host string, ts long, cpu_pct double, mem_pct double, swap_pct double,"
        " is_anomaly boolean, score double",
    )
    found = raise_alerts(rows, default_rules()).orderBy("ts", "rule_order").collect()
    assert [(r.rule, r.severity, r.message) for r in found] == [
        ("cpu_high", "warning", "cpu_pct exceeded threshold: 95.1 >= 90.0"),
        ("swap_high", "warning", "swap_pct exceeded threshold: 80.0 >= 80.0"),
        ("anomaly_detected", "critical", "Anomaly detected (score=-0.612)"),
    ]
    bare = rows.withColumn("score", F.lit(None).cast("double"))
    texts = [r.message for r in raise_alerts(bare, [anomaly_rule(), threshold_rule("t", "mem_pct", 10, "info")]).collect()]
    assert texts == ["Anomaly detected (score=0.000)", "mem_pct exceeded threshold: 10.0 >= 10.0"]


def test_alerts_are_computed_once(spark, plan_of):
    """The day lists feed both the chain and the result; their shuffle is shared."""
    plan = plan_of(apply_cooldown(alerts(spark, range(100, 5000, 7))))
    assert "ReusedExchange" in plan or "ReusedQueryStage" in plan
