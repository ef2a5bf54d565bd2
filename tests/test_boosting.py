"""Boosted trees on histograms: they learn, do not depend on partitioning, and take nulls and constant features."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetpulse.operators.boosting import fit_boosted_trees, part_of
from fleetpulse.operators.forecasting import fit_forecaster, solve_normal_equations


@pytest.fixture(scope="module")
def steps(spark):
    """A label that two features decide, one that says nothing, one that never varies; some nulls."""
    rows = spark.range(2000).selectExpr("id", "cast(pmod(hash(id), 1000) as double) as a", "cast(pmod(hash(id, 7), 1000) as double) as b", "3D as c")
    label = F.when(F.col("a") > 500, 40.0).otherwise(10.0) + F.when(F.col("b") > 250, 5.0).otherwise(0.0)
    rows = rows.withColumn("y", F.when(F.col("id") % 10 != 0, label))
    return rows.withColumn("a", F.when(F.col("id") % 50 != 1, F.col("a"))).cache()


def test_steps_are_learnt(spark, steps):
    trees = fit_boosted_trees(steps, ["a", "b", "c"], "y", trees=40, depth=2, rate=0.3)
    error = steps.agg(F.avg(F.abs(F.col("y") - trees.prediction()))).first()[0]
    assert error < 1.5 and steps.where(trees.prediction().isNull()).count() == 0
    again = fit_boosted_trees(steps.repartition(7, F.rand(1)), ["a", "b", "c"], "y", trees=40, depth=2, rate=0.3)
    assert again == trees


def test_forecaster_reports_its_spread(spark, steps):
    fit = fit_forecaster(steps, ["a", "b"], "y", algo="gbr", max_iter=3)
    told = fit.predict(steps).where("y is not null").select((F.col("y") - F.col("time_to_threshold_minutes")).alias("r")).toPandas()["r"]
    assert fit.residual_std == pytest.approx(np.std(told), rel=1e-9)
    with pytest.raises(ValueError):
        fit_boosted_trees(steps.where("y < 0"), ["a"], "y")
    with pytest.raises(ValueError):
        fit_forecaster(steps, ["a"], "y", algo="other")


def test_parts(spark):
    rows = spark.createDataFrame([(v,) for v in (-5.0, 0.0, 0.99, 1.0, 3.999, 4.0, 9.0, None)], "v double")
    assert [r[0] for r in rows.select(part_of(F.col("v"), 0.0, 4.0, 4)).collect()] == [0, 0, 0, 1, 3, 3, 3, 0]
    assert {r[0] for r in rows.select(part_of(F.col("v"), 4.0, 4.0, 4)).collect()} == {0}


def test_normal_equations_with_dependent_features():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 3))
    x = np.column_stack((x, 2 * x[:, 0] - 7, np.full(500, 3.0)))  # the fourth follows from the first, the fifth is constant
    y = x[:, :3] @ [1.0, -2.0, 0.5]
    products, targets = np.cov(x.T, bias=True), np.cov(np.column_stack((x, y)).T, bias=True)[:-1, -1]
    assert solve_normal_equations(products, targets) == pytest.approx([1.0, -2.0, 0.5, 0, 0], abs=1e-9)
