import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fleetpulse.operators.forest import (
    ForestScorer,
    average_path,
    below_threshold,
    calibrate_threshold,
    contamination_label,
    contamination_offset,
    fit_forest,
    forest_sample,
)

COLUMNS = [f"x{i}" for i in range(10)]


def matrix(spark, rows):
    frame = pd.DataFrame(rows, columns=COLUMNS)
    frame.insert(0, "sample_id", np.arange(len(frame)))
    return spark.createDataFrame(frame)


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(42)
    rows = np.vstack([rng.normal(size=(1000, 10)), rng.normal(size=(50, 10)) * 5 + 10])
    return matrix(spark, rows).cache()


@pytest.fixture(scope="module")
def nodes(data):
    return fit_forest(data, COLUMNS, n_trees=50).collect()


@pytest.fixture(scope="module")
def scored(spark, data, nodes):
    scorer = ForestScorer(spark, nodes, 256)
    return data.withColumn("score", scorer.score(COLUMNS)).cache()


def test_trees_are_well_formed(nodes):
    table = pd.DataFrame([n.asDict() for n in nodes])
    assert table["tree_id"].nunique() == 50 and table["depth"].max() <= 8
    roots = table[table["node_id"] == 0]
    assert (roots["size"] == 256).all()
    leaves = table[table["feature"].isna()]
    assert (leaves.groupby("tree_id")["size"].sum() == 256).all()


def test_scores_rank_outliers(scored):
    frame = scored.toPandas()
    assert frame["score"].between(-1, 0, inclusive="left").all()
    normal, outliers = frame[frame["sample_id"] < 1000], frame[frame["sample_id"] >= 1000]
    assert outliers["score"].median() < normal["score"].median()
    assert (outliers["score"] < normal["score"].quantile(0.02)).mean() > 0.9


def test_partitioning_does_not_matter(spark, data, nodes):
    again = fit_forest(data.repartition(13, F.rand(1)), COLUMNS, n_trees=50).collect()
    assert sorted(map(tuple, again), key=lambda n: n[:2]) == sorted(map(tuple, nodes), key=lambda n: n[:2])


def test_labels_and_threshold(spark, data, nodes, scored):
    offset = contamination_offset(scored, 0.05)
    labels = scored.select(contamination_label(F.col("score"), offset).alias("l")).toPandas()["l"]
    assert set(labels) == {-1, 1} and 0.03 < (labels == -1).mean() < 0.06
    validation = matrix(spark, np.random.default_rng(1).normal(size=(200, 10)))
    threshold = calibrate_threshold(
        validation.withColumn("score", ForestScorer(spark, nodes, 256).score(COLUMNS)), 0.05
    )
    assert isinstance(threshold, float)
    flagged = scored.filter(below_threshold(F.col("score"), threshold)).count()
    assert 0 < flagged < 1050
    with pytest.raises(RuntimeError):
        below_threshold(F.col("score"), None)


def test_sample_without_replacement(spark):
    rows = spark.range(5000).withColumnRenamed("id", "sample_id")
    for trees, size in ((10, 64), (100, 128)):
        drawn = forest_sample(rows, trees, size).toPandas()
        assert (drawn.groupby("tree_id")["sample_id"].nunique() == size).all() and len(drawn) == trees * size


def test_one_law_at_every_size(spark):
    """Trees overlap as independent draws do, whether or not there are rows enough for all of them."""
    for total, size in ((2000, 199), (2000, 201), (20000, 199), (150, 199)):
        rows = spark.range(total).withColumnRenamed("id", "sample_id")
        drawn = forest_sample(rows, 10, size).toPandas()
        share = min(1, size / total)
        assert len(drawn) == 10 * min(size, total)
        assert drawn["sample_id"].nunique() == pytest.approx(total * (1 - (1 - share) ** 10), rel=0.06)
        again = forest_sample(rows.repartition(7), 10, size).toPandas()
        assert set(map(tuple, drawn.to_numpy())) == set(map(tuple, again.to_numpy()))


def test_few_rows(spark):
    nodes = fit_forest(matrix(spark, np.random.default_rng(0).normal(size=(3, 10))), COLUMNS, n_trees=4).collect()
    assert {n["size"] for n in nodes if n.node_id == 0} == {3}


def test_average_path():
    assert [average_path(n) for n in (0, 1, 2)] == [0, 0, 1]
    assert average_path(256) == pytest.approx(10.2448, abs=1e-4)


def test_empty_model(spark):
    with pytest.raises(RuntimeError):
        ForestScorer(spark, [], 256)


def test_walk_equals_a_walk_by_hand(spark):
    """Children anywhere in the table, a value at the cut, NaN to the right; more rows than walk together."""
    rows = [
        (0, 0, 0, 1.0, 7, 3, 9, 0), (0, 7, None, None, None, None, 5, 1), (0, 3, 1, 2.0, 8, 4, 4, 1),
        (0, 4, None, None, None, None, 1, 2), (0, 8, None, None, None, None, 3, 2), (1, 0, None, None, None, None, 9, 0),
    ]
    rng = np.random.default_rng(4)
    points = rng.choice([0.0, 1.0, 2.0, 3.0, np.nan], (10_001, 2))

    def path(x):
        if x[0] <= 1.0:
            return 1 + average_path(5)
        return 2 + (average_path(3) if x[1] <= 2.0 else average_path(1))

    scorer = ForestScorer(spark, rows, 9)
    assert "children" in scorer._forest.value  # one lookup leads to either side
    ours = scorer.walk()(points)
    expected = [-(2.0 ** (-(path(x) + average_path(9)) / 2 / average_path(9))) for x in points]
    np.testing.assert_allclose(ours, expected, rtol=1e-8)
    assert len(scorer.walk()(points[:0])) == 0
