"""Every query that SQL can express gives DuckDB's values; the others run and keep their schema."""

import pytest
from compare import difference
from conftest import SMALL

from __spark_entry__ import entry, oracle_sql, queries
from fleetpulse.catalog.oracles import ORACLES
from fleetpulse.catalog.queries import QUERIES

#: Each trains a forest of its own; the same training is compared in detect_batch and evaluation_report.
TRAINED_AGAIN = {"train_summary", "forest_score", "detect_streaming", "evaluation_tables"}


@pytest.mark.parametrize("name", sorted(ORACLES.keys() - TRAINED_AGAIN))
def test_matches_duckdb(spark, name):
    assert difference(spark, SMALL, name) is None


def test_contract():
    assert QUERIES.keys() <= queries().keys()
    assert set(oracle_sql()) <= set(queries())


def test_flagship(spark):
    result = entry(spark)
    assert result.columns == ["sample_id", "host", "ts", "score", "metric_tags", "explanation"]
    rows = result.collect()
    assert rows and all(r.explanation.startswith("Anomaly score -0.") for r in rows)
