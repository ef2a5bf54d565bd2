"""The registered queries against DuckDB, and the pipeline against its stages' own rules."""

import pytest
from compare import _sorted, connect
from conftest import SMALL

import corpus_pipeline
from fleetpulse.llm.oracles import ORACLES
from fleetpulse.llm.queries import QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_duckdb(spark, name):
    ours, theirs = _sorted(QUERIES[name](spark, SMALL).toPandas()), _sorted(connect(SMALL).execute(ORACLES[name]).df())
    assert list(ours.columns) == list(theirs.columns) and len(ours) == len(theirs)
    for column in ours.columns:
        same = (ours[column].astype(str) == theirs[column].astype(str)) | (ours[column].isna() & theirs[column].isna())
        assert same.all(), column


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    found = corpus_pipeline.run(spark, SMALL).collect()
    assert sorted(r.position for r in found) == list(range(len(found)))
    assert {r.doc_id for r in found} <= {r.doc_id for r in docs.collect()}
    assert len({r.text for r in found if len(r.text.split()) >= 5}) == sum(len(r.text.split()) >= 5 for r in found)
