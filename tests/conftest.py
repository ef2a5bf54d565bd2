import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

from fleetpulse.session import build_session  # noqa: E402
from fleetpulse.sources.views import load_samples  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        "local[8]",
        spark__sql__shuffle__partitions="8",
        spark__driver__memory="6g",
        spark__ui__showConsoleProgress="false",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def samples(spark):
    return load_samples(spark, SMALL).cache()


@pytest.fixture
def plan_of():
    def text(df):
        df.collect()
        return df._jdf.queryExecution().executedPlan().toString()

    return text
