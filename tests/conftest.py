import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from mediatally.session import build_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    scratch = tmp_path_factory.mktemp("scratch")
    session = build_session("tests", "local[4]", **{
        "spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g", "spark.checkpoint.dir": str(scratch),
        "spark.sql.codegen.fallback": "false"})
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def value(spark):
    """Evaluate a column on one row of literals."""

    def run(column):
        return spark.range(1).select(column.alias("v")).first()["v"]

    return run


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()
