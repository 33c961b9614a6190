import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("siftrow-tests")
        .config("spark.sql.shuffle.partitions", "2")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.default.parallelism", "2")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def docs_of(spark):
    """Documents from keyword arguments or (key, text) pairs."""

    def make(*pairs):
        return spark.createDataFrame(list(pairs), "doc_key string, text string")

    return make


def plan_of(df) -> str:
    return df._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
