import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .config("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make(spark):
    """Samples out of (name, labels, ts, value) tuples; seq is their order."""
    from chronoframe.model import SAMPLES, series_key
    from pyspark.sql import functions as F

    def build(rows):
        df = spark.createDataFrame([(n, l, "", t, float(v), i) for i, (n, l, t, v) in enumerate(rows)], SAMPLES)  # noqa: E741
        return df.withColumn("series_key", series_key(F.col("name"), F.col("labels")))

    return build
