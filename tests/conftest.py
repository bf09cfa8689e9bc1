import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[8]")
        .appName("econcheck-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def rows(spark):
    """Evaluate columns over literal rows: rows(data, ddl, col) -> list of values."""

    def run(data, ddl, *cols):
        out = spark.createDataFrame(data, ddl).select(*cols).collect()
        return [tuple(r) if len(cols) > 1 else r[0] for r in out]

    return run
