import os
import sys
import tempfile

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = (SparkSession.builder.master("local[8]").appName("prismatica-tests")
               .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g")
               .config("spark.sql.session.timeZone", "UTC")
               .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="prismatica-test-")).getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def sf_dir():
    return SF


@pytest.fixture()
def five(spark):
    """Five sales rows with one dominating record."""
    rows = [(0, 100, 20, 2, "South"), (1, 200, 40, 4, "North"), (2, 150, 30, 3, "South"),
            (3, 1000, 300, 20, "East"), (4, 180, 35, 4, "North")]
    return spark.createDataFrame(rows, "row_no long, Sales long, Profit long, Quantity long, Region string")


@pytest.fixture()
def sales(five):
    return five.drop("row_no")


@pytest.fixture()
def spikes(spark):
    """Values around 50 and ten spikes at 500."""
    import numpy as np
    rng = np.random.default_rng(0)
    rows = [(i, float(50 + 5 * rng.standard_normal())) for i in range(2000)] + [(5000 + i, 500.0) for i in range(10)]
    return spark.createDataFrame(rows, "key long, v double")


def rows_of(df):
    """Rows as plain tuples, order left out."""
    return sorted(map(tuple, df.collect()), key=repr)
