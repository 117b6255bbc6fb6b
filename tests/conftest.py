import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    SparkSession.builder.master("local[8]").config("spark.driver.memory", "8g").config(
        "spark.ui.enabled", "false"
    ).config("spark.ui.showConsoleProgress", "false").getOrCreate()
    from pourscale.session import build_session

    session = build_session(partitions=8)
    session.sparkContext.setLogLevel("ERROR")
    yield session
