import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parents[1])
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(p for p in (ROOT, os.environ.get("PYTHONPATH")) if p)


def pytest_configure(config):
    """One session for all tests, there before they are collected, so that they may name columns at their top."""
    from pyspark.sql import SparkSession

    config.spark = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    config.spark.sparkContext.setLogLevel("ERROR")


@pytest.fixture(scope="session")
def spark(pytestconfig):
    yield pytestconfig.spark
    pytestconfig.spark.stop()
