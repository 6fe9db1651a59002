import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path[:0] = [os.path.abspath(os.path.join(os.path.dirname(__file__), "..", "..")), os.path.dirname(__file__)]


@pytest.fixture(scope="session")
def spark():
    os.environ["PYTHONPATH"] = f"{sys.path[0]}:{os.environ.get('PYTHONPATH', '')}"
    return (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
