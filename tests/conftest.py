import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from wattloom.session import build_session


@pytest.fixture(scope="session")
def spark():
    s = build_session("tests", "local[8]", 8, quiet=True)
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def series(spark):
    """Rows of one meter from a list of values, one per step."""

    def make(values, step="15 minutes", start="2025-04-01 00:00:00", meter="m", name="v"):
        rows = [(meter, i, None if v is None else float(v)) for i, v in enumerate(values)]
        df = spark.createDataFrame(rows, f"meter_id string, i int, {name} double")
        unit = {"15 minutes": 900, "30 minutes": 1800, "1 hour": 3600}[step]
        return df.selectExpr("meter_id", f"timestamp_seconds(unix_timestamp(timestamp'{start}') + i * {unit}) as ts", name, "i")

    return make
