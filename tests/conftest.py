import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from driftwise.session import local_session

    s = local_session("*", 8, "driftwise-tests")
    yield s


@pytest.fixture(scope="session")
def toy_features(spark):
    """Two cities x five days: A 10..50, B 100..140; AQI A 50..90, B 200..240."""
    import datetime as dt

    rows = []
    for city, base, aqi in (("A", 10.0, 50), ("B", 100.0, 200)):
        for i in range(5):
            rows.append((city, dt.datetime(2024, 1, 1 + i), i, base + 10 * i, float(aqi + 10 * i)))
    return spark.createDataFrame(rows, "City string, Date timestamp_ntz, rid int, `PM2.5` double, AQI double")
