import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from headrace.session import local_session

    session = local_session(4, "headrace-tests", "4g")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def hourly(spark):
    """(site, ts, value) rows from a dict of value lists, one row per hour."""
    import datetime as dt

    def make(series, name="x"):
        t0 = dt.datetime(2024, 1, 1)
        rows = [(k, t0 + dt.timedelta(hours=i), None if v is None or v != v else float(v)) for k, vs in series.items() for i, v in enumerate(vs)]
        return spark.createDataFrame(rows, f"site string, ts timestamp_ntz, {name} double")

    return make
