import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from thermocline.session import build_session  # noqa: E402

AS_OF = dt.datetime(2024, 6, 30)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session("tests", "local[4]", **{
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        "spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def folder():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def filter_rows(spark):
    day = lambda n: AS_OF - dt.timedelta(days=n)
    rows = [
        (1, "ARGO_001", day(10), 10.5, 75.3, 10.0, 28.5, 35.2, 5900001, 45),
        (2, "ARGO_001", day(5), 10.7, 75.5, 50.0, 26.2, 35.1, 5900001, 46),
        (3, "ARGO_002", day(15), 15.2, 80.1, 100.0, 22.1, 35.0, 5900002, 67),
        (4, "ARGO_002", day(20), 15.0, 80.0, 200.0, 18.5, 34.9, 5900002, 68),
        (5, "ARGO_003", day(30), -5.8, 85.7, 500.0, 12.3, 34.8, 5900003, 23),
    ]
    return spark.createDataFrame(
        rows, "id bigint, float_id string, time timestamp_ntz, lat double, lon double, depth double, "
              "temperature double, salinity double, wmo_id int, cycle_number int")
