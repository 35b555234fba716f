import os

import duckdb
import pytest

from tillwise.session import build_session

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tillwise-tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.driver.memory": "6g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


@pytest.fixture(scope="session")
def duck(sf_dir):
    connection = duckdb.connect()
    for name in os.listdir(sf_dir):
        connection.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{name}'")
    return connection


@pytest.fixture(scope="session")
def four(spark):
    """Four hand-worked customers."""
    rows = [
        (1001, 5, 200, 25, 1500.0, 60.0),
        (1002, 45, 180, 5, 300.0, 60.0),
        (1003, 120, 400, 1, 50.0, 50.0),
        (1004, 10, 150, 15, 900.0, 60.0),
    ]
    return spark.createDataFrame(
        rows,
        "CustomerID bigint, Recency bigint, Tenure bigint, Frequency bigint, Monetary double, AvgOrderValue double",
    )
