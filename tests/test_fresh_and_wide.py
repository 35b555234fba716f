"""Answers follow new files, totals have room, and NaN is no amount."""

import datetime as dt

import pytest

from tillwise.operators import charts, kpi
from tillwise.operators.profile import describe
from tillwise.operators.rfm import rfm_features

LINES = "InvoiceNo string, CustomerID bigint, InvoiceDate timestamp, Quantity int, UnitPrice double"


def line(customer, day):
    return (f"i{customer}", customer, dt.datetime(2024, 1, day), 1, 2.0)


def test_new_files_are_seen(spark, tmp_path):
    path = str(tmp_path / "lines")
    spark.createDataFrame([line(1, 1)], LINES).write.parquet(path)
    assert [r["Recency"] for r in rfm_features(spark.read.parquet(path)).collect()] == [1]
    spark.createDataFrame([line(2, 5)], LINES).write.mode("append").parquet(path)
    rows = {r["CustomerID"]: r["Recency"] for r in rfm_features(spark.read.parquet(path)).collect()}
    assert rows == {1: 5, 2: 1}


def test_nothing_stays_cached(spark, sf_dir):
    import __spark_entry__ as contract

    spark.catalog.clearCache()
    for name in ("rfm_features", "eda_overview", "segment_kpis"):
        contract.queries()[name](spark, sf_dir).count()
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == 0


@pytest.fixture(scope="module")
def large(spark):
    rows = [(i, 10, 1, 2.5e17, "High Risk") for i in range(4)] + [(9, 10, 1, float("nan"), "Low Risk")]
    return spark.createDataFrame(rows, "CustomerID bigint, Recency bigint, Frequency bigint, Monetary double, ChurnRisk string")


def test_large_totals_without_nan(large):
    row = kpi.compute_kpis(large)["revenue"].first()
    assert row["total_revenue"] == 1e18 and row["median_monetary"] == 2.5e17
    shares = [r["CumulativePct"] for r in charts.revenue_pareto(large).orderBy("Rank").collect()]
    assert shares[:4] == [25.0, 50.0, 75.0, 100.0]


def test_describe_leaves_nan_out(large):
    row = describe(large, ["Monetary"]).first()
    assert row["count"] == 4 and row["max"] == 2.5e17 and row["std"] == 0
