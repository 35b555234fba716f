import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tillwise.constants import RFM_FEATURES
from tillwise.operators import cleaning, preprocess, selection
from tillwise.operators.profile import column_info, describe, health_check, missing_pct


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(3)
    n = 203
    return pd.DataFrame(
        {
            "CustomerID": np.arange(n),
            "Recency": rng.integers(1, 12, n),
            "Tenure": rng.integers(20, 400, n),
            "Frequency": rng.integers(1, 30, n),
            "Monetary": rng.lognormal(5, 1, n),
            "FreeTransactionRatio": np.zeros(n),
            "AvgOrderValue": rng.lognormal(3, 1, n),
        }
    )


def test_split_sizes_order_and_no_overlap(spark, frame):
    train, test = preprocess.time_split(spark.createDataFrame(frame))
    train_ids = {r.CustomerID for r in train.collect()}
    test_ids = {r.CustomerID for r in test.collect()}
    assert len(test_ids) == int(len(frame) * 0.2) and not train_ids & test_ids
    want = frame.sort_values(["Recency", "CustomerID"]).head(int(len(frame) * 0.2)).CustomerID
    assert test_ids == set(want)


@pytest.mark.parametrize("sample", [1 << 14, 2])
@pytest.mark.parametrize("days,ratio", [([1] * 10, 0.2), ([1, 2, 3, 4], 0.5), ([1, 2], 0.2), ([1, 1, 2], 0.0), ([None, None, 1], 0.67), ([1, 2], 1.0)])
def test_split_edges(spark, monkeypatch, days, ratio, sample):
    monkeypatch.setattr(selection, "SAMPLE", sample)
    rows = list(enumerate(days))
    train, test = preprocess.time_split(spark.createDataFrame(rows, "CustomerID bigint, Recency bigint"), ratio)
    order = sorted(rows, key=lambda r: (r[1] is None, r[1] or 0, r[0]))
    n = int(len(rows) * ratio)
    assert sorted(r.CustomerID for r in test.collect()) == sorted(i for i, _ in order[:n])
    assert sorted(r.CustomerID for r in train.collect()) == sorted(i for i, _ in order[n:])


SPLITS = {
    "two without id on one day": [(1, 5.0, "a"), (None, 5.0, "b"), (2, 5.0, "c"), (None, 5.0, "d"), (3, 5.0, "e")],
    "equal ids": [(7, 1.0, "a"), (7, 1.0, "b"), (7, 1.0, "c"), (8, 0.5, "d")],
    "equal rows": [(7, 1.0, "a")] * 5 + [(8, 2.0, "b")],
    "fractions of days": [(i, i * 0.25 % 3, "x") for i in range(40)],
    "no recency": [(1, None, "a"), (2, float("nan"), "b"), (3, 1.0, "c")],
}


@pytest.mark.parametrize("name", SPLITS)
@pytest.mark.parametrize("ratio", [0.2, 0.6, 0.9])
def test_split_has_its_size_and_loses_no_row(spark, name, ratio):
    rows = SPLITS[name]
    train, test = preprocess.time_split(spark.createDataFrame(rows, "CustomerID bigint, Recency double, note string"), ratio)
    train, test = train.collect(), test.collect()
    assert len(test) == int(len(rows) * ratio)
    missing = [tuple(None if v != v else v for v in r) for r in rows]
    assert sorted(map(str, map(tuple, train + test))) == sorted(map(str, missing))

    def place(r):
        return r.Recency is None, r.Recency or 0.0, r.CustomerID is None, r.CustomerID or 0

    assert not test or not train or max(map(place, test)) <= min(map(place, train))


def test_train_is_scaled_and_a_constant_is_shifted(spark, frame):
    data = preprocess.prepare_training(spark.createDataFrame(frame).withColumn("FreeTransactionRatio", F.lit(0.25)))
    train = data.train.toPandas()
    for c in set(RFM_FEATURES) - {"FreeTransactionRatio"}:
        assert train[c].mean() == pytest.approx(0, abs=1e-9)
        assert train[c].std(ddof=0) == pytest.approx(1, abs=1e-9)
    assert data.scaler["FreeTransactionRatio"] == (0.25, 1.0)
    assert set(train.FreeTransactionRatio) == {0.0}


def test_caps_keep_nulls_and_use_given_ones(spark):
    df = spark.createDataFrame([(1, None), (2, 5.0), (3, 50.0)], "CustomerID bigint, Monetary double")
    got = {r.CustomerID: r.Monetary for r in preprocess.winsorize(df, ["Monetary", "absent"], {"Monetary": 10.0}).collect()}
    assert got == {1: None, 2: 5.0, 3: 10.0}
    own = {r.CustomerID: r.Monetary for r in preprocess.winsorize(df, ["Monetary"]).collect()}
    assert own[3] == pytest.approx(pd.Series([5.0, 50.0]).quantile(0.95))


def test_feature_absent_at_scoring_is_raw_zero(spark, four):
    scaler = {f: (0.5, 0.25) for f in RFM_FEATURES}
    row = preprocess.scoring_features(four, scaler).first()
    assert row.FreeTransactionRatio == -2.0


def test_cleaning_steps_and_report(spark):
    rows = [
        ("1", 12.0, 1, "2011-01-01 10:00:00"), ("1", 12.0, 1, "2011-01-01 10:00:00"),
        ("2", None, 1, "2011-01-02 10:00:00"), ("2", None, 1, "2011-01-02 10:00:00"),
        ("3", 13.0, 0, "2011-01-03 10:00:00"), ("4", 13.0, None, "2011-01-03 10:00:00"),
        ("5", float("nan"), 4, "2011-01-03 10:00:00"), ("6", 14.0, 4, "2011-01-04 10:00:00"),
    ]
    df = spark.createDataFrame(rows, "InvoiceNo string, CustomerID double, Quantity int, InvoiceDate string")
    assert tuple(cleaning.cleaning_report(df).first()) == (8, 2, 2, 2, 2)
    got = sorted(map(tuple, cleaning.clean(df).collect()))
    assert got == [("1", 12, 1, dt.datetime(2011, 1, 1, 10)), ("6", 14, 4, dt.datetime(2011, 1, 4, 10))]


def test_bad_dates_raise_unless_lenient(spark):
    df = spark.createDataFrame([("1", 1.0, 1, "not a date")], "InvoiceNo string, CustomerID double, Quantity int, InvoiceDate string")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT|CANNOT_PARSE"):
        cleaning.clean(df).collect()
    assert cleaning.clean(df, lenient=True).first().InvoiceDate is None


def test_profile_of_empty_and_missing(spark):
    df = spark.createDataFrame([(1, None), (2, "x"), (None, None)], "a int, b string")
    assert [tuple(r) for r in missing_pct(df).collect()] == [("b", pytest.approx(200 / 3)), ("a", pytest.approx(100 / 3))]
    assert {r.column_name: (r.type, r.non_null) for r in column_info(df).collect()} == {"a": ("int", 2), "b": ("string", 1)}
    row = describe(df).first()
    assert (row["count"], row["mean"], row["p50"]) == (2, 1.5, 1.5)
    assert describe(df.limit(0)).first()["count"] == 0
    report = health_check(df, ["a"], rows=2)
    assert set(report) == {"preview", "columns", "missing_pct", "describe"} and report["preview"].count() == 2
