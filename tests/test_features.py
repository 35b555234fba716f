import datetime as dt

import pytest
from pyspark.sql import functions as F

from tillwise.operators import rfm

DAY = dt.datetime(2011, 6, 1, 12, 0)
SCHEMA = "CustomerID bigint, InvoiceNo string, InvoiceDate timestamp, Quantity int, UnitPrice double"


def tx(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)


def by_customer(df):
    return {r.CustomerID: r for r in df.collect()}


def test_customer_with_only_free_lines(spark):
    rows = [(1, "a", DAY, 3, 0.0), (1, "b", DAY, 1, 0.0), (2, "c", DAY, 2, 1.5), (2, "c", DAY, 1, 0.0)]
    got = by_customer(rfm.rfm_features(tx(spark, rows)))
    assert (got[1].Frequency, got[1].Monetary, got[1].AvgOrderValue, got[1].FreeTransactionRatio) == (2, 0.0, 0.0, 1.0)
    assert (got[2].Frequency, got[2].Monetary, got[2].AvgOrderValue, got[2].FreeTransactionRatio) == (1, 3.0, 3.0, 0.5)


def test_days_are_full_days_and_snapshot_is_a_day_later(spark):
    rows = [(1, "a", DAY, 1, 1.0), (2, "b", DAY - dt.timedelta(hours=25), 1, 1.0), (2, "c", DAY - dt.timedelta(hours=47), 1, 1.0)]
    got = by_customer(rfm.rfm_features(tx(spark, rows)))
    assert (got[1].Recency, got[1].Tenure) == (1, 1)
    assert (got[2].Recency, got[2].Tenure) == (2, 2)


def test_fixed_snapshot(spark):
    rows = [(1, "a", DAY, 1, 1.0)]
    frame = tx(spark, rows)
    recency = lambda hours: rfm.rfm_features(frame, ["Recency"], DAY + dt.timedelta(hours=hours)).first().Recency
    assert [recency(h) for h in (23, 24, 49, -1)] == [0, 1, 2, -1]


def test_rows_without_customer_move_the_snapshot_only(spark):
    rows = [(1, "a", DAY, 1, 1.0), (None, "b", DAY + dt.timedelta(days=10), 1, 1.0)]
    got = by_customer(rfm.rfm_features(tx(spark, rows)))
    assert list(got) == [1] and got[1].Recency == 11


def test_infinite_and_missing_amounts(spark):
    inf, nan = float("inf"), float("nan")
    rows = [
        (1, "a", DAY, 1, 2.0, inf), (1, "b", DAY, 1, 2.0, 5.0),
        (2, "c", DAY, 1, 2.0, nan), (2, "d", DAY, 1, 2.0, 5.0),
        (3, "e", DAY, 1, nan, 7.0), (4, "f", DAY, 1, None, 7.0),
    ]
    got = by_customer(rfm.rfm_features(tx(spark, rows, SCHEMA + ", TotalPrice double")))
    assert {k: v.Monetary for k, v in got.items()} == {1: 0.0, 2: 5.0, 3: 0.0, 4: 0.0}
    assert got[4].FreeTransactionRatio == 0.0


def test_sums_do_not_depend_on_partitions(spark):
    rows = [(i % 3, str(i), DAY, 1, 0.1 + i / 7) for i in range(500)]
    frame = tx(spark, rows)
    sums = [
        [r.Monetary for r in rfm.rfm_features(frame.repartition(n), ["Monetary"]).orderBy("CustomerID").collect()]
        for n in (1, 5, 13)
    ]
    assert sums[0] == sums[1] == sums[2]


def test_required_columns(spark):
    with pytest.raises(ValueError, match="InvoiceNo"):
        rfm.rfm_features(tx(spark, [(1, "a", DAY, 1, 1.0)]).drop("InvoiceNo"))


def test_line_total_is_kept_when_present(spark):
    frame = tx(spark, [(1, "a", DAY, 2, 1.5)])
    assert rfm.with_line_total(frame).first().TotalPrice == 3.0
    assert rfm.with_line_total(frame.withColumn("TotalPrice", F.lit(9.0))).first().TotalPrice == 9.0


def test_outer_alignment_keeps_every_customer(spark):
    a = spark.createDataFrame([(1, 10), (2, 20)], "CustomerID bigint, x int")
    b = spark.createDataFrame([(2, 5), (3, 6)], "CustomerID bigint, y int")
    got = {r.CustomerID: (r.x, r.y) for r in rfm.align_by_customer([a, b]).collect()}
    assert got == {1: (10, None), 2: (20, 5), 3: (None, 6)}


def test_one_pass_equals_aligned_aggregates(spark):
    rows = [(i % 7, str(i % 40), DAY - dt.timedelta(hours=i), 1 + i % 3, float(i % 4)) for i in range(300)]
    frame = rfm.with_line_total(tx(spark, rows))
    parts = [
        frame.groupBy("CustomerID").agg(F.count_distinct("InvoiceNo").alias("Frequency")),
        frame.filter("UnitPrice > 0").groupBy("CustomerID").agg(F.sum("TotalPrice").alias("Monetary")),
    ]
    aligned = sorted(map(tuple, rfm.align_by_customer(parts).select("CustomerID", "Frequency", "Monetary").collect()))
    assert aligned == sorted(map(tuple, rfm.rfm_features(frame, ["Frequency", "Monetary"]).collect()))


def test_four_aggregates_aligned(spark):
    """Customers without a paid line, without a date, and lines without a customer."""
    rows = [
        (1, "a", DAY, 2, 1.5), (1, "b", DAY - dt.timedelta(days=3), 1, 0.0), (2, "c", DAY, 1, 0.0), (3, "d", None, 1, 4.0),
        (None, "e", DAY, 1, 9.0), (4, None, DAY, 1, 0.00004), (4, "f", DAY, 1, 0.00004),
    ]
    end = F.lit(str(DAY + dt.timedelta(days=1))).cast("timestamp")
    frames = rfm.separate_features(rfm.customer_parts(tx(spark, rows), parts=2), end)
    assert [f.count() for f in frames] == [3, 4, 3, 4]
    got = {r.CustomerID: tuple(r)[1:] for r in rfm.align_by_customer(frames).collect()}
    assert got == {1: (1, 4, 2, 3.0, 0.5), 2: (1, 1, 1, None, 1.0), 3: (None, None, 1, 4.0, 0.0), 4: (1, 1, 1, 0.00008, 0.0)}


def test_alignment_leaves_out_rows_without_customer(spark):
    a = spark.createDataFrame([(1, 10), (None, 20)], "CustomerID bigint, x int")
    b = spark.createDataFrame([(None, 6)], "CustomerID bigint, y int")
    assert [tuple(r) for r in rfm.align_by_customer([a, b]).collect()] == [(1, 10, None)]
