import pytest
from pyspark.sql import functions as F

from tillwise import constants as K
from tillwise.operators import charts, churn, kpi


def frame(spark, rows, schema="CustomerID bigint, Recency double, Frequency double, Monetary double"):
    return spark.createDataFrame(rows, schema)


def scores(df):
    return {r.CustomerID: (r.ChurnScore, r.ChurnRisk) for r in df.collect()}


def test_hand_worked_customers(spark, four):
    assert scores(churn.add_churn(four)) == {
        1001: (0.0, "Low Risk"),
        1002: (0.5894, "Medium Risk"),
        1003: (1.0, "High Risk"),
        1004: (0.2295, "Low Risk"),
    }
    assert scores(churn.churn_scores_absolute(four)) == {
        1001: (0.2, "Low Risk"),
        1002: (0.425, "Medium Risk"),
        1003: (0.775, "High Risk"),
        1004: (0.2, "Low Risk"),
    }


def test_band_edges(spark):
    rows = [(0, 0.0, 0.0, 0.0), (1, 30.0, 10.0, 5000.0), (2, 31.0, 11.0, 5001.0), (3, 366.0, 26.0, 100.0)]
    assert scores(churn.churn_scores_absolute(frame(spark, rows))) == {
        0: (0.55, "Medium Risk"),
        1: (0.225, "Low Risk"),
        2: (0.23, "Low Risk"),
        3: (0.73, "High Risk"),
    }


def test_one_customer_and_constant_columns(spark):
    assert scores(churn.add_churn(frame(spark, [(1, 9.0, 2.0, 3.0)]))) == {1: (0.5, "Medium Risk")}
    got = scores(churn.add_churn(frame(spark, [(1, 0.0, 2.0, 3.0), (2, 10.0, 2.0, 3.0)])))
    assert got == {1: (0.25, "Low Risk"), 2: (0.75, "High Risk")}


@pytest.mark.parametrize("missing", [None, float("nan")])
def test_missing_recency_has_no_score_and_low_risk(spark, missing):
    rows = [(1, missing, 1.0, 1.0), (2, 5.0, 2.0, 2.0), (3, 9.0, 3.0, 9.0)]
    assert scores(churn.add_churn(frame(spark, rows)))[1] == (None, "Low Risk")


def test_class_on_rounded_score(spark):
    from tillwise.functions.scores import risk_class

    df = spark.createDataFrame([(0.65,), (0.6499,), (0.35,), (0.3499,), (None,)], "s double")
    got = [r[0] for r in df.select(risk_class(F.col("s"))).collect()]
    assert got == ["High Risk", "Medium Risk", "Medium Risk", "Low Risk", "Low Risk"]


def test_empty_input(spark, four):
    none = four.limit(0)
    assert churn.add_churn(none).count() == 0
    revenue = kpi.revenue_kpis(none).first()
    assert (revenue.total_revenue, revenue.arpu, revenue.top10_pct_revenue_share, revenue.median_monetary) == (0.0, 0.0, 0.0, None)
    assert kpi.customer_kpis(none).first().active_rate_pct == 0.0
    assert charts.histogram(none, "Monetary").count() == 0
    assert [r.Count for r in charts.risk_counts(churn.add_churn(none)).collect()] == [0, 0, 0]


def test_required_columns(spark, four):
    for call, absent in [
        (lambda df: churn.add_churn(df.drop("Monetary")), "Monetary"),
        (lambda df: churn.segment_churn_summary(churn.add_churn(df)), "Segment_Name"),
        (lambda df: kpi.revenue_kpis(df.drop("Monetary")), "Monetary"),
        (lambda df: kpi.risk_kpis(df), "ChurnRisk"),
        (lambda df: kpi.segment_kpis(df), "Segment_Name"),
    ]:
        with pytest.raises(ValueError, match=absent):
            call(four)


def test_churn_is_added_only_where_absent(spark, four):
    given = four.withColumn("ChurnRisk", F.lit("High Risk"))
    assert churn.ensure_churn(given) is given
    assert "ChurnScore" in churn.ensure_churn(four).columns


def test_absent_optional_columns_give_null(spark, four):
    bare = four.select("CustomerID", "Recency", "Frequency", "Monetary")
    customer, engagement = kpi.customer_kpis(bare).first(), kpi.engagement_kpis(bare).first()
    assert customer.churn_rate_pct is None and customer.avg_tenure_days is None
    assert engagement.avg_order_value is None
    # fallbacks of the order value: per-customer mean of Monetary / Frequency, then revenue per user
    assert kpi.revenue_kpis(bare).first().avg_order_value == 57.5
    assert kpi.revenue_kpis(bare.select("Monetary")).first().avg_order_value == 687.5
    assert "HighRiskPct" not in kpi.segment_kpis(bare.withColumn("Segment_Name", F.lit("a"))).columns


def test_median_of_fractional_recency(spark):
    df = frame(spark, [(1, 1.5, 1.0, 1.0), (2, 4.0, 1.0, 1.0)])
    assert kpi.customer_kpis(df).first().median_recency_days == 2.8
    assert kpi.customer_kpis(df.withColumn("Recency", F.col("Recency").cast("int"))).first().median_recency_days == 2.5


def test_zero_frequency_is_left_out_of_the_order_value(spark):
    df = frame(spark, [(1, 1.0, 0.0, 10.0), (2, 1.0, 2.0, 10.0)])
    assert kpi.revenue_kpis(df).first().avg_order_value == 5.0


def test_zero_revenue_gives_zero_shares(spark):
    df = frame(spark, [(1, 1.0, 1.0, 0.0), (2, 50.0, 1.0, 0.0)]).withColumn("Segment_Name", F.lit("a"))
    with_risk = churn.add_churn(df)
    assert kpi.revenue_kpis(df).first().top10_pct_revenue_share == 0.0
    assert kpi.risk_kpis(with_risk).first().revenue_at_risk_pct == 0.0
    assert kpi.segment_kpis(with_risk).first().RevenueSharePct == 0.0


def test_rows_without_a_segment_count_in_totals_only(spark, four):
    df = four.withColumn("Segment_Name", F.when(F.col("CustomerID") < 1003, F.lit("a")))
    got = kpi.segment_kpis(df).collect()
    assert [(r.Segment, r.CustomerCount, r.CustomerSharePct, r.RevenueSharePct) for r in got] == [("a", 2, 50.0, 65.5)]
    summary = churn.segment_churn_summary(churn.add_churn(df)).collect()
    assert [(r.Segment_Name, r.CustomerCount) for r in summary] == [("a", 2)]


def test_shares_and_counts_add_up(spark, four):
    df = churn.add_churn(four).withColumn("Segment_Name", (F.col("CustomerID") % 2).cast("string"))
    risk = kpi.risk_kpis(df).first()
    assert risk.n_high_risk + risk.n_medium_risk + risk.n_low_risk == 4
    assert sum(r.RevenueSharePct for r in kpi.segment_kpis(df).collect()) == pytest.approx(100, abs=0.2)
    report = kpi.compute_kpis(df)
    assert set(report) == {"revenue", "customer", "engagement", "segment", "risk"}
    long = {(r.kpi_group, r.item, r.metric): r.value for r in kpi.all_kpis(df).collect()}
    assert long[("risk", None, "revenue_at_risk")] == 50.0
    assert set(g for g, _, _ in long) == set(report)
    assert set(kpi.compute_kpis(four)) == {"revenue", "customer", "engagement"}


def test_explanation_adds_up(spark, four):
    for r in churn.explain_churn(four).collect():
        parts = r.recency_component + r.frequency_component + r.monetary_component
        assert parts == pytest.approx(r.total_score, abs=1e-4)
    assert churn.churn_breakdown(four).count() == 12


def test_recency_buckets_edges(spark):
    values = [0, 1, 30, 31, 90, 91, 180, 181, 365, 366]
    df = spark.createDataFrame([(v,) for v in values], "Recency bigint")
    assert [r.Customers for r in charts.recency_buckets(df).collect()] == [2, 2, 2, 2, 1]
    few = charts.recency_buckets(df.filter("Recency < 31")).collect()
    assert [(r.Bucket, r.Customers) for r in few] == [(n, 2 if i == 0 else 0) for i, (_, _, n) in enumerate(K.RECENCY_BUCKETS)]


def test_histogram_maximum_and_constant(spark):
    df = spark.createDataFrame([(float(v), 5.0) for v in (0, 1, 9, 10)], "a double, c double")
    got = {(r.column_name, r.bin): r.n_rows for r in charts.histograms(df, {"a": 10, "c": 4}).collect()}
    assert got == {("a", 0): 1, ("a", 1): 1, ("a", 9): 2, ("c", 0): 4}


def test_pareto_ends_at_100_and_line(spark, four):
    pareto = charts.revenue_pareto(four).orderBy("Rank").collect()
    assert [r.CustomerID for r in pareto] == [1001, 1004, 1002, 1003] and pareto[-1].CumulativePct == 100.0
    assert charts.pareto_line(charts.revenue_pareto(four)).first().CustomersNeeded == 2


def test_sample_is_repeatable(spark):
    df = spark.range(500).select(F.col("id").alias("CustomerID"), F.lit(1).alias("Recency"))
    take = lambda f: {r.CustomerID for r in charts.scatter_sample(f, rows=50).collect()}
    assert len(take(df)) == 50 and take(df) == take(df.repartition(7))
