"""Registered: churn, KPIs and chart tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillwise.constants import CHURN_WEIGHTS, HISTOGRAM_BINS, RECENCY_BUCKETS
from tillwise.functions import scores as S
from tillwise.functions.numbers import round_even
from tillwise.operators import charts, churn, kpi
from tillwise.operators.cleaning import clean
from tillwise.operators.rfm import rfm_features
from tillwise.plans.inputs import enriched, enriched_customers, keyed
from tillwise.plans.oracle_parts import ABSOLUTE, BAND_F, BAND_M, BAND_R, money, risk, rounded, sql, sql_after_cleaning
from tillwise.plans.registry import register
from tillwise.plans.transactions import histogram_sql, rounded_edges
from tillwise.session import reused
from tillwise.sources.retail import customers, retail_dirty

DRIVERS = list(CHURN_WEIGHTS)
FEATURES = "Recency, Tenure, Frequency, Monetary, FreeTransactionRatio, AvgOrderValue"


def churned_customers(spark, sf_dir):
    return churn.add_churn(customers(spark, sf_dir))


# --- churn -----------------------------------------------------------------


@register(
    "min_max_norm",
    sql("SELECT CustomerID, " + ", ".join(f"{rounded(f'{c}_norm', 6)} AS {c}_norm" for c in DRIVERS) + " FROM norms", "norms"),
)
def min_max_norm(spark, sf_dir):
    norms = churn.normalised(customers(spark, sf_dir), DRIVERS)
    return keyed(norms, *[round_even(F.col(f"{c}_norm"), 6).alias(f"{c}_norm") for c in DRIVERS])


@register(
    "band_scores",
    sql(f"SELECT CustomerID, {BAND_R} AS Recency_band, {BAND_F} AS Frequency_band, {BAND_M} AS Monetary_band FROM rfm", "rfm"),
)
def band_scores(spark, sf_dir):
    return keyed(customers(spark, sf_dir), *[c.alias(f"{d}_band") for d, c in S.band_components().items()])


@register("churn_scores", sql("SELECT CustomerID, ChurnScore FROM scored", "scored"))
def churn_scores(spark, sf_dir):
    return keyed(churn.churn_scores(customers(spark, sf_dir)), "ChurnScore")


@register(
    "churn_scores_absolute",
    sql(f"SELECT CustomerID, {ABSOLUTE} AS ChurnScore, {risk(ABSOLUTE)} AS ChurnRisk FROM rfm", "rfm"),
)
def churn_scores_absolute(spark, sf_dir):
    return keyed(churn.churn_scores_absolute(customers(spark, sf_dir)), "ChurnScore", "ChurnRisk")


@register("churn_risk", sql("SELECT CustomerID, ChurnRisk FROM churned", "churned"))
def churn_risk(spark, sf_dir):
    return keyed(churned_customers(spark, sf_dir), "ChurnRisk")


@register("churn_analysis", sql(f"SELECT CustomerID, {FEATURES}, ChurnScore, ChurnRisk FROM churned", "churned"))
def churn_analysis(spark, sf_dir):
    return churned_customers(spark, sf_dir)


_HIGH = "count(*) FILTER (WHERE ChurnRisk = 'High Risk')"
_SUMMARY = f"""SELECT Segment_Name, count(ChurnScore) AS CustomerCount, {rounded("avg(ChurnScore)", 4)} AS AvgChurnScore,
{_HIGH} AS HighRiskCount, count(*) FILTER (WHERE ChurnRisk = 'Medium Risk') AS MediumRiskCount,
count(*) FILTER (WHERE ChurnRisk = 'Low Risk') AS LowRiskCount,
{rounded(f"100e0 * {_HIGH} / count(ChurnScore)", 1)} AS HighRiskPct FROM enriched GROUP BY Segment_Name"""


@register("segment_churn_summary", sql(_SUMMARY + " ORDER BY AvgChurnScore DESC, Segment_Name", "enriched"))
def segment_churn_summary(spark, sf_dir):
    return churn.segment_churn_summary(enriched_customers(spark, sf_dir))


_BANDS = {"recency": ("Recency", 0.5, BAND_R), "frequency": ("Frequency", 0.3, BAND_F), "monetary": ("Monetary", 0.2, BAND_M)}


@register(
    "churn_explain",
    sql(
        f"SELECT CustomerID, {ABSOLUTE} AS total_score, {risk(ABSOLUTE)} AS risk_label, "
        + ", ".join(f"{rounded(f'{w}e0 * ({b})', 4)} AS {n}_component, {c} AS {n}_raw" for n, (c, w, b) in _BANDS.items())
        + " FROM rfm",
        "rfm",
    ),
)
def churn_explain(spark, sf_dir):
    return churn.explain_churn(customers(spark, sf_dir))


@register(
    "churn_breakdown_long",
    sql(
        " UNION ALL ".join(
            f"""SELECT CustomerID, '{c}' AS Driver, CAST({c} AS DOUBLE) AS RawValue, {w}e0 AS Weight,
{rounded(f"{w}e0 * ({b})", 4)} AS Contribution FROM rfm"""
            for c, w, b in _BANDS.values()
        ),
        "rfm",
    ),
)
def churn_breakdown_long(spark, sf_dir):
    return churn.churn_breakdown(customers(spark, sf_dir))


# --- KPIs ------------------------------------------------------------------


def _share(part: str, whole: str, digits: int = 1) -> str:
    return rounded(f"coalesce(100e0 * ({part}) / nullif({whole}, 0), 0)", digits)


_TOP = f"(SELECT {money('Monetary')} FROM enriched WHERE Monetary >= (SELECT quantile_cont(Monetary, 0.9) FROM enriched))"


def _revenue_metrics(order_value: str) -> dict[str, str]:
    return {
        "total_revenue": rounded(money("Monetary"), 2),
        "arpu": rounded(f"{money('Monetary')} / count(*)", 2),
        "avg_order_value": rounded(order_value, 2),
        "median_monetary": rounded("quantile_cont(Monetary, 0.5)", 2),
        "top10_pct_revenue_share": rounded(f"100e0 * {_TOP} / {money('Monetary')}", 1),
        "revenue_std": rounded("stddev_samp(Monetary)", 2),
    }


_AT_RISK = "coalesce(" + money("CASE WHEN ChurnRisk = 'High Risk' THEN Monetary END") + ", 0)"
KPI_SQL = {
    "revenue": _revenue_metrics("avg(AvgOrderValue)"),
    "customer": {
        "total_customers": "count(*)",
        "active_customers": "count(*) FILTER (WHERE Recency <= 90)",
        "active_rate_pct": _share("count(*) FILTER (WHERE Recency <= 90)", "count(*)"),
        "churn_rate_pct": _share(_HIGH, "count(*)"),
        "avg_tenure_days": rounded("avg(Tenure)", 1),
        "median_recency_days": rounded("quantile_cont(Recency, 0.5)", 1),
    },
    "engagement": {
        "avg_recency": rounded("avg(Recency)", 1),
        "avg_frequency": rounded("avg(Frequency)", 2),
        "avg_order_value": rounded("avg(AvgOrderValue)", 2),
        "pct_single_purchase": _share("count(*) FILTER (WHERE Frequency = 1)", "count(*)"),
        "pct_high_frequency": _share("count(*) FILTER (WHERE Frequency > 10)", "count(*)"),
    },
    "risk": {
        "n_high_risk": _HIGH,
        "n_medium_risk": "count(*) FILTER (WHERE ChurnRisk = 'Medium Risk')",
        "n_low_risk": "count(*) FILTER (WHERE ChurnRisk = 'Low Risk')",
        "revenue_at_risk": rounded(_AT_RISK, 2),
        "revenue_at_risk_pct": _share(_AT_RISK, money("Monetary")),
        "high_risk_pct": _share(_HIGH, "count(*)"),
        "medium_risk_pct": _share("count(*) FILTER (WHERE ChurnRisk = 'Medium Risk')", "count(*)"),
        "low_risk_pct": _share("count(*) FILTER (WHERE ChurnRisk = 'Low Risk')", "count(*)"),
    },
}

def _one_row_sql(metrics: dict[str, str]) -> str:
    return sql("SELECT " + ", ".join(f"{e} AS {n}" for n, e in metrics.items()) + " FROM enriched", "enriched")


@register("revenue_kpis", _one_row_sql(KPI_SQL["revenue"]))
def revenue_kpis(spark, sf_dir):
    return kpi.revenue_kpis(customers(spark, sf_dir))


@register("revenue_kpis_fallback", _one_row_sql(_revenue_metrics("avg(Monetary / nullif(Frequency, 0))")))
def revenue_kpis_fallback(spark, sf_dir):
    return kpi.revenue_kpis(customers(spark, sf_dir).drop("AvgOrderValue"))


@register("customer_kpis", _one_row_sql(KPI_SQL["customer"]))
def customer_kpis(spark, sf_dir):
    return kpi.customer_kpis(churned_customers(spark, sf_dir))


@register("engagement_kpis", _one_row_sql(KPI_SQL["engagement"]))
def engagement_kpis(spark, sf_dir):
    return kpi.engagement_kpis(customers(spark, sf_dir))


@register("risk_kpis", _one_row_sql(KPI_SQL["risk"]))
def risk_kpis(spark, sf_dir):
    return kpi.risk_kpis(churned_customers(spark, sf_dir))


_SEGMENT_KPIS = f"""SELECT Segment_Name AS Segment, count(Monetary) AS CustomerCount,
{rounded("100e0 * count(Monetary) / (SELECT count(*) FROM enriched)", 1)} AS CustomerSharePct,
{rounded(money("Monetary"), 2)} AS TotalRevenue,
{rounded(f"100e0 * {money('Monetary')} / (SELECT {money('Monetary')} FROM enriched)", 1)} AS RevenueSharePct,
{rounded("avg(Monetary)", 2)} AS ARPU, {rounded("avg(Recency)", 2)} AS AvgRecency,
{rounded("avg(Frequency)", 2)} AS AvgFrequency, {rounded("avg(Monetary)", 2)} AS AvgMonetary,
{rounded(f"100e0 * {_HIGH} / count(*)", 1)} AS HighRiskPct FROM enriched GROUP BY Segment_Name"""
SEGMENT_MEASURES = [
    "CustomerCount",
    "CustomerSharePct",
    "TotalRevenue",
    "RevenueSharePct",
    "ARPU",
    "AvgRecency",
    "AvgFrequency",
    "AvgMonetary",
    "HighRiskPct",
]


@register("segment_kpis", sql(_SEGMENT_KPIS + " ORDER BY TotalRevenue DESC, Segment", "enriched"))
def segment_kpis(spark, sf_dir):
    return kpi.segment_kpis(enriched_customers(spark, sf_dir))


def _all_kpis_sql(build=sql) -> str:
    rows = [
        f"SELECT '{g}' AS kpi_group, CAST(NULL AS VARCHAR) AS item, '{m}' AS metric, CAST({e} AS DOUBLE) AS value FROM enriched"
        for g, metrics in KPI_SQL.items()
        for m, e in metrics.items()
    ]
    rows += [
        f"SELECT 'segment', Segment, '{m}', CAST({m} AS DOUBLE) FROM ({_SEGMENT_KPIS})" for m in SEGMENT_MEASURES
    ]
    return build(" UNION ALL ".join(rows), "enriched")


@register("all_kpis", _all_kpis_sql())
def all_kpis(spark, sf_dir):
    return kpi.all_kpis(enriched_customers(spark, sf_dir))


@register("end_to_end", _all_kpis_sql(sql_after_cleaning))
def end_to_end(spark, sf_dir):
    """From dirty lines to KPIs: clean, build features, segment, name, score churn, report."""
    rfm = rfm_features(clean(retail_dirty(spark, sf_dir)))
    return kpi.all_kpis(enriched(rfm))


# --- chart tables ----------------------------------------------------------

_CLASSES = "(VALUES ('High Risk'), ('Medium Risk'), ('Low Risk')) AS c(ChurnRisk)"
_COUNTS = f"""SELECT c.ChurnRisk, count(churned.ChurnRisk) AS "Count" FROM {_CLASSES}
LEFT JOIN churned ON churned.ChurnRisk = c.ChurnRisk GROUP BY c.ChurnRisk"""


@register("risk_counts", sql(_COUNTS, "churned"))
def risk_counts(spark, sf_dir):
    return charts.risk_counts(churned_customers(spark, sf_dir))


@register(
    "risk_overview",
    sql(f'SELECT ChurnRisk, "Count", {rounded("100e0 * n / sum(n) OVER ()", 1)} AS Pct FROM (SELECT *, "Count" AS n FROM ({_COUNTS}))', "churned"),
)
def risk_overview(spark, sf_dir):
    return charts.risk_overview(churned_customers(spark, sf_dir))


def _register_histogram(name: str, column: str) -> None:
    source = "churned" if column == "ChurnScore" else "rfm"

    @register(name, sql(histogram_sql(source, column, HISTOGRAM_BINS[column]), source))
    def one_histogram(spark, sf_dir):
        make = churned_customers if column == "ChurnScore" else customers
        return rounded_edges(charts.histogram(make(spark, sf_dir), column))


for _name, _column in {
    "histogram_score": "ChurnScore",
    "histogram_monetary": "Monetary",
    "histogram_recency": "Recency",
    "histogram_tenure": "Tenure",
    "histogram_frequency": "Frequency",
    "histogram_aov": "AvgOrderValue",
}.items():
    _register_histogram(_name, _column)


@register(
    "histogram_score_by_risk",
    sql(histogram_sql("churned", "ChurnScore", HISTOGRAM_BINS["ChurnScore"], by="ChurnRisk, "), "churned"),
)
def histogram_score_by_risk(spark, sf_dir):
    return rounded_edges(charts.histogram(reused(churned_customers(spark, sf_dir)), "ChurnScore", by="ChurnRisk"))


_PARETO = """SELECT CustomerID, Monetary, row_number() OVER w AS "Rank",
100e0 * CAST(sum(CAST(Monetary AS DECIMAL(18,4))) OVER w AS DOUBLE)
  / (SELECT CAST(sum(CAST(Monetary AS DECIMAL(18,4))) AS DOUBLE) FROM rfm) AS pct
FROM rfm WINDOW w AS (ORDER BY Monetary DESC, CustomerID ROWS UNBOUNDED PRECEDING)"""


@register(
    "revenue_pareto",
    sql(f'SELECT CustomerID, Monetary, "Rank", {rounded("pct", 6)} AS CumulativePct FROM ({_PARETO})', "rfm"),
)
def revenue_pareto(spark, sf_dir):
    pareto = charts.revenue_pareto(customers(spark, sf_dir))
    return pareto.withColumn("CumulativePct", round_even(F.col("CumulativePct"), 6))


@register("pareto_80", sql(f'SELECT min("Rank") AS CustomersNeeded FROM ({_PARETO}) WHERE pct >= 80', "rfm"))
def pareto_80(spark, sf_dir):
    return charts.customers_for_share(customers(spark, sf_dir))


def _buckets_sql() -> str:
    values = ", ".join(f"({lo}, {'1e18' if hi is None else hi}, '{name}')" for lo, hi, name in RECENCY_BUCKETS)
    return sql(
        f"""SELECT Bucket, count(CustomerID) AS Customers FROM (VALUES {values}) AS b(lo, hi, Bucket)
LEFT JOIN rfm ON Recency > lo AND Recency <= hi GROUP BY Bucket""",
        "rfm",
    )


@register("recency_buckets", _buckets_sql())
def recency_buckets(spark, sf_dir):
    return charts.recency_buckets(customers(spark, sf_dir))


_AXES = ["AvgRecency", "AvgFrequency", "AvgMonetary"]


@register(
    "segment_radar",
    sql(
        "SELECT Segment, "
        + ", ".join(f"{rounded(f'{a} / max({a}) OVER ()', 6)} AS {a}" for a in _AXES)
        + f" FROM ({_SEGMENT_KPIS})",
        "enriched",
    ),
)
def segment_radar(spark, sf_dir):
    radar = charts.segment_radar(kpi.segment_kpis(enriched_customers(spark, sf_dir)))
    return radar.withColumns({a: round_even(F.col(a), 6) for a in _AXES})


@register(
    "segment_revenue_share",
    sql(f"SELECT Segment, TotalRevenue, RevenueSharePct FROM ({_SEGMENT_KPIS})", "enriched"),
)
def segment_revenue_share(spark, sf_dir):
    return charts.segment_revenue_share(kpi.segment_kpis(enriched_customers(spark, sf_dir)))


@register(
    "segment_risk_long",
    sql(
        " UNION ALL ".join(
            f"SELECT Segment_Name, '{c}' AS RiskLevel, {c} AS Customers FROM ({_SUMMARY})"
            for c in ("HighRiskCount", "MediumRiskCount", "LowRiskCount")
        ),
        "enriched",
    ),
)
def segment_risk_long(spark, sf_dir):
    return charts.segment_risk_long(churn.segment_churn_summary(enriched_customers(spark, sf_dir)))


@register(
    "scatter_sample",
    sql(
        """SELECT CustomerID, Recency, Monetary, Frequency, ChurnScore, ChurnRisk, Segment_Name FROM enriched
ORDER BY md5('42:' || CAST(CustomerID AS VARCHAR)), CustomerID LIMIT 3000""",
        "enriched",
    ),
)
def scatter_sample(spark, sf_dir):
    return charts.scatter_sample(enriched_customers(spark, sf_dir))


@register(
    "customer_churn_table",
    sql(
        "SELECT CustomerID, Recency, Frequency, Monetary, Segment_Name, ChurnScore, ChurnRisk FROM enriched",
        "enriched",
    ),
)
def customer_churn_table(spark, sf_dir):
    return charts.customer_churn_table(enriched_customers(spark, sf_dir))
