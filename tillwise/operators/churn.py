"""Churn scores, risk classes, segment summary and explanation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwise import constants as K
from tillwise.functions import scores as S
from tillwise.functions.numbers import count_where, pct, round_even
from tillwise.schemas import require_columns

DRIVERS = list(K.CHURN_WEIGHTS)


def normalised(df: DataFrame, columns: list[str]) -> DataFrame:
    """Add ``<column>_norm``: min-max over the whole frame, fitted by one job."""
    return df.withColumns(
        {f"{c}_norm": S.min_max(S.as_number(c), lo, hi) for c, (lo, hi) in S.ranges(df, columns).items()}
    )


def churn_scores(df: DataFrame) -> DataFrame:
    """Add ChurnScore relative to this population, 4 digits."""
    require_columns(df, DRIVERS, "churn scoring")
    score = S.weighted(F.col("Recency_norm"), 1 - F.col("Frequency_norm"), 1 - F.col("Monetary_norm"))
    others = [c for c in df.columns if c != "ChurnScore"]
    return normalised(df, DRIVERS).select(*others, round_even(score, 4).alias("ChurnScore"))


def add_churn(df: DataFrame) -> DataFrame:
    """Add ChurnScore and ChurnRisk (class of the rounded score)."""
    return churn_scores(df).withColumn("ChurnRisk", S.risk_class(F.col("ChurnScore")))


def ensure_churn(df: DataFrame) -> DataFrame:
    """Churn columns only where a frame comes without them."""
    return df if "ChurnRisk" in df.columns else add_churn(df)


def churn_scores_absolute(df: DataFrame) -> DataFrame:
    """ChurnScore and ChurnRisk by fixed bands: independent of other rows."""
    require_columns(df, DRIVERS, "churn scoring")
    return df.withColumn("ChurnScore", S.absolute_score()).withColumn("ChurnRisk", S.risk_class(F.col("ChurnScore")))


def segment_churn_summary(df: DataFrame, segment_col: str = "Segment_Name") -> DataFrame:
    """Customers, mean score and risk counts per segment, riskiest first."""
    require_columns(df, [segment_col, "ChurnScore", "ChurnRisk"], "segment churn summary")
    grouped = (
        df.filter(F.col(segment_col).isNotNull())
        .groupBy(segment_col)
        .agg(
            F.count("ChurnScore").alias("CustomerCount"),
            round_even(F.avg("ChurnScore"), 4).alias("AvgChurnScore"),
            count_where(F.col("ChurnRisk") == K.HIGH_RISK).alias("HighRiskCount"),
            count_where(F.col("ChurnRisk") == K.MEDIUM_RISK).alias("MediumRiskCount"),
            count_where(F.col("ChurnRisk") == K.LOW_RISK).alias("LowRiskCount"),
        )
    )
    share = pct(F.col("HighRiskCount"), F.col("CustomerCount"), None)
    return grouped.withColumn("HighRiskPct", round_even(share, 1)).orderBy(
        F.desc_nulls_last("AvgChurnScore"), segment_col
    )


def explain_churn(df: DataFrame) -> DataFrame:
    """What drives the banded score of each customer."""
    require_columns(df, DRIVERS, "churn explanation")
    parts = S.band_components()
    key = [c for c in df.columns if c == K.CUSTOMER_KEY]
    return df.select(
        *key,
        S.absolute_score().alias("total_score"),
        S.risk_class(S.absolute_score()).alias("risk_label"),
        *[round_even(K.CHURN_WEIGHTS[d] * parts[d], 4).alias(f"{d.lower()}_component") for d in DRIVERS],
        *[F.col(d).alias(f"{d.lower()}_raw") for d in DRIVERS],
    )


def churn_breakdown(df: DataFrame) -> DataFrame:
    """The explanation in long form: one row per customer and driver."""
    rows = [
        F.struct(
            F.lit(d).alias("Driver"),
            F.col(f"{d.lower()}_raw").cast("double").alias("RawValue"),
            F.lit(K.CHURN_WEIGHTS[d]).alias("Weight"),
            F.col(f"{d.lower()}_component").alias("Contribution"),
        )
        for d in DRIVERS
    ]
    explained = explain_churn(df)
    key = [c for c in explained.columns if c == K.CUSTOMER_KEY]
    return explained.select(*key, F.inline(F.array(*rows)))
