"""Frames the registered queries start from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwise.constants import CUSTOMER_KEY, RFM_FEATURES
from tillwise.operators.churn import add_churn
from tillwise.operators.clusters import SEGMENT, nearest_centre
from tillwise.operators.naming import with_segment_names
from tillwise.operators.preprocess import fit_scaler, log_skewed, scale
from tillwise.plans.oracle_parts import FIXED_CENTRES
from tillwise.session import reused
from tillwise.sources.retail import customers


def scaled_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All customers, logged and scaled over themselves."""
    logs = log_skewed(customers(spark, sf_dir))
    return scale(logs, fit_scaler(logs, RFM_FEATURES), RFM_FEATURES)


def segmented_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw features and the nearest fixed centre."""
    return segmented(customers(spark, sf_dir))


def segmented(rfm: DataFrame) -> DataFrame:
    logs = log_skewed(rfm.select(F.struct("*").alias("_raw"), *RFM_FEATURES))
    scaled = scale(logs, fit_scaler(logs, RFM_FEATURES), RFM_FEATURES)
    return scaled.select("_raw.*", nearest_centre(RFM_FEATURES, FIXED_CENTRES).alias(SEGMENT))


def enriched_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features, segment, segment name, churn score and risk."""
    return enriched(customers(spark, sf_dir))


def enriched(rfm: DataFrame) -> DataFrame:
    return reused(add_churn(with_segment_names(reused(segmented(rfm)))))


def keyed(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(CUSTOMER_KEY, *columns)
