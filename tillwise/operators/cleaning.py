"""Row cleaning of transactions and its report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwise.constants import CUSTOMER_KEY
from tillwise.functions.numbers import nan_to_null_columns
from tillwise.schemas import require_columns


def drop_duplicate_rows(df: DataFrame) -> DataFrame:
    """Exact duplicates, nulls being equal. Copies meet on the map side first."""
    return df.dropDuplicates()


def drop_missing_customers(df: DataFrame) -> DataFrame:
    return df.dropna(subset=[CUSTOMER_KEY])


def keep_positive_quantities(df: DataFrame) -> DataFrame:
    return df.filter(F.col("Quantity") > 0)


def parse_invoice_dates(df: DataFrame, pattern: str | None = None, lenient: bool = False) -> DataFrame:
    """Text to timestamp. Bad text raises; ``lenient`` makes it null instead."""
    if "InvoiceDate" not in df.columns or dict(df.dtypes)["InvoiceDate"].startswith("timestamp"):
        return df
    parse = F.try_to_timestamp if lenient else F.to_timestamp
    text = F.col("InvoiceDate").cast("string")
    return df.withColumn("InvoiceDate", parse(text, F.lit(pattern)) if lenient and pattern else
                         parse(text, pattern) if pattern else parse(text))


def typed_ids(df: DataFrame) -> DataFrame:
    """Whole-number customer ids (files often carry ``12647.0``), text invoices."""
    if CUSTOMER_KEY in df.columns:
        df = df.withColumn(CUSTOMER_KEY, F.col(CUSTOMER_KEY).cast("double").cast("bigint"))
    if "InvoiceNo" in df.columns:
        df = df.withColumn("InvoiceNo", F.col("InvoiceNo").cast("string"))
    return df


def clean(df: DataFrame, pattern: str | None = None, lenient: bool = False) -> DataFrame:
    """All cleaning steps. The filters run before the shuffle that finds
    duplicates: they depend on the row alone, so the result is the same."""
    require_columns(df, [CUSTOMER_KEY, "Quantity"], "cleaning")
    df = nan_to_null_columns(df)
    kept = drop_duplicate_rows(keep_positive_quantities(drop_missing_customers(df)))
    return typed_ids(parse_invoice_dates(kept, pattern, lenient))


def cleaning_report(df: DataFrame) -> DataFrame:
    """Rows removed by each step, in step order, from one grouping by all columns."""
    require_columns(df, [CUSTOMER_KEY, "Quantity"], "cleaning")
    distinct = nan_to_null_columns(df).groupBy(*df.columns).agg(F.count("*").alias("_copies"))
    known = F.col(CUSTOMER_KEY).isNotNull()
    positive = F.coalesce(F.col("Quantity") > 0, F.lit(False))
    return distinct.agg(
        F.coalesce(F.sum("_copies"), F.lit(0)).alias("InitialRows"),
        F.coalesce(F.sum(F.col("_copies") - 1), F.lit(0)).alias("DuplicatesRemoved"),
        F.count_if(~known).alias("MissingCustomersRemoved"),
        F.count_if(known & ~positive).alias("InvalidQuantitiesRemoved"),
        F.count_if(known & positive).alias("FinalRows"),
    )
