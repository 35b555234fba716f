"""Explicit input schemas and the required-column guard."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import types as T

TRANSACTIONS = T.StructType(
    [
        T.StructField("InvoiceNo", T.StringType()),
        T.StructField("StockCode", T.StringType()),
        T.StructField("Description", T.StringType()),
        T.StructField("Quantity", T.IntegerType()),
        T.StructField("InvoiceDate", T.TimestampType()),
        T.StructField("UnitPrice", T.DoubleType()),
        T.StructField("CustomerID", T.DoubleType()),
        T.StructField("Country", T.StringType()),
        T.StructField("TotalPrice", T.DoubleType()),
    ]
)

# As read before cleaning: dates still text.
RAW_TRANSACTIONS = T.StructType(
    [
        T.StructField(f.name, T.StringType() if f.name == "InvoiceDate" else f.dataType)
        for f in TRANSACTIONS
    ]
)

CUSTOMERS_RFM = T.StructType(
    [
        T.StructField("CustomerID", T.LongType()),
        T.StructField("Recency", T.LongType()),
        T.StructField("Tenure", T.LongType()),
        T.StructField("Frequency", T.LongType()),
        T.StructField("Monetary", T.DoubleType()),
        T.StructField("FreeTransactionRatio", T.DoubleType()),
        T.StructField("AvgOrderValue", T.DoubleType()),
    ]
)


def require_columns(df: DataFrame, columns: Iterable[str], purpose: str) -> None:
    """Raise ``ValueError`` naming every absent column. Costs no job."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{purpose} needs columns that are absent: {missing}")


def existing_columns(df: DataFrame, columns: Iterable[str]) -> list[str]:
    return [c for c in columns if c in df.columns]
