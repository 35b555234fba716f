"""Recency, tenure, frequency and monetary features: one row per customer."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.constants import CUSTOMER_KEY, RFM_FEATURES
from tillwise.functions.dates import one_day, whole_days
from tillwise.functions.numbers import amount_parts, amount_total, exact_sum, finite_or_zero, is_infinite, nan_to_null, ratio
from tillwise.schemas import require_columns
from tillwise.session import bucketed, one_row, reused

_DATED = ("Recency", "Tenure")
#: Rows that a customer has at most when its facts meet.
SPREAD = 64


def with_line_total(tx: DataFrame) -> DataFrame:
    """TotalPrice = Quantity x UnitPrice, unless the table has it."""
    if "TotalPrice" in tx.columns:
        return tx
    return tx.withColumn("TotalPrice", F.col("Quantity") * F.col("UnitPrice"))


def is_free() -> Column:
    return F.coalesce((F.col("UnitPrice") == 0).cast("int"), F.lit(0))


def snapshot_date(tx: DataFrame) -> DataFrame:
    """The day after the last purchase of the whole input: one row."""
    return tx.agg((F.max("InvoiceDate") + one_day()).alias("SnapshotDate"))


def monetary_value() -> Column:
    """Money over paid lines. A customer without any gets 0, and so does one
    whose total is not finite."""
    paid = F.when(nan_to_null(F.col("UnitPrice").cast("double")) > 0, nan_to_null(F.col("TotalPrice").cast("double")))
    endless = F.coalesce(F.bool_or(is_infinite(paid)), F.lit(False))
    total = exact_sum(F.when(~is_infinite(paid), paid))
    return F.when(endless, F.lit(0.0)).otherwise(F.coalesce(total, F.lit(0.0)))


# Aggregates behind each feature. One grouping serves them all, and columns
# nobody asks for are never read.
_FACTS = {
    "LastPurchase": lambda: F.max("InvoiceDate"),
    "FirstPurchase": lambda: F.min("InvoiceDate"),
    "Frequency": lambda: F.count_distinct("InvoiceNo"),
    "Monetary": monetary_value,
    "FreeTransactionRatio": lambda: F.avg(is_free()),
}
_FACTS_OF = {
    "Recency": ["LastPurchase"],
    "Tenure": ["LastPurchase", "FirstPurchase"],
    "Frequency": ["Frequency"],
    "Monetary": ["Monetary"],
    "FreeTransactionRatio": ["FreeTransactionRatio"],
    "AvgOrderValue": ["Monetary", "Frequency"],
}


def customer_facts(tx: DataFrame, features: Sequence[str] = tuple(RFM_FEATURES)) -> DataFrame:
    """The one shuffle by customer. Rows without a customer stay as one group:
    they count towards the snapshot date.

    The distinct count makes Spark group by (customer, invoice) first, so a
    customer with a third of all lines is spread over its invoices.
    """
    facts = list(dict.fromkeys(f for feature in features for f in _FACTS_OF[feature]))
    return with_line_total(tx).groupBy(CUSTOMER_KEY).agg(*[_FACTS[f]().alias(f) for f in facts])


def rfm_features(
    tx: DataFrame,
    features: Sequence[str] = tuple(RFM_FEATURES),
    snapshot: dt.datetime | None = None,
) -> DataFrame:
    """CustomerID and the asked features, in the given order.

    Without a fixed ``snapshot`` the date is fitted on the grouped customers (a
    job), which are written to the shared folder: the transactions are read once only.
    """
    needed = [CUSTOMER_KEY] + [c for c, used_by in _INPUTS.items() if set(used_by) & set(features)]
    require_columns(tx, needed, "RFM features")
    facts = customer_facts(tx, features)
    if set(features) & set(_DATED):
        if snapshot is None:
            facts = reused(facts)
            last = (F.max("LastPurchase") + one_day()).cast("string")
            end = one_row(facts.agg(last.alias("end")))["end"]
        else:
            end = str(snapshot)
        end = F.lit(end).cast(dict(tx.dtypes)["InvoiceDate"])
    columns = {
        "Recency": lambda: whole_days(F.col("LastPurchase"), end),
        "Tenure": lambda: whole_days(F.col("FirstPurchase"), end),
        "Frequency": lambda: F.col("Frequency"),
        "Monetary": lambda: F.col("Monetary"),
        "FreeTransactionRatio": lambda: F.col("FreeTransactionRatio"),
        "AvgOrderValue": lambda: avg_order_value(),
    }
    return facts.filter(F.col(CUSTOMER_KEY).isNotNull()).select(
        CUSTOMER_KEY, *[columns[f]().alias(f) for f in features]
    )


_INPUTS = {
    "InvoiceDate": ["Recency", "Tenure"],
    "InvoiceNo": ["Frequency", "AvgOrderValue"],
    "UnitPrice": ["Monetary", "FreeTransactionRatio", "AvgOrderValue"],
}


def avg_order_value() -> Column:
    return ratio(F.col("Monetary"), F.col("Frequency"), 0.0)


def clean_nonfinite(df: DataFrame, columns: Sequence[str] = ("Monetary", "AvgOrderValue")) -> DataFrame:
    """Infinities and missing values become 0 in the given columns."""
    return df.withColumns({c: finite_or_zero(F.col(c)) for c in columns})


def customer_parts(tx: DataFrame, parts: int = SPREAD) -> DataFrame:
    """Facts of each customer in up to ``parts`` rows (by a hash of the invoice), stored in buckets by customer.

    A customer with a third of all lines is grouped by invoice and by part before
    anything meets by customer. Grouping the buckets by customer, and aligning such
    groups, needs no further shuffle.
    """
    paid = F.when(nan_to_null(F.col("UnitPrice").cast("double")) > 0, nan_to_null(F.col("TotalPrice").cast("double")))
    whole, rest = amount_parts(F.when(~is_infinite(paid), paid))
    known = with_line_total(tx).filter(F.col(CUSTOMER_KEY).isNotNull())
    by_invoice = known.groupBy(CUSTOMER_KEY, "InvoiceNo").agg(
        F.max("InvoiceDate").alias("last"),
        F.min("InvoiceDate").alias("first"),
        F.sum(whole).alias("whole"),
        F.sum(rest).alias("rest"),
        F.coalesce(F.bool_or(is_infinite(paid)), F.lit(False)).alias("endless"),
        F.count_if(F.col("UnitPrice") > 0).alias("paid"),
        F.sum(is_free()).alias("free"),
        F.count("*").alias("lines"),
    )
    by_part = by_invoice.groupBy(CUSTOMER_KEY, F.pmod(F.xxhash64("InvoiceNo"), F.lit(parts)).alias("part")).agg(
        F.max("last").alias("last"),
        F.min("first").alias("first"),
        F.sum("whole").alias("whole"),
        F.sum("rest").alias("rest"),
        F.bool_or("endless").alias("endless"),
        *[F.sum(c).alias(c) for c in ("paid", "free", "lines")],
        F.count("InvoiceNo").alias("invoices"),
    )
    dealt = int(tx.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return bucketed(by_part, CUSTOMER_KEY, dealt)


def separate_features(parts: DataFrame, end: Column) -> list[DataFrame]:
    """Four frames over ``customer_parts``, each with the customers it has something on: Recency and
    Tenure up to ``end``, Frequency, Monetary (customers with a paid line), FreeTransactionRatio."""
    own = parts.groupBy(CUSTOMER_KEY)
    dates = own.agg(F.max("last").alias("last"), F.min("first").alias("first"))
    money = parts.filter("paid > 0").groupBy(CUSTOMER_KEY)
    total = amount_total(F.sum("whole"), F.sum("rest"))
    return [
        dates.filter("last IS NOT NULL").select(CUSTOMER_KEY, whole_days(F.col("last"), end).alias("Recency"), whole_days(F.col("first"), end).alias("Tenure")),
        own.agg(F.sum("invoices").alias("Frequency")),
        money.agg(F.when(F.bool_or("endless"), F.lit(0.0)).otherwise(F.coalesce(total, F.lit(0.0))).alias("Monetary")),
        own.agg((F.sum("free") / F.sum("lines")).alias("FreeTransactionRatio")),
    ]


def align_by_customer(frames: Sequence[DataFrame]) -> DataFrame:
    """Outer alignment of frames of one row per customer: a row for each customer of any frame.

    Rows are put under each other and grouped once, so many frames cost one shuffle,
    and frames that are dealt alike by customer (see ``customer_parts``) cost none. A
    row without customer belongs to nobody and is left out.
    """
    under = reduce(lambda upper, lower: upper.unionByName(lower, allowMissingColumns=True), frames)
    columns = [c for c in under.columns if c != CUSTOMER_KEY]
    aligned = under.groupBy(CUSTOMER_KEY).agg(*[F.max(c).alias(c) for c in columns], F.count(CUSTOMER_KEY).alias("_known"))
    # not a filter on the key: below the union that would hide how the frames are dealt
    return aligned.filter("_known > 0").drop("_known")
