"""Approximate answers for any range of days, from one stored row of sketches per day.

Distinct customers and orders are HyperLogLog sketches, line amounts a quantile (KLL)
sketch. Sketches of days merge into those of any range, so a new range reads the
days' rows and no line. The exact counterparts are in ``explore`` and ``quantiles``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise import constants as K
from tillwise.functions.numbers import nan_to_null
from tillwise.operators.rfm import with_line_total

LOG_BUCKETS = 14
QUANTILE_SIZE = 400
#: Bounds that an answer keeps but for a few in a million: relative for counts, in rank for quantiles.
COUNT_ERROR = 5 * 1.04 / math.sqrt(1 << LOG_BUCKETS)
RANK_ERROR = 0.02


def daily_sketches(tx: DataFrame) -> DataFrame:
    """One row per day: n_rows, and the sketches customers, orders, amounts."""
    dated = with_line_total(tx).filter(F.col("InvoiceDate").isNotNull())
    return dated.groupBy(F.to_date("InvoiceDate").alias("day")).agg(
        F.count("*").alias("n_rows"),
        F.hll_sketch_agg(K.CUSTOMER_KEY, LOG_BUCKETS).alias("customers"),
        F.hll_sketch_agg("InvoiceNo", LOG_BUCKETS).alias("orders"),
        F.kll_sketch_agg_double(nan_to_null(F.col("TotalPrice").cast("double")), QUANTILE_SIZE).alias("amounts"),
    )


def merged(days: DataFrame, by: Column | None = None) -> DataFrame:
    """The days' rows merged into one, or into one for each value of ``by``."""
    groups = [] if by is None else [by]
    return days.groupBy(*groups).agg(
        F.sum("n_rows").alias("n_rows"),
        F.hll_union_agg("customers").alias("customers"),
        F.hll_union_agg("orders").alias("orders"),
        F.kll_merge_agg_double("amounts", QUANTILE_SIZE).alias("amounts"),
    )


def answers(sketches: DataFrame, quantile: float = 0.5) -> DataFrame:
    """Estimates in the place of the sketches: customers, orders, and one quantile of the amounts."""
    return sketches.withColumns(
        {
            "customers": F.hll_sketch_estimate("customers"),
            "orders": F.hll_sketch_estimate("orders"),
            "amount": F.kll_sketch_get_quantile_double("amounts", F.lit(quantile)),
        }
    ).drop("amounts")
