"""Global order over a large table, without one task that sees every row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillwise.session import cut_lineage

_PART = "_part"


def _wide(kind: T.DataType) -> T.DataType:
    """The type of a running sum; two decimals of it add up without losing a digit."""
    if isinstance(kind, T.DecimalType):
        return T.DecimalType(37, kind.scale)
    return T.LongType()


def global_rank(
    df: DataFrame,
    order: list[Column],
    rank: str = "Rank",
    running: dict[str, Column] | None = None,
) -> DataFrame:
    """Add the 1-based rank of each row, and running sums of BIGINT or DECIMAL columns.

    Rows are split into ranges of the whole sort key, so equal leading values
    spread over several ranges when the key ends in a unique column. Row counts
    and sums per range (one row for each range) give the offsets; ranges are
    then ranked on their own. The ranges are written to the shared folder once:
    a second evaluation could draw other bounds.
    """
    running = running or {}
    kinds = {n: _wide(df.select(c.alias(n)).schema[n].dataType) for n, c in running.items()}
    parts = df.select("*", *[c.alias(f"_{n}_step") for n, c in running.items()])
    parts = cut_lineage(parts.repartitionByRange(*order).withColumn(_PART, F.spark_partition_id()))

    sizes = parts.groupBy(_PART).agg(
        F.count("*").alias("_rows"), *[F.sum(f"_{n}_step").alias(f"_{n}_sum") for n in running]
    )
    # As many rows as ranges, so one task can order them.
    before = Window.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)

    def total_before(name: str) -> Column:
        return F.coalesce(F.sum(name).over(before), F.lit(0))

    offsets = sizes.select(
        _PART,
        total_before("_rows").alias("_rows_before"),
        *[total_before(f"_{n}_sum").alias(f"_{n}_before") for n in running],
    )
    within = Window.partitionBy(_PART).orderBy(*order)
    so_far = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return parts.join(F.broadcast(offsets), _PART).select(
        *df.columns,
        (F.row_number().over(within) + F.col("_rows_before")).cast("bigint").alias(rank),
        *[
            (F.coalesce(F.sum(f"_{n}_step").over(so_far), F.lit(0)).cast(kinds[n]) + F.col(f"_{n}_before").cast(kinds[n])).alias(n)
            for n in running
        ],
    )
