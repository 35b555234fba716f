"""Health check of any table: preview, column info, missing share, describe."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwise.operators.quantiles import exact_quantiles

NUMERIC_TYPES = ("tinyint", "smallint", "int", "bigint", "float", "double")
QUARTILES = {"p25": 0.25, "p50": 0.5, "p75": 0.75}


def preview(df: DataFrame, order_by: list[str], rows: int = 5) -> DataFrame:
    """First rows by key; a bare limit would not be repeatable."""
    return df.orderBy(*order_by).limit(rows)


def named_preview(df: DataFrame, order_by: list[str], names: dict[str, DataFrame], rows: int = 5) -> DataFrame:
    """The first rows by key, then the names (key -> frame with that key) of those rows only."""
    first = preview(df, order_by, rows)
    for key, frame in names.items():
        first = frame.join(F.broadcast(first), key)  # `rows` rows
    return first.orderBy(*order_by)


def _long_form(one_row: DataFrame, columns: list[str], value: str) -> DataFrame:
    return one_row.unpivot([], columns, "column_name", value)


def column_info(df: DataFrame) -> DataFrame:
    """Type and non-null count per column, in one pass."""
    counts = _long_form(df.agg(*[F.count(c).alias(c) for c in df.columns]), df.columns, "non_null")
    types = F.create_map(*[F.lit(x) for name, kind in df.dtypes for x in (name, kind)])
    return counts.select("column_name", types[F.col("column_name")].alias("type"), "non_null")


def missing_counts(df: DataFrame) -> DataFrame:
    """Nulls per column, zeros kept."""
    nulls = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return _long_form(nulls, df.columns, "missing")


def missing_pct(df: DataFrame) -> DataFrame:
    """Share of nulls in per cent, only columns that have any, largest first."""
    shares = df.agg(*[F.avg(F.col(c).isNull().cast("int") * 100.0).alias(c) for c in df.columns])
    return (
        _long_form(shares, df.columns, "missing_pct")
        .filter(F.col("missing_pct") > 0)
        .orderBy(F.desc("missing_pct"), "column_name")
    )


def numeric_columns(df: DataFrame) -> list[str]:
    return [n for n, t in df.dtypes if t in NUMERIC_TYPES or t.startswith("decimal")]


def health_check(df: DataFrame, order_by: list[str], rows: int = 5) -> dict[str, DataFrame]:
    """Everything one looks at after loading a table."""
    return {
        "preview": preview(df, order_by, rows),
        "columns": column_info(df),
        "missing_pct": missing_pct(df),
        "describe": describe(df),
    }


def describe(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """count, mean, std, min, quartiles and max: one row per numeric column."""
    columns = columns or numeric_columns(df)
    measures = {"count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    targets = {f"{c}.{name}": (c, p) for c in columns for name, p in QUARTILES.items()}
    also = {f"{c}.{name}": f(F.col(c).cast("double")) for c in columns for name, f in measures.items()}
    found = exact_quantiles(df, targets, also)
    shown = ["count", "mean", "std", "min", *QUARTILES, "max"]
    schema = ", ".join(["column_name string"] + [f"`{m}` {'bigint' if m == 'count' else 'double'}" for m in shown])
    return df.sparkSession.createDataFrame([(c, *[found[f"{c}.{m}"] for m in shown]) for c in columns], schema)
