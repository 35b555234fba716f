"""Name -> query, and name -> the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwise.session import apply_settings

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; without ``sql`` only its rows can be checked."""

    def add(build: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            apply_settings(spark)
            return plain_types(build(spark, sf_dir))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return build

    return add


def plain_types(df: DataFrame) -> DataFrame:
    """BIGINT, DOUBLE and VARCHAR only, so that two engines can be compared."""

    def plain(name: str, kind: str):
        c = F.col(f"`{name}`")
        if kind in ("tinyint", "smallint", "int", "boolean"):
            return c.cast("int").cast("bigint").alias(name)
        if kind.startswith("timestamp"):
            return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(name)
        if kind == "date":
            return c.cast("string").alias(name)
        if kind == "float" or kind.startswith("decimal"):
            return c.cast("double").alias(name)
        return c

    return df.select(*[plain(n, t) for n, t in df.dtypes])
