"""CSV and Parquet, always with an explicit schema."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tillwise.functions.numbers import nan_to_null_columns
from tillwise.schemas import TRANSACTIONS


def read_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType = TRANSACTIONS,
    timestamp_format: str | None = None,
) -> DataFrame:
    """A CSV with a header. A path that is not there raises at once; a value
    that does not fit its type fails the read. NaN is read as missing."""
    reader = spark.read.schema(schema).option("header", True).option("mode", "FAILFAST")
    if timestamp_format:
        reader = reader.option("timestampFormat", timestamp_format)
    return nan_to_null_columns(reader.csv(path))


def write_csv(df: DataFrame, path: str) -> None:
    """A folder of CSV parts with headers; no single writer task."""
    df.write.mode("overwrite").option("header", True).csv(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return nan_to_null_columns(spark.read.parquet(path))


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Parquet, by partitions if asked for.

    With ``partition_by`` only the partitions that ``df`` has rows of are replaced; the
    others stay. Files are staged, and the old ones go when the job commits.
    """
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by)
    writer.parquet(path)
