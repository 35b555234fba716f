"""Helpers that several of the text operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwise.session import new_shared_path

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else; null stays null."""
    return F.translate(text, UPPER, UPPER.lower())


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have (names differ by more than case)."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


class Scratch:
    """Tables of one run in the shared folder.

    Writing cuts lineage: a lost executor costs a read of the shared folder, not
    the steps before. ``drop`` takes a table away once nothing reads it any more.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.root = spark, new_shared_path(spark, name)
        self.count = 0
        self.paths: dict[int, str] = {}

    def path(self, name: str) -> str:
        self.count += 1
        return f"{self.root}/{self.count:03d}-{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            path = self.paths.pop(id(df), None)
            if path:
                target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
                target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def partitions(spark: SparkSession) -> int:
    """How many tasks a shuffle of this session has: the measure for explicit bucket counts."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
