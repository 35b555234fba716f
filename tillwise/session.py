"""Session settings, shared folders and reuse of frames."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}
# Only a new session takes these: no call-site capture for each column expression.
# And what cut_lineage writes is deleted once the driver has let go of the frame.
STATIC_SETTINGS = {
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(app_name: str = "tillwise", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators rely on.

    ``conf`` uses underscores-free Spark keys, for example
    ``**{"spark.sql.shuffle.partitions": "8"}``.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **STATIC_SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def apply_settings(spark: SparkSession) -> None:
    """Put the runtime settings on a session made by somebody else."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as the cluster names it.

    Only a local session without that setting gets a folder of its own.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(configured)
        return configured
    if not sc.getCheckpointDir():
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tillwise-"))
    return sc.getCheckpointDir()


def new_shared_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def reused(df: DataFrame) -> DataFrame:
    """Compute a frame once that several branches of one plan read.

    It is written to the shared folder and read from there (a job). Nothing is
    cached: a cached frame would answer for every later plan over the same path,
    also after new files have come, and would stay until somebody released it.
    """
    return cut_lineage(df)


def one_row(df: DataFrame) -> Row:
    """Fit: run an aggregate of one row and get its few numbers.

    They go into the next plan as literals. That keeps plans flat (a scalar
    subquery would be copied into each expression that uses it, and again at
    each level above) and makes every later pass see the same numbers.
    """
    return df.first()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write a frame to the shared folder and go on from there (a job)."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def stored(df: DataFrame) -> Iterator[DataFrame]:
    """A frame as Parquet in the shared folder while a fit reads it again and again; then deleted."""
    path = new_shared_path(df.sparkSession, "stored")
    df.write.parquet(path)
    try:
        yield df.sparkSession.read.schema(df.schema).parquet(path)
    finally:
        delete_path(df.sparkSession, path)


def bucketed(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """A frame as Parquet in the shared folder, in buckets by ``key``: groupings by it read it without a shuffle.

    Spark takes the layout from its catalog, so the files are a table for as long as
    the frame is made; the catalog is left as it was, and the files stay.
    """
    spark, path = df.sparkSession, new_shared_path(df.sparkSession, "bucketed")
    name = f"bucketed_{uuid.uuid4().hex}"
    df.repartition(buckets, key).write.bucketBy(buckets, key).option("path", path).saveAsTable(name)
    try:
        # fresh names: a union compares columns together with the table they came from
        return spark.table(name).select(*[F.col(f"`{c}`").alias(c) for c in df.columns])
    finally:
        spark.sql(f"DROP TABLE {name}")


def delete_path(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def replace_file(spark: SparkSession, path: str, text: str) -> None:
    """Put a small file in the place of another in one step: written beside it, then renamed over it."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target, beside = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    out = beside.getFileSystem(conf).create(beside)
    out.write(bytearray(text.encode()))
    out.close()
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    ways = spark.sparkContext._gateway.new_array(rename, 1)
    ways[0] = rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.getFileSystem(conf).getUri(), conf).rename(beside, target, ways)


def read_file(spark: SparkSession, path: str) -> str:
    return "\n".join(r["value"] for r in spark.read.text(path).collect())
