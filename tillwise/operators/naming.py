"""Profile clusters, give them business names, predict for new customers."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillwise import constants as K
from tillwise.operators.clusters import SEGMENT, nearest_centre
from tillwise.operators.preprocess import scoring_features
from tillwise.schemas import require_columns
from tillwise.operators.profile import numeric_columns
from tillwise.session import reused

NAME = "Segment_Name"


def segment_profile(df: DataFrame) -> DataFrame:
    """Mean of each numeric column per cluster: k rows."""
    columns = [c for c in numeric_columns(df) if c not in (SEGMENT, K.CUSTOMER_KEY)]
    return df.filter(F.col(SEGMENT).isNotNull()).groupBy(SEGMENT).agg(*[F.avg(c).alias(c) for c in columns])


def segment_names(df: DataFrame) -> DataFrame:
    """(Segment, Segment_Name): clusters by falling mean Monetary, in label order."""
    means = df.filter(F.col(SEGMENT).isNotNull()).groupBy(SEGMENT).agg(F.avg("Monetary").alias("_mean"))
    # k rows, so one task can order them.
    place = F.row_number().over(Window.orderBy(F.desc_nulls_last("_mean"), SEGMENT))
    label = F.try_element_at(F.array(*[F.lit(x) for x in K.SEGMENT_LABELS]), place)
    return means.select(SEGMENT, F.coalesce(label, F.lit(K.SEGMENT_LABEL_BEYOND)).alias(NAME))


def with_segment_names(df: DataFrame, names: DataFrame | Mapping[int, str] | None = None) -> DataFrame:
    """Add Segment_Name: ranked over this batch, or as stored at fit time."""
    if isinstance(names, Mapping):
        chain = F.lit(None).cast("string")
        for segment, name in names.items():
            chain = F.when(F.col(SEGMENT) == segment, F.lit(name)).otherwise(chain)
        return df.withColumn(NAME, chain)
    names = segment_names(df) if names is None else names
    return df.join(F.broadcast(names), SEGMENT, "left").select(*df.columns, NAME)


def predict_segments(rfm: DataFrame, scaler, centres, features=tuple(K.RFM_FEATURES), caps=None) -> DataFrame:
    """The input columns, Segment and Segment_Name, named over the batch."""
    if not isinstance(rfm, DataFrame):
        raise ValueError("a Spark DataFrame is needed")
    require_columns(rfm, K.SCORING_INPUTS, "segment prediction")
    # The untouched row travels beside its scaled features: no join brings
    # them together again, and rows need no unique key.
    kept = [c for c in rfm.columns if c not in (SEGMENT, NAME)]
    packed = rfm.select(F.struct(*kept).alias("_row"), *K.SCORING_INPUTS)
    scaled = scoring_features(packed, scaler, features, caps, keep=["_row"])
    labelled = scaled.select("_row.*", nearest_centre(features, centres).alias(SEGMENT))
    return with_segment_names(reused(labelled))
