"""Segment and churn risk of new customers, one plan for batch and stream.

Each row is scored by itself: fixed bands, stored centres, stored caps and
names. So the stream holds no state and needs no watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tillwise import constants as K
from tillwise.functions import scores as S
from tillwise.functions.numbers import nan_to_null_columns, round_even
from tillwise.operators.clusters import SEGMENT, nearest_centre
from tillwise.operators.model import SegmentModel
from tillwise.operators.naming import with_segment_names
from tillwise.operators.preprocess import scoring_features
from tillwise.schemas import CUSTOMERS_RFM, require_columns


def score_customers(df: DataFrame, model: SegmentModel) -> DataFrame:
    """The input row with segment, name, banded churn score, risk class and the
    weighted component of each driver."""
    require_columns(df, K.SCORING_INPUTS, "live scoring")
    added = [SEGMENT, "Segment_Name", "ChurnScore", "ChurnRisk"]
    kept = [c for c in df.columns if c not in added]
    packed = df.select(F.struct(*kept).alias("_row"), *K.SCORING_INPUTS)
    scaled = scoring_features(packed, model.scaler, model.features, model.caps, keep=["_row"])
    labelled = scaled.select("_row.*", nearest_centre(model.features, model.centres).alias(SEGMENT))
    parts = S.band_components()
    return with_segment_names(labelled, model.names).select(
        *kept,
        SEGMENT,
        "Segment_Name",
        S.absolute_score().alias("ChurnScore"),
        S.risk_class(S.absolute_score()).alias("ChurnRisk"),
        *[
            round_even(weight * parts[d], 4).alias(f"{d}_component")
            for d, weight in K.CHURN_WEIGHTS.items()
        ],
    )


def read_customer_stream(
    spark: SparkSession, path: str, schema: T.StructType = CUSTOMERS_RFM, file_format: str = "parquet"
) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if file_format == "csv":
        reader = reader.option("header", True)
    return nan_to_null_columns(reader.format(file_format).load(path))


def start_scoring(
    customers: DataFrame,
    model: SegmentModel,
    out_path: str,
    checkpoint_path: str,
    available_now: bool = True,
) -> StreamingQuery:
    """Append scored customers to Parquet; the checkpoint makes a restart go on
    where it stopped, without a second copy of a row."""
    writer = (
        score_customers(customers, model)
        .writeStream.format("parquet")
        .outputMode("append")
        .option("path", out_path)
        .option("checkpointLocation", checkpoint_path)
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
