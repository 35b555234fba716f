"""Split, cap, log and scale customer features."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwise import constants as K
from tillwise.functions.numbers import nan_to_null_columns
from tillwise.operators.quantiles import exact_quantiles
from tillwise.operators.selection import key_literal, keys_at
from tillwise.schemas import existing_columns, require_columns
from tillwise.session import one_row, stored

Caps = Mapping[str, float]
Scaler = Mapping[str, tuple[float, float]]

_ROW_KEY = "_place_in_time"


def upper_caps(df: DataFrame, columns: Sequence[str], percentile: float = K.CAP_PERCENTILE) -> Caps:
    return exact_quantiles(df, {c: (c, percentile) for c in columns})


def winsorize(
    df: DataFrame,
    columns: Sequence[str],
    caps: Caps | None = None,
    percentile: float = K.CAP_PERCENTILE,
) -> DataFrame:
    """Lower what exceeds the cap; nulls stay. Caps are fitted on ``df`` itself
    unless stored ones are given. Absent columns are passed over."""
    columns = existing_columns(df, columns)
    if caps is None:
        caps = upper_caps(df, columns, percentile) if columns else {}
    capped = {c: F.lit(caps[c]) for c in columns if caps[c] is not None}
    return df.withColumns(
        {c: F.when(F.col(c) > cap, cap).otherwise(F.col(c).cast("double")) for c, cap in capped.items()}
    )


def log_skewed(df: DataFrame, columns: Sequence[str] = tuple(K.LOGGED_FEATURES)) -> DataFrame:
    return df.withColumns({c: F.log1p(F.col(c)) for c in existing_columns(df, columns)})


def time_split(rfm: DataFrame, test_ratio: float = K.TEST_RATIO) -> tuple[DataFrame, DataFrame]:
    """(train, test): the most recent ``int(n * ratio)`` customers are the test.

    Ordered by Recency, then CustomerID, each with nulls (and NaN) last, then by a hash
    of the whole row. The cut is one order statistic of that key, found by jobs; the
    parts are filters. Rows that are equal in all columns are dealt by number.
    """
    require_columns(rfm, [K.CUSTOMER_KEY, "Recency"], "time split")
    plain = nan_to_null_columns(rfm)
    key = F.struct(
        *[part.alias(f"{c}_{n}") for c in ("Recency", K.CUSTOMER_KEY) for n, part in enumerate((plain[c].isNull().cast("int"), plain[c]))],
        F.xxhash64(*plain.columns).alias("row"),
    )
    with stored(plain.select(key.alias("key"))) as keys:
        rows = keys.count()
        wanted = int(rows * test_ratio)
        if wanted <= 0 or wanted >= rows:
            return (plain, plain.limit(0)) if wanted <= 0 else (plain.limit(0), plain)
        cut = keys_at(keys, {"key": [wanted - 1]}, {"key": rows})["key", wanted - 1]
        mark = key_literal(cut, keys.schema["key"].dataType)
        same = one_row(keys.agg(F.count_if(F.col("key") < mark).alias("less"), F.count_if(F.col("key") == mark).alias("equal")))
    whole = F.col(_ROW_KEY)
    marked = plain.withColumn(_ROW_KEY, key)
    in_test = wanted - same["less"]
    if in_test == same["equal"]:
        return marked.filter(whole > mark).drop(_ROW_KEY), marked.filter(whole <= mark).drop(_ROW_KEY)
    parts = []
    for side, copies in ((whole > mark, same["equal"] - in_test), (whole < mark, in_test)):
        # as many copies of the one row that stands at the cut
        again = marked.filter(whole == mark).limit(1).crossJoin(rfm.sparkSession.range(copies).select()).drop(_ROW_KEY)
        parts.append(marked.filter(side).drop(_ROW_KEY).unionByName(again))
    return tuple(parts)


def fit_scaler(df: DataFrame, columns: Sequence[str]) -> Scaler:
    """(mean, population std) per column. A constant column has std 1, so that
    scaling only shifts it."""
    fitted = one_row(
        df.agg(*[F.avg(c).alias(f"{c}_mean") for c in columns], *[F.stddev_pop(c).alias(f"{c}_std") for c in columns])
    )
    return {c: (fitted[f"{c}_mean"], fitted[f"{c}_std"] or 1.0) for c in columns}


def scale(df: DataFrame, scaler: Scaler, columns: Sequence[str]) -> DataFrame:
    """(x - mean) / std."""
    return df.withColumns({c: (F.col(c) - F.lit(scaler[c][0])) / F.lit(scaler[c][1]) for c in columns})


class TrainingData(NamedTuple):
    train: DataFrame
    test: DataFrame
    scaler: Scaler
    raw_train: DataFrame


def training_features(df: DataFrame) -> DataFrame:
    """Cap three columns by this part's own percentile, then log."""
    return log_skewed(winsorize(df, K.CAPPED_FOR_TRAINING))


def prepare_training(rfm: DataFrame, test_ratio: float = K.TEST_RATIO) -> TrainingData:
    """Split, cap, log, and scale by the train part."""
    features = existing_columns(rfm, K.RFM_FEATURES)
    raw_train, raw_test = time_split(rfm, test_ratio)
    train, test = training_features(raw_train), training_features(raw_test)
    scaler = fit_scaler(train, features)
    return TrainingData(scale(train, scaler, features), scale(test, scaler, features), scaler, raw_train)


def scoring_features(
    rfm: DataFrame,
    scaler: Scaler,
    features: Sequence[str] = tuple(K.RFM_FEATURES),
    caps: Caps | None = None,
    keep: Sequence[str] = (K.CUSTOMER_KEY,),
) -> DataFrame:
    """Features of new customers in the fitted space, beside the ``keep`` columns.

    Five columns are capped (by the batch itself, or by stored caps, which is
    the only way on a stream). A fitted feature that is no scoring input is raw
    0 before scaling.
    """
    require_columns(rfm, K.SCORING_INPUTS, "scoring")
    keys = existing_columns(rfm, keep)
    ready = log_skewed(winsorize(rfm.select(*keys, *K.SCORING_INPUTS), K.CAPPED_FOR_SCORING, caps))
    raw = [F.col(f) if f in K.SCORING_INPUTS else F.lit(0.0).alias(f) for f in features]
    return scale(ready.select(*keys, *raw), scaler, features)
