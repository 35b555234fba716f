"""Churn arithmetic as column builders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise import constants as K
from tillwise.functions.numbers import nan_to_null, round_even
from tillwise.session import one_row

Bands = Sequence[tuple[float | None, float]]


def as_number(name: str) -> Column:
    return nan_to_null(F.col(name).cast("double"))


def band_score(value: Column, bands: Bands) -> Column:
    """Score of the first band whose upper bound is not exceeded.

    The open last band also takes what compares with nothing (null).
    """
    (first_bound, first_score), *rest = bands[:-1]
    chain = F.when(value <= first_bound, F.lit(first_score))
    for bound, score in rest:
        chain = chain.when(value <= bound, F.lit(score))
    return chain.otherwise(F.lit(bands[-1][1]))


def min_max(value: Column, low: float | None, high: float | None) -> Column:
    """Position within [low, high]; 0.5 for every row of a constant column."""
    if low is None:
        return F.lit(None).cast("double")
    if low == high:
        return F.lit(0.5)
    return (value - F.lit(low)) / F.lit(high - low)


def ranges(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float | None, float | None]]:
    """(min, max) of each column over the frame, fitted by one job."""
    found = one_row(
        df.agg(
            *[F.min(as_number(c)).alias(f"{c}_lo") for c in columns],
            *[F.max(as_number(c)).alias(f"{c}_hi") for c in columns],
        )
    )
    return {c: (found[f"{c}_lo"], found[f"{c}_hi"]) for c in columns}


def weighted(recency: Column, frequency: Column, monetary: Column) -> Column:
    w = K.CHURN_WEIGHTS
    return w["Recency"] * recency + w["Frequency"] * frequency + w["Monetary"] * monetary


def risk_class(score: Column) -> Column:
    """Risk label of a rounded score; a missing score counts as low."""
    return (
        F.when(score >= K.HIGH_RISK_FROM, F.lit(K.HIGH_RISK))
        .when(score >= K.MEDIUM_RISK_FROM, F.lit(K.MEDIUM_RISK))
        .otherwise(F.lit(K.LOW_RISK))
    )


def band_components() -> dict[str, Column]:
    """Band score of each driver, before weighting."""
    return {
        "Recency": band_score(as_number("Recency"), K.RECENCY_BANDS),
        "Frequency": band_score(as_number("Frequency"), K.FREQUENCY_BANDS),
        "Monetary": band_score(as_number("Monetary"), K.MONETARY_BANDS),
    }


def absolute_score() -> Column:
    parts = band_components()
    return round_even(weighted(parts["Recency"], parts["Frequency"], parts["Monetary"]), 4)
