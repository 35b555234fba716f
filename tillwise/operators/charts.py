"""Tables behind the charts; drawing them is left to the caller."""

from __future__ import annotations

from collections.abc import Mapping
from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillwise import constants as K
from tillwise.functions import scores as S
from tillwise.functions.numbers import amount_parts, amount_total, exact_sum, nan_to_null, pct, round_even
from tillwise.operators.ranking import global_rank
from tillwise.operators.selection import rows_for_share
from tillwise.schemas import existing_columns, require_columns
from tillwise.session import one_row, stored


def risk_counts(df: DataFrame) -> DataFrame:
    """Customers per risk class in fixed order, 0 for an absent class."""
    require_columns(df, ["ChurnRisk"], "risk counts")
    classes = df.sparkSession.createDataFrame(list(enumerate(K.RISK_LABELS)), "_place int, ChurnRisk string")
    counts = df.groupBy("ChurnRisk").agg(F.count("*").alias("Count"))
    return (
        classes.join(counts, "ChurnRisk", "left")
        .orderBy("_place")
        .select("ChurnRisk", F.coalesce("Count", F.lit(0)).alias("Count"))
    )


def risk_overview(df: DataFrame) -> DataFrame:
    """Count and share of all customers per risk class."""
    counts = risk_counts(df)
    # Three rows.
    total = F.sum("Count").over(Window.partitionBy())
    return counts.select("ChurnRisk", "Count", round_even(pct(F.col("Count"), total), 1).alias("Pct"))


def histograms(df: DataFrame, bins: Mapping[str, int], by: str | None = None) -> DataFrame:
    """Equal-width bins over [min, max] of each column; the maximum is in the
    last bin and a constant column has one. Empty bins have no row.

    All columns share one pass for the ranges and one for the counts, and the
    counts are combined before they are shuffled.
    """
    require_columns(df, list(bins) + ([by] if by else []), "histogram")
    spans = S.ranges(df, list(bins))
    marks, edges = [], F.lit(None)
    for column, n in bins.items():
        value = S.as_number(column)
        lo, hi = spans[column]
        if lo is None:
            continue
        place = F.floor((value - F.lit(lo)) / F.lit(hi - lo) * n) if hi > lo else F.lit(0)
        # least() passes over nulls, so a missing value is kept out first.
        place = F.when(value.isNotNull(), F.least(place.cast("bigint"), F.lit(n - 1).cast("bigint")))
        marks.append(F.struct(F.lit(column).alias("column_name"), place.alias("bin")))
        edge = F.struct(F.lit(lo).alias("lo"), F.lit((hi - lo) / n).alias("width"))
        edges = F.when(F.col("column_name") == column, edge).otherwise(edges)
    group = [by] if by else []
    if not marks:
        nothing = F.struct(F.lit("").alias("column_name"), F.lit(None).cast("bigint").alias("bin"))
        marks, edges = [nothing], F.struct(F.lit(0.0).alias("lo"), F.lit(0.0).alias("width"))
    return (
        df.select(*group, F.inline(F.array(*marks)))
        .filter(F.col("bin").isNotNull())
        .groupBy(*group, "column_name", "bin")
        .agg(F.count("*").alias("n_rows"))
        .withColumn("_e", edges)
        .select(
            *group,
            "column_name",
            "bin",
            (F.col("_e.lo") + F.col("bin") * F.col("_e.width")).alias("bin_start"),
            (F.col("_e.lo") + (F.col("bin") + 1) * F.col("_e.width")).alias("bin_end"),
            "n_rows",
        )
    )


def histogram(df: DataFrame, column: str, bins: int | None = None, by: str | None = None) -> DataFrame:
    """One column; the usual number of bins unless given."""
    return histograms(df, {column: bins or K.HISTOGRAM_BINS[column]}, by).drop("column_name")


def revenue_pareto(df: DataFrame) -> DataFrame:
    """Customers by falling Monetary with rank and cumulative revenue share."""
    require_columns(df, [K.CUSTOMER_KEY, "Monetary"], "Pareto table")
    whole, rest = amount_parts(F.col("Monetary"))
    total = one_row(df.agg(exact_sum(F.col("Monetary"))))[0]
    ranked = global_rank(
        df.select(K.CUSTOMER_KEY, nan_to_null(F.col("Monetary").cast("double")).alias("Monetary")),
        [F.desc_nulls_last("Monetary"), F.asc(K.CUSTOMER_KEY)],
        running={"_whole": whole, "_rest": rest},
    )
    cumulative = amount_total(F.col("_whole"), F.col("_rest"))
    return ranked.select(
        K.CUSTOMER_KEY,
        "Monetary",
        "Rank",
        (cumulative / F.nullif(F.lit(total).cast("double"), F.lit(0.0)) * 100.0).alias("CumulativePct"),
    )


def pareto_line(pareto: DataFrame, line_pct: float = K.PARETO_LINE_PCT) -> DataFrame:
    """How many of the largest customers it takes to reach a revenue share, from a ranked table."""
    return pareto.filter(F.col("CumulativePct") >= line_pct).agg(F.min("Rank").alias("CustomersNeeded"))


def customers_for_share(df: DataFrame, line_pct: float = K.PARETO_LINE_PCT) -> DataFrame:
    """The same from the customers themselves, without ranking them: null without any revenue."""
    require_columns(df, ["Monetary"], "Pareto line")
    with stored(df.select(nan_to_null(F.col("Monetary").cast("double")).alias("Monetary"))) as money:
        needed = rows_for_share(money, "Monetary", Fraction(str(line_pct)) / 100)
    return df.sparkSession.createDataFrame([(needed,)], "CustomersNeeded bigint")


def recency_buckets(df: DataFrame) -> DataFrame:
    """Customers per Recency bucket (lower, upper]; empty buckets stay, and a
    Recency of 0 is in none."""
    require_columns(df, ["Recency"], "recency buckets")
    recency = F.col("Recency")
    label = F.lit(None).cast("string")
    for low, high, name in reversed(K.RECENCY_BUCKETS):
        inside = recency > low if high is None else (recency > low) & (recency <= high)
        label = F.when(inside, F.lit(name)).otherwise(label)
    counts = df.groupBy(label.alias("Bucket")).agg(F.count("*").alias("Customers"))
    names = [(i, name) for i, (_, _, name) in enumerate(K.RECENCY_BUCKETS)]
    buckets = df.sparkSession.createDataFrame(names, "_place int, Bucket string")
    return (
        buckets.join(counts, "Bucket", "left")
        .orderBy("_place")
        .select("Bucket", F.coalesce("Customers", F.lit(0)).alias("Customers"))
    )


def segment_radar(segments: DataFrame) -> DataFrame:
    """Mean Recency, Frequency and Monetary over the largest of all segments."""
    axes = ["AvgRecency", "AvgFrequency", "AvgMonetary"]
    require_columns(segments, ["Segment", *axes], "segment radar")
    # As many rows as segments.
    everything = Window.partitionBy()
    return segments.select(
        "Segment",
        *[
            F.when(F.max(a).over(everything) > 0, F.col(a) / F.nullif(F.max(a).over(everything), F.lit(0.0)))
            .otherwise(F.col(a))
            .alias(a)
            for a in axes
        ],
    )


def segment_revenue_share(segments: DataFrame) -> DataFrame:
    """Revenue and its share per segment (the pie)."""
    return segments.select("Segment", "TotalRevenue", "RevenueSharePct")


def segment_risk_long(summary: DataFrame, segment_col: str = "Segment_Name") -> DataFrame:
    """Risk counts per segment, one row per segment and class."""
    counts = ["HighRiskCount", "MediumRiskCount", "LowRiskCount"]
    return summary.unpivot([segment_col], counts, "RiskLevel", "Customers")


def scatter_sample(df: DataFrame, rows: int = K.SAMPLE_ROWS, seed: int = K.SEED) -> DataFrame:
    """A repeatable random sample of at most ``rows`` customers: the first by a
    hash of seed and key, so no order of partitions can change it."""
    require_columns(df, [K.CUSTOMER_KEY], "sample")
    mixed = F.md5(F.concat(F.lit(f"{seed}:"), F.col(K.CUSTOMER_KEY).cast("string")))
    columns = ["Recency", "Monetary", "Frequency", "ChurnScore", "ChurnRisk", "Segment_Name"]
    return df.orderBy(mixed, K.CUSTOMER_KEY).limit(rows).select(K.CUSTOMER_KEY, *existing_columns(df, columns))


def customer_churn_table(df: DataFrame) -> DataFrame:
    """The columns of the customer table that exist, in display order."""
    wanted = [K.CUSTOMER_KEY, "Recency", "Frequency", "Monetary", "Segment_Name", "ChurnScore", "ChurnRisk"]
    return df.select(*existing_columns(df, wanted))
