"""Registered: RFM features, preprocessing, clustering, naming."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillwise.constants import CAP_PERCENTILE, RFM_FEATURES
from tillwise.functions.numbers import round_even
from tillwise.operators import cleaning, clusters, naming, preprocess, rfm
from tillwise.operators.model import SegmentModel, fit_segment_model
from tillwise.plans.inputs import keyed, scaled_customers, segmented_customers
from tillwise.plans.oracle_parts import FEATURES, FIXED_CENTRES, money, nearest, rounded, scaled, sql
from tillwise.plans.registry import register
from tillwise.session import new_shared_path, reused
from tillwise.sources.retail import customers, lines, retail_dirty
from tillwise.streaming.live import read_customer_stream, score_customers, start_scoring

SIX = ", ".join(f"{rounded(f, 6)} AS {f}" for f in FEATURES)
EXACT = ", ".join(FEATURES)


def _six(df):
    return df.withColumns({f: round_even(F.col(f), 6) for f in RFM_FEATURES if f in df.columns})


# --- features --------------------------------------------------------------


@register(
    "line_total",
    sql(
        f"""SELECT InvoiceNo, StockCode, CAST(Quantity AS BIGINT) AS Quantity,
{rounded("Quantity * UnitPrice", 2)} AS TotalPrice FROM retail""",
        "retail",
    ),
)
def line_total(spark, sf_dir):
    tx = rfm.with_line_total(lines(spark, sf_dir).drop("TotalPrice"))
    return tx.select("InvoiceNo", "StockCode", "Quantity", round_even(F.col("TotalPrice"), 2).alias("TotalPrice"))


@register("snapshot_date", sql("SELECT strftime(snapshot, '%Y-%m-%d %H:%M:%S') AS SnapshotDate FROM snap", "snap"))
def snapshot_date(spark, sf_dir):
    return rfm.snapshot_date(lines(spark, sf_dir))


def _register_feature(name: str, feature: str) -> None:
    @register(name, sql(f"SELECT CustomerID, {feature} FROM rfm", "rfm"))
    def one_feature(spark, sf_dir):
        return rfm.rfm_features(lines(spark, sf_dir), [feature])


for _name, _feature in {
    "rfm_recency": "Recency",
    "rfm_tenure": "Tenure",
    "rfm_frequency": "Frequency",
    "rfm_monetary": "Monetary",
    "rfm_free_ratio": "FreeTransactionRatio",
    "rfm_aov": "AvgOrderValue",
}.items():
    _register_feature(_name, _feature)


@register("rfm_features", sql(f"SELECT CustomerID, {EXACT} FROM rfm", "rfm"))
def rfm_features(spark, sf_dir):
    return customers(spark, sf_dir)


@register(
    "rfm_outer_align",
    sql(
        f"""SELECT CustomerID, Recency, Tenure, Frequency, Monetary, FreeTransactionRatio FROM
(SELECT CustomerID, date_sub('day', max(CAST(InvoiceDate AS TIMESTAMP)), any_value(snapshot)) AS Recency,
  date_sub('day', min(CAST(InvoiceDate AS TIMESTAMP)), any_value(snapshot)) AS Tenure FROM dirty, snap WHERE CustomerID IS NOT NULL GROUP BY 1) a
FULL JOIN (SELECT CustomerID, count(DISTINCT InvoiceNo) AS Frequency FROM dirty WHERE CustomerID IS NOT NULL GROUP BY 1) b USING (CustomerID)
FULL JOIN (SELECT CustomerID, {money("TotalPrice")} AS Monetary FROM dirty WHERE UnitPrice > 0 AND CustomerID IS NOT NULL GROUP BY 1) c USING (CustomerID)
FULL JOIN (SELECT CustomerID, avg(CASE WHEN UnitPrice = 0 THEN 1e0 ELSE 0e0 END) AS FreeTransactionRatio
  FROM dirty WHERE CustomerID IS NOT NULL GROUP BY 1) d USING (CustomerID)""",
        "dirty",
        "snap",
    ),
)
def rfm_outer_align(spark, sf_dir):
    """The reference's four aggregates over all dirty lines, each on its own, then aligned."""
    tx = cleaning.parse_invoice_dates(retail_dirty(spark, sf_dir))
    end = rfm.snapshot_date(lines(spark, sf_dir)).first()[0]
    parts = rfm.customer_parts(tx)
    return rfm.align_by_customer(rfm.separate_features(parts, F.lit(str(end)).cast(dict(tx.dtypes)["InvoiceDate"])))


@register(
    "clean_nonfinite",
    sql(
        """SELECT CustomerID, CASE WHEN CustomerID % 5 IN (0, 1, 2) THEN 0 ELSE Monetary END AS Monetary,
CASE WHEN CustomerID % 5 = 3 THEN 0 ELSE AvgOrderValue END AS AvgOrderValue FROM rfm""",
        "rfm",
    ),
)
def clean_nonfinite(spark, sf_dir):
    """Values spoilt by rule, in all four ways, then cleaned."""
    kind = F.col("CustomerID") % 5
    spoilt = (
        customers(spark, sf_dir)
        .withColumn(
            "Monetary",
            F.when(kind == 0, F.lit(float("inf")))
            .when(kind == 1, F.lit(float("-inf")))
            .when(kind == 2, F.lit(float("nan")))
            .otherwise(F.col("Monetary")),
        )
        .withColumn("AvgOrderValue", F.when(kind != 3, F.col("AvgOrderValue")))
    )
    return keyed(rfm.clean_nonfinite(spoilt), "Monetary", "AvgOrderValue")


# --- preprocessing ---------------------------------------------------------

CAPPED = ["Monetary", "Frequency", "Recency"]


@register(
    "winsorize",
    sql(
        "SELECT CustomerID, "
        + ", ".join(rounded(f"CASE WHEN {c} > cap_{c} THEN cap_{c} ELSE CAST({c} AS DOUBLE) END", 4) + f" AS {c}" for c in CAPPED)
        + " FROM rfm, (SELECT "
        + ", ".join(f"quantile_cont({c}, {CAP_PERCENTILE}) AS cap_{c}" for c in CAPPED)
        + " FROM rfm)",
        "rfm",
    ),
)
def winsorize(spark, sf_dir):
    done = preprocess.winsorize(keyed(customers(spark, sf_dir), *CAPPED), CAPPED)
    return done.withColumns({c: round_even(F.col(c), 4) for c in CAPPED})


@register("log_transform", sql(f"SELECT CustomerID, {SIX} FROM logs", "logs"))
def log_transform(spark, sf_dir):
    return _six(preprocess.log_skewed(customers(spark, sf_dir)))


@register("time_split", sql("SELECT CustomerID, part FROM split", "split"))
def time_split(spark, sf_dir):
    train, test = preprocess.time_split(keyed(customers(spark, sf_dir), "Recency"))
    return keyed(train, F.lit("train").alias("part")).unionByName(keyed(test, F.lit("test").alias("part")))


@register("standard_scale", sql(f"SELECT CustomerID, {SIX} FROM z", "z"))
def standard_scale(spark, sf_dir):
    return _six(scaled_customers(spark, sf_dir))


@register(
    "preprocess_all",
    sql(
        f"""SELECT CustomerID, part, {SIX} FROM ({scaled("train_logs", "train_logs", "'train' AS part, ")}
UNION ALL {scaled("test_logs", "train_logs", "'test' AS part, ")})""",
        "train_logs",
        "test_logs",
    ),
)
def preprocess_all(spark, sf_dir):
    data = preprocess.prepare_training(customers(spark, sf_dir))
    parts = [_six(df).withColumn("part", F.lit(p)) for df, p in ((data.train, "train"), (data.test, "test"))]
    return parts[0].unionByName(parts[1])


@register(
    "inference_features",
    sql(f"SELECT CustomerID, {SIX} FROM ({scaled('scoring_logs', 'train_logs')})", "scoring_logs", "train_logs"),
)
def inference_features(spark, sf_dir):
    rfm_all = customers(spark, sf_dir)
    data = preprocess.prepare_training(rfm_all)
    return _six(preprocess.scoring_features(rfm_all, data.scaler))


# --- clustering ------------------------------------------------------------


@register("nearest_centre", sql("SELECT CustomerID, CAST(Segment AS BIGINT) AS Segment FROM assigned", "assigned"))
def nearest_centre(spark, sf_dir):
    z = scaled_customers(spark, sf_dir)
    return keyed(z, clusters.nearest_centre(RFM_FEATURES, FIXED_CENTRES).alias("Segment"))


_SQUARE = " + ".join(f"p.{f} * p.{f}" for f in FEATURES)
_DOT = " + ".join(f"p.{f} * s_{f}" for f in FEATURES)
_SILHOUETTE = sql(
    f"""SELECT {rounded("avg(CASE WHEN own_n = 1 THEN 0e0 WHEN own < other THEN 1e0 - own / other WHEN own > other THEN other / own - 1e0 ELSE 0e0 END)", 6)}
AS silhouette, count(*) AS customers FROM (
SELECT p.CustomerID, any_value(CASE WHEN p.Segment = c.Segment THEN c.n END) AS own_n,
any_value(CASE WHEN p.Segment = c.Segment THEN ({_SQUARE} + sq / n - 2e0 * ({_DOT}) / n) * n / nullif(n - 1, 0) END) AS own,
min(CASE WHEN p.Segment <> c.Segment THEN {_SQUARE} + sq / n - 2e0 * ({_DOT}) / n END) AS other
FROM assigned p, (SELECT Segment, count(*) AS n, sum({_SQUARE}) AS sq, {", ".join(f"sum(p.{f}) AS s_{f}" for f in FEATURES)}
FROM assigned p GROUP BY Segment) c GROUP BY p.CustomerID)""",
    "assigned",
)


@register("silhouette", _SILHOUETTE)
def silhouette(spark, sf_dir):
    z = scaled_customers(spark, sf_dir)
    labelled = reused(
        clusters.assemble(z, RFM_FEATURES).withColumn(
            "Segment", clusters.nearest_centre(RFM_FEATURES, FIXED_CENTRES)
        )
    )
    score = clusters.silhouette(labelled)
    return labelled.agg(
        round_even(F.lit(score).cast("double"), 6).alias("silhouette"), F.count("*").alias("customers")
    )


@register("kmeans_segments")
def kmeans_segments(spark, sf_dir):
    data = preprocess.prepare_training(customers(spark, sf_dir))
    search = clusters.ClusterSearch(data.train, data.test, RFM_FEATURES).fit()
    train, test = search.assign()
    return keyed(train, "Segment", F.lit("train").alias("part")).unionByName(
        keyed(test, "Segment", F.lit("test").alias("part"))
    )


@register("k_selection")
def k_selection(spark, sf_dir):
    data = preprocess.prepare_training(customers(spark, sf_dir))
    search = clusters.ClusterSearch(data.train, data.test, RFM_FEATURES).fit()
    return search.metrics_frame().withColumn("chosen", (F.col("k") == search.best_k).cast("bigint"))


# --- naming ----------------------------------------------------------------

PROFILE = ", ".join(f"{rounded(f'avg({f})', 4)} AS {f}" for f in FEATURES)


@register("segment_profile", sql(f"SELECT CAST(Segment AS BIGINT) AS Segment, {PROFILE} FROM segmented GROUP BY Segment", "segmented"))
def segment_profile(spark, sf_dir):
    means = naming.segment_profile(segmented_customers(spark, sf_dir))
    return means.withColumns({f: round_even(F.col(f), 4) for f in RFM_FEATURES})


@register("segment_names", sql("SELECT CAST(Segment AS BIGINT) AS Segment, Segment_Name FROM names", "names"))
def segment_names(spark, sf_dir):
    return naming.segment_names(segmented_customers(spark, sf_dir))


@register(
    "segment_customers",
    sql(
        f"""SELECT CustomerID, {EXACT}, CAST(segmented.Segment AS BIGINT) AS Segment, Segment_Name
FROM segmented JOIN names ON segmented.Segment = names.Segment""",
        "names",
    ),
)
def segment_customers(spark, sf_dir):
    return naming.with_segment_names(reused(segmented_customers(spark, sf_dir)))


CHECKED_FIT = sql(
    "SELECT count(*) AS customers, CAST(floor(count(*) * 0.2e0) AS BIGINT) AS test_customers, CAST(0 AS BIGINT) AS off_nearest FROM rfm", "rfm"
)


@register("kmeans_checked", CHECKED_FIT)
def kmeans_checked(spark, sf_dir):
    """Properties of the segments: all customers have one, the parts have their sizes, none is off its nearest centre."""
    data = preprocess.prepare_training(customers(spark, sf_dir))
    search = clusters.ClusterSearch(data.train, data.test, RFM_FEATURES).fit()
    train, test = search.assign()
    both = train.withColumn("in_test", F.lit(0)).unionByName(test.withColumn("in_test", F.lit(1)))
    off = clusters.off_nearest(both, RFM_FEATURES, clusters.centres_of(search.best_model))
    return both.agg(F.count("Segment").alias("customers"), F.sum("in_test").cast("bigint").alias("test_customers"), F.count_if(off).alias("off_nearest"))


@register(
    "k_selection_checked",
    "SELECT k, CAST(1 AS BIGINT) AS found, CAST(0 AS BIGINT) AS better_than_chosen FROM (VALUES (3), (4), (5), (6), (7), (8)) AS t(k)",
)
def k_selection_checked(spark, sf_dir):
    """Each k was fitted with k centres at a finite cost, and none has a better train silhouette than the chosen one."""
    data = preprocess.prepare_training(customers(spark, sf_dir))
    search = clusters.ClusterSearch(data.train, data.test, RFM_FEATURES).fit()
    chosen = max(m[1] for m in search.metrics if m[0] == search.best_k)
    better = F.coalesce((F.col("train_silhouette") > F.lit(chosen)).cast("bigint"), F.lit(0).cast("bigint"))
    found = (F.col("inertia") < F.lit(float("inf"))).cast("bigint")
    return search.metrics_frame().select("k", found.alias("found"), better.alias("better_than_chosen"))


@register(
    "predict_checked",
    sql("SELECT count(*) AS customers, CAST(0 AS BIGINT) AS off_nearest, CAST(0 AS BIGINT) AS unnamed, CAST(0 AS BIGINT) AS out_of_order FROM rfm", "rfm"),
)
def predict_checked(spark, sf_dir):
    """Properties of a prediction: nearest centre in the space of the batch, and names in order of mean Monetary."""
    rfm_all = customers(spark, sf_dir)
    model, _ = fit_segment_model(rfm_all)
    predicted = reused(model.predict(rfm_all))
    scaled = preprocess.scoring_features(rfm_all, model.scaler, model.features).join(keyed(predicted, "Segment", "Segment_Name"), "CustomerID")
    off = clusters.off_nearest(scaled, model.features, model.centres)
    means = {r["Segment_Name"]: r["m"] for r in predicted.groupBy("Segment_Name").agg(F.avg("Monetary").alias("m")).collect()}  # a row a name
    ranked = [means[n] for n in ("High Value", "Frequent Buyer") if n in means]
    wrong = sum(a < b for a, b in zip(ranked, ranked[1:])) + sum(means[n] > ranked[-1] for n in means if n not in ("High Value", "Frequent Buyer"))
    return scaled.agg(
        F.count("*").alias("customers"), F.count_if(off).alias("off_nearest"), F.count_if(F.col("Segment_Name").isNull()).alias("unnamed"), F.lit(wrong).cast("bigint").alias("out_of_order")
    )


@register("model_checked", sql("SELECT count(*) AS customers, CAST(0 AS BIGINT) AS differ FROM rfm", "rfm"))
def model_checked(spark, sf_dir):
    """The model that was saved over an older one and loaded predicts what the fitted one does."""
    rfm_all = customers(spark, sf_dir)
    model, _ = fit_segment_model(rfm_all)
    path = new_shared_path(spark, "segment-model")
    LIVE_MODEL.save(spark, path)
    model.save(spark, path)
    one = keyed(model.predict(rfm_all, caps="fitted"), "Segment", "Segment_Name")
    two = keyed(SegmentModel.load(spark, path).predict(rfm_all, caps="fitted"), F.col("Segment").alias("s"), F.col("Segment_Name").alias("n"))
    same = F.col("Segment").eqNullSafe(F.col("s")) & F.col("Segment_Name").eqNullSafe(F.col("n"))
    return one.join(two, "CustomerID", "full_outer").agg(F.count("*").alias("customers"), F.count_if(~same).alias("differ"))


@register("predict_segments")
def predict_segments(spark, sf_dir):
    rfm_all = customers(spark, sf_dir)
    model, _ = fit_segment_model(rfm_all)
    return model.predict(rfm_all)


@register("model_roundtrip")
def model_roundtrip(spark, sf_dir):
    rfm_all = customers(spark, sf_dir)
    model, _ = fit_segment_model(rfm_all)
    path = new_shared_path(spark, "segment-model")
    model.save(spark, path)
    return SegmentModel.load(spark, path).predict(rfm_all, caps="fitted")


# --- live scoring ----------------------------------------------------------

# Caps, scaler and names for scoring that SQL can repeat.
LIVE_CAPS = {"Monetary": 2.5e6, "Frequency": 16.0, "Recency": 900.0, "Tenure": 2390.0, "AvgOrderValue": 220000.0}
LIVE_SCALER = {
    "Recency": (250.0, 220.0),
    "Tenure": (7.65, 0.15),
    "Frequency": (2.3, 0.35),
    "Monetary": (14.0, 0.45),
    "FreeTransactionRatio": (0.05, 0.04),
    "AvgOrderValue": (11.7, 0.2),
}
LIVE_NAMES = {0: "High Value", 1: "Frequent Buyer", 2: "Regular", 3: "At Risk"}
LIVE_MODEL = SegmentModel(list(RFM_FEATURES), LIVE_SCALER, LIVE_CAPS, FIXED_CENTRES, LIVE_NAMES)


def _live_sql() -> str:
    from tillwise.plans.oracle_parts import ABSOLUTE, BAND_F, BAND_M, BAND_R, logged, risk

    def value(f: str) -> str:
        if f == "FreeTransactionRatio":
            return "CAST(0 AS DOUBLE)"
        return logged(f).replace(f, f"least(CAST({f} AS DOUBLE), {LIVE_CAPS[f]}e0)")

    z = ", ".join(f"({value(f)} - {m}e0) / {s}e0 AS {f}" for f, (m, s) in LIVE_SCALER.items())
    names = " ".join(f"WHEN {i} THEN '{n}'" for i, n in LIVE_NAMES.items())
    return sql(
        f"""SELECT rfm.CustomerID, {EXACT.replace("Recency", "rfm.Recency", 1)}, CAST(Segment AS BIGINT) AS Segment,
CASE Segment {names} END AS Segment_Name, {ABSOLUTE} AS ChurnScore, {risk(ABSOLUTE)} AS ChurnRisk,
{rounded(f"0.5e0 * ({BAND_R})", 4)} AS Recency_component, {rounded(f"0.3e0 * ({BAND_F})", 4)} AS Frequency_component,
{rounded(f"0.2e0 * ({BAND_M})", 4)} AS Monetary_component
FROM rfm JOIN (SELECT CustomerID, {nearest()} AS Segment FROM (SELECT CustomerID, {z} FROM rfm)) a
ON rfm.CustomerID = a.CustomerID""",
        "rfm",
    )


@register("score_customers", _live_sql())
def live_scoring(spark, sf_dir):
    return score_customers(customers(spark, sf_dir), LIVE_MODEL)


@register("score_stream", _live_sql())
def stream_scoring(spark, sf_dir):
    """The same by a stream over files that come in two lots, stopped and started again between them."""
    source, sink, marks = (new_shared_path(spark, f"stream-{n}") for n in ("in", "out", "marks"))
    rfm_all = customers(spark, sf_dir)
    for lot in (0, 1):
        rfm_all.filter(F.pmod(F.xxhash64("CustomerID"), F.lit(2)) == lot).write.mode("append").parquet(source)
        run = start_scoring(read_customer_stream(spark, source), LIVE_MODEL, sink, marks)
        run.awaitTermination()
    return spark.read.parquet(sink)
