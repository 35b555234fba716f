"""Registered: files, profile, cleaning, exploratory report."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillwise.functions.dates import month_label
from tillwise.functions.numbers import round_even
from tillwise.operators import charts, cleaning, explore, profile, sketches
from tillwise.plans.oracle_parts import money, rounded, sql
from tillwise.plans.registry import register
from tillwise.session import new_shared_path
from tillwise.sources import files
from tillwise.sources.retail import customer_places, customers, lines, product_names, purchases, retail, retail_dirty

LABEL = "'%Y-%m-%d %H:%M:%S'"
RETAIL_COLUMNS = {
    "InvoiceNo": "string",
    "StockCode": "string",
    "Description": "string",
    "Quantity": "int",
    "InvoiceDate": "timestamp_ntz",
    "UnitPrice": "double",
    "CustomerID": "bigint",
    "Country": "string",
    "TotalPrice": "double",
}


def _each(template: str, columns) -> str:
    return " UNION ALL ".join(template.format(c=c) for c in columns)


# --- files -----------------------------------------------------------------

ALL_NINE = sql(
    f"""SELECT InvoiceNo, StockCode, Description, CAST(Quantity AS BIGINT) AS Quantity,
strftime(InvoiceDate, {LABEL}) AS InvoiceDate, UnitPrice, CustomerID, Country, TotalPrice FROM retail""",
    "retail",
)


@register("csv_roundtrip", ALL_NINE)
def csv_roundtrip(spark, sf_dir):
    path = new_shared_path(spark, "retail-csv")
    table = retail(spark, sf_dir)
    files.write_csv(table, path)
    return files.read_csv(spark, path, table.schema)


@register("parquet_months", ALL_NINE)
def parquet_months(spark, sf_dir):
    """Written by month with one month spoilt, then that month alone is written again."""
    path = new_shared_path(spark, "retail-months")
    table = retail(spark, sf_dir).withColumn("month", month_label(F.col("InvoiceDate")))
    last = table.agg(F.max("month")).first()[0]
    spoilt = table.withColumn("TotalPrice", F.when(F.col("month") != last, F.col("TotalPrice")))
    files.write_parquet(spoilt, path, ["month"])
    files.write_parquet(table.filter(F.col("month") == last), path, ["month"])
    return files.read_parquet(spark, path).drop("month")


# --- profile ---------------------------------------------------------------


@register(
    "preview",
    sql(
        f"""SELECT InvoiceNo, StockCode, Description, CAST(Quantity AS BIGINT) AS Quantity,
strftime(InvoiceDate, {LABEL}) AS InvoiceDate, {rounded("UnitPrice", 4)} AS UnitPrice, CustomerID, Country, TotalPrice
FROM retail ORDER BY InvoiceNo, StockCode, Quantity, TotalPrice LIMIT 5""",
        "retail",
    ),
)
def preview(spark, sf_dir):
    tx = lines(spark, sf_dir).withColumn("UnitPrice", round_even(F.col("UnitPrice"), 4))
    names = {"StockCode": product_names(spark, sf_dir), "CustomerID": customer_places(spark, sf_dir)}
    return profile.named_preview(tx, ["InvoiceNo", "StockCode", "Quantity", "TotalPrice"], names)


@register(
    "column_info",
    sql(
        " UNION ALL ".join(
            f"SELECT '{c}' AS column_name, '{t}' AS \"type\", count({c}) AS non_null FROM retail"
            for c, t in RETAIL_COLUMNS.items()
        ),
        "retail",
    ),
)
def column_info(spark, sf_dir):
    return profile.column_info(retail(spark, sf_dir))


DIRTY_COLUMNS = ["InvoiceNo", "StockCode", "Quantity", "InvoiceDate", "UnitPrice", "CustomerID", "Country", "TotalPrice"]


@register(
    "missing_pct",
    sql(
        f"""SELECT column_name, {rounded("missing_pct", 6)} AS missing_pct FROM ("""
        + _each(
            "SELECT '{c}' AS column_name, avg(CASE WHEN {c} IS NULL THEN 100.0e0 ELSE 0e0 END) AS missing_pct FROM dirty",
            DIRTY_COLUMNS,
        )
        + ") WHERE missing_pct > 0 ORDER BY missing_pct DESC",
        "dirty",
    ),
)
def missing_pct(spark, sf_dir):
    shares = profile.missing_pct(retail_dirty(spark, sf_dir))
    return shares.withColumn("missing_pct", round_even(F.col("missing_pct"), 6))


def _describe_sql(table: str, columns, digits: int = 4) -> str:
    pieces = {
        "count": "count({c})",
        "mean": rounded("avg(CAST({c} AS DOUBLE))", digits),
        "std": rounded("stddev_samp(CAST({c} AS DOUBLE))", digits),
        "min": "CAST(min({c}) AS DOUBLE)",
        "p25": rounded("quantile_cont(CAST({c} AS DOUBLE), 0.25)", digits),
        "p50": rounded("quantile_cont(CAST({c} AS DOUBLE), 0.5)", digits),
        "p75": rounded("quantile_cont(CAST({c} AS DOUBLE), 0.75)", digits),
        "max": "CAST(max({c}) AS DOUBLE)",
    }
    body = ", ".join(f'{e} AS "{n}"' for n, e in pieces.items())
    return _each("SELECT '{c}' AS column_name, " + body + f" FROM {table}", columns)


def _rounded_describe(df):
    parts = ["mean", "std", "p25", "p50", "p75"]
    return df.withColumns({c: round_even(F.col(c), 4) for c in parts})


NUMBERS = ["Quantity", "UnitPrice", "CustomerID", "TotalPrice"]


@register("describe", sql(_describe_sql("retail", NUMBERS), "retail"))
def describe(spark, sf_dir):
    return _rounded_describe(profile.describe(lines(spark, sf_dir)))


# --- cleaning --------------------------------------------------------------

DIRTY_OUT = (
    "InvoiceNo, StockCode, CAST(Quantity AS BIGINT) AS Quantity, InvoiceDate, "
    f"{rounded('UnitPrice', 4)} AS UnitPrice, CustomerID, Country, TotalPrice"
)


def _shown(df):
    return df.withColumn("UnitPrice", round_even(F.col("UnitPrice"), 4))


@register("clean_dedup", sql(f"SELECT {DIRTY_OUT} FROM (SELECT DISTINCT * FROM dirty)", "dirty"))
def clean_dedup(spark, sf_dir):
    return _shown(cleaning.drop_duplicate_rows(retail_dirty(spark, sf_dir)))


@register("clean_dropna", sql(f"SELECT {DIRTY_OUT} FROM dirty WHERE CustomerID IS NOT NULL", "dirty"))
def clean_dropna(spark, sf_dir):
    return _shown(cleaning.drop_missing_customers(retail_dirty(spark, sf_dir)))


@register("clean_quantity", sql(f"SELECT {DIRTY_OUT} FROM dirty WHERE Quantity > 0", "dirty"))
def clean_quantity(spark, sf_dir):
    return _shown(cleaning.keep_positive_quantities(retail_dirty(spark, sf_dir)))


@register(
    "clean_all",
    sql(
        f"""SELECT InvoiceNo, StockCode, CAST(Quantity AS BIGINT) AS Quantity,
strftime(CAST(InvoiceDate AS TIMESTAMP), {LABEL}) AS InvoiceDate, {rounded("UnitPrice", 4)} AS UnitPrice,
CAST(CustomerID AS BIGINT) AS CustomerID, Country, TotalPrice
FROM (SELECT DISTINCT * FROM dirty) WHERE CustomerID IS NOT NULL AND Quantity > 0""",
        "dirty",
    ),
)
def clean_all(spark, sf_dir):
    return _shown(cleaning.clean(retail_dirty(spark, sf_dir)))


@register(
    "cleaning_report",
    sql(
        """SELECT CAST(sum(copies) AS BIGINT) AS InitialRows, CAST(sum(copies - 1) AS BIGINT) AS DuplicatesRemoved,
count(*) FILTER (WHERE CustomerID IS NULL) AS MissingCustomersRemoved,
count(*) FILTER (WHERE CustomerID IS NOT NULL AND NOT Quantity > 0) AS InvalidQuantitiesRemoved,
count(*) FILTER (WHERE CustomerID IS NOT NULL AND Quantity > 0) AS FinalRows
FROM (SELECT *, count(*) AS copies FROM dirty GROUP BY ALL)""",
        "dirty",
    ),
)
def cleaning_report(spark, sf_dir):
    return cleaning.cleaning_report(retail_dirty(spark, sf_dir))


# --- exploratory report ----------------------------------------------------


@register(
    "eda_overview",
    sql(
        f"""SELECT count(*) AS n_rows, CAST(9 AS BIGINT) AS n_columns, count(DISTINCT InvoiceNo) AS invoices,
count(DISTINCT CustomerID) AS customers, count(DISTINCT StockCode) AS products, count(DISTINCT Country) AS countries,
strftime(min(InvoiceDate), {LABEL}) AS first_date, strftime(max(InvoiceDate), {LABEL}) AS last_date,
{rounded(money("TotalPrice"), 2)} AS total_revenue,
{rounded(money("TotalPrice") + " / count(DISTINCT InvoiceNo)", 2)} AS avg_order_value,
(SELECT {rounded("quantile_cont(v, 0.5)", 2)} FROM
  (SELECT {money("TotalPrice")} AS v FROM retail GROUP BY InvoiceNo)) AS median_order_value
FROM retail""",
        "retail",
    ),
)
def eda_overview(spark, sf_dir):
    return explore.overview(lines(spark, sf_dir), customer_places(spark, sf_dir), columns=len(RETAIL_COLUMNS))


@register(
    "eda_quality",
    sql(
        """SELECT CAST(sum(copies - 1) AS BIGINT) AS duplicate_rows,
CAST(coalesce(sum(copies) FILTER (WHERE InvoiceNo IS NULL OR StockCode IS NULL OR Quantity IS NULL
  OR InvoiceDate IS NULL OR UnitPrice IS NULL OR CustomerID IS NULL OR Country IS NULL OR TotalPrice IS NULL), 0) AS BIGINT)
  AS rows_with_missing,
CAST(coalesce(sum(copies) FILTER (WHERE UnitPrice = 0), 0) AS BIGINT) AS zero_unit_price,
CAST(coalesce(sum(copies) FILTER (WHERE Quantity <= 0), 0) AS BIGINT) AS non_positive_quantity,
CAST(coalesce(sum(copies) FILTER (WHERE TotalPrice = 0), 0) AS BIGINT) AS zero_total_price
FROM (SELECT *, count(*) AS copies FROM dirty GROUP BY ALL)""",
        "dirty",
    ),
)
def eda_quality(spark, sf_dir):
    return explore.quality(retail_dirty(spark, sf_dir))


@register(
    "eda_missing",
    sql(
        _each(
            "SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS missing FROM dirty", DIRTY_COLUMNS
        ),
        "dirty",
    ),
)
def eda_missing(spark, sf_dir):
    return profile.missing_counts(retail_dirty(spark, sf_dir))


@register(
    "monthly_trend",
    sql(
        f"""SELECT strftime(InvoiceDate, '%Y-%m') AS period, {money("TotalPrice")} AS revenue,
count(DISTINCT InvoiceNo) AS orders, count(DISTINCT CustomerID) AS customers FROM retail GROUP BY 1 ORDER BY 1""",
        "retail",
    ),
)
def monthly_trend(spark, sf_dir):
    return explore.monthly_trend(lines(spark, sf_dir))


@register(
    "sketch_months",
    sql(
        """SELECT strftime(InvoiceDate, '%Y-%m') AS period, count(*) AS n_rows, count(DISTINCT CustomerID) AS customers,
count(DISTINCT InvoiceNo) AS orders, CAST(1 AS BIGINT) AS customers_near, CAST(1 AS BIGINT) AS orders_near,
CAST(1 AS BIGINT) AS median_near FROM retail GROUP BY 1""",
        "retail",
    ),
)
def sketch_months(spark, sf_dir):
    """Months merged from stored days: whether each estimate is within its bound of the exact number beside it."""
    tx = lines(spark, sf_dir)
    path = new_shared_path(spark, "sketches")
    files.write_parquet(sketches.daily_sketches(tx), path)
    merged = sketches.merged(files.read_parquet(spark, path), month_label(F.col("day")).alias("period"))
    near = sketches.answers(merged).select("period", F.col("customers").alias("c"), F.col("orders").alias("o"), "amount")
    exact = explore.monthly_trend(tx).select("period", "customers", "orders")
    ranks = (
        tx.withColumn("period", month_label(F.col("InvoiceDate")))
        .join(F.broadcast(near.select("period", "amount")), "period")  # a row a month
        .groupBy("period")
        .agg(F.count("*").alias("n_rows"), F.avg((F.col("TotalPrice") < F.col("amount")).cast("int")).alias("under"), F.avg((F.col("TotalPrice") <= F.col("amount")).cast("int")).alias("upto"))
    )

    def within(estimate, true):
        return (F.abs(F.col(estimate) - F.col(true)) <= F.greatest(F.lit(0.5), sketches.COUNT_ERROR * F.col(true))).cast("bigint")

    median = ((F.col("under") <= 0.5 + sketches.RANK_ERROR) & (F.col("upto") >= 0.5 - sketches.RANK_ERROR)).cast("bigint")
    return exact.join(near, "period").join(ranks, "period").select(
        "period", "n_rows", "customers", "orders", within("c", "customers").alias("customers_near"), within("o", "orders").alias("orders_near"), median.alias("median_near")
    )


WEEKDAY = "CASE isodow({d}) WHEN 1 THEN 'Mon' WHEN 2 THEN 'Tue' WHEN 3 THEN 'Wed' WHEN 4 THEN 'Thu' WHEN 5 THEN 'Fri' WHEN 6 THEN 'Sat' ELSE 'Sun' END"


@register(
    "weekday_trend",
    sql(
        f"""SELECT {WEEKDAY.format(d="InvoiceDate")} AS weekday, {money("TotalPrice")} AS revenue,
count(DISTINCT InvoiceNo) AS orders, isodow(InvoiceDate) - 1 AS weekday_no FROM retail GROUP BY 1, 4 ORDER BY 4""",
        "retail",
    ),
)
def weekday_trend(spark, sf_dir):
    return explore.weekday_trend(lines(spark, sf_dir))


@register(
    "weekday_hour",
    sql(
        f"""SELECT isodow(InvoiceDate) - 1 AS weekday_no, hour(InvoiceDate) AS hour, {money("TotalPrice")} AS revenue
FROM purchases GROUP BY 1, 2""",
        "purchases",
    ),
)
def weekday_hour(spark, sf_dir):
    return explore.weekday_hour(purchases(spark, sf_dir))


@register(
    "weekday_hour_wide",
    sql(
        "SELECT isodow(InvoiceDate) - 1 AS weekday_no, "
        + ", ".join(f'{money(f"CASE WHEN hour(InvoiceDate) = {h} THEN TotalPrice END")} AS "{h}"' for h in range(24))
        + " FROM purchases GROUP BY 1",
        "purchases",
    ),
)
def weekday_hour_wide(spark, sf_dir):
    return explore.weekday_hour_wide(purchases(spark, sf_dir))


@register(
    "country_revenue",
    sql(
        f"""SELECT Country, revenue, orders, customers, {rounded("revenue / customers", 2)} AS rev_per_customer
FROM (SELECT Country, {money("TotalPrice")} AS revenue, count(DISTINCT InvoiceNo) AS orders,
count(DISTINCT CustomerID) AS customers FROM retail GROUP BY Country) ORDER BY revenue DESC, Country LIMIT 10""",
        "retail",
    ),
)
def country_revenue(spark, sf_dir):
    return explore.country_revenue(lines(spark, sf_dir), places=customer_places(spark, sf_dir))


@register(
    "product_revenue",
    sql(
        f"""SELECT StockCode, Description, {money("TotalPrice")} AS revenue, CAST(sum(Quantity) AS BIGINT) AS qty,
count(DISTINCT InvoiceNo) AS orders FROM retail GROUP BY StockCode, Description
ORDER BY revenue DESC, StockCode, Description LIMIT 10""",
        "retail",
    ),
)
def product_revenue(spark, sf_dir):
    return explore.product_revenue(lines(spark, sf_dir), names=product_names(spark, sf_dir))


@register(
    "basket_shape",
    sql(
        f"""SELECT {rounded("avg(n)", 6)} AS lines_per_order, {rounded("avg(u)", 6)} AS units_per_order
FROM (SELECT count(*) AS n, sum(Quantity) AS u FROM retail GROUP BY InvoiceNo)""",
        "retail",
    ),
)
def basket_shape(spark, sf_dir):
    shape = explore.basket_shape(lines(spark, sf_dir))
    return shape.select(*[round_even(F.col(c), 6).alias(c) for c in shape.columns])


@register(
    "zero_price_rows",
    sql(
        """SELECT InvoiceNo, StockCode, Description, CAST(Quantity AS BIGINT) AS Quantity, CustomerID, Country
FROM retail WHERE UnitPrice = 0
ORDER BY InvoiceNo, StockCode, Description, retail.Quantity, CustomerID, Country LIMIT 10""",
        "retail",
    ),
)
def zero_price_rows(spark, sf_dir):
    return explore.zero_price_rows(retail(spark, sf_dir))


@register("rfm_describe", sql(_describe_sql("rfm", explore.RFM), "rfm"))
def rfm_describe(spark, sf_dir):
    return _rounded_describe(explore.rfm_describe(customers(spark, sf_dir)))


@register(
    "iqr_outliers",
    sql(
        _each(
            f"""SELECT '{{c}}' AS metric, count(*) FILTER (WHERE {{c}} < q1 - 1.5 * (q3 - q1) OR {{c}} > q3 + 1.5 * (q3 - q1))
AS outliers, {rounded("100e0 * count(*) FILTER (WHERE {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) / count(*)", 2)}
AS share_pct, {rounded("any_value(q1 - 1.5 * (q3 - q1))", 4)} AS lower_bound,
{rounded("any_value(q3 + 1.5 * (q3 - q1))", 4)} AS upper_bound
FROM rfm, (SELECT quantile_cont({{c}}, 0.25) AS q1, quantile_cont({{c}}, 0.75) AS q3 FROM rfm)""",
            explore.RFM,
        ),
        "rfm",
    ),
)
def iqr_outliers(spark, sf_dir):
    found = explore.iqr_outliers(customers(spark, sf_dir))
    return found.withColumns({c: round_even(F.col(c), 4) for c in ("lower_bound", "upper_bound")})


@register(
    "rfm_correlation",
    sql(
        " UNION ALL ".join(
            f"SELECT '{a}' AS metric, "
            + ", ".join("1e0 AS " + b if a == b else f"{rounded(f'corr({a}, {b})', 6)} AS {b}" for b in explore.RFM)
            + " FROM rfm"
            for a in explore.RFM
        ),
        "rfm",
    ),
)
def rfm_correlation(spark, sf_dir):
    matrix = explore.rfm_correlation(customers(spark, sf_dir))
    return matrix.withColumns({c: round_even(F.col(c), 6) for c in explore.RFM})


@register(
    "country_concentration",
    sql(
        f"""SELECT {rounded("100e0 * sum(revenue) FILTER (WHERE place <= 1) / sum(revenue)", 2)} AS top1_share_pct,
{rounded("100e0 * sum(revenue) FILTER (WHERE place <= 5) / sum(revenue)", 2)} AS top5_share_pct
FROM (SELECT revenue, row_number() OVER (ORDER BY revenue DESC, Country) AS place
FROM (SELECT Country, {money("TotalPrice")} AS revenue FROM retail GROUP BY Country))""",
        "retail",
    ),
)
def country_concentration(spark, sf_dir):
    return explore.country_concentration(lines(spark, sf_dir), customer_places(spark, sf_dir))


@register(
    "repeat_rate",
    sql(f"SELECT {rounded('100e0 * count(*) FILTER (WHERE Frequency > 1) / count(*)', 2)} AS repeat_pct FROM rfm", "rfm"),
)
def repeat_rate(spark, sf_dir):
    return explore.repeat_rate(customers(spark, sf_dir))


@register(
    "top_customers_share",
    sql(
        " UNION ALL ".join(
            f"""SELECT CAST({n} AS BIGINT) AS top_n, {money("Monetary")} AS revenue,
{rounded(f"100e0 * {money('Monetary')} / (SELECT {money('Monetary')} FROM rfm)", 2)} AS share_pct
FROM (SELECT Monetary FROM rfm ORDER BY Monetary DESC, CustomerID LIMIT {n})"""
            for n in (10, 100)
        ),
        "rfm",
    ),
)
def top_customers_share(spark, sf_dir):
    return explore.top_customers_share(customers(spark, sf_dir))


def _peak_sql() -> str:
    label = "printf('%02d:00-%02d:00', CAST({a} AS INT), CAST({b} AS INT))"
    kinds = [
        ("month", "strftime(InvoiceDate, '%Y-%m')", "strftime(InvoiceDate, '%Y-%m')", "purchases"),
        ("weekday", "CAST(isodow(InvoiceDate) AS VARCHAR)", WEEKDAY.format(d="InvoiceDate"), "purchases"),
        (
            "hour",
            label.format(a="hour(InvoiceDate)", b="hour(InvoiceDate) + 1"),
            label.format(a="hour(InvoiceDate)", b="hour(InvoiceDate) + 1"),
            "purchases",
        ),
        (
            "two_hours",
            label.format(a="h", b="h + 2"),
            label.format(a="h", b="h + 2"),
            "(SELECT p.*, h FROM purchases p JOIN (SELECT unnest(range(0, 23)) AS h) ON hour(InvoiceDate) IN (h, h + 1))",
        ),
    ]
    return " UNION ALL ".join(
        f"""(SELECT '{kind}' AS kind, label, revenue FROM (SELECT {key} AS k, {name} AS label,
{money("TotalPrice")} AS revenue FROM {source} GROUP BY 1, 2) ORDER BY revenue DESC, k LIMIT 1)"""
        for kind, key, name, source in kinds
    )


@register("peak_periods", sql(_peak_sql(), "purchases"))
def peak_periods(spark, sf_dir):
    return explore.peak_periods(purchases(spark, sf_dir))


@register(
    "partial_months",
    sql(
        """SELECT period, CAST(first_date AS VARCHAR) AS first_date, CAST(last_date AS VARCHAR) AS last_date,
CAST(CASE WHEN (period = min(period) OVER () AND first_date > date_trunc('month', first_date))
  OR (period = max(period) OVER () AND last_date < last_day(last_date)) THEN 1 ELSE 0 END AS BIGINT) AS is_partial
FROM (SELECT strftime(InvoiceDate, '%Y-%m') AS period, min(CAST(InvoiceDate AS DATE)) AS first_date,
max(CAST(InvoiceDate AS DATE)) AS last_date FROM retail GROUP BY 1)""",
        "retail",
    ),
)
def partial_months(spark, sf_dir):
    return explore.partial_months(lines(spark, sf_dir))


HISTOGRAM_OF_LINES = {"Quantity": 40, "UnitPrice": 40, "TotalPrice": 40}


def histogram_sql(table: str, column: str, bins: int, by: str = "") -> str:
    """One column's histogram; ``by`` is an extra key followed by a comma."""
    place = f"least(CAST(floor(({column} - lo) / nullif(hi - lo, 0) * {bins}) AS BIGINT), {bins - 1})"
    return f"""SELECT {by}bin, {rounded(f"any_value(lo) + bin * (any_value(hi - lo) / {bins})", 6)} AS bin_start,
{rounded(f"any_value(lo) + (bin + 1) * (any_value(hi - lo) / {bins})", 6)} AS bin_end, count(*) AS n_rows
FROM (SELECT {by}coalesce({place}, 0) AS bin, lo, hi FROM {table},
(SELECT CAST(min({column}) AS DOUBLE) AS lo, CAST(max({column}) AS DOUBLE) AS hi FROM {table})
WHERE {column} IS NOT NULL) GROUP BY {by}bin"""


def rounded_edges(df):
    return df.withColumns({c: round_even(F.col(c), 6) for c in ("bin_start", "bin_end")})


@register(
    "histogram_transactions",
    sql(
        " UNION ALL ".join(
            f"SELECT '{c}' AS column_name, * FROM ({histogram_sql('retail', c, n)})" for c, n in HISTOGRAM_OF_LINES.items()
        ),
        "retail",
    ),
)
def histogram_transactions(spark, sf_dir):
    return rounded_edges(charts.histograms(lines(spark, sf_dir), HISTOGRAM_OF_LINES))


@register(
    "date_parts",
    sql(
        """SELECT InvoiceNo, StockCode, year(InvoiceDate) AS "Year", month(InvoiceDate) AS "Month",
day(InvoiceDate) AS "Day", isodow(InvoiceDate) - 1 AS DayOfWeek FROM retail""",
        "retail",
    ),
)
def date_parts(spark, sf_dir):
    return explore.date_parts(lines(spark, sf_dir)).select("InvoiceNo", "StockCode", "Year", "Month", "Day", "DayOfWeek")
