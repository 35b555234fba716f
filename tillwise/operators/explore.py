"""Exploratory report over transactions and customers."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillwise import constants as K
from tillwise.functions.dates import month_label, weekday_number
from tillwise.functions.numbers import amount_parts, amount_total, count_where, exact_sum, pct, ratio, round_even
from tillwise.operators.profile import describe
from tillwise.operators.quantiles import exact_quantiles
from tillwise.operators.rfm import with_line_total
from tillwise.session import one_row, reused

RFM = ["Recency", "Frequency", "Monetary"]


def _revenue():
    return F.coalesce(exact_sum(F.col("TotalPrice")), F.lit(0.0))


def _by_order(tx: DataFrame, *keys: Column | str) -> DataFrame:
    """Lines added up by the given keys, invoice and customer.

    Distinct invoices and customers are counted on these rows; counting them on the
    lines would first multiply every line by the number of counts.
    """
    whole, rest = amount_parts(F.col("TotalPrice"))
    added = [F.sum(whole).alias("whole"), F.sum(rest).alias("rest")]
    return with_line_total(tx).groupBy(*keys, "InvoiceNo", K.CUSTOMER_KEY).agg(*added)


def _added() -> Column:
    return F.coalesce(amount_total(F.sum("whole"), F.sum("rest")), F.lit(0.0))


def overview(tx: DataFrame, places: DataFrame | None = None, columns: int | None = None) -> DataFrame:
    """Size, distinct keys, date range, revenue and order values: one row.

    ``places`` (CustomerID, Country) stands in for a Country column of the lines, and
    ``columns`` for their number, so that neither names nor countries meet the lines.
    """
    columns = len(tx.columns) if columns is None else columns
    tx = with_line_total(tx)
    whole, rest = amount_parts(F.col("TotalPrice"))
    keys = ["InvoiceNo", K.CUSTOMER_KEY] + ["Country"] * (places is None)
    facts = [F.count("*").alias("n"), F.min("InvoiceDate").alias("first"), F.max("InvoiceDate").alias("last"), F.sum(whole).alias("whole"), F.sum(rest).alias("rest")]
    orders = reused(tx.groupBy(*keys).agg(*facts))
    by_invoice = orders.filter(F.col("InvoiceNo").isNotNull()).groupBy("InvoiceNo").agg(_added().alias("order_value"))
    found = exact_quantiles(by_invoice, {"median": ("order_value", 0.5)}, {"invoices": F.count("*")})
    customers = orders.filter(F.col(K.CUSTOMER_KEY).isNotNull()).select(K.CUSTOMER_KEY).distinct()
    countries = customers.join(places, K.CUSTOMER_KEY) if places is not None else orders
    n_customers, n_products = customers.count(), tx.filter(F.col("StockCode").isNotNull()).select("StockCode").distinct().count()
    n_countries = countries.filter(F.col("Country").isNotNull()).select("Country").distinct().count()
    invoices = F.lit(found["invoices"])
    return orders.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
        F.lit(columns).cast("bigint").alias("n_columns"),
        invoices.alias("invoices"),
        F.lit(n_customers).cast("bigint").alias("customers"),
        F.lit(n_products).cast("bigint").alias("products"),
        F.lit(n_countries).cast("bigint").alias("countries"),
        F.min("first").alias("first_date"),
        F.max("last").alias("last_date"),
        round_even(_added(), 2).alias("total_revenue"),
        round_even(ratio(_added(), invoices, None), 2).alias("avg_order_value"),
        round_even(F.lit(found["median"]).cast("double"), 2).alias("median_order_value"),
    )


def quality(tx: DataFrame) -> DataFrame:
    """Duplicates, incomplete rows, zero prices, quantities and totals."""
    columns = tx.columns
    copies = tx.groupBy(*columns).agg(F.count("*").alias("_copies"))
    incomplete = F.lit(False)
    for c in columns:
        incomplete = incomplete | F.col(c).isNull()

    def rows_where(condition):
        return F.coalesce(F.sum(F.when(condition, F.col("_copies"))), F.lit(0))

    line_total = F.col("TotalPrice") if "TotalPrice" in columns else F.col("Quantity") * F.col("UnitPrice")
    return copies.agg(
        F.coalesce(F.sum(F.col("_copies") - 1), F.lit(0)).alias("duplicate_rows"),
        rows_where(incomplete).alias("rows_with_missing"),
        rows_where(F.col("UnitPrice") == 0).alias("zero_unit_price"),
        rows_where(F.col("Quantity") <= 0).alias("non_positive_quantity"),
        rows_where(line_total == 0).alias("zero_total_price"),
    )


def date_parts(tx: DataFrame) -> DataFrame:
    """Add Year, Month, Day and DayOfWeek (0 = Monday)."""
    d = F.col("InvoiceDate")
    return tx.withColumns(
        {"Year": F.year(d), "Month": F.month(d), "Day": F.day(d), "DayOfWeek": weekday_number(d)}
    )


def monthly_trend(tx: DataFrame) -> DataFrame:
    dated = tx.filter(F.col("InvoiceDate").isNotNull())
    return (
        _by_order(dated, month_label(F.col("InvoiceDate")).alias("period"))
        .groupBy("period")
        .agg(
            _added().alias("revenue"),
            F.count_distinct("InvoiceNo").alias("orders"),
            F.count_distinct(K.CUSTOMER_KEY).alias("customers"),
        )
        .orderBy("period")
    )


def weekday_trend(tx: DataFrame) -> DataFrame:
    """Monday first; a day without sales has no row."""
    names = F.array(*[F.lit(n) for n in K.WEEKDAY_NAMES])
    return (
        with_line_total(tx)
        .filter(F.col("InvoiceDate").isNotNull())
        .groupBy(weekday_number(F.col("InvoiceDate")).alias("weekday_no"))
        .agg(_revenue().alias("revenue"), F.count_distinct("InvoiceNo").alias("orders"))
        .orderBy("weekday_no")
        .select(names[F.col("weekday_no")].alias("weekday"), "revenue", "orders", "weekday_no")
    )


def weekday_hour(tx: DataFrame) -> DataFrame:
    """Revenue per weekday and hour that occur."""
    d = F.col("InvoiceDate")
    return (
        with_line_total(tx)
        .filter(d.isNotNull())
        .groupBy(weekday_number(d).alias("weekday_no"), F.hour(d).alias("hour"))
        .agg(_revenue().alias("revenue"))
    )


def weekday_hour_wide(tx: DataFrame) -> DataFrame:
    """The same as a heatmap: a row per weekday, a column per hour of the day."""
    return weekday_hour(tx).groupBy("weekday_no").pivot("hour", list(range(24))).agg(F.sum("revenue"))


def _orders_by_country(tx: DataFrame, places: DataFrame | None) -> DataFrame:
    """Orders with their Country: of the lines, or from ``places`` (CustomerID, Country) once lines are added up."""
    if places is None:
        return _by_order(tx.filter(F.col("Country").isNotNull()), "Country")
    return _by_order(tx).join(places.filter(F.col("Country").isNotNull()), K.CUSTOMER_KEY)


def country_revenue(tx: DataFrame, top: int = 10, places: DataFrame | None = None) -> DataFrame:
    return (
        _orders_by_country(tx, places)
        .groupBy("Country")
        .agg(
            _added().alias("revenue"),
            F.count_distinct("InvoiceNo").alias("orders"),
            F.count_distinct(K.CUSTOMER_KEY).alias("customers"),
        )
        .withColumn("rev_per_customer", round_even(ratio(F.col("revenue"), F.col("customers"), None), 2))
        .orderBy(F.desc("revenue"), "Country")
        .limit(top)
    )


def product_revenue(tx: DataFrame, top: int = 10, names: DataFrame | None = None) -> DataFrame:
    """The products with most revenue. ``names`` (StockCode, Description, one row a code) joins
    the top rows only; without it the lines carry the Description."""
    keys = ["StockCode"] if names is not None else ["StockCode", "Description"]
    first = [F.desc("revenue"), *keys]
    best = (
        with_line_total(tx)
        .filter(" AND ".join(f"{k} IS NOT NULL" for k in keys))
        .groupBy(*keys)
        .agg(
            _revenue().alias("revenue"),
            F.sum(F.col("Quantity").cast("bigint")).alias("qty"),
            F.count_distinct("InvoiceNo").alias("orders"),
        )
        .orderBy(*first)
        .limit(top)
    )
    if names is not None:
        best = with_names(best, names, "StockCode").orderBy(*first)
    return best.select("StockCode", "Description", "revenue", "qty", "orders")


def with_names(top: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """Join names to a frame of a few rows (a limit): those rows are broadcast, the names stay where they are."""
    return names.join(F.broadcast(top), key)


def basket_shape(tx: DataFrame) -> DataFrame:
    """Mean lines and units per order. Means over orders are totals over the
    number of orders, so orders need not be formed."""
    known = tx.filter(F.col("InvoiceNo").isNotNull())
    orders = F.count_distinct("InvoiceNo")
    return known.agg(
        ratio(F.count("*"), orders, None).alias("lines_per_order"),
        ratio(F.sum(F.col("Quantity").cast("bigint")), orders, None).alias("units_per_order"),
    )


def zero_price_rows(tx: DataFrame, top: int = 10) -> DataFrame:
    shown = ["InvoiceNo", "StockCode", "Description", "Quantity", "CustomerID", "Country"]
    return tx.filter(F.col("UnitPrice") == 0).select(*shown).orderBy(*shown).limit(top)


def rfm_describe(rfm: DataFrame) -> DataFrame:
    return describe(rfm, RFM)


def iqr_outliers(rfm: DataFrame, columns: Sequence[str] = tuple(RFM)) -> DataFrame:
    """Rows outside 1.5 interquartile ranges of the quartiles, per column."""
    targets = {f"{c}_{q}": (c, p) for c in columns for q, p in (("q1", 0.25), ("q3", 0.75))}
    found = exact_quantiles(rfm, targets)
    low, high, outside = {}, {}, {}
    for c in columns:
        q1, q3 = (F.lit(found[f"{c}_{q}"]).cast("double") for q in ("q1", "q3"))
        low[c], high[c] = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
        outside[c] = (F.col(c) < low[c]) | (F.col(c) > high[c])
    counts = rfm.agg(
        *[count_where(outside[c]).alias(f"{c}_out") for c in columns],
        *[F.count(c).alias(f"{c}_n") for c in columns],
    )
    return counts.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(c).alias("metric"),
                        F.col(f"{c}_out").alias("outliers"),
                        round_even(pct(F.col(f"{c}_out"), F.col(f"{c}_n")), 2).alias("share_pct"),
                        low[c].alias("lower_bound"),
                        high[c].alias("upper_bound"),
                    )
                    for c in columns
                ]
            )
        )
    )


def rfm_correlation(rfm: DataFrame, columns: Sequence[str] = tuple(RFM)) -> DataFrame:
    """Pearson matrix, all pairs from one aggregation."""
    pairs = {frozenset(p): f"{p[0]}_{p[1]}" for p in combinations(columns, 2)}
    one = rfm.agg(*[F.corr(*sorted(p, key=list(columns).index)).alias(n) for p, n in pairs.items()])

    def cell(a: str, b: str):
        return F.lit(1.0) if a == b else F.col(pairs[frozenset((a, b))])

    return one.select(
        F.inline(
            F.array(*[F.struct(F.lit(a).alias("metric"), *[cell(a, b).alias(b) for b in columns]) for a in columns])
        )
    )


def country_concentration(tx: DataFrame, places: DataFrame | None = None) -> DataFrame:
    """Revenue share of the largest and the five largest countries, per cent."""
    countries = _orders_by_country(tx, places).groupBy("Country").agg(_added().alias("revenue"))
    # One row per country.
    place = F.row_number().over(Window.orderBy(F.desc("revenue"), "Country"))
    ranked = countries.withColumn("place", place)
    total = F.sum("revenue")
    return ranked.agg(
        round_even(pct(F.sum(F.when(F.col("place") <= 1, F.col("revenue"))), total), 2).alias("top1_share_pct"),
        round_even(pct(F.sum(F.when(F.col("place") <= 5, F.col("revenue"))), total), 2).alias("top5_share_pct"),
    )


def repeat_rate(rfm: DataFrame) -> DataFrame:
    """Share of customers with more than one order, per cent."""
    return rfm.agg(round_even(pct(count_where(F.col("Frequency") > 1), F.count("*")), 2).alias("repeat_pct"))


def top_customers_share(rfm: DataFrame, sizes: Sequence[int] = (10, 100)) -> DataFrame:
    """Revenue share of the N largest customers, for each N."""
    total = F.lit(one_row(rfm.agg(F.coalesce(exact_sum(F.col("Monetary")), F.lit(0.0))))[0])
    largest = rfm.select("Monetary", K.CUSTOMER_KEY).orderBy(F.desc_nulls_last("Monetary"), K.CUSTOMER_KEY)
    top = largest.limit(max(sizes))
    # At most max(sizes) rows.
    place = F.row_number().over(Window.orderBy(F.desc_nulls_last("Monetary"), K.CUSTOMER_KEY))
    sums = top.withColumn("place", place).agg(
        *[F.coalesce(exact_sum(F.when(F.col("place") <= n, F.col("Monetary"))), F.lit(0.0)).alias(f"_{n}") for n in sizes]
    )
    return sums.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(n).cast("bigint").alias("top_n"),
                        F.col(f"_{n}").alias("revenue"),
                        round_even(pct(F.col(f"_{n}"), total), 2).alias("share_pct"),
                    )
                    for n in sizes
                ]
            )
        )
    )


def peak_periods(tx: DataFrame) -> DataFrame:
    """Month, weekday, hour and two-hour window with most revenue.

    One pass makes the (month, weekday, hour) cells; the rest is a regrouping
    of those few rows. The earlier period wins a tie.
    """
    d = F.col("InvoiceDate")
    cells = (
        with_line_total(tx)
        .filter(d.isNotNull())
        .groupBy(month_label(d).alias("month"), weekday_number(d).alias("weekday"), F.hour(d).alias("hour"))
        .agg(_revenue().alias("revenue"))
    )

    def hours(start, length):
        return F.format_string("%02d:00-%02d:00", start, start + length)

    def place(kind, key, label):
        return F.struct(F.lit(kind).alias("kind"), key.alias("key"), label.alias("label"))

    month, weekday, hour = F.col("month"), F.col("weekday"), F.col("hour")
    names = F.array(*[F.lit(n) for n in K.WEEKDAY_NAMES])
    places = F.array_compact(
        F.array(
            place("month", month, month),
            place("weekday", weekday.cast("string"), names[weekday]),
            place("hour", hours(hour, 1), hours(hour, 1)),
            F.when(hour <= 22, place("two_hours", hours(hour, 2), hours(hour, 2))),
            F.when(hour >= 1, place("two_hours", hours(hour - 1, 2), hours(hour - 1, 2))),
        )
    )
    periods = (
        cells.select(F.explode(places).alias("p"), "revenue")
        .groupBy("p.kind", "p.key", "p.label")
        .agg(exact_sum(F.col("revenue")).alias("revenue"))
    )
    first = Window.partitionBy("kind").orderBy(F.desc("revenue"), "key")
    return periods.withColumn("place", F.row_number().over(first)).filter(F.col("place") == 1).select(
        "kind", "label", "revenue"
    )


def partial_months(tx: DataFrame) -> DataFrame:
    """Per month the dates seen; the first or last month is partial when its
    dates do not reach the month's own first or last day."""
    day = F.to_date("InvoiceDate")
    months = (
        tx.filter(F.col("InvoiceDate").isNotNull())
        .groupBy(month_label(F.col("InvoiceDate")).alias("period"))
        .agg(F.min(day).alias("first_date"), F.max(day).alias("last_date"))
    )
    # One row per month.
    everything = Window.partitionBy()
    starts_late = (F.col("period") == F.min("period").over(everything)) & (
        F.col("first_date") > F.trunc("first_date", "month")
    )
    ends_early = (F.col("period") == F.max("period").over(everything)) & (
        F.col("last_date") < F.last_day("last_date")
    )
    return months.select("period", "first_date", "last_date", (starts_late | ends_early).alias("is_partial"))
