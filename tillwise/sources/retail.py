"""Transaction and customer tables derived from the given star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwise.constants import CUSTOMER_KEY
from tillwise.operators.rfm import rfm_features


# The columns used here; an explicit schema saves the job that infers one.
SCHEMAS = {
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_quantity double, l_extendedprice double, l_discount double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp_ntz",
    "customer": "c_custkey bigint, c_nationkey int",
    "nation": "n_nationkey int, n_name string",
    "part": "p_partkey bigint, p_name string",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def retail(
    spark: SparkSession, sf_dir: str, country: bool = True, description: bool = True, numbered: bool = False
) -> DataFrame:
    """One row per invoice line. A discount of 0.10 stands for a give-away.

    The country and the product name are joined only where asked for; each line
    has exactly one customer and part, so leaving these out changes no row. The
    country goes to the orders first, so that the far more numerous lines are
    shuffled by order once and not again by customer. No join is hinted: Spark
    broadcasts a side by its file size and shuffles it once it has grown.
    ``numbered``: an invoice keeps the number of its order, so that Spark groups by
    invoice where the join has put the lines, and shuffles them no second time.
    """
    line, order = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    if country:
        customer, nation = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
        place = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        order = order.join(place, F.col("o_custkey") == F.col("c_custkey"))
    tx = line.join(order, F.col("l_orderkey") == F.col("o_orderkey"))
    if description:
        tx = tx.join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    free = F.col("l_discount") == 0.1
    price = F.col("l_extendedprice") / F.nullif(F.col("l_quantity"), F.lit(0.0))
    columns = {
        "InvoiceNo": F.col("l_orderkey") if numbered else F.col("l_orderkey").cast("string"),
        "StockCode": F.col("l_partkey").cast("string"),
        "Description": F.col("p_name") if description else None,
        "Quantity": F.col("l_quantity").cast("int"),
        "InvoiceDate": F.col("o_orderdate"),
        "UnitPrice": F.when(free, F.lit(0.0)).otherwise(price),
        CUSTOMER_KEY: F.col("o_custkey"),
        "Country": F.col("n_name") if country else None,
        "TotalPrice": F.when(free, F.lit(0.0)).otherwise(F.col("l_extendedprice")),
    }
    return tx.select(*[c.alias(n) for n, c in columns.items() if c is not None])


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``retail`` without country and product name."""
    return retail(spark, sf_dir, country=False, description=False)


def customer_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(CustomerID, Country) of every customer."""
    customer, nation = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    place = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return place.select(F.col("c_custkey").alias(CUSTOMER_KEY), F.col("n_name").alias("Country"))


def product_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(StockCode, Description) of every product."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("StockCode"), F.col("p_name").alias("Description"))


def retail_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``retail`` with dirt put in by rule: text dates, missing customers,
    quantities at or below zero, repeated rows."""
    stock, invoice = F.col("StockCode").cast("bigint"), F.col("InvoiceNo").cast("bigint")
    once = retail(spark, sf_dir, description=False).select(
        "InvoiceNo",
        "StockCode",
        F.when(stock % 61 == 0, -F.col("Quantity"))
        .when(stock % 61 == 1, F.lit(0))
        .otherwise(F.col("Quantity"))
        .alias("Quantity"),
        F.col("InvoiceDate").cast("string").alias("InvoiceDate"),
        "UnitPrice",
        F.when(invoice % 50 != 0, F.col(CUSTOMER_KEY)).alias(CUSTOMER_KEY),
        "Country",
        "TotalPrice",
    )
    copies = F.when(invoice % 97 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    # Repeating rows in place reads the joined tables once; a union reads them twice.
    return once.withColumn("_copy", F.explode(copies)).drop("_copy")


def purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchase events as transactions: these carry times of day."""
    return (
        table(spark, sf_dir, "events")
        .filter(F.col("event_type") == "purchase")
        .select(
            F.col("user_id").alias(CUSTOMER_KEY),
            F.col("event_id").cast("string").alias("InvoiceNo"),
            F.lit(1).alias("Quantity"),
            F.col("value").alias("UnitPrice"),
            F.col("ts").alias("InvoiceDate"),
        )
    )


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RFM features of every customer of ``retail``."""
    return rfm_features(retail(spark, sf_dir, country=False, description=False, numbered=True))
