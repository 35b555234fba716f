"""What the physical plans must and must not contain."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from tillwise.operators import rfm
from tillwise.sources.retail import customers, lines, retail

QUERIES = contract.queries()


@pytest.fixture(autouse=True)
def no_cached_frames(spark):
    spark.catalog.clearCache()


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


FAST = ["rfm_features", "churn_analysis", "all_kpis", "segment_kpis", "country_revenue", "cleaning_report",
        "histogram_monetary", "score_customers", "churn_breakdown_long", "revenue_pareto", "segment_customers"]


@pytest.mark.parametrize("name", FAST)
def test_no_python_and_no_cross_join(spark, sf_dir, name):
    text = plan(QUERIES[name](spark, sf_dir))
    assert not re.search(r"BatchEvalPython|ArrowEvalPython|MapInPandas|CartesianProduct|BroadcastNestedLoopJoin", text)


def test_features_read_the_lines_once_and_only_needed_columns(spark, sf_dir):
    text = plan(rfm.customer_facts(lines(spark, sf_dir)))
    assert text.count("FileScan parquet") == 2
    assert "p_name" not in text and "l_partkey" not in text
    assert text.count("PushedFilters: [IsNotNull(l_orderkey)]") == 1
    # grouped by (customer, invoice) before customer: a hot customer is spread
    exchanges = re.findall(r"hashpartitioning\(([^)]*)\)", text)
    assert any("InvoiceNo" in e for e in exchanges) and len(exchanges) == 2


def test_one_feature_reads_less(spark, sf_dir):
    text = plan(rfm.rfm_features(lines(spark, sf_dir), ["Frequency"]))
    assert "l_extendedprice" not in text and "o_orderdate" not in text


def test_country_and_product_are_joined_only_when_asked(spark, sf_dir):
    assert plan(retail(spark, sf_dir)).count("FileScan parquet") == 5
    assert plan(lines(spark, sf_dir)).count("FileScan parquet") == 2


def test_registered_queries_cover_whole_tables(sf_dir):
    text = " ".join(contract.oracle_sql().values()).lower()
    assert "tablesample" not in text and "using sample" not in text


def test_names_and_countries_never_meet_the_lines(spark, sf_dir):
    """Top products, the preview and country shares join names to few rows, and count no multiplied lines."""
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("product_revenue", "preview"):
            text = plan(QUERIES[name](spark, sf_dir))
            top = text[text.rindex("TakeOrderedAndProject") :]  # what the top rows are taken from comes first
            scans = list(re.finditer(r"FileScan parquet \[([^\]]*)\]", top))
            assert "l_orderkey" in scans[0][1] and "o_orderkey" in scans[1][1]
            assert top[: scans[1].start()].count("SortMergeJoin") == 1
        for name in ("country_revenue", "country_concentration", "monthly_trend"):
            text = plan(QUERIES[name](spark, sf_dir))
            # below the Expand (two counts) lines are already added up by order
            if "Expand" in text:
                assert re.search(r"Expand(.|\n)*HashAggregate\(keys=\[[^\]]*InvoiceNo[^\]]*\](.|\n)*l_orderkey", text)
            lines_part = text[text.rindex("HashAggregate"):]
            assert "n_name" not in lines_part or lines_part.index("n_name") > lines_part.index("l_orderkey")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)


def test_aligned_features_need_no_shuffle_above_the_stored_parts(spark, sf_dir):
    parts = rfm.customer_parts(lines(spark, sf_dir))
    end = F.lit("2020-01-01").cast("timestamp_ntz")
    tables = spark.catalog.listTables()
    text = plan(rfm.align_by_customer(rfm.separate_features(parts, end)))
    assert "Exchange" not in text and "l_orderkey" not in text and "Union" in text
    assert not [t for t in tables if t.name.startswith("bucketed")]


def test_features_group_invoices_where_the_join_put_them(spark, tmp_path, monkeypatch):
    """One shuffle of each table by order, one of the grouped rows by customer, none of the lines by invoice."""
    t = "2024-01-0%d 00:00:00"
    tables = {
        "lineitem": ("l_orderkey bigint, l_partkey bigint, l_quantity double, l_extendedprice double, l_discount double", [(1, 1, 2.0, 10.5, 0.0), (1, 1, 2.0, 10.5, 0.0), (2, 1, 1.0, 4.0, 0.1), (3, 2, 4.0, 8.0, 0.0), (None, 2, 4.0, 8.0, 0.0)]),
        "orders": ("o_orderkey bigint, o_custkey bigint, o_orderdate string", [(1, 7, t % 1), (2, 7, t % 3), (3, 8, t % 2), (3, None, t % 5), (None, 8, t % 4)]),
    }
    for name, (schema, rows) in tables.items():
        df = spark.createDataFrame(rows, schema)
        df.select(*[F.col(c).cast("timestamp_ntz") if c == "o_orderdate" else F.col(c) for c in df.columns]).write.parquet(f"{tmp_path}/{name}.parquet")
    monkeypatch.setattr(rfm, "reused", lambda df: df)
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = customers(spark, str(tmp_path))
        text = plan(got)
        assert sorted(re.sub(r"#\d+L?", "", e).split(",")[0] for e in re.findall(r"hashpartitioning\(([^)]*)\)", text)) == ["CustomerID", "l_orderkey", "o_orderkey"]
        want = rfm.rfm_features(lines(spark, str(tmp_path)))
        assert got.dtypes == want.dtypes and sorted(got.collect()) == sorted(want.collect()) and got.count() == 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
