import random
from decimal import Decimal

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tillwise.functions.numbers import amount_parts, exact_sum
from tillwise.operators import charts, quantiles, selection
from tillwise.operators.ranking import global_rank

PROBABILITIES = [0, 0.05, 0.25, 0.5, 0.75, 0.9, 0.95, 1]


@pytest.fixture(scope="module")
def skewed():
    rng = np.random.default_rng(7)
    n = 60_000
    return pd.DataFrame(
        {
            "wide": rng.lognormal(3, 2, n),
            # one value holds a third of all rows
            "hot": np.where(rng.random(n) < 0.34, 7.0, rng.integers(0, 50, n)).astype(float),
            "sparse": np.where(rng.random(n) < 0.9, np.nan, rng.normal(size=n)),
        }
    )


@pytest.mark.parametrize("sample", [1 << 20, 4_000, 60])
def test_same_as_numpy_however_few_are_sampled(spark, monkeypatch, skewed, sample):
    """Read off at once, after a round or two, and after many."""
    monkeypatch.setattr(selection, "SAMPLE", sample)
    df = spark.createDataFrame(skewed).repartition(5)
    targets = {f"{c}_{i}": (c, p) for c in df.columns for i, p in enumerate(PROBABILITIES)}
    got = quantiles.exact_quantiles(df, targets, {"n": F.count("*")})
    assert got.pop("n") == len(skewed)
    want = {a: skewed[c].quantile(p) for a, (c, p) in targets.items()}
    assert got == pytest.approx(want, rel=1e-12)


def test_no_values(spark):
    df = spark.createDataFrame([(None,)], "x double")
    assert quantiles.exact_quantiles(df, {"m": ("x", 0.5)}) == {"m": None}
    assert quantiles.exact_quantiles(df.limit(0), {"m": ("x", 0.5)}) == {"m": None}


def test_infinite_values_have_their_place(spark):
    df = spark.createDataFrame([(float("inf"),), (float("-inf"),), (1.0,), (2.0,), (float("nan"),)], "x double")
    found = quantiles.exact_quantiles(df, {"low": ("x", 0.0), "high": ("x", 1.0), "m": ("x", 0.5)})
    assert found == {"low": float("-inf"), "high": float("inf"), "m": 1.5}


def test_searches_leave_no_file_and_plan_no_sort(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(selection, "SAMPLE", 500)
    before = set(_shared(spark))
    df = spark.range(20_000).select((F.col("id") * 7919 % 20_000).cast("double").alias("x"))
    assert quantiles.exact_quantiles(df, {"m": ("x", 0.5)}) == {"m": 9_999.5}
    assert set(_shared(spark)) == before


def _shared(spark):
    import os

    from tillwise.session import shared_dir

    return os.listdir(shared_dir(spark).removeprefix("file:"))


@pytest.mark.parametrize("sample", [1 << 14, 50])
@pytest.mark.parametrize("kind", ["wide", "hot", "signed", "loss"])
def test_customers_for_a_share(spark, monkeypatch, sample, kind):
    monkeypatch.setattr(selection, "SAMPLE", sample)
    rng = np.random.default_rng(5)
    values = {
        "wide": rng.lognormal(3, 2, 3000).round(2),
        "hot": np.where(rng.random(3000) < 0.6, 7.5, rng.integers(0, 50, 3000)).astype(float),
        "signed": rng.normal(1, 3, 3000).round(3),
        "loss": rng.normal(-1, 3, 300).round(3),
    }[kind]
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "CustomerID long, Monetary double")
    for line in (10.0, 80.0, 100.0):
        units = np.sort((values * 1000).round().astype(int))[::-1]
        reached = np.flatnonzero(units.cumsum() * 100 >= units.sum() * line)
        want = int(reached[0]) + 1 if units.sum() > 0 and len(reached) else None
        assert charts.customers_for_share(df, line).first()[0] == want


def test_share_agrees_with_the_ranked_table(spark):
    df = spark.createDataFrame([(i, float((i * 37) % 101) / 4) for i in range(400)], "CustomerID long, Monetary double")
    assert charts.customers_for_share(df).first()[0] == charts.pareto_line(charts.revenue_pareto(df)).first()[0]
    assert charts.customers_for_share(df.limit(0)).first()[0] is None


SUMS = [
    ([0.00004] * 4, 0.00016),
    ([0.1] * 3, 0.3),
    ([1e18, 0.25, -1e18], 0.25),
    ([1e18, 1.0, 1.0], 1e18 + 2),
    ([1e30, 1e-15, -1e30], 1e-15),
    ([9.5e15, 9.5e15, 0.5], 1.9e16),
    ([-0.75, -0.5], -1.25),
    ([float("nan"), None, 2.5], 2.5),
    ([None], None),
]


@pytest.mark.parametrize("values, want", SUMS)
def test_sums_are_exact_at_any_scale_and_partitioning(spark, values, want):
    for parts in (1, 3):
        df = spark.createDataFrame([(v,) for v in values], "x double").repartition(parts)
        assert df.agg(exact_sum(F.col("x"))).first()[0] == want


def test_common_amounts_are_added_with_others(spark):
    """Amounts of four decimals at most, finer, tiny and large ones: the total of their shortest decimals."""
    rng = random.Random(3)
    draws = [lambda: round(rng.uniform(-1e5, 1e5), 2), lambda: round(rng.uniform(-1e9, 1e9), 4), lambda: 7.82e-16, lambda: -0.0, lambda: 999_999_999.9999, lambda: round(rng.uniform(-1, 1), 6)]
    groups = {g: [rng.choice(draws[: 1 + g % 6])() for _ in range(1 + g % 9)] for g in range(200)}
    df = spark.createDataFrame([(g, v) for g, own in groups.items() for v in own], "g int, v double")
    got = {r.g: r.s for r in df.groupBy("g").agg(exact_sum(F.col("v")).alias("s")).collect()}
    assert got == {g: float(sum(Decimal(repr(v)) for v in own)) for g, own in groups.items()}


def test_common_amounts_take_no_decimal(spark):
    """Amounts of four decimals at most never reach the slow path."""
    seen = []
    with pytest.MonkeyPatch.context() as m:
        m.setattr("tillwise.functions.numbers.amount_parts", lambda c: seen.append(c) or amount_parts(c))
        df = spark.createDataFrame([(0.1, False), (-12.3456, False), (1e8 + 0.25, False), (0.00001, True), (2e9, True)], "v double, slow boolean")
        df.agg(exact_sum(F.col("v"))).collect()
    assert df.select(seen[0].isNotNull().alias("s"), "slow").filter("s <> slow").count() == 0


def test_rank_and_running_sum_with_a_hot_value(spark):
    """A third of the rows share one value; they spread over several ranges."""
    n = 3000
    df = spark.range(n).select(
        F.col("id").alias("key"), F.when(F.col("id") % 3 == 0, F.lit(50)).otherwise(F.col("id") % 101).alias("v")
    )
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = global_rank(df, [F.desc("v"), F.asc("key")], running={"total": F.col("v")}).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    rows = sorted(((r.v, r.key) for r in df.collect()), key=lambda t: (-t[0], t[1]))
    total, want = 0, {}
    for i, (v, key) in enumerate(rows, 1):
        total += v
        want[key] = (i, total)
    assert {r.key: (r.Rank, r.total) for r in got} == want
