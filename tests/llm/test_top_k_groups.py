"""Exact top-k where groups of row blocks meet the queries: the same rows, and nothing goes through the driver."""

import math

import numpy as np
import pytest

from tillwise.llm import topk
from tillwise.llm.topk import embedding_rows, top_k

from .test_large_scores import brute


def top_k_plan(spark, n, block, query_block):
    rows = embedding_rows(spark.range(n).selectExpr("id AS vec_id", "array(cast(id AS double), 1.0) AS embedding"))
    return top_k(rows, rows.where("id % 10 = 0"), 2, block, query_block)._jdf.queryExecution()


def test_copies_of_the_queries_are_not_broadcast(spark):
    """The queries are a small file, but their copies for all groups are not."""
    plan = top_k_plan(spark, 300, 10, 5)
    assert "Broadcast" not in plan.executedPlan().toString()
    assert "SortMergeJoin" in plan.executedPlan().toString()


@pytest.mark.parametrize("block, query_block, parts_of", [(10, 50, 32), (10, 3, 2), (7, 1, 4), (1, 300, 1)])
def test_groups_of_blocks_by_brute_force(spark, monkeypatch, block, query_block, parts_of):
    monkeypatch.setattr(topk, "QUERY_BLOCKS", parts_of)
    rng = np.random.default_rng(5)
    vectors = {i: [float(x) for x in rng.normal(0, 1, 4)] for i in range(200)}
    vectors[301], vectors[302] = vectors[9], vectors[180]  # ties
    rows = embedding_rows(spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>"))
    got = sorted(tuple(r) for r in top_k(rows, rows.where("id % 20 = 0"), 10, block, query_block).collect())
    assert got == sorted(brute(vectors, [i for i in vectors if i % 20 == 0], 10))


@pytest.mark.parametrize("dim, components, size", [(70, 64, 1.0), (5, 2, 3e5), (6, 64, 0.001)])
def test_blocks_of_queries_with_repeated_ids_by_brute_force(spark, monkeypatch, dim, components, size):
    """Ids that come twice, as rows and as queries; many ties; more components than are written out at a time."""
    monkeypatch.setattr(topk, "COMPONENTS", components)
    rng = np.random.default_rng(23)
    pairs = [(i % 150, [float(x) for x in rng.normal(0, 1, dim) * size]) for i in range(200)]
    rows = embedding_rows(spark.createDataFrame(pairs, "vec_id long, embedding array<double>")).cache()
    got = sorted(tuple(r) for r in top_k(rows, rows.where("id % 10 = 0"), 10, 64, 8).collect())
    whole = [(i, [math.floor(x * 1024) for x in v]) for i, v in pairs]
    want = []
    for query in {i for i, _ in whole if i % 10 == 0}:
        scored = sorted((-sum(a * b for a, b in zip(q, v)), j) for i, q in whole if i == query for j, v in whole if j != query)
        want += [(query, rank, j, -s) for rank, (s, j) in enumerate(scored[:10], 1)]
    rows.unpersist()
    assert got == sorted(want)
