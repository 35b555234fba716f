"""Exact top-k scores at any size of the components, and how its join is keyed."""

import math

import numpy as np
import pytest

from tillwise.llm import topk
from tillwise.llm.topk import embedding_rows, top_k


def brute(vectors, queries, k):
    whole = {i: [math.floor(x * 1024) for x in v] for i, v in vectors.items()}
    for q in queries:
        scored = sorted((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q)
        yield from ((q, rank, i, -s) for rank, (s, i) in enumerate(scored[:k], 1))


@pytest.mark.parametrize("size", [1.0, 3e4, 3e5])
@pytest.mark.parametrize("block, query_block", [(4096, 512), (50, 3)])
def test_scores_by_brute_force(spark, monkeypatch, size, block, query_block):
    monkeypatch.setattr(topk, "QUERY_BLOCKS", 2)
    rng = np.random.default_rng(17)
    vectors = {i: [float(x) for x in rng.normal(0, 1, 6) * size] for i in range(300)}
    vectors[301], vectors[302] = vectors[7], vectors[7]  # ties
    rows = embedding_rows(spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>"))
    got = sorted(tuple(r) for r in top_k(rows, rows.where("id % 20 = 0"), 10, block, query_block).collect())
    assert got == sorted(brute(vectors, [i for i in vectors if i % 20 == 0], 10))


def test_large_beside_small(spark):
    """A score near 2^62 beside small ones; one beyond 64 bits raises, and so does a component."""
    rows = lambda *v: embedding_rows(spark.createDataFrame(list(enumerate([[x] for x in v])), "vec_id long, embedding array<double>"))
    v = rows(1.0, 3e6, 1e15 / 1024, 2.0)
    assert [tuple(r) for r in top_k(v, v.where("id = 0"), 3).orderBy("rank").collect()] == [(0, 1, 2, 1024 * 10**15), (0, 2, 1, 1024 * 3072 * 10**6), (0, 3, 3, 1024 * 2048)]
    with pytest.raises(Exception, match="beyond 64 bits"):
        top_k(w := rows(1e15, 1e15), w.where("id = 0"), 1).collect()
    with pytest.raises(Exception, match="beyond 64 bits"):
        top_k(w := rows(1e300, 1.0), w.where("id = 0"), 1).collect()


def test_no_single_key_joins_all_blocks(spark):
    rows = embedding_rows(spark.range(100).selectExpr("id AS vec_id", "array(cast(id AS double)) AS embedding"))
    text = top_k(rows, rows, 2, 10, 5)._jdf.queryExecution().optimizedPlan().toString()
    join = next(x for x in text.splitlines() if "Join" in x)
    assert all(c in join for c in ("dim", "block", "part"))
