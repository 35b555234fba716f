"""Periodic runs, SimHash groups and ranked search against plain Python, and in odd cases."""

import collections
import math
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tillwise.llm import lexical, simhash
from tillwise.llm.common import Scratch, table
from tillwise.llm.lexical import product, ranked_search
from tillwise.llm.nearcopies import components
from tillwise.llm.periodic import FIRST, LEAST, collapse_runs, runs_of
from tillwise.llm.queries import with_periodic_words
from tillwise.llm.registry import QUERIES
from tillwise.llm.simhash import keep_one_of_each_group, simhash_groups

# `anchor`, `point`, `row`, `n`, `gone`: names that the operators use themselves
DOCS = "doc_id long, text string, anchor string, point int, row int, n string, gone long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def documents(spark, *texts, ids=None):
    return spark.createDataFrame([(i, t, "x", 1, 2, "n", 3) for i, t in zip(ids or range(len(texts)), texts)], DOCS)


def all_runs(words, least=LEAST):
    """By every diagonal in full."""
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = q
        while i < len(words):
            begin = i
            while i < len(words) and words[i] == words[i - q]:
                i += 1
            if i - begin >= max(least - q, q):
                found.setdefault((begin - q, i), q)
            i += i == begin
    return sorted(((b, e - b, q) for (b, e), q in found.items()), key=lambda r: (r[0], r[2]))


def made_words(rng, kind):
    n, few = int(rng.integers(0, 160)), int(rng.integers(1, 5))
    if kind == 0:
        return rng.integers(0, few, n)
    if kind == 1:  # a period with a few errors
        words = np.resize(rng.integers(0, few + 1, int(rng.integers(1, 40))), n)
        words[rng.integers(0, n, min(n, 2))] = 9
        return words
    if kind == 2:  # Fibonacci words are full of runs
        a, b = "0", "01"
        while len(b) < n:
            a, b = b, b + a
        return np.array([int(c) for c in b[:n]], dtype=np.int64)
    if kind == 3:  # periods within periods
        part = np.concatenate([np.resize(rng.integers(0, 2, int(rng.integers(1, 6))), int(rng.integers(1, 40))) for _ in range(3)])
        return np.resize(part, 2 * len(part) + int(rng.integers(0, 9)))
    words = np.zeros(n, dtype=np.int64)
    words[:: int(rng.integers(1, 60))] = 1
    return words


def test_runs_by_brute_force():
    rng = np.random.default_rng(11)
    for i in range(400):
        words = np.asarray(made_words(rng, i % 5), dtype=np.int64)
        least = LEAST if i % 3 else 5
        assert [tuple(map(int, r)) for r in zip(*runs_of(words, least))] == all_runs(words.tolist(), least)


def test_runs_of_long_texts(spark):
    """One word a hundred thousand times, a long period, and a text of several slices, in one unit each."""
    period = " ".join(f"w{i}" for i in range(70_000))
    texts = ["a " * 100_000, f"{period} {period} {period} end", " ".join(str(i % 400_003) for i in range(800_006))]
    got = {r["doc_id"]: r for r in collapse_runs(documents(spark, *texts)).collect()}
    assert [tuple(r) for r in got[0]["runs"]] == [(0, 100_000, 1)] and got[0]["text"] == "a"
    assert [tuple(r) for r in got[1]["runs"]] == [(0, 210_000, 70_000)] and got[1]["text"] == f"{period} end"
    assert [tuple(r) for r in got[2]["runs"]] == [(0, 800_006, 400_003)]


def test_runs_in_odd_cases(spark):
    run = "x y z " * 5
    docs = documents(spark, None, "", " \t\n", run, run, "  " * 13, run + "x y", ids=[0, 1, 2, 3, 3, None, 5])
    got = [(r["doc_id"], r["text"], [tuple(x) for x in r["runs"]]) for r in collapse_runs(docs).collect()]
    three = "x y z"
    assert sorted(got, key=str) == sorted([
        (0, "", []), (1, "", []), (2, "", []), (3, three, [(0, 15, 3)]), (3, three, [(0, 15, 3)]),
        (None, " ", [(0, 13, 1)]), (5, three, [(0, 17, 3)]),
    ], key=str)
    assert collapse_runs(docs.limit(0)).count() == 0
    assert "Exchange" not in collapse_runs(docs)._jdf.queryExecution().executedPlan().toString()
    assert FIRST & (FIRST - 1) == 0


def plain_fingerprint(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, 1))]
    bits = collections.Counter(b for g in grams for b in range(64) if xxhash.xxh64_intdigest(g.encode(), 42) >> b & 1)
    return sum(1 << b for b, c in bits.items() if 2 * c > len(grams))


def groups_of(points):
    """By comparing all: the smallest id that each place of (id, fingerprint) reaches."""
    parent = list(range(len(points)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (_, a) in enumerate(points):
        for j, (_, b) in enumerate(points[:i]):
            if (a ^ b).bit_count() <= 2:
                parent[top(i)] = top(j)
    least = {}
    for i, (own, _) in enumerate(points):
        if own is not None:
            least[top(i)] = min(least.get(top(i), own), own)
    return [least.get(top(i)) for i in range(len(points))]


def test_simhash_by_brute_force(spark, sf_dir):
    texts = [(r["doc_id"], r["text"]) for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    points = [(i, plain_fingerprint(t)) for i, t in texts]
    want = {(i, f"{p:016x}", c) for (i, p), c in zip(points, groups_of(points))}
    assert {tuple(r) for r in QUERIES["op12_simhash"](spark, sf_dir).collect()} == want


@pytest.mark.parametrize("block", [simhash.BLOCK, 3])
def test_anchors_lose_no_link(spark, monkeypatch, block):
    """Points around a few centres, at one to five differing bits, in blocks of any size."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = np.random.default_rng(12)
    points = {0, 1 << 63, (1 << 64) - 1}
    for centre in rng.integers(0, 1 << 63, 12).tolist():
        for _ in range(25):
            points.add(centre ^ sum({1 << int(b) for b in rng.integers(0, 64, rng.integers(0, 6))}))
    points = sorted(points)
    signed = [(int(np.uint64(p).astype(np.int64)),) for p in points]
    scratch = Scratch(spark, "test")
    found = simhash.links(spark.createDataFrame(signed, "point long"), scratch)
    comp = {int(np.int64(r["node"]).astype(np.uint64)): r["comp"] for r in components(spark, found, scratch).collect()}
    want = groups_of([(i, p) for i, p in enumerate(points)])
    groups = collections.defaultdict(set)
    for p, top in zip(points, want):
        groups[top].add(p)
    for members in groups.values():
        assert len({comp.get(p) for p in members}) == 1 and (len(members) > 1) == (min(members) in comp)
    assert len({comp[p] for p in comp}) == sum(len(m) > 1 for m in groups.values())


def test_dense_group_leaves_few_links(spark):
    """All 2,081 points within two bits of one: links grow with the points, not with their pairs."""
    near = {0} | {1 << a | 1 << b for a in range(64) for b in range(64)}
    scratch = Scratch(spark, "test")
    found = simhash.links(spark.createDataFrame([(int(np.uint64(p).astype(np.int64)),) for p in near], "point long"), scratch)
    assert found.count() < 20 * len(near)
    assert components(spark, found, scratch).select("comp").distinct().count() == 1


def test_simhash_in_odd_cases(spark):
    docs = documents(spark, None, "", "One two", "one  TWO\n", "Éa b c d", "éa b c d", "one two", ids=[0, 1, 2, 3, 4, 5, None])
    got = {r["doc_id"]: (r["point"] & (2**64 - 1), r["component_id"]) for r in simhash_groups(docs).collect()}
    assert got[0] == got[1] == (0, 0)
    assert got[2] == got[3] == got[None] == (xxhash.xxh64_intdigest(b"one two", 42), 2)
    assert got[4][0] == plain_fingerprint("Éa b c d") != got[5][0] and got[4][1] == 4 and got[5][1] == 5
    twice = docs.union(docs)
    assert simhash_groups(twice).count() == 14 and simhash_groups(docs.limit(0)).count() == 0
    assert simhash_groups(documents(spark, "a b c", ids=[None])).first()["component_id"] is None
    kept = keep_one_of_each_group(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {0, 2, 4, 5, None}
    long = " ".join(str(i) for i in range(200_000))
    assert simhash_groups(documents(spark, long)).first()["point"] & (2**64 - 1) == plain_fingerprint(long)


def plain_ranks(docs, items, k=10):
    def terms(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))

    counted = [(i, collections.Counter(terms(t))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    n, length = len(counted), sum(c.total() for _, c in counted)
    df = collections.Counter(t for _, c in counted for t in c)
    asked = collections.defaultdict(collections.Counter)
    for i, t in items:
        asked[i].update(terms(t))
    for item, query in asked.items():
        found = []
        for i, c in counted:
            m = 25 + 75 * c.total() * n // length
            score = sum(times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, times in query.items() if t in c)
            if score > 0 and i is not None:
                found.append((-score, i))
        yield from ((item, rank, i, -s) for rank, (s, i) in enumerate(sorted(found)[:k], 1))


@pytest.mark.parametrize("pairs, tile", [(lexical.ROUND, lexical.ITEM_TILE), (500, 3)])
def test_ranks_by_brute_force(spark, sf_dir, monkeypatch, pairs, tile):
    """Also in several rounds, and with narrow item tiles."""
    monkeypatch.setattr(lexical, "ITEM_TILE", tile)
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    got = {tuple(r) for r in ranked_search(docs, items, round_pairs=pairs).collect()}
    assert got == set(plain_ranks([tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in items.select("item_id", "text").collect()]))


def test_ranks_in_odd_cases(spark):
    texts = [(0, None), (1, ""), (2, "a b c"), (3, "A-b c!"), (3, "a b c"), (None, "a a a"), (4, "é ÉCLAIR 12"), (5, "x " * 300_000 + "a"), (6, "z q"), (7, "z z z"), (8, "y" * 1_200_000)]
    docs = spark.createDataFrame([(i, t, 1, "w") for i, t in texts], "doc_id long, text string, item int, score string")
    items = [(1, "a b"), (1, "c a"), (2, None), (None, "É 12"), (3, "nowhere"), (4, "a " * 5000)]
    asked = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, rank int")
    got = [tuple(r) for r in ranked_search(docs, asked, k=2).collect()]
    assert sorted(got, key=str) == sorted(plain_ranks(texts, items, 2), key=str)
    assert [r for r in sorted(got, key=str) if r[0] == 1][0][2] == 2 and {r[0] for r in got} == {1, None, 4}
    assert ranked_search(docs.limit(0), asked).count() == 0 and ranked_search(docs, asked.limit(0)).count() == 0


def test_products_are_exact_beyond_53_bits():
    rng = np.random.default_rng(13)
    impacts = rng.integers(0, 1 << 40, (20, 300))
    impacts[:, 7] = rng.integers(1 << 50, 1 << 52, 20)
    times = rng.integers(0, 1000, (300, 5))
    assert (product(impacts.astype(np.float64), times.astype(np.float64)) == impacts @ times).all()


def test_stand_in_input_of_periodic_runs(spark, sf_dir):
    """The stand-in input repeats a document's own words and changes no other."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    made = {r["doc_id"]: r["text"] for r in with_periodic_words(docs).collect()}
    for r in docs.withColumn("h", F.crc32(F.col("doc_id").cast("string"))).collect():
        words = WORD.findall(r["text"])
        if r["h"] % 10 or not words:
            assert made[r["doc_id"]] == r["text"]
            continue
        g, n = r["h"] // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        assert made[r["doc_id"]] == " ".join(w if i < a else words[a + (i - a) % p] for i, w in enumerate(words))
