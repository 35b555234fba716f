"""Repeats: copies of whole texts, long texts, missing ids, many buckets; the plan and the catalog."""

import hashlib

import numpy as np

from tillwise.llm import repeats
from tillwise.llm.repeats import remove_repeats

DOCS = "doc_id long, text string, h long, hashes string"


def report(rows):
    """Plain form of the job: [(doc_id, bytes, removed, runs, kept)], sorted; ``rows`` hold no two ids that are equal but for equal texts and nulls."""
    seen, out = {}, []
    for i, text in sorted(((i, t) for i, t in rows if i is not None), key=lambda r: r[0]):
        data = (text or "").encode()
        covered = np.zeros(len(data) + 1, np.int32)
        grams = [data[k : k + 50] for k in range(len(data) - 49)]
        for k, g in enumerate(grams):
            if seen.get(g, i) < i:
                covered[k : k + 50] = 1
        for g in grams:
            seen.setdefault(g, i)
        out.append((i, data, covered[:-1].astype(bool)))
    out += [(None, (t or "").encode(), np.zeros(len((t or "").encode()), bool)) for i, t in rows if i is None]
    lines = []
    for i, data, gone in out:
        kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
        runs = int((gone & ~np.append(False, gone[:-1])[: len(gone)]).sum())
        lines.append((i, len(data), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(lines, key=str)


def found(spark, rows, parts=5):
    frame = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], DOCS).repartition(parts)
    return sorted((tuple(r) for r in remove_repeats(frame).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=str)


def made(rng, n):
    return "".join(rng.choice(list("abcdé"), n))


def test_copies_passages_and_missing_ids(spark, monkeypatch):
    """Exact copies in groups of two to many, passages they share with others, rows that share id and text, null ids, one bucket for few bytes."""
    rng = np.random.default_rng(5)
    passages = [made(rng, n) for n in (30, 49, 50, 51, 90, 200)]
    texts = []
    for _ in range(60):
        parts = [made(rng, int(rng.integers(0, 80))) for _ in range(4)]
        texts.append("".join(x for p in parts for x in (p, passages[rng.integers(0, len(passages))])))
    texts += [None, "", "short", made(rng, 49), made(rng, 50)]
    rows = [(int(i), t) for i, t in enumerate(texts * 2 + texts[:3] * 30)]
    rows = [(i * 7919 % 1009, t) for i, t in rows]
    rows += [rows[0], rows[100], (None, texts[0]), (None, texts[0]), (None, None)]
    want = report(rows)
    assert found(spark, rows) == want
    monkeypatch.setattr(repeats, "BUCKET", 2000)
    assert found(spark, rows) == want


def test_long_texts(spark):
    """Texts of over 1 MiB, cut in parts, with passages over the cuts; a word of over 1 MiB."""
    rng = np.random.default_rng(6)
    long = rng.integers(97, 123, 1_300_000, dtype=np.uint8).tobytes().decode()
    edge = 1 << 20
    rows = [
        (5, long),
        (1, "x" * 60 + long[edge - 200 : edge + 200]),
        (2, long[edge - 120 : edge - 60] + " " + long[-70:]),
        (7, long[:80] + "-" + long[edge - 30 : edge + 30] + "-" + long[edge + 10 : edge + 59]),
        (9, long[1000:] + "end"),
        (8, "z" * 1_100_000),
        (10, "z" * 50),
    ]
    assert found(spark, rows) == report(rows)


def test_texts_are_not_moved_again_and_no_table_stays(spark):
    before = {t.name for t in spark.catalog.listTables()}
    frame = spark.createDataFrame([(i, f"{i} " * 40, 1, "x") for i in range(50)], DOCS)
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    usual = spark.conf.get(threshold)
    try:
        spark.conf.set(threshold, "-1")
        out = remove_repeats(frame)
        plan = out._jdf.queryExecution().executedPlan().treeString()
    finally:
        spark.conf.set(threshold, usual)
    assert {t.name for t in spark.catalog.listTables()} == before
    assert out.count() == 50
    assert "Bucketed: true" in plan
