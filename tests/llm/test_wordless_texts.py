"""Periodic runs as registered, over texts without words and texts whose bytes are no UTF-8."""

import hashlib

import duckdb
from pyspark.sql import functions as F

from tillwise.llm.periodic import collapse_runs
from tillwise.llm.queries import PERIODIC_RUNS_SQL, op11_periodic_runs


def test_texts_without_words_have_no_runs(spark, tmp_path):
    texts = ["", " \t\n", None, "one", "x y z " * 5, "a b c d e f g h i j k l m n o p"]
    rows = [(i, texts[i % len(texts)]) for i in range(120)]  # every tenth or so is to go on in a period, blank ones too
    path = f"{tmp_path}/documents.parquet"
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(path)
    got = sorted((tuple(r) for r in op11_periodic_runs(spark, str(tmp_path)).collect()), key=str)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    assert got == sorted(con.execute(PERIODIC_RUNS_SQL).fetchall(), key=str)
    nothing = hashlib.sha256(b"").hexdigest()
    assert sum(r[1] == 0 and r[6] == r[7] == nothing for r in got) == 60


def test_bytes_that_are_no_utf8_stay(spark):
    raw = [b"\xff\xfe bad \x80 " * 6, b"cut \xe2\x82", b"fine"]
    docs = spark.createDataFrame(list(enumerate(map(bytearray, raw))), "doc_id long, b binary").select("doc_id", F.expr("cast(b AS string)").alias("text"))
    got = {r["doc_id"]: (bytes(r["b"]), [tuple(x) for x in r["runs"]]) for r in collapse_runs(docs).select("doc_id", F.col("text").cast("binary").alias("b"), "runs").collect()}
    assert got == {0: (b"\xff\xfe bad \x80", [(0, 18, 3)]), 1: (b"cut \xe2\x82", []), 2: (b"fine", [])}
