"""Benchmark decontamination: windows of benchmark words found in training texts.

Native: DataFrame functions only. A text is cut into words once; blocks of words
at fixed distances are looked up in the set of benchmark blocks, and only texts
with a hit are scanned window by window.

Why no occurrence is lost: a window of m words that starts anywhere in a text
holds a whole block of b = (m + 1) // 2 words whose first word has a place
divisible by b, as 2b - 1 <= m. So one look-up per b words is enough.

Defined results
* null or wordless text: n_words 0, nothing hit, not contaminated;
* null or wordless benchmark items have no window; an empty benchmark hits nothing;
* each input row is judged by itself: repeated rows give repeated results, and
  rows that share an id but not a text keep their own figures;
* item ids of equal items are all reported; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.llm.common import ascii_lower, fresh, Scratch

WINDOW = 13
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# A broadcast look-up table has at most this many rows (of 8 bytes and a short text); beyond it both sides are shuffled.
BROADCAST_ROWS = 200_000


def words(text: Column) -> Column:
    """Lower-cased words; an empty array for null."""
    return F.array_remove(F.split(F.coalesce(ascii_lower(text), F.lit("")), NO_WORD), "")


def grams(array: Column, length: int, step: int = 1) -> Column:
    """Hashes of the runs of ``length`` words that start at 0, step, 2 step ..."""
    starts = F.when(F.size(array) >= length, F.sequence(F.lit(0), F.size(array) - length, F.lit(step)))
    return F.transform(F.coalesce(starts, F.array().cast("array<int>")), lambda i: F.xxhash64(F.slice(array, i + 1, length)))


def benchmark_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Rows (m, gram, gram_hash, item_id): the distinct windows of each item."""
    items = benchmark.select(F.col(f"`{id_col}`").alias("item_id"), words(F.col(f"`{text_col}`")).alias("w"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)))
    runs = items.where(F.size("w") > 0).select("item_id", "w", F.explode(starts).alias("i"))
    runs = runs.select("item_id", F.slice("w", F.col("i") + 1, window).alias("run"))
    return runs.select(
        "item_id", F.size("run").alias("m"), F.array_join("run", " ").alias("gram"), F.xxhash64("run").alias("gram_hash"), "run"
    ).dropDuplicates(["item_id", "gram"])


def look_up(df: DataFrame, right: DataFrame, keys: list[str], how: str, rows: int) -> DataFrame:
    """Join with a table of benchmark size: broadcast if it is known to be small."""
    return df.join(F.broadcast(right) if rows <= BROADCAST_ROWS else right.hint("shuffle_hash"), keys, how)


def find_hits(docs: DataFrame, windows: DataFrame, lengths: list[int], rows: int) -> DataFrame:
    """Rows (doc_id, text_hash, at, m, gram) for each place where a window occurs. ``docs``: doc_id, text_hash, text."""
    cut = docs.select("doc_id", "text_hash", words(F.col("text")).alias("w"))
    known = windows.select("gram", "gram_hash", "m").distinct()
    found = None
    for m in lengths:
        own = F.transform(grams(F.col("w"), m), lambda h, i: F.struct(h.alias("gram_hash"), F.array_join(F.slice("w", i + 1, m), " ").alias("own")))  # noqa: B023
        at = cut.select("doc_id", "text_hash", F.posexplode(own).alias("at", "run")).select("doc_id", "text_hash", "at", "run.*")
        one = look_up(at, known.where(F.col("m") == m), ["gram_hash"], "inner", rows)
        one = one.where(F.col("own") == F.col("gram")).drop("own")  # equal hashes may be of other words
        found = one if found is None else found.unionByName(one)
    return found


def decontamination_report(
    documents: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    share: int = 20,
) -> DataFrame:
    """Rows doc_id, text_hash, n_words, n_hit, n_items, item_ids, spans, contaminated.

    ``spans``: the hit runs of words as (start, end), not overlapping, in order;
    ``contaminated``: some word is hit and share * n_hit >= n_words.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "decontaminate")
    windows = scratch.keep(benchmark_windows(benchmark, item_id, item_text, window), "windows")
    count = windows.groupBy("m").count().collect()  # at most `window` rows
    lengths, rows = sorted(r["m"] for r in count), sum(r["count"] for r in count) * (window // 2 + 1)
    text = F.col(f"`{text_col}`")
    docs = documents.select(F.col(f"`{id_col}`").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))
    sizes = sorted({(m + 1) // 2 for m in lengths})
    cut = docs.select("doc_id", "text_hash", words(F.col("text")).alias("w"))
    blocks = [grams(F.col("w"), b, b).alias(f"b{b}") for b in sizes]
    base = scratch.keep(cut.select("doc_id", "text_hash", F.size("w").cast("long").alias("n_words"), *blocks), "blocks")
    empty = spark.createDataFrame([], f"doc_id {dict(base.dtypes)['doc_id']}, text_hash long, n_hit long, n_items long, "
                                      f"item_ids array<{dict(windows.dtypes)['item_id']}>, spans array<struct<start:int,end:int>>")
    hits = empty
    if lengths:
        own = None
        for b in sizes:
            ms = [m for m in lengths if (m + 1) // 2 == b]
            known = windows.where(F.col("m").isin(ms)).select(F.explode(grams(F.col("run"), b)).alias("h")).distinct()
            one = look_up(base.select("doc_id", "text_hash", F.explode(f"b{b}").alias("h")), known, ["h"], "left_semi", rows)
            own = one if own is None else own.unionByName(one)
        own = own.select("doc_id", "text_hash").distinct()
        same = docs["doc_id"].eqNullSafe(own["doc_id"]) & (docs["text_hash"] == own["text_hash"])
        found = find_hits(docs.join(own, same, "left_semi").distinct(), windows, lengths, rows)
        found = scratch.keep(found, "hits")
        # merge overlapping windows of a text: sorted places, then one pass over them
        spans = F.sort_array(F.collect_list(F.struct(F.col("at").alias("start"), (F.col("at") + F.col("m")).alias("end"))))
        merged = found.groupBy("doc_id", "text_hash").agg(spans.alias("s"))
        last = lambda a: F.element_at(a, -1)
        start = F.array().cast("array<struct<start:int,end:int>>")
        joined = F.aggregate(
            "s",
            start,
            lambda a, x: F.when(
                (F.size(a) > 0) & (F.coalesce(last(a)["end"], F.lit(-1)) >= x["start"]),
                F.concat(
                    F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))),
                    F.array(F.struct(last(a)["start"].alias("start"), F.greatest(last(a)["end"], x["end"]).alias("end"))),
                ),
            ).otherwise(F.concat(a, F.array(x))),
        )
        merged = merged.select("doc_id", "text_hash", joined.alias("spans"))
        merged = merged.withColumn("n_hit", F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + (x["end"] - x["start"]).cast("long")))
        items = look_up(found.select("doc_id", "text_hash", "gram").distinct(), windows.select("gram", "item_id"), ["gram"], "inner", rows)
        items = items.groupBy("doc_id", "text_hash").agg(F.collect_set("item_id").alias("item_ids"))
        both = merged["doc_id"].eqNullSafe(items["doc_id"]) & (merged["text_hash"] == items["text_hash"])
        hits = merged.join(items, both).select(
            merged["doc_id"], merged["text_hash"], "n_hit", F.size("item_ids").cast("long").alias("n_items"), "item_ids", "spans"
        )
    left = base.select("doc_id", "text_hash", "n_words")
    both = left["doc_id"].eqNullSafe(hits["doc_id"]) & (left["text_hash"] == hits["text_hash"])
    zero = lambda c: F.coalesce(hits[c], F.lit(0).cast("long")).alias(c)
    out = left.join(hits, both, "left").select(
        left["doc_id"], left["text_hash"], "n_words", zero("n_hit"), zero("n_items"),
        F.coalesce(hits["item_ids"], F.array().cast(dict(hits.dtypes)["item_ids"])).alias("item_ids"),
        F.coalesce(hits["spans"], F.array().cast(dict(hits.dtypes)["spans"])).alias("spans"),
    )
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Take whole documents out that the rule of ``decontamination_report`` calls contaminated; the rest as it was."""
    bad = decontamination_report(documents, benchmark, id_col, text_col, **options).where("contaminated")
    own_id, own_hash = fresh(documents, "__own_id"), fresh(documents, "__own_hash")
    bad = bad.select(F.col("doc_id").alias(own_id), F.col("text_hash").alias(own_hash))
    same = F.col(f"`{id_col}`").eqNullSafe(F.col(own_id)) & (F.xxhash64(F.col(f"`{text_col}`")) == F.col(own_hash))
    return documents.join(bad, same, "left_anti")
