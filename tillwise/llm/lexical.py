"""Ranked lexical search: benchmark items against all documents, by dense blocked multiplication.

The score of a document is a sum over the item's terms of an integer impact, so all
items against a block of documents is one product of two matrices: documents x terms
(impacts) times terms x items (how often the item has the term).

1. One pass over the documents turns each into the numbers and counts of the items'
   terms in it, and its length: a table in the shared folder. Document frequencies,
   the number of documents and their total length are sums over that table.
2. A task takes ``DOC_TILE`` documents at a time, keeps the terms that occur in them,
   fills the dense impact tile, and multiplies it by item tiles of ``ITEM_TILE`` columns.
   Multiplication is BLAS's in float64; the terms are cut into pieces whose possible
   sum stays under 2^52, so each partial sum is an exact integer, and pieces are
   added as 64-bit integers. A single term that could pass the bound is multiplied in integers.
3. Of each tile a task keeps, per item, the k best by (score, smaller id); ties at the
   k-th score are ordered by id before the cut. Tasks' lists meet in one ranking per item.

Bounded: items go in rounds of about ``ROUND`` (item, term) pairs, chosen by a hash of
the id; only one round's pairs are collected and broadcast. Every document meets every item.

Defined results
* terms are maximal runs of ASCII letters, digits and characters beyond ASCII, A-Z in lower case;
* documents without terms (null or empty text) count for nothing and are in no list;
* rows that share an item id are one item with the terms of all of them; a null item id is an id;
* rows that share a document id are documents of their own; one without an id counts in
  all statistics but is not listed;
* fewer than k documents with a score above zero: all of them; an empty table: no rows;
* texts of any length count whole; columns are taken by name, extra ones are not looked at.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillwise.llm.common import Scratch

TOP = 10
DOC_TILE, ITEM_TILE = 512, 256
ROUND = 1 << 20
EXACT = float(1 << 51)
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def term_counts(text: bytes | None) -> Counter[bytes]:
    return Counter((text or b"").translate(TERM_BYTES).split())


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows item_id, term, times."""
    own = items.select(F.col(f"`{id_col}`").alias("item_id"), F.col(f"`{text_col}`").alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text in enumerate(batch.column(1).cast(pa.binary())):
                found = term_counts(text.as_py())
                ids = pa.array([batch.column(0)[row].as_py()] * len(found), batch.column(0).type)
                yield pa.RecordBatch.from_arrays([ids, pa.array(found.keys(), pa.binary()), pa.array(found.values(), pa.int64())], ["item_id", "term", "times"])

    counted = own.mapInArrow(run, f"item_id {dict(own.dtypes)['item_id']}, term binary, times long")
    return counted.groupBy("item_id", "term").agg(F.sum("times").alias("times"))


def counted(documents: DataFrame, number, id_col: str, text_col: str) -> DataFrame:
    """Rows doc_id, n, terms, tfs: of each document with terms its length, and the counts of known terms. ``number``: broadcast dict."""
    own = documents.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = number.value
        for batch in batches:
            n, size, terms, tfs = [], [0], [], []
            for text in batch.column(1).cast(pa.binary()):
                found = term_counts(text.as_py())
                n.append(found.total())
                both = known.keys() & found.keys()
                terms.extend([known[t] for t in both])
                tfs.extend([found[t] for t in both])
                size.append(len(terms))
            offsets = pa.array(size, pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x, kind)) for x, kind in ((terms, pa.int32()), (tfs, pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), *lists], ["doc_id", "n", "terms", "tfs"])

    return own.mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<long>").where("n > 0")


def document_frequencies(rows: DataFrame, size: int) -> np.ndarray:
    """In how many documents each of the ``size`` terms occurs."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype=np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(), minlength=size)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["term", "df"])

    out = np.zeros(size, dtype=np.int64)
    for r in rows.select("terms").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toLocalIterator():
        out[r["term"]] = r["df"]
    return out


def weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], dtype=np.int64)


class Items:
    """The terms x items matrix of one round, by term; columns are cut into tiles."""

    def __init__(self, term: np.ndarray, item: np.ndarray, times: np.ndarray, terms: int, items: int) -> None:
        order = np.lexsort((item, term))
        self.item, self.times, self.items = item[order], times[order], items
        self.begin = np.searchsorted(term[order], np.arange(terms + 1))

    def tiles(self, used: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(first column, dense tile) over the rows of the terms ``used``."""
        size = self.begin[used + 1] - self.begin[used]
        at = np.repeat(self.begin[used] - np.cumsum(size) + size, size) + np.arange(size.sum())
        row, item, times = np.repeat(np.arange(len(used)), size), self.item[at], self.times[at]
        for first in range(0, self.items, ITEM_TILE):
            some = (item >= first) & (item < first + ITEM_TILE)
            tile = np.zeros((len(used), min(ITEM_TILE, self.items - first)))
            tile[row[some], item[some] - first] = times[some]
            yield first, tile


def product(impacts: np.ndarray, tile: np.ndarray) -> np.ndarray:
    """impacts @ tile in exact 64-bit integers; both hold integers as float64."""
    most = impacts.max(axis=0) * tile.max(axis=1)
    large = most >= EXACT
    piece = np.floor(np.cumsum(np.where(large, 0.0, most)) / EXACT)
    out = np.zeros((len(impacts), tile.shape[1]), dtype=np.int64)
    for p in np.unique(piece[~large]):
        some = np.flatnonzero((piece == p) & ~large)
        some = slice(some[0], some[-1] + 1) if len(some) == some[-1] + 1 - some[0] else some
        out += (impacts[:, some] @ tile[some]).astype(np.int64)  # under 2^52: exact in any order
    for t in np.flatnonzero(large):
        out += impacts[:, t].astype(np.int64)[:, None] * tile[t].astype(np.int64)[None, :]
    return out


def k_best(item: np.ndarray, doc: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Which rows are among the k best of their item, by score, then smaller id."""
    order = np.lexsort((doc, -score, item))
    item = item[order]
    first = np.searchsorted(item, item)
    return order[np.arange(len(item)) - first < k]


def searched(rows: DataFrame, shared, n_docs: int, length: int, k: int) -> DataFrame:
    """Rows item (number), doc_id, score: the k best of each task. ``shared``: broadcast (Items, weights)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weight = shared.value
        best = tuple(np.zeros(0, dtype=np.int64) for _ in range(3))  # item, doc, score
        limit = np.zeros(items.items, dtype=np.int64)  # lower scores can't be among the k best
        for batch in (b.slice(at, DOC_TILE) for b in batches for at in range(0, b.num_rows, DOC_TILE)):
            terms, tfs = batch.column(2).flatten().to_numpy(), batch.column(3).flatten().to_numpy()
            if not len(terms):
                continue
            doc = np.repeat(np.arange(batch.num_rows), batch.column(2).value_lengths().to_numpy())
            m = np.array([25 + 75 * n * n_docs // length for n in batch.column(1).to_pylist()], dtype=np.int64)
            impact = weight[terms] * ((1_000_000_000 * tfs) // (1000 * tfs + 8 * m[doc]))
            used, place = np.unique(terms, return_inverse=True)
            impacts = np.zeros((batch.num_rows, len(used)))
            impacts[doc, place] = impact
            ids = batch.column(0).to_numpy()
            found = [best]
            for first, tile in items.tiles(used):
                score = product(impacts, tile)
                row, column = np.nonzero((score > 0) & (score >= limit[first : first + tile.shape[1]]))
                found.append((column + first, ids[row], score[row, column]))
            best = tuple(np.concatenate(x) for x in zip(*found))
            kept = k_best(*best, k)
            best = tuple(x[kept] for x in best)
            full = np.bincount(best[0], minlength=items.items) >= k
            last = np.full(items.items, np.iinfo(np.int64).max)
            np.minimum.at(last, best[0], best[2])
            limit = np.where(full, last, 0)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in best], ["item", "doc_id", "score"])

    return rows.mapInArrow(run, "item long, doc_id long, score long")


def ranked_search(
    documents: DataFrame, items: DataFrame, k: int = TOP, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", round_pairs: int = ROUND
) -> DataFrame:
    """Rows item_id, rank (from 1), doc_id, score."""
    spark = documents.sparkSession
    scratch = Scratch(spark, "lexical")
    pairs = scratch.keep(item_terms(items, item_col, item_text), "items")
    rounds = -(-pairs.count() // round_pairs)
    out = spark.createDataFrame([], f"item_id {dict(pairs.dtypes)['item_id']}, rank int, doc_id long, score long")
    for number in range(rounds):
        mine = pairs.where(F.pmod(F.xxhash64("item_id"), F.lit(rounds)) == number).toArrow()  # about round_pairs rows
        if not len(mine):
            continue
        asked, words = mine.column("item_id").to_pylist(), mine.column("term").to_pylist()
        ids = list(dict.fromkeys(asked))
        place, vocabulary = {x: p for p, x in enumerate(ids)}, {t: p for p, t in enumerate(sorted(set(words)))}
        item, term = np.array([place[x] for x in asked]), np.array([vocabulary[t] for t in words])
        rows = scratch.keep(counted(documents, spark.sparkContext.broadcast(vocabulary), id_col, text_col), "documents")
        total = rows.agg(F.count("*").alias("n"), F.sum("n").alias("l")).first()
        if not total["n"]:
            break
        weight = weights(document_frequencies(rows, len(vocabulary)), total["n"])
        shared = spark.sparkContext.broadcast((Items(term, item, mine.column("times").to_numpy(), len(vocabulary), len(ids)), weight))
        found = scratch.keep(searched(rows.where("doc_id IS NOT NULL"), shared, total["n"], total["l"], k), "found")
        rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "doc_id"))
        best = found.withColumn("rank", rank).where(F.col("rank") <= k)
        names = spark.createDataFrame([(p, i) for p, i in enumerate(ids)], f"item long, item_id {dict(pairs.dtypes)['item_id']}")
        ranked = best.join(F.broadcast(names), "item")  # at most round_pairs rows
        out = out.union(ranked.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))
    return out
