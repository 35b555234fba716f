"""Periodic runs of words: sparse diagonal dynamic programming over lags.

A run is a stretch of words with smallest period q (words q apart are equal) of at
least ``least`` and 2 q words that no neighbouring word extends. In the table of
all word pairs (i, i - q) it is a stretch of a diagonal, the lag q, of at least
``max(least - q, q)`` matches.

Only diagonals that can get so long are opened. A lag between m and 2 m needs m
matches on end, so what is looked up for a word is the m words from it on: their
earlier occurrences at such a lag open the diagonal, unless the words before agree
as well (then it is open already). Its match length is not counted up one by one
but put together from the powers of two that its grams of 1, 2, 4 ... words agree in;
diagonals of sufficient length are emitted, the shortest lag of each stretch being
its period. m doubles as long as any m words occur twice. Lags under ``FIRST`` are
followed word by word.

This is the sparse table taken m words at a time: to add to the lag of each earlier
occurrence of each single word is square in a frequent word. Here m words that overlap
their own earlier occurrences are passed over as one block of equal left words, so
that a text of one word, too, takes time in proportion to n log n.

Documents are independent: no shuffle, a lost task is run again. A task holds one
slice of texts (``SLICE`` bytes, or one longer text) with one number per word and
doubling. Grams are compared by 64 bits of hash; the words of each emitted run are
compared themselves.

Defined results
* words are what stands between blanks (space, tab to carriage return), case kept;
* null, empty or blank text: no words, no runs, empty collapsed text;
* words are compared by their bytes and handed on as they are, also bytes that are no UTF-8;
* rows are handled one by one, so repeated rows or ids give repeated results and a
  null id is kept; an empty table gives no rows; extra columns are not looked at;
* a text of any length is one unit: runs are found across its whole length.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import compress, count

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST = 12
FIRST = 8  # a power of two
SLICE = 2_000_000
WEIGHT = np.uint64(0x9E3779B97F4A7C15)
RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit numbers whose bits depend on all bits of ``x``."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(32))


def short_lags(words: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(start, end, lag) of the long stretches on the diagonals under FIRST."""
    for lag in range(1, min(FIRST, len(words))):
        same = np.zeros(len(words) - lag + 2, dtype=np.int8)
        same[1:-1] = words[lag:] == words[:-lag]
        edges = np.flatnonzero(np.diff(same))
        start, stop = edges[::2], edges[1::2]
        long = stop - start >= max(least - lag, lag)
        yield start[long], stop[long] + lag, np.full(long.sum(), lag)


def openings(at: np.ndarray, group: np.ndarray, left: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of one group with m <= i - j < 2 m and other words on their left.

    ``at``: places sorted by group and place; ``left``: the word before each. Blocks of
    neighbours with equal left words are passed over as a whole.
    """
    width = int(at.max()) + 2 * m + 1
    key = group * width + at
    low = np.searchsorted(key, group * width + np.maximum(at - 2 * m + 1, 0))
    high = np.searchsorted(key, key - m, side="right")
    first = np.flatnonzero(np.concatenate(([True], (group[1:] != group[:-1]) | (left[1:] != left[:-1]))))
    block = np.searchsorted(first, np.arange(len(at)), side="right") - 1
    ends = np.append(first, len(at))
    open_ = np.flatnonzero((low < high) & (first[block] > low))
    mine, other = [], []
    back = 1
    while len(open_):
        earlier = block[open_] - back
        begin = np.maximum(low[open_], first[earlier])
        size = np.minimum(high[open_], ends[earlier + 1]) - begin
        size[left[first[earlier]] == left[open_]] = 0
        size = np.maximum(size, 0)
        mine.append(np.repeat(open_, size))
        other.append(np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum()))
        open_ = open_[first[earlier] > low[open_]]
        back += 1
    if not mine:
        return at[:0], at[:0]
    return at[np.concatenate(mine)], at[np.concatenate(other)]


def agreement(i: np.ndarray, j: np.ndarray, grams: list[np.ndarray]) -> np.ndarray:
    """How many words from i on equal those from j < i on; grams[k]: a number for the 2^k words from each place on."""
    length = np.zeros(len(i), dtype=np.int64)
    for k in range(len(grams) - 1, -1, -1):
        if len(grams[k]):
            there, last = i + length, len(grams[k]) - 1
            same = (there <= last) & (grams[k][np.minimum(there, last)] == grams[k][np.minimum(j + length, last)])
            length += same.astype(np.int64) << k
    return length


def long_lags(words: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(start, end, lag) of the long stretches on the diagonals from FIRST on."""
    grams, m = [mixed(words.astype(np.uint64))], 1

    def double() -> None:
        h = grams[-1]
        grams.append(mixed(h[: max(len(h) - m, 0)] * WEIGHT + h[m:]))

    while m < FIRST:
        double()
        m *= 2
    pairs = []
    at = np.arange(len(grams[-1]))
    while len(at):
        h = grams[-1][at]
        order = np.argsort(h, kind="stable")
        at, h = at[order], h[order]
        group = np.cumsum(np.concatenate(([0], h[1:] != h[:-1])))
        again = np.bincount(group)[group] > 1
        at, group = at[again], group[again]
        if not len(at):
            break
        pairs.append(openings(at, group, np.where(at > 0, words[at - 1], -1), m))
        double()
        known = np.zeros(len(words), dtype=bool)
        known[at] = True
        at = np.sort(at)
        at = at[at < len(grams[-1])]
        at = at[known[at + m]]
        m *= 2
    for i, j in pairs:
        length = agreement(i, j, grams)
        lag = i - j
        long = length >= np.maximum(least - lag, lag)
        yield j[long], (i + length)[long], lag[long]


def runs_of(words: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths and periods of all runs, by start, then period. ``words``: a number per word, -1 not among them."""
    start, end, lag = (np.concatenate(x) for x in zip((np.zeros(0, np.int64),) * 3, *short_lags(words, least), *long_lags(words, least)))
    order = np.lexsort((lag, end, start))
    start, end, lag = start[order], end[order], lag[order]
    # a stretch has its smallest period and multiples of it
    least_lag = np.concatenate(([True], (start[1:] != start[:-1]) | (end[1:] != end[:-1])))[: len(start)]
    true = [keep and bool((words[s : e - q] == words[s + q : e]).all()) for keep, s, e, q in zip(least_lag.tolist(), start.tolist(), end.tolist(), lag.tolist())]
    start, end, lag = start[true], end[true], lag[true]
    order = np.lexsort((lag, start))
    return start[order], (end - start)[order], lag[order]


def collapsed(texts: list[bytes | None], least: int) -> tuple[pa.Array, pa.Array]:
    """The texts without the repeats of their runs, and the runs (word numbers of their text)."""
    number: dict[bytes, int] = defaultdict(count(len(texts)).__next__)
    split = [(t or b"").split() for t in texts]
    sizes = np.array([len(w) for w in split])
    ends = np.cumsum(sizes + 1)
    begins = ends - sizes - 1
    words = np.empty(int(ends[-1]), dtype=np.int64)
    for k, (one, begin) in enumerate(zip(split, begins.tolist())):
        words[begin : begin + len(one)] = np.fromiter(map(number.__getitem__, one), np.int64, len(one))
        words[begin + len(one)] = k  # a word of its own ends each text, so nothing runs on into the next
    start, length, period = runs_of(words, least)
    step = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(step, start + period, 1)
    np.add.at(step, start + length, -1)
    kept = np.cumsum(step)[:-1] == 0
    of = np.searchsorted(begins, start, side="right") - 1
    with_runs = set(of.tolist())
    out = [b" ".join(compress(w, kept[b : b + len(w)].tolist()) if k in with_runs else w) for k, (w, b) in enumerate(zip(split, begins.tolist()))]
    places = np.searchsorted(of, np.arange(len(texts) + 1)).astype(np.int32)
    found = pa.StructArray.from_arrays([pa.array(start - begins[of]), pa.array(length), pa.array(period)], ["start", "length", "period"])
    return pa.array(out, pa.binary()).view(pa.string()), pa.ListArray.from_arrays(pa.array(places), found).cast(RUNS)


def slices(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold up to SLICE bytes together, or one row."""
    begin, held = 0, 0
    for i, size in enumerate(sizes):
        if i > begin and held + size > SLICE:
            yield begin, i
            begin, held = i, 0
        held += size
    if begin < len(sizes):
        yield begin, len(sizes)


def collapse_runs(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """Rows doc_id, text (words joined by one space, of each run its first period) and runs (start, length, period; by start, then period)."""
    docs = documents.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = batch.column(1).cast(pa.binary())
            lengths = [0 if x is None else x for x in pa.compute.binary_length(data).to_pylist()]
            for begin, end in slices(lengths):
                text, runs = collapsed(data[begin:end].to_pylist(), least)
                yield pa.RecordBatch.from_arrays([batch.column(0)[begin:end], text, runs], ["doc_id", "text", "runs"])

    return docs.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, text string, runs array<struct<start: bigint, length: bigint, period: bigint>>")
