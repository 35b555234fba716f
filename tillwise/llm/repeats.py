"""Exact repeats across documents: bytes covered by a 50-byte string of an earlier text.

Suffixes are kept sparsely: of the 50-byte windows of a text, neighbours whose
smallest 20-byte hash is the same form a segment, and the segment stands in the
index by that hash. Equal windows have equal smallest hashes, so a window can only
be repeated where its segment's hash is.

A text that a smaller document has as a whole is removed at once (128 bits of hash)
and neither stored nor indexed: what it could repeat stands in that document too.

1. Each batch of documents becomes a run: its hashes, dealt to buckets. In a bucket
   runs are put in order and go into a logarithmic family: a new run is merge-scanned
   against the sorted levels there are, and levels of equal size merge, so each hash
   is moved a logarithmic number of times. Hashes that met go back to their documents.
   A passage on a third of all documents is one entry per run.
2. Documents list their segments with such a hash. A segment whose whole text begins
   in a smaller document is removed: at once where that lies in the same batch,
   as intervals, the others by one grouping of all batches by hash.
3. Hashes with several segment texts (a repeat that begins or ends inside) are
   settled window by window, for the first document of each text only.

Texts are held once, bucketed by document, so the steps join what they found to the
texts without moving these again. Buckets hold ``BUCKET`` bytes of text on average,
one for each shuffle partition at least; a task sorts the hashes of a fourth of one.

The order of the levels is that of the hashes of the suffixes' leading strings, not
of the bytes: equal strings are neighbours either way, and hashes are dealt evenly.

Defined results
* null or short text (under 50 bytes): nothing removed, nothing found in it;
* rows that share an id never repeat each other, and each keeps its own result;
* rows with a null id are no earlier and no later than others: they keep all their
  bytes and nothing is removed for them;
* texts of over ``CHUNK`` bytes are cut in overlapping parts, with the same result;
* an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillwise.llm.common import Scratch, partitions

LENGTH = 50
GRAM = 20
CHUNK = 1 << 20
BUCKET = 64 << 20
SETTLE = 1 << 18
BASE = 0xD6E8FEB86659FD93
MIX = np.uint64(0xBF58476D1CE4E5B9)


def powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.full(n, base, dtype=np.uint64))


POWERS, BACK = powers(BASE, CHUNK + 1), powers(pow(BASE, -1, 1 << 64), CHUNK + 1)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * MIX
    return x ^ (x >> np.uint64(29))


class Cut:
    """Segments of some texts laid end to end: parallel arrays doc, hash, lo (first window), count (of windows)."""

    def __init__(self, texts: list[bytes], begin: int) -> None:
        data = np.frombuffer(b"".join(texts), dtype=np.uint8)
        lengths = np.array([len(t) for t in texts])
        self.ends = np.cumsum(lengths)
        self.starts = self.ends - lengths
        self.run = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * POWERS[: len(data)], out=self.run[1:])
        n = len(data) - LENGTH + 1
        empty = np.zeros(0, dtype=np.int64)
        self.doc, self.hash, self.lo, self.count = empty, empty.astype(np.uint64), empty, empty
        if n <= 0:
            return
        grams = mixed((self.run[GRAM:] - self.run[:-GRAM]) * BACK[: len(data) - GRAM + 1])
        low, width, wanted = grams, 1, LENGTH - GRAM + 1
        while width * 2 <= wanted:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        low = np.minimum(low[: len(low) - (wanted - width)], low[wanted - width :])  # smallest hash of each window
        doc = np.repeat(np.arange(len(texts)), lengths)[:n]
        valid = np.arange(n) + LENGTH <= self.ends[doc]
        new = np.ones(n, dtype=bool)
        new[1:] = (low[1:] != low[:-1]) | (doc[1:] != doc[:-1]) | (valid[1:] != valid[:-1])
        at = np.flatnonzero(new)
        count = np.diff(np.append(at, n))
        real = valid[at]
        at, self.count = at[real], count[real]
        self.doc, self.hash, self.place = doc[at], low[at], at
        self.lo = at - self.starts[self.doc] + begin

    def strings(self, at: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        """Hashes of the strings of the given length at the given places of the laid-out bytes."""
        return mixed((self.run[at + length] - self.run[at]) * BACK[at])


def cuts(texts: list[str | None]) -> Iterator[tuple[int, Cut]]:
    """Cut texts many at a time: (number of the first text, its cut). Long ones come in overlapping parts."""
    held: list[bytes] = []
    first = room = 0
    for i, text in enumerate(texts):
        data = (text or "").encode("utf-8", "surrogatepass")
        if held and len(data) > room:
            yield first, Cut(held, 0)
            held = []
        if len(data) > CHUNK:
            for at in range(0, len(data) - LENGTH + 1, CHUNK - LENGTH + 1):
                yield i, Cut([data[at : at + CHUNK]], at)
            continue
        if not held:
            first, room = i, CHUNK
        held.append(data)
        room -= len(data)
    if held:
        yield first, Cut(held, 0)


def runs(texts: DataFrame, buckets: int) -> DataFrame:
    """Step 1, batch side. Rows (bucket, run, hashes, docs, met): hashes by document, and those that met within the batch."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.array(batch.column(0).to_pylist(), dtype=np.int64)
            docs, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
            for first, c in cuts(batch.column(1).to_pylist()):
                docs.append(c.doc + first)
                hashes.append(c.hash)
            doc, h = ids[np.concatenate(docs)], np.concatenate(hashes)
            order = np.lexsort((doc, h))
            doc, h = doc[order], h[order]
            fresh = np.ones(len(h), dtype=bool)
            fresh[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
            doc, h = doc[fresh], h[fresh]  # one entry per document and hash
            group = np.ones(len(h), dtype=bool)
            group[1:] = h[1:] != h[:-1]
            size = np.diff(np.append(np.flatnonzero(group), len(h)))
            many = np.repeat(size, size) > 1
            name = uuid.uuid4().hex
            once_h, once_d, met = h[~many], doc[~many], np.unique(h[many])
            back = (met % np.uint64(buckets)).astype(np.int64)
            b = (once_h % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((once_d, b))
            once_h, once_d, b = once_h[order], once_d[order], b[order]
            edge, met_order = np.searchsorted(b, np.arange(buckets + 1)), np.argsort(back, kind="stable")
            met, edge2 = met[met_order], np.searchsorted(back[met_order], np.arange(buckets + 1))
            rows = [
                (k, name, once_h[edge[k] : edge[k + 1]].tobytes(), zlib.compress(np.diff(once_d[edge[k] : edge[k + 1]], prepend=0).astype("<i8").tobytes(), 1), met[edge2[k] : edge2[k + 1]].tobytes())
                for k in range(buckets)
                if edge[k + 1] > edge[k] or edge2[k + 1] > edge2[k]
            ]
            local = pa.array([None] * len(rows), pa.binary())
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([*columns, local], ["bucket", "run", "hashes", "docs", "met", "local"])
            # documents that meet within the batch need no answer from elsewhere
            yield pa.RecordBatch.from_arrays(
                [pa.array([-1], pa.int64()), pa.array([name]), pa.array([h[many].tobytes()], pa.binary()), pa.array([None], pa.binary()), pa.array([None], pa.binary()), pa.array([doc[many].tobytes()], pa.binary())],
                ["bucket", "run", "hashes", "docs", "met", "local"],
            )

    return texts.mapInArrow(run, "bucket long, run string, hashes binary, docs binary, met binary, local binary")


class Family:
    """Sorted levels of hashes; equal-sized levels merge."""

    def __init__(self) -> None:
        self.levels: list[np.ndarray] = []

    def add(self, run: np.ndarray) -> np.ndarray:
        """Put a sorted run in; its hashes that some level holds."""
        met = np.zeros(len(run), dtype=bool)
        for level in self.levels:
            at = np.minimum(np.searchsorted(level, run), len(level) - 1)
            met |= level[at] == run
        self.levels.append(run)
        while len(self.levels) > 1 and len(self.levels[-2]) <= 2 * len(self.levels[-1]):
            last = self.levels.pop()
            self.levels[-1] = np.union1d(self.levels[-1], last)
        return run[met]


def meet(frame: pd.DataFrame) -> pd.DataFrame:
    """Step 1, bucket side: rows (doc_id, hash) of the hashes that runs share."""
    family, met = Family(), [np.frombuffer(x, np.uint64) for x in frame["met"]]
    entries = []
    for _, hashes, docs, own in frame[["run", "hashes", "docs", "met"]].sort_values("run").itertuples(index=False):
        h = np.frombuffer(hashes, np.uint64)
        entries.append((h, np.cumsum(np.frombuffer(zlib.decompress(docs), "<i8"))))
        run = np.unique(np.concatenate([h, np.frombuffer(own, np.uint64)]))
        if len(run):
            met.append(family.add(run))
    shared = np.unique(np.concatenate(met))
    out_h, out_d = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for h, d in entries:
        if len(shared) and len(h):
            there = shared[np.minimum(np.searchsorted(shared, h), len(shared) - 1)] == h
            out_h.append(h[there])
            out_d.append(d[there])
    return pd.DataFrame({"doc_id": np.concatenate(out_d), "hash": np.concatenate(out_h).view(np.int64)})


def local_marks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for hashes, docs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(docs, np.int64)), pa.array(np.frombuffer(hashes, np.int64))], ["doc_id", "hash"])


def segments(marked: DataFrame) -> DataFrame:
    """Step 2. (doc_id, text, hashes, h) to rows (doc_id, h, hash, lo, count, whole): the segments with such a hash.

    Segments that a smaller document of the batch has too come as intervals, with a null hash.
    """
    names = ["doc_id", "h", "hash", "lo", "count", "whole"]

    def settled(parts: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        doc, own, h, lo, count, whole = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((doc, count, whole, h))
        doc, own, h, lo, count, whole = (x[order] for x in (doc, own, h, lo, count, whole))
        head = np.ones(len(h), dtype=bool)
        head[1:] = (h[1:] != h[:-1]) | (whole[1:] != whole[:-1]) | (count[1:] != count[:-1])
        least = doc[np.flatnonzero(head)][np.cumsum(head) - 1]
        later = doc > least
        yield pa.RecordBatch.from_arrays([pa.array(x[~later]) for x in (doc, own, h, lo, count, whole)], names)
        gone = spans(doc[later], own[later], lo[later], lo[later] + count[later] + LENGTH - 1)
        nothing = pa.nulls(len(gone), pa.int64())
        count = gone["end"] - gone["start"] - LENGTH + 1
        yield pa.RecordBatch.from_arrays([pa.array(gone["doc_id"]), pa.array(gone["h"]), nothing, pa.array(gone["start"]), pa.array(count), nothing], names)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.array(batch.column(0).to_pylist(), dtype=np.int64)
            own = np.array(batch.column(3).to_pylist(), dtype=np.int64)
            marks = [np.sort(np.array(m, dtype=np.int64).view(np.uint64)) for m in batch.column(2).to_pylist()]
            parts, total = [], 0
            for first, c in cuts(batch.column(1).to_pylist()):
                keep = np.zeros(len(c.hash), dtype=bool)
                edge = np.searchsorted(c.doc, np.arange(len(c.ends) + 1))
                for d in range(len(c.ends)):
                    m, part = marks[first + d], slice(edge[d], edge[d + 1])
                    if len(m) and part.stop > part.start:
                        keep[part] = m[np.minimum(np.searchsorted(m, c.hash[part]), len(m) - 1)] == c.hash[part]
                if keep.any():
                    whole = c.strings(c.place[keep], c.count[keep] + LENGTH - 1)
                    doc = c.doc[keep] + first
                    parts.append((ids[doc], own[doc], c.hash[keep].view(np.int64), c.lo[keep], c.count[keep], whole.view(np.int64)))
                    total += len(doc)
                if total >= SETTLE:
                    yield from settled(parts)
                    parts, total = [], 0
            if parts:
                yield from settled(parts)

    return marked.mapInArrow(run, "doc_id long, h long, hash long, lo long, count long, whole long")


def windows(asked: DataFrame, buckets: int) -> DataFrame:
    """Step 3, batch side. (doc_id, text, h, places) to rows (bucket, known, one, doc, own, at), as bytes, all but one packed.

    Windows that a smaller document of the batch has too are put together to known intervals
    (one: end, at: start), in any bucket; each window's smallest document of the batch goes on
    to be compared with other batches.
    """
    names = ["bucket", "known", "one", "doc", "own", "at"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, own, places, ones = [], [], [], []
            columns = [batch.column(i).to_pylist() for i in range(4)]
            texts = [(text or "").encode("utf-8", "surrogatepass") for text in columns[1]]
            for doc_id, data, h, asked_here in zip(columns[0], texts, columns[2], columns[3]):
                wanted = np.array([(p["lo"], p["count"]) for p in asked_here if p["h"] == h], dtype=np.int64).reshape(-1, 2)
                if not len(wanted):
                    continue
                at = np.unique(np.repeat(wanted[:, 0], wanted[:, 1]) + np.arange(wanted[:, 1].sum()) - np.repeat(np.cumsum(wanted[:, 1]) - wanted[:, 1], wanted[:, 1]))
                for begin in range(0, len(data), CHUNK - LENGTH + 1):
                    part = at[(at >= begin) & (at < begin + CHUNK - LENGTH + 1)] - begin
                    if len(part):
                        ones.append(window_hashes(data[begin : begin + CHUNK], part))
                        places.append(part + begin)
                        docs.append(np.full(len(part), doc_id, dtype=np.int64))
                        own.append(np.full(len(part), h, dtype=np.int64))
            if not docs:
                continue
            one, doc, h, at = (np.concatenate(x) for x in (ones, docs, own, places))
            later = later_windows(one, doc)
            gone = spans(doc[later], h[later], at[later], at[later] + LENGTH)
            if len(gone):
                blobs = [pa.array([x], pa.binary()) for x in (gone["end"].to_numpy().tobytes(), *(packed(gone[c].to_numpy()) for c in ("doc_id", "h", "start")))]
                yield pa.RecordBatch.from_arrays([pa.array([int(gone["doc_id"][0]) % buckets], pa.int64()), pa.array([True]), *blobs], names)
            one, doc, h, at = (x[~later] for x in (one, doc, h, at))
            bucket = (one % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            found, edge = np.unique(bucket[order], return_index=True)
            parts = np.split(order, edge[1:])
            blobs = [pa.array([one[p].tobytes() for p in parts], pa.binary()), *(pa.array([packed(x[p]) for p in parts], pa.binary()) for x in (doc, h, at))]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array([False] * len(found)), *blobs], names)

    return asked.mapInArrow(run, "bucket long, known boolean, one binary, doc binary, own binary, at binary")


def window_hashes(data: bytes, at: np.ndarray) -> np.ndarray:
    low = np.frombuffer(data, dtype=np.uint8)
    run = np.zeros(len(low) + 1, dtype=np.uint64)
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * POWERS[: len(low)], out=run[1:])
    return mixed((run[at + LENGTH] - run[at]) * BACK[at])


def later_windows(one: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which windows a smaller document has too."""
    order = np.lexsort((doc, one))
    sorted_one, sorted_doc = one[order], doc[order]
    head = np.ones(len(one), dtype=bool)
    head[1:] = sorted_one[1:] != sorted_one[:-1]
    least = sorted_doc[np.flatnonzero(head)][np.cumsum(head) - 1]
    out = np.zeros(len(one), dtype=bool)
    out[order] = sorted_doc > least
    return out


def spans(doc: np.ndarray, own: np.ndarray, start: np.ndarray, end: np.ndarray) -> pd.DataFrame:
    """Intervals as rows (doc_id, h, start, end), those that touch put together; ends are in the order of starts."""
    order = np.lexsort((start, own, doc))
    doc, own, start, end = doc[order], own[order], start[order], end[order]
    new = np.ones(len(start), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (own[1:] != own[:-1]) | (start[1:] > end[:-1])
    begin = np.flatnonzero(new)
    last = np.append(begin[1:], len(start))[: len(begin)] - 1
    return pd.DataFrame({"doc_id": doc[begin], "h": own[begin], "start": start[begin], "end": end[last]})


def intervals(doc: np.ndarray, own: np.ndarray, at: np.ndarray) -> pd.DataFrame:
    """Windows as rows (doc_id, h, start, end), neighbours put together."""
    return spans(doc, own, at, at + LENGTH)


def packed(x: np.ndarray) -> bytes:
    """Whole numbers as their steps, byte by byte: runs of one document and of neighbouring places become short."""
    steps = np.diff(x, prepend=np.int64(0)).astype("<i8")
    return zlib.compress(steps.view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    steps = np.frombuffer(zlib.decompress(data), np.uint8).reshape(8, -1).T
    return np.cumsum(np.ascontiguousarray(steps).view("<i8").ravel())


def numbers(frame: pd.DataFrame) -> list[np.ndarray]:
    """Rows of packed windows or intervals as arrays one, doc, own, at."""
    others = [np.concatenate([np.zeros(0, np.int64), *map(unpacked, frame[n])]) for n in ("doc", "own", "at")]
    return [np.frombuffer(b"".join(frame["one"]), np.uint64), *others]


def compare(frame: pd.DataFrame) -> pd.DataFrame:
    """Step 3, bucket side: the windows of a bucket that a smaller document has too, and the known intervals."""
    known = frame["known"].to_numpy(dtype=bool)
    end, doc, own, start = numbers(frame[known])
    settled = pd.DataFrame({"doc_id": doc, "h": own, "start": start, "end": end.view(np.int64)})
    one, doc, own, at = numbers(frame[~known])
    if not len(one):
        return settled
    later = later_windows(one, doc)
    return pd.concat([settled, intervals(doc[later], own[later], at[later])])


def digest(found: DataFrame) -> DataFrame:
    """(doc_id, text, h, gone: array of h, start, end) to the report's rows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, text, h, gone in zip(*(batch.column(i).to_pylist() for i in range(4))):
                data = (text or "").encode("utf-8", "surrogatepass")
                kept, at, spans = [], 0, 0
                for g in sorted((g for g in gone or [] if g["h"] == h), key=lambda x: x["start"]):
                    if g["start"] > at or not spans:
                        kept.append(data[at : g["start"]])
                        spans += 1
                        at = g["end"]
                    else:
                        at = max(at, g["end"])
                kept.append(data[at:])
                left = b"".join(kept)
                out.append((doc_id, len(data), len(data) - len(left), spans, hashlib.sha256(left).hexdigest(), left))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return found.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def whole_copies(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, int]:
    """Rows doc_id, h, size whose whole text a smaller document has; how many bytes all texts have."""
    text = F.col("text")
    sizes = scratch.keep(docs.select("doc_id", "h", F.xxhash64(F.lit(1), text).alias("g"), F.octet_length(text).cast("long").alias("size")), "sizes")
    groups = sizes.where(F.col("size") >= LENGTH).groupBy("h", "g").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most")
    copies = sizes.join(scratch.keep(groups, "groups"), ["h", "g"]).where("doc_id > least").select("doc_id", "h", "size")
    return scratch.keep(copies, "copies"), sizes.agg(F.sum("size")).first()[0] or 0


def bucketed(docs: DataFrame, scratch: Scratch, n: int) -> DataFrame:
    """The rows in ``n`` buckets by doc_id, in files that no table of the catalog names any more."""
    name = f"repeats_{uuid.uuid4().hex}"
    docs.write.option("compression", "zstd").option("path", scratch.path("texts")).bucketBy(n, "doc_id").sortBy("doc_id").saveAsTable(name)
    held = docs.sparkSession.table(name)
    docs.sparkSession.sql(f"DROP TABLE {name}")
    return held


def remove_repeats(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (bytes)."""
    spark = documents.sparkSession
    scratch = Scratch(spark, "repeats")
    text = F.col(f"`{text_col}`")
    every = documents.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h"))
    docs = every.where("doc_id is not null")
    copies, total = whole_copies(docs, scratch)
    n = max(partitions(spark), -(-total // BUCKET))

    def by(df: DataFrame, key: str) -> DataFrame:
        return df.repartition(n, key)

    left_out = copies.groupBy("doc_id").agg(F.collect_set("h").alias("copied"))
    docs = by(docs, "doc_id").join(left_out, "doc_id", "left").where("copied is null or not array_contains(copied, h)")
    # from here on h only tells apart the texts of one id: a small number, nearly always 1
    docs = docs.withColumn("h", F.dense_rank().over(Window.partitionBy("doc_id").orderBy("h")).cast("long"))
    texts = bucketed(docs.select("doc_id", "text", "h"), scratch, n)
    held = scratch.keep(runs(texts.select("doc_id", "text"), 4 * n), "runs")
    met = by(held.where("bucket >= 0"), "bucket").groupBy("bucket").applyInPandas(meet, "doc_id long, hash long")
    local = held.where("bucket < 0").select("hashes", "local").mapInArrow(local_marks, "doc_id long, hash long")
    marks = by(met.union(local), "doc_id").groupBy("doc_id").agg(F.collect_set("hash").alias("hashes"))
    found = scratch.keep(segments(texts.join(marks, "doc_id").select("doc_id", "text", "hashes", "h")), "segments")
    scratch.drop(held)
    # a segment is either whole in a smaller document, or the first with its text: then it matters whether the hash has others;
    # batches have settled what they hold, so a hot hash has a few rows of each batch
    text_of = F.struct("whole", "count")
    each_hash, each_text = Window.partitionBy("hash"), Window.partitionBy("hash", "whole", "count")
    judged = by(found.where("hash is not null"), "hash").withColumn("least", F.min("doc_id").over(each_text))
    judged = judged.withColumn("several", F.min(text_of).over(each_hash) < F.max(text_of).over(each_hash)).where("doc_id > least or several")
    judged = judged.select("doc_id", "h", "lo", "count", (F.col("doc_id") > F.col("least")).alias("whole"))
    judged = scratch.keep(judged.union(found.where("hash is null").select("doc_id", "h", "lo", "count", F.lit(True))), "judged")
    scratch.drop(found)
    gone = judged.where("whole").select("doc_id", "h", F.col("lo").alias("start"), (F.col("lo") + F.col("count") + LENGTH - 1).alias("end"))
    asked = by(judged.where("not whole"), "doc_id").groupBy("doc_id").agg(F.collect_list(F.struct("h", "lo", "count")).alias("places"))
    each = windows(texts.join(asked, "doc_id").select("doc_id", "text", "h", "places"), 4 * n)
    each = by(each, "bucket").groupBy("bucket").applyInPandas(compare, "doc_id long, h long, start long, end long")
    gone = gone.union(scratch.keep(each, "spans"))
    gone = by(gone, "doc_id").groupBy("doc_id").agg(F.collect_list(F.struct("h", "start", "end")).alias("gone"))
    judged_texts = texts.join(gone, "doc_id", "left").select("doc_id", "text", "h", "gone")
    without_id = every.where("doc_id is null").select("doc_id", "text", "h", F.lit(None).cast(judged_texts.schema["gone"].dataType).alias("gone"))
    empty = F.lit(b"")
    whole = copies.select("doc_id", F.col("size").alias("n_bytes"), F.col("size").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.sha2(empty, 256).alias("kept_sha256"), empty.alias("kept"))
    return digest(judged_texts.union(without_id)).union(whole)
