"""Best-fit packing: documents laid end to end in sequences of bounded length.

Hierarchical residual packing. Each document becomes token ids with a closing id;
documents longer than a sequence are cut, and full pieces are sequences by
themselves. The rest is packed in rounds: every partition packs its items best
fit, largest first, and emits bins that are nearly full; underfull bins are items
of the next round, in a sixteenth of the partitions, up to groups of at most
``GROUP`` items. So a task never holds more than its partition or ``GROUP`` items,
whatever the corpus, and only underfull bins are shuffled again (their members'
places, not their ids).

Each round is written to the shared folder, so a lost executor costs a read and
numbers given to sequences stay the same.

Defined results
* null or empty text: one piece that holds the closing id alone;
* rows that share an id are documents of their own, each with pieces from 0;
* an empty table gives no pieces; extra columns are ignored;
* sequence numbers are unique, with gaps.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwise.llm.common import Scratch, partitions
from tillwise.llm.tokens import encoder

CAPACITY = 2048
CLOSING_ID = 0
GROUP = 20_000
FAN_IN = 16
NEARLY_FULL = 0.995


def pieces_of(documents: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, closing_id: int = CLOSING_ID) -> DataFrame:
    """Rows doc_id, piece, start, length, ids_crc32: each document's ids, cut where they pass the capacity."""
    docs = documents.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(vocabulary)
        for batch in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for i, ids in enumerate(tool.encode(batch.column(1).to_pylist())):
                ids = np.append(ids, np.uint32(closing_id))
                for k, at in enumerate(range(0, len(ids), capacity)):
                    part = ids[at : at + capacity]
                    row.append(i)
                    piece.append(k)
                    start.append(at)
                    length.append(len(part))
                    crc.append(zlib.crc32(part.astype("<u4").tobytes()))
            columns = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.mapInArrow(cut, f"doc_id {dict(docs.dtypes)['doc_id']}, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Best fit, largest first: each item goes to the fullest bin that still takes it."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r is set if some bin has room for r more
    for i in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        n = lengths[i]
        fitting = rooms >> n
        if fitting:
            room = n + (fitting & -fitting).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
            bins[b].append(i)
        else:
            room, b = capacity, len(bins)
            bins.append([i])
        left = room - n
        if left:
            by_room[left].append(b)
            rooms |= 1 << left
    return bins


def packer(capacity: int):
    """Per partition: items in, bins out (their members and how full they are)."""

    def pack(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fills: list[int] = []
        members: list = []
        for frame in frames:
            fills += frame["fill"].tolist()
            members += frame["members"].tolist()
            if len(fills) >= 4 * GROUP:  # a partition may be large: pack what is there
                yield packed(fills, members)
                fills, members = [], []
        if fills:
            yield packed(fills, members)

    def packed(fills: list[int], members: list) -> pd.DataFrame:
        bins = best_fit(fills, capacity)
        return pd.DataFrame({"fill": [sum(fills[i] for i in b) for b in bins], "members": [[m for i in b for m in members[i]] for b in bins]})

    return pack


def pack_documents(
    documents: DataFrame,
    vocabulary: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    closing_id: int = CLOSING_ID,
    nearly_full: float = NEARLY_FULL,
) -> DataFrame:
    """Rows doc_id, piece, start, length, ids_crc32, sequence_id, offset: where each piece lies."""
    spark = documents.sparkSession
    scratch = Scratch(spark, "packing")
    pieces = scratch.keep(pieces_of(documents, vocabulary, id_col, text_col, capacity, closing_id), "pieces")
    full = pieces.where(F.col("length") == capacity)
    full = full.select("*", (F.monotonically_increasing_id() * 2).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    names = ("doc_id", "piece", "start", "length", "ids_crc32")
    items = pieces.where(F.col("length") < capacity).select(
        F.col("length").alias("fill"), F.array(F.struct(*names)).alias("members"), F.xxhash64("doc_id", "piece", "ids_crc32").alias("slot")
    )
    schema = items.select("fill", "members").schema
    done: list[DataFrame] = []
    groups, before = max(1, partitions(spark)), None
    while True:
        # dealt by a hash, not round robin: a task that runs again gets the same items
        dealt = items.repartition(groups, "slot").select("fill", "members")
        bins = scratch.keep(dealt.mapInPandas(packer(capacity), schema), "bins")
        low = int(capacity * nearly_full)
        under = bins.where(F.col("fill") < low)
        count = under.count()
        if groups == 1 or before is not None and groups * GROUP >= before > 0.99 * before <= count:
            done.append(bins)
            break
        done.append(bins.where(F.col("fill") >= low))
        items = under.withColumn("slot", F.xxhash64(F.col("members")[0]))
        groups, before = max(-(-count // GROUP), groups // FAN_IN, 1), count
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    out = out.select((F.monotonically_increasing_id() * 2 + 1).alias("sequence_id"), "members")
    out = out.select("sequence_id", F.col("members").alias("m"), F.posexplode("members").alias("at", "x"))
    before_it = F.aggregate(F.slice("m", 1, F.col("at")), F.lit(0).cast("long"), lambda a, x: a + x["length"])
    packed = out.select(*[F.col(f"x.{n}").alias(n) for n in names], "sequence_id", before_it.alias("offset"))
    return full.unionByName(packed)
