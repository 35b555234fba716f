"""Near copies by SimHash: fingerprints of 64 bits, linked at up to two differing bits, met at anchor points.

1. Fingerprint of a text: over all its 3-word shingles (repeats included), each bit
   is 1 if it is set in over half of the shingles' XXH64 hashes (seed 42).
2. Anchor points. The 64 bits are cut in two parts, 31 and 33. Of two fingerprints
   that differ in two bits at most, the second parts are equal or the first parts
   differ in one bit at most.
   * First part: the anchors are the 2^26 words of the Hamming code of length 31, a
     perfect covering code of radius 1: the words whose set places (1 to 31) add up
     to zero by XOR. A fingerprint goes to every anchor within radius + 1 = 2 of it:
     its nearest one, its home, and 15 more. If two differ there in one bit at most, the
     home of either is an anchor of the other.
   * Second part: all 2^33 words are anchors (radius 0, threshold 0).
   One code over all 64 bits would have 652 anchors within radius + 2 of each.
3. Per anchor, each home is compared with all that came there, on all 64 bits. Of the
   links found, one task gives each fingerprint with the smallest one it reaches
   there, so a dense group leaves as many rows as members, not as pairs.
4. Components of these links over all anchors; the smallest document of each.

Equal fingerprints are one point before anything is dealt, whatever their number.
An anchor of over ``BLOCK`` points is dealt to pairs of blocks, each its own task; small
anchors share tasks of some ``UNIT`` points. Nothing but counts goes to the driver, and
fingerprints, links and labels are tables in the shared folder.

Defined results
* words are what stands between blanks (space, tab to carriage return), A-Z in lower case;
* under three words: the whole sequence is the one shingle; null, empty or blank
  text: fingerprint zero, linked like any other;
* a text of any length counts whole, its shingles in pieces of bounded size;
* repeated rows and ids come back as often as given; a row without id comes back too, links
  what its fingerprint links, and is never the smallest (null if no row it reaches has an id);
* an empty table gives no rows; extra columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwise.llm.common import Scratch
from tillwise.llm.nearcopies import components

SHINGLE = 3
SEED = 42
NEAR = 2
PLACES = 31
BLOCK, UNIT = 1024, 1 << 14
PIECE = 1 << 16


def fingerprint(text: bytes | None, size: int = SHINGLE) -> int:
    """The majority of each bit over the hashes of the shingles, as an unsigned number."""
    words = (text or b"").lower().split()  # of bytes: A-Z, and the six blanks
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    n = max(len(words) - size + 1, 1)
    starts = np.concatenate(([0], ends[: n - 1] + 1)).tolist()
    ends = ends[-n:].tolist()
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, PIECE):
        hashes = [xxhash.xxh64_intdigest(joined[s:e], SEED) for s, e in zip(starts[at : at + PIECE], ends[at : at + PIECE])]
        ones += np.unpackbits(np.array(hashes, dtype=">u8").view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n).view(">u8")[0])


def fingerprints(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows doc_id, point: the fingerprint as a signed number."""
    docs = documents.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = batch.column(1).cast(pa.binary())
            found = np.fromiter((fingerprint(x.as_py()) for x in data), np.uint64, len(data))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "point"])

    return docs.mapInArrow(run, "doc_id long, point long")


def anchors(points: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(which points, their anchor, whether it is their home), for all anchors within reach."""
    first = points & np.uint64((1 << PLACES) - 1)
    total = np.zeros(len(points), dtype=np.uint64)
    for place in range(1, PLACES + 1):
        total ^= np.uint64(place) * (first >> np.uint64(place - 1) & np.uint64(1))
    every = np.arange(len(points))

    def flipped(place: np.ndarray) -> np.ndarray:
        """The bit of each place; none for place zero."""
        return np.where(place > 0, np.uint64(1) << (np.maximum(place, 1).astype(np.uint64) - np.uint64(1)), np.uint64(0))

    yield every, first ^ flipped(total), np.ones(len(points), dtype=bool)
    for place in range(1, PLACES + 1):
        other = total ^ np.uint64(place)  # two places that add up to the total
        some = np.flatnonzero((total > 0) & (other > place))
        yield some, first[some] ^ np.uint64(1 << (place - 1)) ^ flipped(other[some]), np.zeros(len(some), dtype=bool)
    second = points >> np.uint64(PLACES)
    yield every, second | np.uint64(1 << 62), np.ones(len(points), dtype=bool)


def at_anchors(points: DataFrame) -> DataFrame:
    """Rows anchor, point, home: each point at every anchor within its reach."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy()
            for some, anchor, home in anchors(own.view(np.uint64)):
                yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(own[some]), pa.array(home)], ["anchor", "point", "home"])

    return points.select("point").mapInArrow(run, "anchor long, point long, home boolean")


def smallest_reached(count: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of ``count`` numbers the smallest that the links a-b lead to."""
    label = np.arange(count)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def linked(rows: pa.Table) -> pa.Table:
    """The links of one unit: each point that has one, with the smallest it reaches here."""
    anchor, point, home, mine = (rows.column(c).to_numpy() for c in ("anchor", "point", "home", "mine"))
    whole = rows.column("low")[0].as_py() == rows.column("high")[0].as_py()
    order = np.argsort(anchor, kind="stable")
    anchor, home, mine = anchor[order], home[order], mine[order]
    known, number = np.unique(point[order], return_inverse=True)
    bits = point[order].view(np.uint64)
    at = np.arange(len(anchor))
    one, two = [], []
    step = 1
    while True:  # each point with the one ``step`` places on, as long as the anchor is the same
        at = at[at + step < len(anchor)]
        at = at[anchor[at] == anchor[at + step]]
        if not len(at):
            break
        near = (np.bitwise_count(bits[at] ^ bits[at + step]) <= NEAR) & (home[at] | home[at + step])
        if not whole:  # two blocks of one anchor; within themselves they are compared elsewhere
            near &= mine[at] != mine[at + step]
        one.append(number[at[near]])
        two.append(number[at[near] + step])
        step += 1
    nothing = [np.zeros(0, dtype=np.int64)]
    label = smallest_reached(len(known), np.concatenate(one or nothing), np.concatenate(two or nothing))
    moved = np.flatnonzero(label != np.arange(len(known)))
    return pa.table({"a": pa.array(known[moved]), "b": pa.array(known[label[moved]])})


def links(points: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows (a, b) whose components are those of all pairs of points that differ in up to NEAR bits."""
    placed = scratch.keep(at_anchors(points), "anchors")
    sizes = placed.groupBy("anchor").agg(F.count("*").alias("members"), F.max("home").alias("homes")).where("members > 1 AND homes").drop("homes")
    sizes = scratch.keep(sizes, "met")
    units = 1 + (sizes.agg(F.sum("members")).first()[0] or 0) // UNIT
    blocks = F.ceil(F.col("members") / BLOCK)
    dealt = placed.join(sizes, "anchor").withColumn("blocks", blocks).withColumn("mine", F.pmod(F.xxhash64("point"), F.col("blocks")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    low, high = F.least("mine", "other"), F.greatest("mine", "other")
    unit = F.when(F.col("blocks") > 1, F.xxhash64("anchor", low, high)).otherwise(F.pmod(F.xxhash64("anchor"), F.lit(units)))
    dealt = dealt.select(unit.alias("unit"), F.when(F.col("blocks") > 1, F.col("anchor")).alias("own"), low.alias("low"), high.alias("high"), "anchor", "point", "home", "mine")
    return scratch.keep(dealt.groupBy("unit", "own", "low", "high").applyInArrow(linked, "a long, b long"), "links")


def simhash_groups(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows doc_id, point (the fingerprint as a signed number), component_id (the smallest id reached)."""
    spark = documents.sparkSession
    scratch = Scratch(spark, "simhash")
    every = scratch.keep(fingerprints(documents, id_col, text_col), "fingerprints")
    points = scratch.keep(every.groupBy("point").agg(F.min("doc_id").alias("first")), "points")
    found = links(points, scratch)
    comp = scratch.keep(components(spark, found, scratch).withColumnRenamed("node", "point"), "components")
    joined = points.join(comp, "point")
    top = joined.groupBy("comp").agg(F.min("first").alias("top"))
    linked_points = joined.select("point", "comp").join(top, "comp").select("point", "top")
    alone = points.join(comp, "point", "left_anti").select("point", F.col("first").alias("top"))
    tops = scratch.keep(linked_points.union(alone), "tops")
    return every.join(tops, "point").select("doc_id", "point", F.col("top").alias("component_id"))


def keep_one_of_each_group(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, of each group the one with the smallest id, and those without id; columns as they are."""
    gone = simhash_groups(documents, id_col, text_col).where("doc_id <> component_id").select(F.col("doc_id").alias("gone"))
    own = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"))
    return own.join(gone, own["row"][id_col] == gone["gone"], "left_anti").select("row.*")
