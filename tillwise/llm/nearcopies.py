"""Near copies by HyperMinHash sketches: sets of word shingles, linked from a Jaccard similarity on.

1. Each text becomes the set of its 5-word shingles (64-bit hashes). Texts with
   equal sets are one class, stood for by the smallest id.
2. Of each class a sketch: for each of 160 hash functions the minimum over the
   set, stored as a register of 16 bits, leading-zero count and mantissa.
3. Four registers make a band, 40 bands; classes that agree in a band are
   candidates. At a similarity of 0.75 a pair agrees in none with a probability of
   (1 - 0.75^4)^40 = 2.5e-7; higher ones are missed still less.
4. Pairs are tested in rounds. In each, every key that still holds classes of different
   components names one pivot (the first by a hash of the round, so that the keys of a
   group name the same one) and its classes of other components are paired with it: a
   group of thousands of near copies is linked by few pairs a member. After ``ROUNDS`` the
   keys that are still open are compared in full, block of rows against block of rows:
   on sketches first, then on the full sets of those that have a likely partner there.
   Classes of one component are passed over.
5. A pair's similarity is first estimated from registers, less the share that
   agrees by collision; pairs over a bound six deviations below the limit are
   confirmed on the full sets.

Only texts of classes that share a key are read again: they are a table of their own, and
a full set goes once to each unit that compares it. Blocks and units are of bounded size,
so a hot key or group is spread over tasks; small keys share tasks. Minima and counts have
map-side combine. Sketches, links and labels are tables in the shared folder.

Defined results
* null or wordless text: no shingles, linked with nothing, kept;
* fewer than five words: the whole sequence is the one shingle;
* rows that share an id are one node with the union of their links (each row comes back);
* a row without id is linked with nothing: its component is null and it is kept;
* a text of any length counts whole, hashed in pieces of CHUNK bytes;
* an empty table gives no rows; extra columns are kept by ``keep_one_of_each``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tillwise.llm.common import Scratch, fresh

SHINGLE = 5
PERCENT = 75
BANDS, ROWS = 40, 4
REGISTERS = BANDS * ROWS
MANTISSA = 10
CHUNK = 1 << 20
ROUNDS = 3
# Up to so many ids are broadcast to the texts; beyond it the texts are dealt by id.
BROADCAST_IDS = 1_000_000
# Rows of small keys that are compared in one task.
UNIT = 4096
# Rows and hashes of a key compared with one another at a time; nodes and hashes of one home.
COMPARE_BLOCK, COMPARE_HASHES = 2048, 1 << 20
CHECK_BLOCK, BLOCK_HASHES = 128, 1 << 15
BASE = 0x9E3779B97F4A7C15
FACTORS = np.random.Generator(np.random.PCG64(21)).integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
WORD_END = re.compile(rb"[\x20\x09-\x0D]")
LOWER_BYTE = np.arange(256, dtype=np.uint8)
LOWER_BYTE[65:91] += 32
SPACE_BYTE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
MULTIPLIERS = np.random.Generator(np.random.PCG64(20)).integers(1, 1 << 63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
# Six standard deviations of the estimate at the limit: 6 * sqrt(0.75 * 0.25 / 160).
SLACK = 0.21


def spread(x: np.ndarray) -> np.ndarray:
    """Mix 64-bit numbers so that each bit depends on all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.full(n, base, dtype=np.uint64))


POWERS, BACK = powers(BASE, CHUNK + 1), powers(pow(BASE, -1, 1 << 64), CHUNK + 1)


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of up to CHUNK bytes start, and a 64-bit number for each."""
    low = LOWER_BYTE[np.frombuffer(data, dtype=np.uint8)]
    inside = np.zeros(len(low) + 2, dtype=bool)
    inside[1:-1] = ~SPACE_BYTE[low]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    run = np.zeros(len(low) + 1, dtype=np.uint64)
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * POWERS[: len(low)], out=run[1:])
    return starts, spread((run[ends] - run[starts]) * BACK[starts])


def long_text_hashes(data: bytes) -> np.ndarray:
    """The same for a text of any length; words longer than CHUNK have a number of their own kind."""
    parts, at = [], 0
    while at < len(data):
        end = at + CHUNK
        if end < len(data):
            cut = max(data.rfind(c, at, end) for c in b" \t\n\v\f\r")
            if cut < at:  # one word fills the chunk
                stop = WORD_END.search(data, at)
                end = stop.start() if stop else len(data)
                digest = hashlib.blake2b(data[at:end].translate(LOWER_BYTE.tobytes()), digest_size=8).digest()
                parts.append(np.frombuffer(digest, dtype=np.uint64))
                at = end
                continue
            end = cut + 1
        parts.append(word_hashes(data[at:end])[1])
        at = end
    return np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64)


def shingles(h: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of the shingles of a text, given its words' numbers."""
    if not len(h):
        return np.zeros(0, dtype=np.uint64)
    n = max(len(h) - size + 1, 1)
    out = np.full(n, min(len(h), size), dtype=np.uint64)
    for k in range(min(size, len(h))):
        out += h[k : k + n] * FACTORS[k]
    return np.unique(spread(out))


def shingle_sets(texts: list[str | None], size: int = SHINGLE) -> Iterator[np.ndarray]:
    """The shingle set of each text, in order; texts are hashed many at a time."""
    held: list[bytes] = []
    room = CHUNK

    def flush() -> Iterator[np.ndarray]:
        if held:
            starts, h = word_hashes(b" ".join(held))
            ends = np.searchsorted(starts, np.cumsum([len(x) + 1 for x in held]))
            for one in np.split(h, ends[:-1]):
                yield shingles(one, size)
            held.clear()

    for text in texts:
        data = (text or "").encode("utf-8", "surrogatepass")
        if len(data) + 1 > room:
            yield from flush()
            room = CHUNK
        if len(data) + 1 > CHUNK:
            yield shingles(long_text_hashes(data), size)
            continue
        held.append(data)
        room -= len(data) + 1
    yield from flush()


def sketch(hashes: np.ndarray) -> np.ndarray:
    """Registers of 16 bits: leading zeros of the minimum, then the bits after its first one."""
    low = np.full(REGISTERS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(hashes), 512):
        np.minimum(low, (hashes[at : at + 512, None] * MULTIPLIERS[None, :]).min(axis=0), out=low)
    low = np.maximum(low, np.uint64(1))
    top = np.frexp(low.astype(np.float64))[1].astype(np.uint64)  # place of the first one; rounding up is the same for equal minima
    zeros = np.uint64(64) - np.minimum(top, np.uint64(64))
    after = (low << (zeros + np.uint64(1))) >> np.uint64(64 - MANTISSA)
    return ((zeros << np.uint64(MANTISSA)) | after).astype(np.uint16)


def collision_rate() -> float:
    """How often two unequal minima share a register: about one in 2^mantissa, less a little for zeros that differ."""
    return 2.0 ** -(MANTISSA + 1)


def band_keys(registers: np.ndarray) -> np.ndarray:
    """One 64-bit key per band."""
    rows = registers.reshape(BANDS, ROWS).astype(np.uint64)
    packed = rows[:, 0] | rows[:, 1] << np.uint64(16) | rows[:, 2] << np.uint64(32) | rows[:, 3] << np.uint64(48)
    return spread(spread(packed) + np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def sketched(docs: DataFrame) -> DataFrame:
    """(doc_id, text) to doc_id, n_shingles, set_key, sketch; the sketch is null for an empty set."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, keys, registers = [], [], []
            for s in shingle_sets(batch.column(1).to_pylist()):
                sizes.append(len(s))
                keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                registers.append(sketch(s).tobytes() if len(s) else None)
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(registers, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "set_key", "sketch"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, set_key binary, sketch binary")


def banded(nodes: DataFrame) -> DataFrame:
    """(node, n_shingles, sketch) to a row for each band: key, band, node, n_shingles."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.concatenate([np.zeros(0, np.uint64), *(band_keys(np.frombuffer(x.as_py(), np.uint16)) for x in batch.column(2))])
            band = np.tile(np.arange(BANDS, dtype=np.int32), batch.num_rows)
            own = [pa.array(np.repeat(batch.column(c).to_numpy(), BANDS)) for c in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(band), *own], ["key", "band", "node", "n_shingles"])

    return nodes.mapInArrow(run, "key long, band int, node long, n_shingles long")


def full_sets(docs: DataFrame) -> DataFrame:
    """(node, text) to (node, hashes)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s.view(np.int64) for s in shingle_sets(batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["node", "hashes"])

    return docs.mapInArrow(run, "node long, hashes array<long>")


def likely(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose similarity, estimated from the sketches, may reach the limit."""
    left = nodes.select(F.col("node").alias("a"), F.col("sketch").alias("sa"), F.col("n_shingles").alias("na"))
    right = nodes.select(F.col("node").alias("b"), F.col("sketch").alias("sb"), F.col("n_shingles").alias("nb"))
    # sets whose sizes differ too much can't reach it
    near = pairs.join(left, "a").join(right, "b").where((100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")))
    least, rate = percent / 100 - SLACK, collision_rate()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint16).reshape(-1, REGISTERS) for c in ("sa", "sb"))
            same = (one == two).mean(axis=1)
            keep = pa.array((same - rate) / (1 - rate) >= least)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(keep) for c in ("a", "b", "na", "nb")], ["a", "b", "na", "nb"])

    return near.mapInArrow(run, "a long, b long, na long, nb long")


def homes(keys: DataFrame) -> DataFrame:
    """(node, home): blocks of nodes that share their heaviest key, of bounded count and bounded sum of set sizes.

    ``keys``: key, node, n_shingles, members and weight (of the key).
    """
    top = keys.groupBy("node").agg(F.max(F.struct("weight", "members", "key")).alias("t"))
    blocks = F.greatest(F.ceil(F.col("t.weight") / BLOCK_HASHES), F.ceil(F.col("t.members") / CHECK_BLOCK))
    return top.select("node", F.xxhash64("t.key", F.pmod(F.xxhash64("node"), blocks)).alias("home"))


def shared_counts(pairs: pa.Table, sets: pa.Table) -> pa.Table:
    """The pairs (a, b, na, nb) of one unit with the size of their sets' intersection; ``sets``: node, hashes."""
    hashes = sets.column("hashes").combine_chunks()
    _, number = np.unique(hashes.flatten().to_numpy(), return_inverse=True)
    sizes = hashes.value_lengths().to_numpy()
    of: dict[tuple[int, int], list[np.ndarray]] = {}  # rows that share an id may have several sets
    for node, size, one in zip(sets.column("node").to_pylist(), sizes.tolist(), np.split(number, np.cumsum(sizes)[:-1])):
        of.setdefault((node, size), []).append(one)
    a, na = pairs.column("a").to_numpy(), pairs.column("na").to_numpy()
    theirs = list(zip(pairs.column("b").to_pylist(), pairs.column("nb").to_pylist()))
    shared = np.zeros(len(a), dtype=np.int64)
    flag = np.zeros(len(number), dtype=np.int64)
    order = np.lexsort((na, a))
    for group in np.split(order, np.flatnonzero(np.diff(a[order]) | np.diff(na[order])) + 1):
        for mine in of[int(a[group[0]]), int(na[group[0]])]:
            flag[mine] = 1
            for at in range(0, len(group), CHECK_BLOCK):
                some = group[at : at + CHECK_BLOCK].tolist()
                rows, others = zip(*((i, x) for i in some for x in of[theirs[i]]))
                starts = np.cumsum([0] + [len(x) for x in others[:-1]])
                np.maximum.at(shared, list(rows), np.add.reduceat(flag[np.concatenate(others)], starts))
            flag[mine] = 0
    return pairs.select(["a", "b", "na", "nb"]).append_column("shared", pa.array(shared))


def placed(pairs: DataFrame, home: DataFrame) -> DataFrame:
    """Add the homes of both nodes of the pairs (a, b, ...): ha and hb."""
    for end in ("a", "b"):
        pairs = pairs.join(home.select(F.col("node").alias(end), F.col("home").alias(f"h{end}")), end)
    return pairs


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of the placed pairs that reach the limit on the full sets.

    A unit is the pairs between two homes, with one copy of the sets they need: a
    set goes once to each unit, not once to each pair.
    """
    ends = F.explode(F.array("a", "b")).alias("node")
    needs = pairs.select(F.col("ha").alias("ua"), F.col("hb").alias("ub"), ends).distinct()
    wanted = pairs.select(ends).distinct().withColumnRenamed("node", "doc_id")
    sets = full_sets(texts.join(wanted, "doc_id", "left_semi"))
    units = pairs.groupBy("ha", "hb").cogroup(needs.join(sets, "node").groupBy("ua", "ub"))
    counted = units.applyInArrow(shared_counts, "a long, b long, na long, nb long, shared long")
    return counted.where(100 * F.col("shared") >= percent * (F.col("na") + F.col("nb") - F.col("shared"))).select("a", "b")


def cross_pairs(rows: pa.Table, percent: int) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
    """For each row of a unit its likely partners: (rows of the key, row, partners).

    Partners are of another component, agree in no earlier band, and may reach the limit by
    their sizes and sketches. ``rows``: key, band, low, high, mine, node, comp, n_shingles, sketch.
    """
    least, rate = percent / 100 - SLACK, collision_rate()
    key, band, low, high, mine, comp, size = (rows.column(c).to_numpy() for c in ("key", "band", "low", "high", "mine", "comp", "n_shingles"))
    registers = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), dtype=np.uint16).reshape(-1, REGISTERS)
    packed = np.ascontiguousarray(registers).view(np.uint64)  # a band of four registers is one number
    order = np.argsort(key, kind="stable")
    for group in np.split(order, np.flatnonzero(np.diff(key[order])) + 1):
        first, b = group[0], band[group[0]]
        left, right = group[mine[group] == low[first]], group[mine[group] == high[first]]
        for at, i in enumerate(left):
            js = right[at + 1 :] if low[first] == high[first] else right
            js = js[comp[js] != comp[i]]
            js = js[100 * np.minimum(size[js], size[i]) >= percent * np.maximum(size[js], size[i])]
            if b and len(js):
                js = js[~(packed[js, :b] == packed[i, :b]).any(axis=1)]
            if len(js):
                same = (registers[js] == registers[i]).mean(axis=1)
                js = js[(same - rate) / (1 - rate) >= least]
            if len(js):
                yield group, i, js


def likely_rows(percent: int):
    """The rows of a unit that have a likely partner."""

    def run(rows: pa.Table) -> pa.Table:
        kept = np.zeros(len(rows), dtype=bool)
        for _, i, js in cross_pairs(rows, percent):
            kept[i] = True
            kept[js] = True
        return rows.filter(pa.array(kept))

    return run


def linked_rows(percent: int):
    """The links of a unit, on the full sets."""

    def run(rows: pa.Table) -> pa.Table:
        node, size = rows.column("node").to_numpy(), rows.column("n_shingles").to_numpy()
        _, number = np.unique(rows.column("hashes").combine_chunks().flatten().to_numpy(), return_inverse=True)
        sets = np.split(number, np.cumsum(size)[:-1])
        flag = np.zeros(len(number), dtype=np.int64)
        one, two = [], []
        for _, i, js in cross_pairs(rows, percent):
            flag[sets[i]] = 1
            starts = np.cumsum(size[js]) - size[js]
            shared = np.add.reduceat(flag[np.concatenate([sets[j] for j in js])], starts)
            flag[sets[i]] = 0
            js = js[100 * shared >= percent * (size[js] + size[i] - shared)]
            one.extend([node[i]] * len(js))
            two.extend(node[js])
        return pa.table({"a": pa.array(one, pa.int64()), "b": pa.array(two, pa.int64())})

    return run


def across_components(rows: DataFrame, nodes: DataFrame, texts: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """All links (a, b) between nodes of different components that share a key.

    ``rows``: key, band, members, weight, node, n_shingles, comp. A key's rows are dealt to
    blocks of bounded size, and each two blocks are compared in one task, so a hot key is
    spread over tasks; small keys share a task. Only rows go on, and at last links.
    """
    blocks = F.greatest(F.ceil(F.col("members") / COMPARE_BLOCK), F.ceil(F.col("weight") / COMPARE_HASHES))
    dealt = rows.withColumn("mine", F.pmod(F.xxhash64("node"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    units = 1 + rows.count() // UNIT
    low, high = F.least("mine", "other"), F.greatest("mine", "other")
    unit = F.when(blocks > 1, F.xxhash64("key", low, high)).otherwise(F.pmod(F.xxhash64("key"), F.lit(units)))
    dealt = dealt.select("key", "band", low.alias("low"), high.alias("high"), "mine", "node", "comp", "n_shingles", unit.alias("unit"), F.when(blocks > 1, F.col("key")).alias("own"))
    known = dealt.join(nodes.select("node", "n_shingles", "sketch"), ["node", "n_shingles"])
    schema = "key long, band int, low long, high long, mine long, node long, comp long, n_shingles long, unit long, own long, sketch binary"
    known = known.select(*[c.split()[0] for c in schema.split(", ")])
    likely_there = scratch.keep(known.groupBy("unit", "own", "low", "high").applyInArrow(likely_rows(percent), schema), "likely")
    wanted = likely_there.select(F.col("node").alias("doc_id")).distinct()
    sets = full_sets(texts.join(wanted, "doc_id", "left_semi")).withColumn("n_shingles", F.size("hashes").cast("long"))
    with_sets = likely_there.join(sets, ["node", "n_shingles"])
    return with_sets.groupBy("unit", "own", "low", "high").applyInArrow(linked_rows(percent), "a long, b long")


def components(spark: SparkSession, links: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows (node, comp) for the nodes of the links (a, b): the smallest node that each reaches.

    Each round takes the smallest label among a node's neighbours and then the
    label of that label, so paths shorten by halves; rounds end when nothing changes.
    """
    edges = scratch.keep(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct(), "edges")
    labels = scratch.keep(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("comp")), "labels")
    while True:
        other = labels.select(F.col("node").alias("b"), F.col("comp").alias("near"))
        best = edges.join(other, "b").groupBy(F.col("a").alias("node")).agg(F.min("near").alias("near"))
        hooked = labels.join(best, "node").select("node", F.least("comp", "near").alias("up"), F.col("comp").alias("old"))
        jump = labels.select(F.col("node").alias("up"), F.col("comp").alias("top"))
        new = hooked.join(jump, "up", "left").select("node", F.least("up", "top").alias("comp"), "old")
        seen = Observation()
        new = scratch.keep(new.observe(seen, F.count_if(F.col("comp") != F.col("old")).alias("changed")), "labels")
        changed = seen.get["changed"]
        scratch.drop(labels)
        labels = new.drop("old")
        scratch.paths[id(labels)] = scratch.paths.pop(id(new))
        if not changed:
            scratch.drop(edges)
            return labels


def merged(spark: SparkSession, comp: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """The components (node, comp) after the links (a, b) between nodes."""
    ends = links
    for end in ("a", "b"):
        ends = ends.join(comp.select(F.col("node").alias(end), F.col("comp").alias(f"c{end}")), end)
    joined = components(spark, ends.select(F.col("ca").alias("a"), F.col("cb").alias("b")), scratch)
    top = joined.select(F.col("node").alias("comp"), F.col("comp").alias("top"))
    new = scratch.keep(comp.join(top, "comp", "left").select("node", F.coalesce("top", "comp").alias("comp")), "components")
    scratch.drop(comp, joined)
    return new


def open_rows(keys: DataFrame, comp: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows of the keys that hold nodes of different components, with ``comp``."""
    labelled = keys.drop("comp").join(comp, "node")
    several = labelled.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("key")
    return scratch.keep(labelled.join(several, "key"), "open")


def near_copy_groups(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """Rows doc_id, n_shingles, component_id, kept."""
    spark = documents.sparkSession
    scratch = Scratch(spark, "nearcopies")
    docs = documents.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    every = scratch.keep(sketched(docs), "sketches")
    full = every.where("n_shingles > 0 AND doc_id IS NOT NULL")
    best = F.min_by(F.struct("doc_id", "n_shingles", "sketch"), "doc_id").alias("x")
    classes = full.groupBy("set_key").agg(best).select("set_key", F.col("x.doc_id").alias("node"), "x.n_shingles", "x.sketch")
    classes = scratch.keep(classes, "classes")
    nodes = classes.select("node", "n_shingles", "sketch")
    keyed = banded(nodes)
    sizes = keyed.groupBy("key").agg(F.count("*").alias("members"), F.sum("n_shingles").alias("weight")).where("members > 1")
    keys = scratch.keep(keyed.join(sizes, "key"), "keys")
    home = scratch.keep(homes(keys), "homes")
    ids = home.select(F.col("node").alias("doc_id")).distinct()
    texts = scratch.keep(docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", "left_semi"), "texts")

    comp = scratch.keep(ids.select(F.col("doc_id").alias("node"), F.col("doc_id").alias("comp")), "components")
    rows = open_rows(keys, comp, scratch)
    for number in range(ROUNDS):
        first = F.min_by(F.struct("node", "comp"), F.struct(F.xxhash64("node", F.lit(number)), "node")).alias("p")
        pivots = rows.groupBy("key").agg(first).select("key", F.col("p.node").alias("pivot"), F.col("p.comp").alias("pivot_comp"))
        met = rows.join(pivots, "key").where("comp <> pivot_comp")
        pairs = met.select(F.least("pivot", "node").alias("a"), F.greatest("pivot", "node").alias("b")).distinct()
        near = scratch.keep(placed(likely(pairs, nodes, percent), home), "likely")
        links = scratch.keep(confirmed(near, texts, percent), "links")
        comp = merged(spark, comp, links, scratch)
        scratch.drop(rows, near, links)
        rows = open_rows(keys, comp, scratch)
    links = scratch.keep(across_components(rows, nodes, texts, percent, scratch), "links")
    comp = merged(spark, comp, links, scratch)
    scratch.drop(keys, home, rows, texts)

    by_class = with_component(classes.select("set_key", "node"), comp).select("set_key", "comp")
    out = every.select("doc_id", "n_shingles", "set_key").join(by_class, "set_key", "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).when(F.col("n_shingles") > 0, F.col("comp")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def with_component(rows: DataFrame, comp: DataFrame) -> DataFrame:
    """Add the component of ``node``; a node without links is its own."""
    return rows.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))


def keep_one_of_each(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """The documents, of each group of near copies the one with the smallest id."""
    own_id = fresh(documents, "__own_id")
    gone = near_copy_groups(documents, id_col, text_col, percent).where(~F.col("kept")).select(F.col("doc_id").alias(own_id))
    return documents.join(gone, F.col(f"`{id_col}`") == F.col(own_id), "left_anti")
