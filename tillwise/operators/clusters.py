"""K-Means over several k, nearest stored centre, silhouette."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise import constants as K
from tillwise.session import one_row, stored

VECTOR = "features"
SEGMENT = "Segment"
#: Lloyd's rounds end when no centre has moved further, or after so many.
TOLERANCE, MAX_ROUNDS = 1e-4, 100
_DRAW = "_draw"
_FLUSH = 1 << 20
#: Rows of one stored block: a pass moves a binary value for them, not a field for each feature of each row.
_STORED = 1 << 13
#: Rows that meet all centres at once: sums of so many are exact, and the work stays in the processor's cache.
_BLOCK = 1 << 10

Centres = Mapping[int, Sequence[float]]


def assemble(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(columns), outputCol=VECTOR).transform(df)


def silhouette(labelled: DataFrame) -> float | None:
    """Mean silhouette in squared Euclidean distance.

    This measure needs the size, the sum and the squared length of each cluster
    only, so it is one pass plus k rows. The plain Euclidean one needs every
    pair of rows and cannot be had at scale.
    """
    if labelled.select(SEGMENT).distinct().limit(2).count() < 2:
        return None
    return ClusteringEvaluator(featuresCol=VECTOR, predictionCol=SEGMENT).evaluate(labelled)


@dataclass
class Fit:
    """One K-Means fit: its centres, and the sum of squared distances to them."""

    k: int
    seed: int
    centres: np.ndarray
    cost: float = math.inf
    rounds: int = 0
    done: bool = False


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances, rows x centres, added column by column: the same for any batch."""
    total = np.zeros((len(x), len(centres)))
    for j in range(x.shape[1]):
        total += (x[:, j, None] - centres[None, :, j]) ** 2
    return total


def points_of(batch: pa.RecordBatch, columns: Sequence[str]) -> np.ndarray:
    return np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in columns])


def packed(points: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``points`` (features and ``_draw``) in blocks, for passes that read them again and again.

    ``rows`` and ``draw`` are the numbers of a block in binary, ``reach`` is its largest one without sign,
    ``missing`` how many rows lack a feature.
    """

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every, draw = points_of(batch, columns), batch.column(_DRAW).to_numpy()
            starts = range(0, len(every), _STORED)
            parts = [every[i : i + _STORED] for i in starts]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([x.tobytes() for x in parts], pa.binary()),
                    pa.array([draw[i : i + _STORED].tobytes() for i in starts], pa.binary()),
                    pa.array([float(np.abs(x).max()) for x in parts], pa.float64()),
                    pa.array([int(np.isnan(x).any(axis=1).sum()) for x in parts], pa.int64()),
                ],
                ["rows", "draw", "reach", "missing"],
            )

    return points.select(*columns, _DRAW).mapInArrow(pack, "rows binary, draw binary, reach double, missing long")


def dealt(points: DataFrame) -> DataFrame:
    """Rows dealt evenly, one part a core: a pass ends on all cores at once, and no core takes a second part meanwhile."""
    return points.repartition(points.sparkSession.sparkContext.defaultParallelism)


def unpacked(batches: Iterable[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows x features, draws) of each block."""
    for batch in batches:
        for rows, draw in zip(batch.column("rows"), batch.column("draw")):
            yield np.frombuffer(rows.as_buffer(), np.float64).reshape(-1, width), np.frombuffer(draw.as_buffer(), np.int64)


def chance(draw: np.ndarray, seed: int, step: int) -> np.ndarray:
    """A number in (0, 1) per row, by a hash of the row's key, the seed and the step."""
    x = draw.view(np.uint64) ^ np.uint64((seed * 1_000_003 + step + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    x ^= x >> np.uint64(31)
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)


def next_centres(blocks: DataFrame, columns: Sequence[str], fits: Sequence[Fit], step: int) -> dict[int, list[float]]:
    """For each fit a row drawn by its squared distance to the nearest centre so far.

    Each row has an exponential waiting time with that distance as its rate, from a hash of
    its key; the first one wins. So the draw hangs on the rows only, not on how they are dealt.
    Distances are taken of the rows only whose number could win at the farthest distance.
    """
    state = [(f.seed, f.centres) for f in fits]
    width = len(columns)

    def first(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[float, ...]] = {}
        for x, draw in unpacked(batches, width):
            length = math.sqrt((x**2).sum(axis=1).max())
            for i, (seed, centres) in enumerate(state):
                number = chance(draw, seed, step)
                far = (length + math.sqrt((centres**2).sum(axis=1).max())) ** 2 if len(centres) else 1.0
                # a little below what the best wait so far asks for, so that rounding leaves out no row
                rows = np.flatnonzero(number >= math.exp(-best[i][0] * far * (1 + 1e-9)) * (1 - 1e-9)) if i in best else np.arange(len(x))
                if not len(rows):
                    continue
                with np.errstate(divide="ignore"):
                    wait = -np.log(number[rows]) / (distances(x[rows], centres).min(axis=1) if len(centres) else 1.0)
                for row in np.flatnonzero(wait == wait.min()) if np.isfinite(wait.min()) else []:
                    best[i] = min(best.get(i, (math.inf,)), (float(wait[row]), *x[rows[row]].tolist()))
        rows = pa.array([list(b) for b in best.values()], pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array(list(best), pa.int32()), rows], ["fit", "row"])

    drawn = blocks.mapInArrow(first, "fit int, row array<double>").groupBy("fit").agg(F.min("row").alias("row"))
    return {r["fit"]: r["row"][1 : width + 1] for r in drawn.collect()}


def block_sums(x: np.ndarray, values: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Sums of ``values`` (rows x values) over the rows nearest to each centre; ``centres`` is fits x k x columns.

    The first value of each row is 1. Nearest by ``distances``, the lower number on a tie. Half a centre's squared length less its
    product with the row orders the centres alike, but for rounding: one matrix product for all
    fits. Rows with two centres within its error are settled by ``distances`` itself.
    """
    fits, k, width = centres.shape
    flat = centres.reshape(-1, width)
    square = (flat**2).sum(axis=1)
    apart = (np.column_stack([square / 2, -flat]) @ np.vstack([np.ones(len(x)), x.T])).reshape(fits, k, len(x))
    # over eight times what rounding can do here and in distances
    slack = 2.0**-44 * ((x**2).sum(axis=1).max() + square.max()) + np.finfo(float).tiny
    near = apart <= apart.min(axis=1, keepdims=True) + slack
    sums = (near.reshape(-1, len(x)).astype(np.float64) @ values).reshape(fits, k, -1)
    for i in np.flatnonzero(sums[:, :, 0].sum(axis=1) != len(x)):
        label = near[i].argmax(axis=0)
        open_ = np.flatnonzero(np.count_nonzero(near[i], axis=0) != 1)
        label[open_] = distances(x[open_], centres[i]).argmin(axis=1)
        sums[i] = (label == np.arange(k)[:, None]).astype(np.float64) @ values
    return sums


def cluster_sums(blocks: DataFrame, columns: Sequence[str], fits: Sequence[Fit], unit: float) -> list[tuple[np.ndarray, list[list[int]]]]:
    """For each fit the sizes and the sums of its clusters, in whole units.

    Features are counted in whole units, so sums are exact and the same in any order.
    """
    centres = [f.centres for f in fits]
    width, most = len(columns), max(len(c) for c in centres)
    groups = [[i for i, c in enumerate(centres) if len(c) == k] for k in sorted({len(c) for c in centres})]

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alike = [(which, np.array([centres[i] for i in which])) for which in groups]

        def empty():
            return np.zeros((len(centres), most, width + 1), dtype=np.int64)

        def out(total: np.ndarray) -> pa.RecordBatch:
            which = np.flatnonzero(total[:, :, 0].ravel())
            rows = total.reshape(-1, width + 1)[which]
            sums = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * (width + 1), pa.int32()), pa.array(rows.ravel()))
            return pa.RecordBatch.from_arrays([pa.array(which // most, pa.int32()), pa.array(which % most, pa.int32()), sums], ["fit", "cluster", "sums"])

        total, held = empty(), 0
        for every, _ in unpacked(batches, width):
            for start in range(0, len(every), _BLOCK):
                x = every[start : start + _BLOCK]
                values = np.column_stack([np.ones(len(x)), np.rint(x / unit)])
                for which, own in alike:
                    total[which, : own.shape[1]] += block_sums(x, values, own).astype(np.int64)
            held += len(every)
            if held >= _FLUSH:
                yield out(total)
                total, held = empty(), 0
        yield out(total)

    parts = blocks.mapInArrow(add, "fit int, cluster int, sums array<long>")
    added = parts.groupBy("fit", "cluster").agg(*[F.sum(F.col("sums")[j].cast("decimal(38,0)")).alias(f"s{j}") for j in range(width + 1)])
    found = [(np.zeros(len(c), dtype=np.int64), [[0] * width for _ in c]) for c in centres]
    for r in added.collect():  # a row for each cluster of each fit
        sizes, sums = found[r["fit"]]
        sizes[r["cluster"]] = int(r["s0"])
        sums[r["cluster"]] = [int(r[f"s{j + 1}"]) for j in range(width)]
    return found


def costs(blocks: DataFrame, columns: Sequence[str], fits: Sequence[Fit], unit: float) -> list[int]:
    """For each fit the sum of squared distances to the nearest centres, in whole units."""
    centres = [f.centres for f in fits]

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(total: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], ["fit", "cost"])

        total, held = np.zeros(len(centres), dtype=np.int64), 0
        for x, _ in unpacked(batches, len(columns)):
            for i, c in enumerate(centres):
                total[i] += np.rint(distances(x, c).min(axis=1) / unit).astype(np.int64).sum()
            held += len(x)
            if held >= _FLUSH:
                yield out(total)
                total, held = np.zeros(len(centres), dtype=np.int64), 0
        yield out(total)

    added = blocks.mapInArrow(add, "fit int, cost long").groupBy("fit").agg(F.sum(F.col("cost").cast("decimal(38,0)")).alias("cost"))
    found = {r["fit"]: int(r["cost"]) for r in added.collect()}  # a row a fit
    return [found.get(i, 0) for i in range(len(centres))]


def silhouettes(blocks: DataFrame, columns: Sequence[str], fits: Sequence[Fit]) -> list[float | None]:
    """``silhouette`` of the labels that each fit gives, all fits in two passes; None with fewer than two clusters."""
    centres, width = [f.centres for f in fits], len(columns)

    def gather(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros((len(c), width + 2)) for c in centres]
        for x, _ in unpacked(batches, width):
            values = np.column_stack([np.ones(len(x)), x, (x**2).sum(axis=1)])
            for own, c in zip(total, centres):
                label = distances(x, c).argmin(axis=1)
                own += (label == np.arange(len(c))[:, None]).astype(np.float64) @ values
        rows = [(i, j, row.tolist()) for i, own in enumerate(total) for j, row in enumerate(own) if row[0]]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.list_(pa.float64()))],
            ["fit", "cluster", "sums"],
        )

    known = [np.zeros((len(c), width + 2)) for c in centres]
    gathered = blocks.mapInArrow(gather, "fit int, cluster int, sums array<double>").groupBy("fit", "cluster")
    for r in gathered.agg(*[F.sum(F.col("sums")[j]).alias(f"s{j}") for j in range(width + 2)]).collect():  # a row for each cluster of each fit
        known[r["fit"]][r["cluster"]] = [r[f"s{j}"] for j in range(width + 2)]
    judged = [i for i, own in enumerate(known) if np.count_nonzero(own[:, 0]) > 1]

    def judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(judged))
        for x, _ in unpacked(batches, width):
            square, every = (x**2).sum(axis=1), np.arange(len(x))
            for at, i in enumerate(judged):
                size, sums, squares = known[i][:, 0], known[i][:, 1:-1], known[i][:, -1]
                label = distances(x, centres[i]).argmin(axis=1)
                some = np.maximum(size, 1)  # mean squared distance of each row to the rows of each cluster
                mean = np.where(size > 0, square[:, None] + squares / some - 2 * (x @ sums.T) / some, np.inf)
                alone, within = size[label] == 1, mean[every, label] * size[label] / np.maximum(size[label] - 1, 1)
                mean[every, label] = np.inf
                other = mean.min(axis=1)
                with np.errstate(divide="ignore", invalid="ignore"):
                    score = np.where(within < other, 1 - within / other, np.where(within > other, other / within - 1, 0.0))
                total[at] += np.where(alone, 0.0, score).sum()
        yield pa.RecordBatch.from_arrays([pa.array(judged, pa.int32()), pa.array(total)], ["fit", "score"])

    scores = blocks.mapInArrow(judge, "fit int, score double").groupBy("fit").agg(F.sum("score").alias("score")) if judged else None
    found = {r["fit"]: float(r["score"] / known[r["fit"]][:, 0].sum()) for r in scores.collect()} if judged else {}  # a row a fit
    return [found.get(i) for i in range(len(fits))]


def fit_all(points: DataFrame, columns: Sequence[str], wanted: Sequence[tuple[int, int]]) -> list[Fit]:
    """K-Means for each (k, seed) on ``points``: the features and ``_draw``, a hash of each row's key."""
    with stored(packed(points, columns)) as blocks:
        return fit_blocks(blocks, columns, wanted)


def reach_of(blocks: DataFrame) -> float:
    """The largest feature without sign; an error if a row lacks one."""
    largest, missing = one_row(blocks.agg(F.max("reach"), F.sum("missing")))
    if missing:
        raise ValueError("features have missing values")
    return largest or 0.0


def fit_blocks(blocks: DataFrame, columns: Sequence[str], wanted: Sequence[tuple[int, int]]) -> list[Fit]:
    """K-Means for each (k, seed) on packed points. All fits share the passes over them.

    First centres are drawn one after another (k-means++), then Lloyd's rounds run until
    every fit stands still. Draws and sums are exact, so the same rows give the same
    centres, bit for bit, however they are partitioned.
    """
    fits = [Fit(k, seed, np.zeros((0, len(columns)))) for k, seed in wanted]
    largest = reach_of(blocks)
    reach = max(math.ceil(math.log2(largest)) if largest else 0, 0)
    # a block of 2^10 rows adds up below 2^53, and 2^20 rows below 2^63
    unit = 2.0 ** (reach - 38)
    cost_unit = 2.0 ** (2 * reach + 2 + math.ceil(math.log2(len(columns))) - 38)
    for step in range(max((f.k for f in fits), default=0)):
        growing = [f for f in fits if f.k > step and len(f.centres) == step]
        for i, row in next_centres(blocks, columns, growing, step).items() if growing else []:
            growing[i].centres = np.vstack([growing[i].centres, row])
    for _ in range(MAX_ROUNDS):
        moving = [f for f in fits if not f.done and len(f.centres)]
        if not moving:
            break
        for f, (sizes, sums) in zip(moving, cluster_sums(blocks, columns, moving, unit)):
            new = [[s * unit / int(n) for s in row] if n else old.tolist() for n, row, old in zip(sizes, sums, f.centres)]
            f.rounds += 1
            f.done = bool((((np.array(new) - f.centres) ** 2).sum(axis=1) <= TOLERANCE**2).all()) or f.rounds == MAX_ROUNDS
            if not f.done:
                f.centres = np.array(new)
    standing = [f for f in fits if len(f.centres)]
    for f, cost in zip(standing, costs(blocks, columns, standing, cost_unit) if standing else []):
        f.cost = cost * cost_unit
    return fits


@dataclass
class ClusterSearch:
    """Fit K-Means for each k on the train part; keep the best train silhouette."""

    train: DataFrame
    test: DataFrame
    columns: Sequence[str]
    k_range: Iterable[int] = K.K_RANGE
    seed: int = K.SEED
    restarts: int = K.RESTARTS
    parallelism: int = 8
    best_k: int | None = None
    best_model: Fit | None = None
    metrics: list[tuple[int, float | None, float | None, float]] = field(default_factory=list)

    def fit(self) -> ClusterSearch:
        """Features are in the shared folder, in blocks, while every pass reads them."""
        keys = [c for c in self.train.columns if c not in self.columns] or list(self.columns)
        ks = list(self.k_range)
        seeds = [self.seed + i for i in range(self.restarts)]
        ready = [part.select(*[F.col(c).cast("double").alias(c) for c in self.columns], F.xxhash64(*keys).alias(_DRAW)) for part in (self.train, self.test)]
        with stored(packed(dealt(ready[0]), self.columns)) as train, stored(packed(dealt(ready[1]), self.columns)) as test:
            models = fit_blocks(train, self.columns, [(k, s) for k in ks for s in seeds])
            # Of the restarts of one k the least training cost counts.
            kept = [min(models[i * len(seeds) : (i + 1) * len(seeds)], key=lambda m: (m.cost, m.seed)) for i in range(len(ks))]
            judged = [i for i, m in enumerate(kept) if len(m.centres) > 1]
            if judged:
                reach_of(test)
            on_parts = [dict(zip(judged, silhouettes(part, self.columns, [kept[i] for i in judged]) if judged else [])) for part in (train, test)]
        best = -1.0
        for i, (k, model) in enumerate(zip(ks, kept)):
            on_train, on_test = (scores.get(i) for scores in on_parts)
            self.metrics.append((k, on_train, on_test, float(model.cost)))
            if on_train is not None and on_train > best:
                best, self.best_k, self.best_model = on_train, k, model
        return self

    def metrics_frame(self) -> DataFrame:
        return self.train.sparkSession.createDataFrame(
            self.metrics, "k bigint, train_silhouette double, test_silhouette double, inertia double"
        )

    def assign(self) -> tuple[DataFrame, DataFrame]:
        """(train, test) with Segment."""
        if self.best_model is None:
            raise ValueError("fit() has to run before segments are assigned")
        segment = nearest_centre(self.columns, centres_of(self.best_model))
        return tuple(part.withColumn(SEGMENT, segment) for part in (self.train, self.test))


def squared_distance(columns: Sequence[str], centre: Sequence[float]) -> Column:
    terms = [(F.col(c) - F.lit(float(v))) * (F.col(c) - F.lit(float(v))) for c, v in zip(columns, centre)]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return total


def nearest_centre(columns: Sequence[str], centres: Centres) -> Column:
    """Id of the nearest centre, the lower id on a tie.

    Centres are literals: no join, no Python, and it runs on a stream.
    """
    options = [
        F.struct(squared_distance(columns, centre).alias("d"), F.lit(int(i)).cast("bigint").alias("id"))
        for i, centre in centres.items()
    ]
    return F.array_min(F.array(*options)).getField("id")


def centres_of(model: Fit) -> dict[int, list[float]]:
    return {i: [float(x) for x in c] for i, c in enumerate(model.centres)}


def off_nearest(labelled: DataFrame, columns: Sequence[str], centres: Centres) -> Column:
    """Condition on rows of ``labelled`` whose Segment is not (within rounding) at the least distance."""
    place = F.array(*[F.col(c).cast("double") for c in columns])
    ids = list(centres)
    away = [
        F.aggregate(F.zip_with(place, F.array(*[F.lit(float(v)) for v in centres[i]]), lambda a, b: F.pow(a - b, 2.0)), F.lit(0.0), lambda total, d: total + d)
        for i in ids
    ]
    own = F.create_map(*[x for i, d in zip(ids, away) for x in (F.lit(int(i)).cast("bigint"), d)])[F.col(SEGMENT).cast("bigint")]
    return own.isNull() | (own > F.least(*away) + 1e-9 if len(away) > 1 else F.lit(False))
