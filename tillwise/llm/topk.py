"""Exact top-k search by inner product, score at a time over an impact-ordered index.

Vectors are turned into integers and dealt into blocks of bounded size. Of each
block the index holds, per component, posting segments: the rows in order of their
value, cut into ``SEGMENTS`` runs, each with its largest and smallest value. For a
block of queries, a segment's impact is the most its rows can gain from that component.

Segments are processed by descending impact, in rounds. After a round every row
has a bound for each query: what its processed segments give plus, for the others, the
impact the component has left; two matrix products give the bounds of a block of queries
that have no proof yet. Rows with the highest bounds are scored exactly, the k-th
score is the limit, and all rows whose bound reaches it are possible members. The
search stops on proof only: when every possible member has been scored exactly.
Blocks answer for themselves; the k best of a query over all blocks follow.

Bounds and the search use float64 with a margin for its rounding. Possible members are
rescored as integers: by float64 where no sum can reach 2^53, by 64-bit numbers where none
can reach 2^63, and beyond by numbers of any length.

Queries are held in blocks too. Groups of row blocks meet the query blocks in parts of
``QUERY_BLOCKS``: the join's key is the group and the part. Its sides hold few and large rows that
are copied for the join only, so their size in files says little: it is a merge join by hint, and
nothing is broadcast or collected. Queries are copied once a group, not once a block: as often as
takes about the room of the rows, or once for each task of a shuffle.

Defined results
* vectors that are null, empty or hold null or non-finite numbers take no part, nor do null ids;
* vectors of another length than the query's are not compared with it;
* a query is not compared with rows of its own id; repeated rows are listed once each;
* ties go to the smaller id; fewer than k rows: all; an empty table: no rows;
* scores are exact 64-bit integers; a component or a score beyond 64 bits raises an error.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillwise.llm.common import Scratch, partitions

SCALE = 1024
BLOCK = 4096
QUERY_BLOCK = 512
QUERY_BLOCKS = 32
SEGMENTS = 16
#: Shares of the posting segments that are processed when a round ends.
ROUNDS = (0.25, 0.5, 1.0)
#: Components whose bounds are written out at a time.
COMPONENTS = 64


def integers(vector: Column, scale: int = SCALE) -> Column:
    def whole(x: Column) -> Column:
        scaled = x.cast("double") * scale
        return F.when(F.abs(scaled) < 2.0**63, F.floor(scaled).cast("long")).otherwise(F.raise_error(F.lit("a component is beyond 64 bits")).cast("long"))

    return F.transform(vector, whole)


def usable(vector: Column) -> Column:
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(sound, F.lit(False))


def in_blocks(rows: DataFrame, size: int, per: str) -> tuple[DataFrame, int]:
    """Rows (id, v) as blocks (dim, block, ids, values) of about ``size`` rows of one length; and how many there may be."""
    count = rows.count()
    number = max(1, -(-count // size))

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("id")
        values = np.stack(frame["v"].to_numpy()).astype("<i8")
        ids = frame["id"].to_numpy().astype("<i8")
        return pd.DataFrame({"dim": [values.shape[1]], per: [frame[per].iloc[0]], f"{per}_ids": [ids.tobytes()], f"{per}_values": [values.tobytes()]})

    dealt = rows.select("id", "v", F.size("v").alias("dim"), F.pmod(F.xxhash64("id"), F.lit(number)).alias(per))
    return dealt.groupBy("dim", per).applyInPandas(pack, f"dim int, {per} long, {per}_ids binary, {per}_values binary"), number


class Index:
    """Posting segments of one block."""

    def __init__(self, values: np.ndarray) -> None:
        self.whole, self.values = values, values.astype(np.float64)
        n, self.dim = values.shape
        self.most = np.abs(self.values).max(axis=0)
        self.segments = min(SEGMENTS, n)
        order = np.argsort(-values, axis=0, kind="stable")
        edges = np.linspace(0, n, self.segments + 1).astype(int)
        sorted_values = np.take_along_axis(self.values, order, axis=0)  # the same order, as float64 is monotone
        self.high = sorted_values[edges[:-1]].T  # dim x segments
        self.low = sorted_values[edges[1:] - 1].T
        run = np.repeat(np.arange(self.segments), np.diff(edges))
        self.segment = np.empty((self.dim, n), dtype=np.intp)
        np.put_along_axis(self.segment, order.T, np.broadcast_to(run, (self.dim, n)), axis=1)

    def exact(self, rows: np.ndarray, query: np.ndarray, reach: float) -> np.ndarray:
        """Integer scores; ``reach``: no sum of products of this block and query is larger."""
        if reach < 2.0**52:
            return (self.values[rows] @ query.astype(np.float64)).astype(np.int64)
        if reach < 2.0**62:
            return self.whole[rows] @ query
        scores = self.whole[rows].astype(object) @ query.astype(object)
        if any(abs(x) >= 1 << 63 for x in scores):
            raise OverflowError("a score is beyond 64 bits")
        return scores.astype(np.int64)

    def bounds(self, queries: np.ndarray, processed: np.ndarray) -> np.ndarray:
        """The most each row can score for each query, as far as the ``processed`` segments (dim x segments) tell."""
        # what a component has left: the largest value, or smallest, of its other segments
        high = np.where(processed, self.high, np.where(processed, -np.inf, self.high).max(axis=1, keepdims=True))
        low = np.where(processed, self.low, np.where(processed, np.inf, self.low).min(axis=1, keepdims=True))
        most = np.zeros((len(queries), len(self.values)))
        for begin in range(0, self.dim, COMPONENTS):
            c = slice(begin, begin + COMPONENTS)
            most += np.maximum(queries[:, c], 0) @ np.take_along_axis(high[c], self.segment[c], axis=1)
            most += np.minimum(queries[:, c], 0) @ np.take_along_axis(low[c], self.segment[c], axis=1)
        return most

    def search(self, queries: np.ndarray, k: int, barred: list[slice]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query, rows that may be among the k best, with their exact scores; the k best are among them."""
        n = len(self.values)
        q = queries.astype(np.float64)
        reach = np.abs(q) @ self.most
        margin = np.where(reach < 2.0**52, 0.0, reach * (self.dim + 2) * 2.0**-52)  # of a sum in float64
        up, down = np.maximum(q, 0).max(axis=0)[:, None], np.maximum(-q, 0).max(axis=0)[:, None]
        gain = np.maximum(up * (self.high - self.high[:, -1:]), down * (self.low[:, :1] - self.low))  # for the query that gains most
        ranked = np.argsort(-gain, axis=None, kind="stable")
        scored = [(np.zeros(0, np.intp), np.zeros(0))] * len(q)
        limit = np.full(len(q), -np.inf)
        open_ = np.arange(len(q))
        for share in ROUNDS:
            processed = np.zeros(gain.size, dtype=bool)
            processed[ranked[: int(np.ceil(share * gain.size))]] = True
            still = []
            for i, most in zip(open_.tolist(), self.bounds(q[open_], processed.reshape(gain.shape))):
                most[barred[i]] = -np.inf
                rows, score = scored[i]
                if limit[i] == -np.inf:
                    first = np.argpartition(-most, min(4 * k, n - 1))[: 4 * k + 1]
                    first = first[most[first] > -np.inf]
                    rows, score = first, self.values[first] @ q[i]
                if len(score) >= k:
                    limit[i] = np.partition(score, len(score) - k)[len(score) - k] - 2 * margin[i]
                most[rows] = -np.inf
                possible = np.flatnonzero((most >= limit[i]) & (most > -np.inf))
                if len(possible) <= n // 16 or share == ROUNDS[-1]:
                    rows, score = np.concatenate((rows, possible)), np.concatenate((score, self.values[possible] @ q[i]))
                else:
                    still.append(i)
                scored[i] = rows, score
            open_ = np.array(still, dtype=np.intp)
            if not len(open_):
                break
        found = []
        for i, (rows, score) in enumerate(scored):
            members = rows[score >= limit[i] - 2 * margin[i]]
            found.append((members, self.exact(members, queries[i], reach[i])))
        return found


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:k]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """Rows query_id, rank, vec_id, score. ``vectors`` and ``queries``: id (long) and v (array of long)."""
    scratch = Scratch(vectors.sparkSession, "topk")
    held, blocks = in_blocks(vectors, block, "block")
    asked, query_blocks = in_blocks(queries, query_block, "query")
    parts = -(-query_blocks // QUERY_BLOCKS)
    groups = min(blocks, max(partitions(vectors.sparkSession), blocks * block // (query_blocks * query_block)))
    held = scratch.keep(held, "index").withColumn("block_group", F.pmod("block", F.lit(groups)).cast("int"))
    held = held.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    asked = scratch.keep(asked, "queries").withColumn("part", F.pmod("query", F.lit(parts)).cast("int"))
    asked = asked.withColumn("block_group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    pairs = held.join(asked.hint("merge"), ["dim", "block_group", "part"])

    def search(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, index = None, None
        for frame in frames:
            for row in frame.itertuples():
                ids = np.frombuffer(row.block_ids, "<i8")
                if last != (row.dim, row.block):
                    last, index = (row.dim, row.block), Index(np.frombuffer(row.block_values, "<i8").reshape(-1, row.dim))
                query_ids = np.frombuffer(row.query_ids, "<i8")
                barred = [slice(*x) for x in zip(np.searchsorted(ids, query_ids), np.searchsorted(ids, query_ids, side="right"))]
                found = index.search(np.frombuffer(row.query_values, "<i8").reshape(-1, row.dim), k, barred)
                tops = [best(ids[members], scores, k) for members, scores in found]
                yield pd.DataFrame({
                    "query_id": np.repeat(query_ids, [len(top) for top in tops]),
                    "vec_id": np.concatenate([ids[members][top] for (members, _), top in zip(found, tops)]),
                    "score": np.concatenate([scores[top] for (_, scores), top in zip(found, tops)]),
                })

    found = pairs.mapInPandas(search, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def embedding_rows(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    rows = embeddings.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").alias("v"))
    return rows.where(F.col("id").isNotNull() & usable(F.col("v"))).select("id", integers(F.col("v"), scale).alias("v"))
