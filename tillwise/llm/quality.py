"""Quality classifier: evidence of the document, prior of its site.

Hierarchical empirical Bayes in three steps. Words and shapes of a text are found in
Python, an Arrow batch at a time; all counting, averaging and joining is Spark's.

1. Document evidence. On a sample of labelled documents, words, word beginnings and
   shapes are counted by label; those that tell the labels apart go into a sparse
   logistic regression. The evidence of a document is its log odds less the log
   odds of the sample's rate: what the text says, without any prior.
2. Site posteriors. Over all documents, the probability that the evidence gives
   under the overall rate is averaged by host (``source``) and by path within the
   host (``lang``). A host's rate is drawn to the overall rate, a path's rate to
   its host's, by a weight estimated from how much the rates differ beyond chance:
   sparse sites say little, large ones speak for themselves.
3. A document's posterior adds the log odds of its path's rate to its evidence.

Bounded: ``SAMPLE`` labelled rows, ``WORDS`` words per target, and the bins of
five shapes, all fixed parameters. Everything else covers all documents; sites are aggregated with
map-side combine, so a host with a third of all rows is one row per task.

Defined results
* null text counts as empty; null source or lang is a site of its own;
* rows are scored one by one, so repeated rows give repeated results; labels
  without document, with null, or given twice (unequal ones both count) do no harm;
* without labels of both kinds a target has no evidence and the rate 1/2, no document is rejected for it;
* an empty table gives no rows; extra columns are kept by ``keep_good``;
* texts of any length count whole; the words of one text are held at a time.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.llm.common import Scratch, fresh

SAMPLE = 20_000
WORDS = 300
BINS = 10
MIN_COUNT = 5
BROADCAST_SITES = 100_000
# Texts whose words are held in one piece of a batch.
PIECE = 256
MIN_RATIO = 1.5
MIN_SURPRISE = 16.0
PENALTY = 0.3
MARKS = ".,;:!?()[]{}\"'|$%&*#+-_/\\<>=@~^`"
SHAPES = ("distinct", "again", "signs", "wordless", "capital", "long")


def document_features(text: str | None) -> tuple[set[str], list[int]]:
    """The distinct words of a text with their first 3 and 5 letters, and the bin of each shape (-1: no words)."""
    tokens = (text or "").split()
    if not tokens:
        return set(), [-1] * len(SHAPES)
    own = set(tokens)
    plain = {t.lower().strip(MARKS) for t in own}
    counts = (
        len(own) / len(tokens) ** 0.75 / 2,  # texts gain new words ever more slowly
        sum(map(eq, tokens, tokens[1:])) / len(tokens),
        sum(not t[-2:].isalnum() and not t[-1].isalnum() and not t[-2].isalnum() for t in own if len(t) > 1) / len(own),
        sum(len(t) == 1 and not t.isalnum() for t in tokens) / len(tokens),
        sum(t[:2].isupper() for t in own if len(t) > 1) / len(own),
        sum(len(w) >= 12 for w in plain) / len(own),
    )
    found = plain | {w[:3] for w in plain} | {w[:5] for w in plain}
    found.discard("")
    return found, [min(int(c * BINS), BINS - 1) for c in counts]


@dataclass
class Evidence:
    """Weights of one target: for being labelled 1 against 0, without the rate."""

    rate: float
    base: float
    words: dict[str, float]
    bins: dict[str, dict[int, float]]

    def of(self, words: set[str], bins: list[int]) -> float:
        total = self.base + sum(self.words[w] for w in self.words.keys() & words)
        return total + sum(self.bins.get(s, {}).get(b, 0.0) for s, b in zip(SHAPES, bins))


def with_features(documents: DataFrame) -> DataFrame:
    """(text, labels ...) to (terms, labels ...): the words and shapes of a sample of documents."""
    rest = [c for c in documents.columns if c != "text"]

    def terms(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, PIECE) for b in batches for at in range(0, b.num_rows, PIECE)):
            out = []
            for text in batch.column("text"):
                words, bins = document_features(text.as_py())
                out.append(pa.array([*words, *(f"{s}={b}" for s, b in zip(SHAPES, bins))], pa.string()))
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in out]))).astype(np.int32)
            terms = pa.ListArray.from_arrays(pa.array(offsets), pa.concat_arrays(out))
            yield pa.RecordBatch.from_arrays([terms, *(batch.column(c) for c in rest)], ["terms", *rest])

    return documents.mapInArrow(terms, "terms array<string>, " + ", ".join(f"{c} {dict(documents.dtypes)[c]}" for c in rest))


def with_evidence(documents: DataFrame, models: dict[str, Evidence]) -> DataFrame:
    """(text, ...) to (..., evidence_t for each target t)."""
    rest = [c for c in documents.columns if c != "text"]

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = np.empty((len(models), batch.num_rows))
            for row, text in enumerate(batch.column("text")):
                found = document_features(text.as_py())  # of one text at a time
                scores[:, row] = [m.of(*found) for m in models.values()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), *map(pa.array, scores)], [*rest, *(f"evidence_{t}" for t in models)])

    schema = [f"{c} {dict(documents.dtypes)[c]}" for c in rest] + [f"evidence_{t} double" for t in models]
    return documents.mapInArrow(score, ", ".join(schema))


def telling_words(sample: DataFrame, target: str, all1: float, all0: float) -> list[str]:
    """The words that speak most surely for the rarer label."""
    one, zero = F.sum(F.col(target)).cast("double"), F.sum(1 - F.col(target)).cast("double")
    counted = sample.select(target, F.explode("terms").alias("w")).groupBy("w").agg(one.alias("n1"), zero.alias("n0"))
    n1, n0, share = F.col("n1"), F.col("n0"), all1 / (all1 + all0)

    def part(n: Column, expected: float) -> Column:
        return F.when(n > 0, n * F.log(n / ((n1 + n0) * expected))).otherwise(0.0)

    surprise = 2 * (part(n1, share) + part(n0, 1 - share))  # likelihood ratio statistic of the word's two counts
    llr = F.log((n1 + 0.5) / (all1 + 1)) - F.log((n0 + 0.5) / (all0 + 1))
    rare, toward = (n1, llr) if all1 <= all0 else (n0, -llr)
    strong = counted.withColumn("surprise", surprise).where((rare >= MIN_COUNT) & (toward >= MIN_RATIO) & (F.col("surprise") >= MIN_SURPRISE))
    return [r["w"] for r in strong.orderBy(F.desc("surprise"), "w").limit(WORDS).collect()]


def fit(sample: DataFrame, target: str) -> Evidence:
    """``sample``: features and the label ``target`` (0 or 1) of a bounded number of documents."""
    total = sample.agg(F.sum(F.col(target)).alias("n1"), F.sum(1 - F.col(target)).alias("n0")).first()
    all1, all0 = float(total["n1"] or 0), float(total["n0"] or 0)
    if not all1 or not all0:
        return Evidence(0.5, 0.0, {}, {})
    chosen = telling_words(sample, target, all1, all0)
    marks = [f"{s}={b}" for s in SHAPES for b in range(-1, BINS)]
    chosen = [w for w in chosen if w not in marks]
    names = chosen + marks
    known = F.array_intersect("terms", F.split(F.lit(" ".join(names)), " "))
    rows = sample.select(F.col(target).alias("y"), known.alias("terms")).collect()  # at most `sample` rows of at most these names
    place = {n: i for i, n in enumerate(names)}
    x = np.zeros((len(rows), len(names) + 1))
    for i, r in enumerate(rows):
        x[i, [place[t] for t in r["terms"]]] = 1
    x[:, -1] = 1
    weights = ridge_logistic(x, np.array([r["y"] for r in rows], dtype=float))
    by_name = dict(zip(names, weights.tolist()))
    bins = {s: {b: by_name[f"{s}={b}"] for b in range(-1, BINS)} for s in SHAPES}
    return Evidence(all1 / (all1 + all0), float(weights[-1]) - math.log(all1 / all0), {w: by_name[w] for w in chosen}, bins)


def ridge_logistic(x: np.ndarray, y: np.ndarray, rounds: int = 25) -> np.ndarray:
    """Logistic regression by Newton steps; the last column is the intercept, the others are held small."""
    held = np.full(x.shape[1], PENALTY)
    held[-1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(held), x.T @ (y - p) - held * w)
        w += step * min(1.0, 4 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return w


def log_odds(p: Column) -> Column:
    return F.log(p) - F.log(1 - p)


def probability(odds: Column) -> Column:
    return 1 / (1 + F.exp(-odds))


def pull(rows: DataFrame, n: str, rate: str, toward: Column) -> float:
    """How many documents' worth the upper level's rate weighs: from the spread of the rates beyond chance."""
    got = rows.where(F.col(n) > 1).agg(
        F.sum(F.col(n) * (F.col(rate) - toward) ** 2).alias("spread"), F.sum(toward * (1 - toward)).alias("chance"), F.sum(n).alias("n"), F.sum(toward * (1 - toward) * F.col(n)).alias("within"),
    ).first()
    if not got["n"] or not got["within"]:
        return 100.0
    between = (got["spread"] - got["chance"]) / got["n"]
    return min(1e4, max(1.0, got["within"] / got["n"] / between - 1)) if between > 0 else 1e4


def site_rates(scored: DataFrame, target: str, rate: float) -> DataFrame:
    """Rows _host, _path, rate: the shrunken rate of each path of each host."""
    p = probability(F.col(f"evidence_{target}") + math.log(rate / (1 - rate)))
    paths = scored.groupBy("_host", "_path").agg(F.count("*").alias("n"), F.sum(p).alias("s"))
    hosts = paths.groupBy("_host").agg(F.sum("n").alias("host_n"), F.sum("s").alias("host_s")).withColumn("host_raw", F.col("host_s") / F.col("host_n"))
    overall = paths.agg((F.sum("s") / F.sum("n")).alias("p")).first()["p"] or rate
    overall = min(max(overall, 1e-6), 1 - 1e-6)
    weight = pull(hosts, "host_n", "host_raw", F.lit(overall))
    hosts = hosts.select("_host", ((F.col("host_s") + weight * overall) / (F.col("host_n") + weight)).alias("host_rate"))
    paths = paths.join(hosts.withColumnRenamed("_host", "_h"), F.col("_host") == F.col("_h")).drop("_h").withColumn("raw", F.col("s") / F.col("n"))
    weight = pull(paths, "n", "raw", F.col("host_rate"))
    return paths.select("_host", "_path", ((F.col("s") + weight * F.col("host_rate")) / (F.col("n") + weight)).alias(f"rate_{target}"))


def quality_scores(
    documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang",
    targets: tuple[str, ...] = ("quality", "toxic"), sample: int = SAMPLE,
) -> DataFrame:
    """Rows doc_id, text_hash and, for each target t, evidence_t, rate_t (its site's) and p_t.

    ``sample``: labelled rows to fit on, those with the smallest hash of their id.
    """
    scratch = Scratch(documents.sparkSession, "quality")
    site = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n) for c, n in ((host_col, "_host"), (path_col, "_path"))]
    docs = documents.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), *site)
    known = labels.select(F.col(f"`{id_col}`").alias("__own_id"), *[F.col(f"`{t}`").cast("int").alias(t) for t in targets]).dropna()
    chosen = known.orderBy(F.xxhash64("__own_id"), *known.columns).limit(sample)
    labelled = docs.join(F.broadcast(chosen), F.col("doc_id") == F.col("__own_id")).select("text", *targets)  # at most `sample` small rows
    labelled = scratch.keep(with_features(labelled), "sample")
    models = {t: fit(labelled, t) for t in targets}
    scored = scratch.keep(with_evidence(docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "_host", "_path", "text"), models), "evidence")
    sites = None
    for t, m in models.items():
        one = site_rates(scored, t, m.rate)
        sites = one if sites is None else sites.join(one, ["_host", "_path"])
    sites = scratch.keep(sites, "sites")
    # a host may have a third of all documents: not dealt by host while the rates are known to be few
    out = scored.join(F.broadcast(sites) if sites.count() <= BROADCAST_SITES else sites, ["_host", "_path"])
    p = {f"p_{t}": probability(F.col(f"evidence_{t}") + log_odds(F.col(f"rate_{t}"))) for t in targets}
    return out.withColumns(p).drop("_host", "_path")


def keep_good(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents that are likely good (p_quality over 1/2) and not toxic (p_toxic up to 1/2); columns as they are."""
    scores = quality_scores(documents, labels, id_col, text_col, **options)
    own_id, own_hash = fresh(documents, "__own_id"), fresh(documents, "__own_hash")
    bad = scores.where(rejected()).select(F.col("doc_id").alias(own_id), F.col("text_hash").alias(own_hash))
    text = F.col(f"`{text_col}`")
    same = F.col(f"`{id_col}`").eqNullSafe(F.col(own_id)) & (F.xxhash64(text) == F.col(own_hash))
    return documents.join(bad, same, "left_anti")


def rejected() -> Column:
    return (F.col("p_quality") < 0.5) | (F.col("p_toxic") > 0.5)
