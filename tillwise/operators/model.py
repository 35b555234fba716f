"""The fitted state of segmentation: scaler, caps, centres and names."""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tillwise import constants as K
from tillwise.operators.clusters import SEGMENT, ClusterSearch, centres_of
from tillwise.operators.naming import NAME, predict_segments, segment_names
from tillwise.operators.preprocess import prepare_training, upper_caps
from tillwise.schemas import existing_columns
from tillwise.session import read_file, replace_file

CURRENT = "CURRENT"


@dataclass
class SegmentModel:
    """Numbers only (a few per feature and centre), so that scoring is plain
    column arithmetic on a batch or a stream."""

    features: list[str]
    scaler: dict[str, tuple[float, float]]
    caps: dict[str, float]
    centres: dict[int, list[float]]
    names: dict[int, str]

    def predict(self, rfm: DataFrame, caps: str = "batch") -> DataFrame:
        """Segment and name every row: caps of this batch, or the fitted ones."""
        stored = self.caps if caps == "fitted" else None
        return predict_segments(rfm, self.scaler, self.centres, self.features, stored)

    def save(self, spark: SparkSession, path: str) -> str:
        """Write a new version and then make it the current one; gives the version's name.

        A version is a folder of its own that nothing changes later. The file ``CURRENT``
        names one version and is swapped in by a rename, so a reader has the old model
        or the new one, also if a save stops halfway.
        """
        version = f"version-{uuid.uuid4().hex}"
        rows = [("scaler", i, f, [float(x) for x in self.scaler[f]]) for i, f in enumerate(self.features)]
        rows += [("cap", i, f, [None if cap is None else float(cap)]) for i, (f, cap) in enumerate(self.caps.items())]
        rows += [("centre", i, None, [float(x) for x in c]) for i, c in self.centres.items()]
        rows += [("name", i, n, []) for i, n in self.names.items()]
        table = spark.createDataFrame(rows, "kind string, place int, label string, numbers array<double>")
        table.coalesce(1).write.parquet(f"{path}/{version}")
        replace_file(spark, f"{path}/{CURRENT}", version)
        return version

    @classmethod
    def load(cls, spark: SparkSession, path: str, version: str | None = None) -> SegmentModel:
        """The current version, or the one that is named."""
        version = version or read_file(spark, f"{path}/{CURRENT}")
        kept = sorted(spark.read.parquet(f"{path}/{version}").collect(), key=lambda r: r.place)  # a few numbers a feature and centre
        rows = {k: [r for r in kept if r.kind == k] for k in ("scaler", "cap", "centre", "name")}
        return cls(
            features=[r.label for r in rows["scaler"]],
            scaler={r.label: tuple(r.numbers) for r in rows["scaler"]},
            caps={r.label: r.numbers[0] for r in rows["cap"]},
            centres={r.place: list(r.numbers) for r in rows["centre"]},
            names={r.place: r.label for r in rows["name"]},
        )


def fit_segment_model(
    rfm: DataFrame,
    k_range: Iterable[int] = K.K_RANGE,
    seed: int = K.SEED,
    restarts: int = K.RESTARTS,
    test_ratio: float = K.TEST_RATIO,
) -> tuple[SegmentModel, ClusterSearch]:
    """Split, scale, search k, and name the clusters by raw Monetary.

    What reaches the driver is one number or two per feature and cluster. Pass
    a reused or stored ``rfm``: every step reads it.
    """
    features = existing_columns(rfm, K.RFM_FEATURES)
    data = prepare_training(rfm, test_ratio)
    search = ClusterSearch(data.train, data.test, features, k_range, seed, restarts).fit()
    if search.best_model is None:
        raise ValueError("no k gave two clusters on the train part")
    capped = existing_columns(rfm, K.CAPPED_FOR_SCORING)
    caps = upper_caps(data.raw_train, capped)
    centres = centres_of(search.best_model)
    named = segment_names(predict_segments(rfm, data.scaler, centres, features))
    names = {r[SEGMENT]: r[NAME] for r in named.collect()}
    # A cluster that got no customer still needs a name for later ones.
    names = {i: names.get(i, K.SEGMENT_LABEL_BEYOND) for i in centres}
    return SegmentModel(features, dict(data.scaler), caps, centres, names), search
