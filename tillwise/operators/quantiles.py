"""Exact interpolated quantiles, on one path at every size.

A quantile is one or two order statistics, found by narrowing brackets (see
``selection``): no column is gathered, sorted or windowed in one task, and a value
held by a third of all rows is one count.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.functions.numbers import nan_to_null_columns
from tillwise.operators.selection import keys_at
from tillwise.session import one_row, stored

Targets = Mapping[str, tuple[str, float]]


def exact_quantiles(df: DataFrame, targets: Targets, also: Mapping[str, Column] | None = None) -> dict[str, object]:
    """Numbers for ``alias -> (column, probability)``, fitted by jobs.

    Interpolates linearly between neighbouring ranks; nulls and NaN are left out; a
    column without values gives None. ``also`` are further aggregates over the
    columns that are asked for. ``df`` is read once: these columns are written to the
    shared folder, searched there, and deleted.
    """
    columns = list(dict.fromkeys(column for column, _ in targets.values()))
    asked = nan_to_null_columns(df.select(*columns))
    with stored(asked.select(*[F.col(c).cast("double").alias(c) for c in columns])) as narrow:
        first = one_row(
            narrow.agg(
                *[F.count(c).alias(f"n_{i}") for i, c in enumerate(columns)],
                *[c.alias(f"also_{n}") for n, c in (also or {}).items()],
            )
        )
        sizes = {c: first[f"n_{i}"] for i, c in enumerate(columns)}
        places = {a: p * (sizes[c] - 1) for a, (c, p) in targets.items() if sizes[c]}
        ranks: dict[str, set[int]] = {}
        for alias, place in places.items():
            ranks.setdefault(targets[alias][0], set()).update((math.floor(place), math.ceil(place)))
        keys = keys_at(narrow, {c: sorted(r) for c, r in ranks.items()}, sizes)
    found: dict[str, object] = dict.fromkeys(targets)
    for alias, place in places.items():
        low, high = (keys[targets[alias][0], f(place)] for f in (math.floor, math.ceil))
        found[alias] = low if low == high else low + (high - low) * (place - math.floor(place))
    return found | {n: first[f"also_{n}"] for n in (also or {})}
