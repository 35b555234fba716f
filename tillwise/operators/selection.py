"""Exact order statistics of a large table by narrowing brackets.

A search looks for the key at one rank of a column. It keeps an open bracket of keys
that holds the rank and the number of rows below it. In each round

1. a random sample of the rows inside the bracket is drawn (about ``SAMPLE`` rows);
2. around the rank's place in the sample two splitters are picked, and one pass counts
   the rows below and equal to each, exactly;
3. the rank is then at a splitter (done), or in a bracket without the splitters that
   is some fifty times smaller.

When the bracket has no more rows than the sample may have, the sample is the whole
bracket and the key is read off. The sample decides only how fast a bracket shrinks: an
unlucky one gives a larger bracket, never another result. All searches share the
passes; a value held by a third of all rows is a splitter with its exact count at once.
Nothing is sorted or shuffled but one row of counts per task, and what reaches the
driver is samples.

The same rounds find a share: the rank at which a running sum passes a limit.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillwise.functions.numbers import exact_number, exact_parts, number_of
from tillwise.session import one_row

SAMPLE = 1 << 14
#: How many standard deviations of the sample's rank the splitters are apart from the rank's place.
SPREAD = 3.0


def key_literal(value, kind: T.DataType) -> Column:
    """A key as the literal that columns of its type compare with; a struct key is a tuple."""
    if isinstance(kind, T.StructType):
        return F.struct(*[key_literal(v, f.dataType).alias(f.name) for v, f in zip(value, kind.fields)])
    return F.lit(value).cast(kind)


@dataclass
class Bracket:
    """The open interval (low, high) of keys of a column; None: no bound."""

    column: str
    rows: int
    low: object = None
    high: object = None
    below: int = 0

    def inside(self, kind: T.DataType) -> Column:
        key = F.col(self.column)
        bounds = key.isNotNull()
        if self.low is not None:
            bounds = bounds & (key > key_literal(self.low, kind))
        if self.high is not None:
            bounds = bounds & (key < key_literal(self.high, kind))
        return bounds


def samples(df: DataFrame, brackets: Sequence[Bracket], seed: int) -> list[list]:
    """Of each bracket a sorted random sample; all of its rows if they are few."""
    kinds = {f.name: f.dataType for f in df.schema}
    draw = F.rand(seed)
    marked = df.select("*", draw.alias("__draw")).select(
        *[
            F.when(b.inside(kinds[b.column]) & (F.col("__draw") < min(1.0, SAMPLE / max(b.rows, 1))), F.struct(F.col(b.column).alias("key"))).alias(f"s{i}")
            for i, b in enumerate(brackets)
        ]
    )
    some = marked.where(" OR ".join(f"s{i} IS NOT NULL" for i in range(len(brackets))))
    drawn: list[list] = [[] for _ in brackets]
    for row in some.toArrow().to_pylist():  # about SAMPLE rows a bracket
        for own, cell in zip(drawn, row.values()):
            if cell is not None:
                key = cell["key"]
                own.append(tuple(key.values()) if isinstance(key, dict) else key)
    for own, b in zip(drawn, brackets):
        own.sort(key=_order)
        if b.rows <= SAMPLE and len(own) != b.rows:
            raise RuntimeError(f"the rows of {b.column} changed while they were searched")
    return drawn


def _order(key):
    """Nulls inside a struct key come first, as in Spark's comparison."""
    return tuple((v is not None, v if v is not None else 0) for v in key) if isinstance(key, tuple) else key


def around(sample: Sequence, place: float) -> list:
    """The two keys of a sample that most likely enclose the key at a share ``place`` of it."""
    middle, reach = place * len(sample), SPREAD * math.sqrt(len(sample)) / 2 + 1
    last = len(sample) - 1
    return [sample[min(max(int(math.floor(middle - reach)), 0), last)], sample[min(max(int(math.ceil(middle + reach)), 0), last)]]


def keys_at(df: DataFrame, ranks: Mapping[str, Sequence[int]], sizes: Mapping[str, int]) -> dict[tuple[str, int], object]:
    """The key at each 0-based rank of each column, nulls left out.

    ``sizes``: how many keys a column has. ``df`` is read twice for each round: pass a
    stored, narrow frame. Keys are numbers, strings, or structs of those.
    """
    kinds = {f.name: f.dataType for f in df.schema}
    open_ = {(c, r): Bracket(c, sizes[c]) for c, wanted in ranks.items() for r in wanted}
    found: dict[tuple[str, int], object] = {}
    seed = 0
    while open_:
        seed += 1
        groups: dict[tuple, tuple[Bracket, list[tuple[str, int]]]] = {}
        for search, b in open_.items():
            groups.setdefault((b.column, b.low, b.high), (b, []))[1].append(search)
        drawn = samples(df, [b for b, _ in groups.values()], seed)
        splitters: dict[str, dict[object, None]] = {}
        for (b, searches), sample in zip(groups.values(), drawn):
            if b.rows <= SAMPLE:
                found.update({s: sample[s[1] - b.below] for s in searches})
                continue
            for _, rank in searches if sample else []:
                splitters.setdefault(b.column, {}).update(dict.fromkeys(around(sample, (rank - b.below + 0.5) / b.rows)))
        open_ = {s: b for s, b in open_.items() if s not in found}
        if not splitters:
            continue
        counted = _counts(df, splitters, kinds)
        for (column, rank), b in list(open_.items()):
            low, high, below, end = b.low, b.high, b.below, b.below + b.rows
            for key in sorted(splitters.get(column, {}), key=_order):
                under, equal = counted[column, key]
                if under <= rank < under + equal:
                    found[column, rank] = key
                    break
                if under > rank:
                    if high is None or _order(key) < _order(high):
                        high, end = key, under
                    break
                if low is None or _order(key) > _order(low):
                    low, below = key, under + equal
            open_[column, rank] = Bracket(column, end - below, low, high, below)
        open_ = {s: b for s, b in open_.items() if s not in found}
    return found


def _counts(df: DataFrame, splitters: Mapping[str, Mapping[object, None]], kinds: Mapping[str, T.DataType]) -> dict[tuple[str, object], tuple[int, int]]:
    """(rows below, rows equal) for each splitter of each column: one pass."""
    asked = [(c, key) for c, keys in splitters.items() for key in keys]
    parts = []
    for i, (c, key) in enumerate(asked):
        mark = key_literal(key, kinds[c])
        parts += [F.count_if(F.col(c) < mark).alias(f"u{i}"), F.count_if(F.col(c) == mark).alias(f"e{i}")]
    row = one_row(df.agg(*parts))
    return {search: (row[f"u{i}"], row[f"e{i}"]) for i, search in enumerate(asked)}


def rows_for_share(df: DataFrame, value: str, share: Fraction) -> int | None:
    """How many of the largest values add up to ``share`` of the sum of all values.

    ``value``: a double column. None where the sum is not positive or never gets there.
    """
    first = one_row(df.agg(exact_parts(F.col(value)).alias("all"), *_above(value, 0.0, 0)))
    total, positive = exact_number(first["all"]), exact_number(first["s0"])
    wanted = share * total
    if total <= 0 or positive < wanted:
        return None
    # the answer lies in (low, high); above: rows from high on, and their sum; upto: rows over low
    low, high, above, sum_above, upto = 0.0, None, 0, Fraction(0), first["n0"]
    seed = 0
    while True:
        seed += 1
        b = Bracket(value, upto - above, low, high)
        (sample,) = samples(df, [b], seed)
        if b.rows <= SAMPLE:
            for key in reversed(sample):
                above, sum_above = above + 1, sum_above + number_of(key)
                if sum_above >= wanted:
                    return above
            raise ArithmeticError("a share is reached in its bracket")
        if not sample:
            continue
        weight, running, place = b.rows / len(sample), float(sum_above), len(sample)
        while place > 1 and running < wanted:
            place -= 1
            running += sample[place] * weight
        keys = sorted(set(around(sample, place / len(sample))), reverse=True)
        row = one_row(df.agg(*[part for i, key in enumerate(keys) for part in _above(value, key, i)]))
        for i, key in enumerate(keys):
            over, equal = exact_number(row[f"s{i}"]), exact_number(row[f"t{i}"])
            if over >= wanted:  # among larger ones
                low, upto = key, row[f"n{i}"]
                break
            if over + equal >= wanted:
                return row[f"n{i}"] + math.ceil((wanted - over) / (equal / row[f"e{i}"]))
            high, above, sum_above = key, row[f"n{i}"] + row[f"e{i}"], over + equal


def _above(value: str, key: float, i: int) -> list[Column]:
    """Count and sum of the rows over ``key``, and of those equal to it."""
    over, equal = F.when(F.col(value) > F.lit(key), F.col(value)), F.when(F.col(value) == F.lit(key), F.col(value))
    return [F.count(over).alias(f"n{i}"), exact_parts(over).alias(f"s{i}"), F.count(equal).alias(f"e{i}"), exact_parts(equal).alias(f"t{i}")]
