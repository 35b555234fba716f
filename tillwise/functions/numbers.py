"""Numbers: missing values, exact sums, rounding and guarded division."""

from __future__ import annotations

from decimal import Decimal
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

# Amounts are added as decimal numbers (a double counts as the shortest decimal that
# reads back as it) in two parts of 38 digits each: whole units, and the rest with 18
# decimals. A sum is then exact and the same for any partitioning, from 10^-18 to 10^38.
_WHOLE, _REST, _UNIT = "decimal(38,0)", "decimal(38,18)", "decimal(1,0)"
# From here on a double is a whole number.
_NO_REST = 1e16
# Amounts of up to four decimals below 10^9 are whole numbers of 1/10,000, below 10^13: added as
# integers, which takes no decimal number a row and passes 2^63 after 9 * 10^9 rows at the earliest.
_PARTS, _MOST_PARTS = 10_000, 1e13

_INFINITY = float("inf")


def nan_to_null(c: Column) -> Column:
    """Missing values of a floating-point column in one form.

    NaN compares as the largest number in Spark, so it must not reach a
    comparison.
    """
    return F.when(~F.isnan(c), c)


def nan_to_null_columns(df: DataFrame) -> DataFrame:
    """``nan_to_null`` on every float and double column."""
    floats = {n for n, t in df.dtypes if t in ("double", "float")}
    if not floats:
        return df
    return df.select(*[nan_to_null(F.col(n)).alias(n) if n in floats else F.col(n) for n in df.columns])


def is_infinite(c: Column) -> Column:
    return F.abs(c) == F.lit(_INFINITY)


def finite_or_zero(c: Column) -> Column:
    """Null, NaN and both infinities become 0."""
    return F.when(F.abs(c) < F.lit(_INFINITY), c).otherwise(F.lit(0.0))


def amount_parts(c: Column) -> tuple[Column, Column]:
    """(whole units, rest in [0, 1)) of an amount; NaN is no amount, an infinite one raises."""
    x = nan_to_null(c.cast("double"))
    near = F.when(F.abs(x) < F.lit(_NO_REST), x).cast(_REST)
    return F.coalesce(F.floor(near).cast(_WHOLE), x.cast(_WHOLE)), F.pmod(near, F.lit(1).cast(_UNIT)).cast(_REST)


def amount_total(whole: Column, rest: Column) -> Column:
    """The double next to the sum of both parts; null when there are no whole units."""
    rest = F.coalesce(rest, F.lit(0).cast(_REST))
    units = whole + F.floor(rest).cast(_WHOLE)
    near = F.when(F.abs(units) < F.lit(10**17).cast(_WHOLE), units).cast("decimal(18,0)")
    return F.coalesce((near + F.pmod(rest, F.lit(1).cast(_UNIT))).cast("double"), units.cast("double"))


def exact_sum(c: Column) -> Column:
    """Sum of a money column; null when there is nothing to add.

    A double that a count of 1/10,000 below 10^15 divides to has that count as its shortest
    decimal, so common amounts are added as integers; all others by ``amount_parts``.
    """
    x = nan_to_null(c.cast("double"))
    parts = F.rint(x * F.lit(float(_PARTS)))
    common = (F.abs(parts) < F.lit(_MOST_PARTS)) & (parts / F.lit(float(_PARTS)) == x)
    count = F.when(common, parts).cast("bigint")
    rest = F.pmod(count, F.lit(_PARTS).cast("bigint"))
    units = F.floor((count - rest) / F.lit(float(_PARTS)))
    other_units, other_rest = (F.sum(part) for part in amount_parts(F.when(~common, x)))
    own_units, own_rest = F.sum(units).cast(_WHOLE), F.sum(rest).cast("decimal(18,0)") * F.lit(Decimal(1) / _PARTS)
    # 19 digits before the point on either side: with more, the sum would lose its last decimal
    all_rest = own_rest.cast("decimal(23,4)") + other_rest.cast("decimal(37,18)")
    return amount_total(F.coalesce((own_units + other_units).cast(_WHOLE), own_units, other_units), F.coalesce(all_rest.cast(_REST), own_rest.cast(_REST), other_rest))


def exact_parts(c: Column) -> Column:
    """The same sum as a pair for ``exact_number``."""
    whole, rest = amount_parts(c)
    return F.struct(F.sum(whole).alias("whole"), F.sum(rest).alias("rest"))


def exact_number(parts: Row) -> Fraction:
    return Fraction(parts["whole"] or 0) + Fraction(parts["rest"] or 0)


def number_of(x: float) -> Fraction:
    """The number that a double counts as."""
    return Fraction(Decimal(repr(x))) if abs(x) >= 1 else Fraction(round(Fraction(Decimal(repr(x))) * 10**18), 10**18)


def round_even(c: Column, digits: int) -> Column:
    """Round half to even by scaling, as numpy does."""
    scale = float(10**digits)
    return F.rint(c * scale) / scale


def ratio(part: Column, whole: Column, default: float | None = 0.0) -> Column:
    """``part / whole``; ``default`` where the whole is zero or null."""
    return F.when(whole != 0, part / whole).otherwise(F.lit(default).cast("double"))


def pct(part: Column, whole: Column, default: float | None = 0.0) -> Column:
    return ratio(part, whole, default) * 100.0


def count_where(condition: Column) -> Column:
    """How many rows meet a condition; unlike a sum it is 0 on no rows."""
    return F.count_if(F.coalesce(condition, F.lit(False)))
