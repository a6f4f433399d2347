"""Sums, means and deviations that do not depend on the order of rows, and rounding by a multiple, as SQL engines do it.

A sum of doubles differs in its last bits with the order of rows, so that equal groups compare as unequal. Doubles that are
decimals of up to six places are added as whole numbers instead, and rounded once; a group with any other value is added as is.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_UNIT, _LIMB = 1_000_000, 26


def _whole(x: Column, limit: float) -> Column:
    """x in millionths as a whole number; NULL where it is none or not below the limit."""
    k = F.rint(x * F.lit(float(_UNIT)))
    return F.when((F.abs(x) < F.lit(limit)) & (k / F.lit(float(_UNIT)) == x), k.cast("long"))


def _total(k: Column) -> Column:
    """Sum of whole numbers in two parts, neither of which can overflow."""
    high, low = F.sum(F.shiftright(k, _LIMB)), F.sum(k.bitwiseAND(F.lit((1 << _LIMB) - 1)))
    return high.cast("decimal(20,0)") * F.lit(1 << _LIMB).cast("decimal(10,0)") + low.cast("decimal(20,0)")


def exact_sum(x: Column) -> Column:
    """Aggregate: sum of doubles."""
    k = _whole(x, 2.0**33)
    return F.when(F.count(k) == F.count(x), _total(k).cast("double") / F.lit(float(_UNIT))).otherwise(F.sum(x))


def exact_mean(x: Column) -> Column:
    """Aggregate: mean of doubles."""
    return F.when(F.count(x) > 0, exact_sum(x) / F.count(x))


def exact_deviation(x: Column) -> Column:
    """Aggregate: population deviation of doubles."""
    k, n = _whole(x, 2147.0), F.count(x)
    count, total, squares = (v.cast("decimal(38,0)") for v in (n, _total(k), _total(k * k)))
    spread = (count * squares - total * total).cast("double")
    return F.when((n > 0) & (F.count(k) == n) & (n < 10_000_000), F.sqrt(spread) / n / F.lit(float(_UNIT))).otherwise(F.stddev_pop(x))


def round_half(x: Column, places: int) -> Column:
    """Rounded by a multiple: halves, as the product shows them, go away from zero."""
    scale = F.lit(10.0**places)
    y = x * scale
    return F.when(F.abs(y) < F.lit(2.0**52), F.round(y, 0) / scale).otherwise(x)
