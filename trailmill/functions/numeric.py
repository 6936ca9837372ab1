"""Scalar arithmetic that must agree between engines to the last printed digit."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def jround(value: Column | str, digits: int = 8) -> Column:
    """Half-up rounding, floor(x * 10^k + 0.5) / 10^k; ``round`` on doubles differs on ties of their decimal form."""
    value = F.col(value) if isinstance(value, str) else value
    return F.floor(value * F.lit(10.0**digits) + F.lit(0.5)).cast("double") / F.lit(10.0**digits)


def stable(value: Column | str, digits: int) -> Column:
    """Rounded to 10 digits first, so that sums that differ in their last bits fall on the same side of a tie."""
    return jround(jround(value, 10), digits)


def clamp(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), value))


def java_hash(text: Column) -> Column:
    """The 31-multiplier string hash over code points as an unsigned 32-bit long (equal to UTF-16 units for the BMP)."""
    return F.aggregate(F.transform(F.split(text, ""), lambda c: F.when(F.length(c) > 0, F.ascii(c)).otherwise(F.lit(None).cast("int"))), F.lit(0).cast("long"), lambda h, c: F.when(c.isNull(), h).otherwise(F.pmod(h * 31 + c, F.lit(1 << 32))))


def traffic_fraction(key: Column) -> Column:
    """A stable number in [0, 1) per key."""
    return java_hash(key) / F.lit(float(1 << 32))


def mean_or_zero(value: Column) -> Column:
    return F.coalesce(F.avg(value), F.lit(0.0))


def exact_sum(value: Column, most: float) -> Column:
    """The sum of numbers from 0 to ``most``, 0 of none. Multiples of a power of two are summed as whole numbers, and only what is left of each
    (less than a millionth of ``most``) as doubles, so that the order of rows and the number of tasks do not show in the sum."""
    unit = F.lit(2.0 ** (math.ceil(math.log2(most)) - 20))
    whole = F.floor(value / unit)
    return F.coalesce(F.sum(whole) * unit + F.sum(value - whole * unit), F.lit(0.0))
