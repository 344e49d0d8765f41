"""Sums and means over prices of any numeric type.

NaN counts as missing, as null does. A decimal column is summed exactly (in a
wider decimal) and turned into a double once per group; a double column is
summed as double, so its last digits may follow the order of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def known(c: Column) -> Column:
    """``c`` with NaN as null; the type is kept."""
    return F.when(~F.isnan(c.cast("double")), c)


def total_of(s: Column) -> Column:
    """:func:`total` from a sum."""
    return F.coalesce(s.cast("double"), F.lit(0.0))


def mean_of(s: Column, n: Column) -> Column:
    """:func:`mean` from a sum and the count of what was summed."""
    return F.try_divide(s.cast("double"), n.cast("double"))


def total(c: Column) -> Column:
    """Sum as double; 0.0 when nothing is summed."""
    return total_of(F.sum(known(c)))


def mean(c: Column) -> Column:
    """Mean of the known values as double; null when there is none."""
    return mean_of(F.sum(known(c)), F.count(known(c)))
