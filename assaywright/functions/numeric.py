"""Column helpers whose results do not depend on the order of rows or on the engine's rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clamp01(x: Column | str) -> Column:
    """x limited to [0, 1]."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), col(x)))


def micro(x: Column | str) -> Column:
    """x in millionths, rounded half up: integers add up alike in any order."""
    return F.floor(col(x) * 1e6 + 0.5).cast("bigint")


def mean6(x: Column | str) -> Column:
    """The mean of a group to six decimals, from exact sums."""
    return F.sum(micro(x)) / F.count(col(x)) / 1e6


def round_to(x: Column | str, digits: int) -> Column:
    """Rounded half up by floor, which engines agree on."""
    return F.floor(col(x) * float(10**digits) + 0.5) / float(10**digits)


def fixed(x: Column | str, digits: int) -> Column:
    """x as text with a fixed number of decimals."""
    return F.call_function("format_number", col(x), F.lit("0" + ("." + "0" * digits if digits else "")))


def share(part: Column, whole: Column) -> Column:
    """part / whole as double, null where whole is zero."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def listed(*items: Column) -> Column:
    """An array of those items that are not null, in order."""
    return F.array_compact(F.array(*items))


def upper_median(values: Column | str) -> Column:
    """The element in the middle of the sorted array, the upper one of two."""
    x = F.array_sort(col(values))
    return F.get(x, (F.size(x) / 2).cast("int"))
