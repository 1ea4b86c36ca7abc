"""Statistics over array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lower_percentile(arr: Column | str, pct: float) -> Column:
    """Element at index ``floor((n - 1) * pct / 100)`` of the sorted non-NULL values; NULL for an empty array."""
    a = F.col(arr) if isinstance(arr, str) else arr
    a = F.array_sort(F.filter(a, lambda x: x.isNotNull()))
    return F.get(a, F.floor((F.size(a) - F.lit(1)) * F.lit(pct / 100.0)).cast("int"))


def array_mean(arr: Column | str) -> Column:
    """Mean of the non-NULL values; NULL for an empty array."""
    a = F.col(arr) if isinstance(arr, str) else arr
    a = F.filter(a, lambda x: x.isNotNull())
    total = F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    return F.try_divide(total, F.size(a))


def expand_counts(counts: Column | str, value: str, n: str = "n") -> Column:
    """The sorted list a ``value -> count`` array stands for, within its row."""
    c = F.col(counts) if isinstance(counts, str) else counts
    return F.flatten(F.transform(c, lambda x: F.array_repeat(x[value], x[n].cast("int"))))
