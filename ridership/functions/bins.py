"""Class bins as expressions (H3-H6)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Bound = tuple[float, float]

# Inclusive load classes, the interval edges used for scoring, and the same-day edges with their gaps.
LOAD_CLASSES: list[Bound] = [(0.0, 9.0), (10.0, 16.0), (17.0, 55.0), (56.0, 75.0), (76.0, 100.0)]
SAME_DAY_CLASSES: list[Bound] = [(0.0, 6.0), (7.0, 12.0), (13.0, 55.0), (56.0, 75.0), (76.0, 100.0)]
SCORING_EDGES: list[Bound] = [(-1, 9), (9, 16), (16, 55), (55, 75), (75, 100)]
SAME_DAY_EDGES: list[Bound] = [(-1, 6), (7, 12), (13, 55), (56, 75), (76, 100)]
HIGH_LOAD_BOUNDS: list[Bound] = [(16.0, 55.0), (56.0, 75.0), (76.0, 100.0)]
CLASS_BINS = [0, 33, 66, 100]
TARGET_MAX = 100


def _chain(tests: Sequence[Column], otherwise: Column) -> Column:
    out = otherwise
    for i in range(len(tests) - 1, -1, -1):
        out = F.when(tests[i], F.lit(i)).otherwise(out)
    return out


def assign_class(value: Column | str, bounds: Sequence[Bound]) -> Column:
    """First bin with ``lo <= v <= hi``, NULL if none (H3); integer edges leave gaps for fractions."""
    v = F.col(value) if isinstance(value, str) else value
    return _chain([(v >= F.lit(lo)) & (v <= F.lit(hi)) for lo, hi in bounds], F.lit(None).cast("int"))


def interval_cut(value: Column | str, edges: Sequence[Bound] = SCORING_EDGES) -> Column:
    """Number of the right-closed interval ``(lo, hi]``, -1 outside and for NULL (H5)."""
    v = F.col(value) if isinstance(value, str) else value
    return _chain([(v > F.lit(lo)) & (v <= F.lit(hi)) for lo, hi in edges], F.lit(-1))


def same_day_cut(value: Column | str) -> Column:
    """``interval_cut`` with the same-day edges: 7, 13, 56 and 76 fall in no interval (H6)."""
    return interval_cut(value, SAME_DAY_EDGES)


def adjusted_bounds(bounds: Sequence[Bound]) -> list[Bound]:
    """The two lower class bounds with the top class split at 55 and 75 (H4)."""
    return [*bounds[:2], *HIGH_LOAD_BOUNDS]


def adjust_bins(value: Column | str, cls: Column | str) -> Column:
    """Class 3 for 56..75 and class 4 for 76..100, any other row keeps its class (H4)."""
    v = F.col(value) if isinstance(value, str) else value
    c = F.col(cls) if isinstance(cls, str) else cls
    (lo3, hi3), (lo4, hi4) = HIGH_LOAD_BOUNDS[1:]
    return (
        F.when((v >= F.lit(lo3)) & (v <= F.lit(hi3)), F.lit(3))
        .when((v >= F.lit(lo4)) & (v <= F.lit(hi4)), F.lit(4))
        .otherwise(c)
    )
