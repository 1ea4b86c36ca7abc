"""Exact distribution operators over value counts.

Every operator first reduces the rows to counts per value, so the work after the first shuffle grows with the number of
distinct values. Cumulative counts run through ``ordered.running_sum``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridership.operators.ordered import PIECE_ROWS, Along, over_neighbours, running_sum
from ridership.session import stage


def value_counts(df: DataFrame, col: str, by: Sequence[str] = ()) -> DataFrame:
    """Counts per non-NULL value with the running count up to and including it."""
    hist = df.filter(F.col(col).isNotNull()).groupBy(*by, F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return hist


def _by_value(piece_rows: int) -> Along:
    return Along(["value"], F.col("value"), piece_rows)


def _cumulative(df: DataFrame, col: str, by: Sequence[str], piece_rows: int) -> DataFrame:
    """Counts per value with ``cum`` and ``_total``. The counts are stored, so the rows are read once."""
    hist = stage(value_counts(df, col, by), "value_counts")
    totals = hist.groupBy(*by).agg(F.sum("n").alias("_total"))
    out = running_sum(hist, by, _by_value(piece_rows), {"cum": F.col("n")})
    return out.join(totals, list(by)) if by else out.withColumn("_total", totals.scalar())


def exact_quantiles(
    df: DataFrame,
    col: str,
    qs: Sequence[float],
    by: Sequence[str] = (),
    kind: str = "linear",
    piece_rows: int = PIECE_ROWS,
) -> DataFrame:
    """Exact quantiles as columns ``q0, q1, ...``; one row per group, or one row without ``by``.

    ``lower`` takes the value at index ``floor((n - 1) * q)``, ``linear`` interpolates to the next index.
    """
    by = list(by)
    hist = _cumulative(df, col, by, piece_rows)

    def at(index: Column) -> Column:
        return F.min(F.when(F.col("cum") > index, F.col("value")))

    aggs = []
    for i, q in enumerate(qs):
        pos = (F.col("_total") - 1) * F.lit(float(q))
        aggs.append(at(F.floor(pos)).alias(f"_lo{i}"))
        if kind == "linear":
            aggs.append(at(F.ceil(pos)).alias(f"_hi{i}"))
            aggs.append(F.max(pos - F.floor(pos)).alias(f"_frac{i}"))
    out = hist.groupBy(*by).agg(*aggs)
    cols = [
        (F.col(f"_lo{i}") + F.col(f"_frac{i}") * (F.col(f"_hi{i}") - F.col(f"_lo{i}"))).alias(f"q{i}")
        if kind == "linear"
        else F.col(f"_lo{i}").alias(f"q{i}")
        for i in range(len(qs))
    ]
    return out.select(*by, *cols)


def lower_percentiles(df: DataFrame, col: str, pcts: Sequence[float]) -> DataFrame:
    """Values at index ``floor((n - 1) * p / 100)`` as ``q0, q1, ...`` (H1)."""
    return exact_quantiles(df, col, [p / 100.0 for p in pcts], kind="lower")


def class_bounds(df: DataFrame, col: str, pcts: Sequence[float] = (0, 33, 66, 100), kind: str = "lower") -> DataFrame:
    """One row of inclusive class bounds ``lo0, hi0, lo1, ...`` (H2).

    ``lower`` gives three classes from the data, ``linear`` keeps two of them and fixes the top at 55, 75 and 100.
    """
    q = exact_quantiles(df, col, [p / 100.0 for p in pcts], kind=kind)
    q = q.select(*[F.col(c).cast("double").alias(c) for c in q.columns])
    lo_hi = [("q0", "q1"), (F.col("q1") + 1, "q2")]
    if kind == "lower":
        lo_hi.append((F.col("q2") + 1, "q3"))
    else:
        lo_hi += [(F.col("q2") + 1, F.lit(55.0)), (F.lit(56.0), F.lit(75.0)), (F.lit(76.0), F.lit(100.0))]
    cols = []
    for i, (lo, hi) in enumerate(lo_hi):
        cols.append((F.col(lo) if isinstance(lo, str) else lo).alias(f"lo{i}"))
        cols.append((F.col(hi) if isinstance(hi, str) else hi).alias(f"hi{i}"))
    return q.select(*cols)


def collect_bounds(bounds: DataFrame) -> list[tuple[float, float]]:
    """The one row of ``class_bounds`` as Python pairs, to be used as literals."""
    row = bounds.first()
    return [(row[f"lo{i}"], row[f"hi{i}"]) for i in range(len(bounds.columns) // 2)]


def ecdf(df: DataFrame, col: str, by: Sequence[str] = (), piece_rows: int = PIECE_ROWS) -> DataFrame:
    """Empirical distribution function at each distinct value (F8)."""
    by = list(by)
    hist = _cumulative(df, col, by, piece_rows)
    return hist.select(*by, "value", (F.col("cum") / F.col("_total")).alias("cdf"))


def ecdf_inverse(
    curve: DataFrame, ps: Sequence[float], by: Sequence[str] = (), piece_rows: int = PIECE_ROWS
) -> DataFrame:
    """Linear inverse of ``ecdf`` at each ``p``; NULL-free: a ``p`` outside the curve gives no row (F8)."""
    steps = over_neighbours(
        curve,
        by,
        _by_value(piece_rows),
        1,
        {"_cdf0": lambda w: F.lag("cdf").over(w), "_value0": lambda w: F.lag("value").over(w)},
        carry=["cdf"],
    )
    hit = (F.col("cdf") == F.col("p")) | ((F.col("_cdf0") < F.col("p")) & (F.col("p") < F.col("cdf")))
    frac = (F.col("p") - F.col("_cdf0")) / (F.col("cdf") - F.col("_cdf0"))
    x = F.when(F.col("cdf") == F.col("p"), F.col("value")).otherwise(
        F.col("_value0") + frac * (F.col("value") - F.col("_value0"))
    )
    return (
        steps.withColumn("p", F.explode(F.array(*[F.lit(float(p)) for p in ps])))
        .filter(hit)
        .select(*by, "p", x.cast("double").alias("x"))
    )


def describe(df: DataFrame, cols: Sequence[str], piece_rows: int = PIECE_ROWS) -> DataFrame:
    """count, mean, std, min, quartiles and max, one row per column."""
    cells = df.select(
        F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in cols])).alias("c")
    ).select("c.*")
    stats = cells.groupBy("column").agg(
        F.count("x").alias("count"),
        F.avg("x").alias("mean"),
        F.stddev("x").alias("std"),
        F.min("x").alias("min"),
        F.max("x").alias("max"),
    )
    quart = exact_quantiles(cells, "x", [0.25, 0.5, 0.75], by=["column"], piece_rows=piece_rows)
    return stats.join(quart.withColumnsRenamed({"q0": "p25", "q1": "p50", "q2": "p75"}), "column")


NORMAL_Z_95 = 1.959963984540054  # fixed value: two-sided 95 % point of the standard normal


def normal_fit_ci(df: DataFrame, col: str, z: float = NORMAL_Z_95) -> DataFrame:
    """Mean, population standard deviation and the central interval."""
    fit = df.agg(F.avg(col).alias("mu"), F.stddev_pop(col).alias("sigma"))
    return fit.select(
        "mu",
        "sigma",
        (F.col("mu") - F.lit(z) * F.col("sigma")).alias("ci_lo"),
        (F.col("mu") + F.lit(z) * F.col("sigma")).alias("ci_hi"),
    )


def kde(df: DataFrame, col: str, grid: Sequence[float]) -> DataFrame:
    """Gaussian density on a grid with the Scott bandwidth.

    Each distinct value meets each grid point once; the sums are combined within a task before the shuffle.
    """
    stats = df.agg(
        F.struct(
            F.count(col).cast("double").alias("n"),
            (F.stddev(col) * F.pow(F.count(col).cast("double"), F.lit(-0.2))).alias("h"),
        ).alias("s")
    ).scalar()
    points = value_counts(df, col).withColumn("s", stats)
    z = (F.col("x") - F.col("value")) / F.col("s.h")
    kernel = F.exp(F.lit(-0.5) * z * z) * F.col("n") / (F.col("s.n") * F.col("s.h") * F.lit(math.sqrt(2 * math.pi)))
    return (
        points.withColumn("x", F.explode(F.array(*[F.lit(float(g)) for g in grid])))
        .groupBy("x")
        .agg(F.sum(kernel).alias("density"))
    )
