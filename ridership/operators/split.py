"""Date splits and stratified samples (L1-L4).

Shuffles are an order by ``xxhash64(seed, key)``, so a split is repeatable and survives recomputation.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridership.operators.basic import between_dates
from ridership.operators.ordered import PIECE_ROWS, Along, fits, row_numbers, top_k
from ridership.session import stage


def date_split(df: DataFrame, ranges: dict[str, tuple[str, str]], col: str = "transit_date", closed: str = "both") -> dict[str, DataFrame]:
    """One DataFrame per named date range (L1); closed ranges may share their boundary day."""
    return {name: between_dates(df, col, lo, hi, closed) for name, (lo, hi) in ranges.items()}


def _hash(keys: Sequence[str], seed: int) -> Column:
    return F.xxhash64(F.lit(seed), *[F.col(k) for k in keys])


RANGE_BITS = 12


def _class_rank(df: DataFrame, y: str, keys: Sequence[str], seed: int, piece_rows: int) -> DataFrame:
    """Shuffled row number within a class, which may hold most rows.

    Where a class has more than ``piece_rows`` rows, rows are ranked within 4,096 ranges of their hashes, which are even, and
    a count per class and range gives the rows before a range: one count and one shuffle, however large a class is.
    """
    hashed = df.withColumn("_h", _hash(keys, seed))
    along = Along(["_h", *keys], F.col("_h"), piece_rows)
    if fits(hashed, [y], along):
        return row_numbers(hashed, [y], replace(along, piece_rows=None), "_rank").drop("_h")
    rows = hashed.withColumn("_range", F.shiftright("_h", 64 - RANGE_BITS).cast("int"))
    counts = rows.groupBy(F.col(y).alias("_class"), F.col("_range").alias("_in")).agg(F.count(F.lit(1)).alias("_n"))
    so_far = F.sum("_n").over(Window.partitionBy("_class").orderBy("_in").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("_class", "_in", F.coalesce(so_far, F.lit(0)).alias("_before"))
    within = Window.partitionBy(y, "_range").orderBy(*[F.col(c).asc_nulls_first() for c in ("_h", *keys)])
    ranked = rows.withColumn("_rank", F.row_number().over(within))
    ranked = ranked.join(starts, F.col(y).eqNullSafe(F.col("_class")) & (F.col("_range") == F.col("_in")))
    return ranked.withColumn("_rank", F.col("_rank") + F.col("_before")).drop("_h", "_range", "_class", "_in", "_before")


def stratified_kfold(
    df: DataFrame, y: str, keys: Sequence[str], k: int, seed: int = 100, piece_rows: int = PIECE_ROWS
) -> DataFrame:
    """Shuffled folds 0..k-1 with equal class shares (L2); ``keys`` identify a row."""
    ranked = _class_rank(df, y, keys, seed, piece_rows)
    return ranked.withColumn("kfold", ((F.col("_rank") - 1) % F.lit(k)).cast("int")).drop("_rank")


def stratified_shuffle(
    df: DataFrame,
    y: str,
    keys: Sequence[str],
    n_splits: int,
    test_frac: float = 0.3,
    seed: int = 100,
    piece_rows: int = PIECE_ROWS,
) -> DataFrame:
    """Repeated splits with equal class shares (L3): ``split`` 0..n-1 and ``is_test``; ``keys`` identify a row.

    The test rows of a class are the first of its shuffled order, in number the rounded share. Nothing is sorted for that: one
    pass counts all splits by ranges of their hashes, a second ranks only the rows of the one range per class and split
    where the share ends (1 of 65,536), the third compares each row with the last test row. Rows without a class are left out.
    """
    given = [c for c in df.columns if c not in ("split", "is_test")]
    drawn = F.array(*[F.struct(F.lit(i).alias("split"), _hash(keys, seed + i).alias("_h")) for i in range(n_splits)])
    rows = df.filter(F.col(y).isNotNull()).select(*given, F.inline(drawn)).withColumn("_range", F.shiftright("_h", 48).cast("int"))
    slim = rows.select(*dict.fromkeys([y, *keys]), "split", "_h", "_range")
    group = [y, "split"]
    counts = slim.groupBy(*group, "_range").agg(F.count(F.lit(1)).alias("_n"))
    # a class has at most 65,536 ranges in a split
    so_far = F.sum("_n").over(Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    size = F.sum("_n").over(Window.partitionBy(*group))
    left = F.round(size * F.lit(test_frac)) - F.coalesce(so_far, F.lit(0))
    ends = counts.withColumn("_left", left).filter("_left BETWEEN 1 AND _n").select(*group, F.col("_range").alias("_end"), "_left")
    near = stage(slim.join(ends, group).filter("_range = _end"), "split_ends")
    ranked = row_numbers(near, group, Along(["_h", *keys], F.col("_h"), piece_rows), "_rank")
    place = F.struct("_h", *keys)
    last = stage(ranked.filter("_rank = _left").select(*group, "_end", place.alias("_last")), "last_test_rows")
    test = (F.col("_range") < F.col("_end")) | ((F.col("_range") == F.col("_end")) & (place <= F.col("_last")))
    return rows.join(last, group, "left").select(*given, "split", F.coalesce(test, F.lit(False)).alias("is_test"))


def sample_per_group(df: DataFrame, group: Sequence[str], keys: Sequence[str], n: int, seed: int = 500) -> DataFrame:
    """``n`` distinct keys drawn per group (L4)."""
    distinct = df.select(*group, *[k for k in keys if k not in group]).distinct().withColumn("_h", _hash(keys, seed))
    return top_k(distinct, group, [F.col("_h"), *[F.col(k) for k in keys]], n).drop("_h")
