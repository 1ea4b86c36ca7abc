"""Group-level cleaning (C1-C11): find the bad keys, then drop or set aside every row that carries one.

Bad keys are reduced with ``distinct`` before the join, which runs as ``left_anti`` / ``left_semi``. A NULL in a key
never matches, so such rows are kept.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRIP = ("transit_date", "trip_id", "overload_id")
BLOCK = ("transit_date", "block_abbr")


def bad_load(col: str = "load") -> Column:
    return (F.col(col) < 0) | F.col(col).isNull()


def any_null(*cols: str) -> Column:
    out = F.lit(False)
    for c in cols:
        out = out | F.col(c).isNull()
    return out


def drop_groups_with_any(df: DataFrame, keys: Sequence[str], cond: Column) -> DataFrame:
    """Drop every group in which some row meets ``cond``."""
    return df.join(df.filter(cond).select(*keys).distinct(), list(keys), "left_anti")


def quarantine(df: DataFrame, bad: DataFrame, remark: str) -> DataFrame:
    """The rows a key set would delete, with the reason."""
    return df.join(bad, list(bad.columns), "left_semi").withColumn("remark", F.lit(remark))


def drop_short_groups(df: DataFrame, keys: Sequence[str] = TRIP, min_rows: int = 4) -> DataFrame:
    """Drop groups with fewer than ``min_rows`` rows."""
    short = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") < min_rows).drop("_n")
    return df.join(short, list(keys), "left_anti")


def blocks_all_null(
    df: DataFrame,
    group: Sequence[str] = ("transit_date", "trip_id", "vehicle_id", "overload_id", "block_abbr"),
    keys: Sequence[str] = BLOCK,
    col: str = "arrival_time",
) -> DataFrame:
    """Blocks in which some trip has no arrival time at all."""
    return (
        df.groupBy(*group)
        .agg(F.count(col).alias("_known"))
        .filter(F.col("_known") == 0)
        .select(*keys)
        .distinct()
    )


def drop_blocks_all_null(df: DataFrame, **kw) -> DataFrame:
    """Drop the blocks of ``blocks_all_null`` (C4)."""
    bad = blocks_all_null(df, **kw)
    return df.join(bad, list(bad.columns), "left_anti")


def drop_stops_null_arrival(
    df: DataFrame, keys: Sequence[str] = ("transit_date", "trip_id", "stop_id"), col: str = "arrival_time"
) -> DataFrame:
    """Drop every (date, trip, stop) with a NULL arrival."""
    return drop_groups_with_any(df, keys, F.col(col).isNull())


def duplicate_stop_blocks(df: DataFrame, dup_keys: Sequence[str], keys: Sequence[str] = BLOCK) -> DataFrame:
    """Blocks that hold a duplicated stop record."""
    return (
        df.groupBy(*dup_keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1).select(*keys).distinct()
    )


def null_vehicle_blocks(df: DataFrame, keys: Sequence[str] = BLOCK, col: str = "vehicle_id") -> DataFrame:
    """Blocks with a NULL vehicle, the text "NULL" included."""
    c = F.col(col)
    return df.filter(c.isNull() | (c.cast("string") == "NULL")).select(*keys).distinct()


def drop_trips_missing(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = ("trip_id", "transit_date")) -> DataFrame:
    """Drop trips for which one of ``cols`` is NULL."""
    return drop_groups_with_any(df, keys, any_null(*cols))


def drop_terminal_stop(df: DataFrame, block: str = "block_abbr", seq: str = "stop_sequence") -> DataFrame:
    """Drop the rows at the highest stop sequence of their block (C10); rows without a block go too."""
    last = df.groupBy(block).agg(F.max(seq).alias("_last"))
    return df.join(last, block).filter(F.coalesce(F.col(seq) != F.col("_last"), F.lit(True))).drop("_last")


def dedup_keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str], descending: bool = False) -> DataFrame:
    """One row per key, the first along ``order`` (C11); ``order`` must order a key's rows completely.

    An aggregate instead of a window, so each task reduces its rows before the shuffle.
    """
    pick = F.max_by if descending else F.min_by
    rest = [c for c in df.columns if c not in keys]
    return (
        df.groupBy(*keys)
        .agg(pick(F.struct(*rest), F.struct(*order)).alias("_row"))
        .select(*keys, "_row.*")
        .select(*df.columns)
    )


def remove_null_events(df: DataFrame) -> DataFrame:
    """The standing cleaning chain: C4, then C2, then C6."""
    df = drop_blocks_all_null(df)
    df = drop_groups_with_any(df, TRIP, bad_load())
    return drop_stops_null_arrival(df)
