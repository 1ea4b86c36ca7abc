"""Headways, bunching flags, time to the next stop and derived load."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridership.functions.times import epoch_micros, epoch_seconds
from ridership.operators.ordered import PIECE_ROWS, Along, over_neighbours, running_sum

STOP = ("transit_date", "route_id", "route_direction_name", "stop_id")


def headway(
    df: DataFrame, time: str, name: str, tie: Sequence[str], keys: Sequence[str] = STOP, piece_rows: int = PIECE_ROWS
) -> DataFrame:
    """Whole seconds since the previous event at the same stop, NULL for the first."""
    return over_neighbours(
        df,
        keys,
        Along([time, *tie], epoch_micros(time), piece_rows),
        1,
        {name: lambda w: epoch_seconds(time) - epoch_seconds(F.lag(time).over(w))},
    )


def scheduled_headway(df: DataFrame, tie: Sequence[str], piece_rows: int = PIECE_ROWS) -> DataFrame:
    return headway(df, "scheduled_time", "sched_hdwy", tie, piece_rows=piece_rows)


def actual_headway(df: DataFrame, tie: Sequence[str], piece_rows: int = PIECE_ROWS) -> DataFrame:
    return headway(df, "departure_time", "actual_hdwy", tie, piece_rows=piece_rows)


def headway_flags(df: DataFrame, actual: str = "actual_hdwy", scheduled: str = "sched_hdwy") -> DataFrame:
    """Gapped, bunched and on-target flags; NULL or a scheduled headway of 0 gives 0."""
    a, s = F.col(actual), F.col(scheduled)
    ratio = F.try_divide(a, s)
    tests = {
        "is_gapped": (a - s > 0) & (ratio >= 1.5),
        "is_bunched": (a - s < 0) & (ratio >= 0) & (ratio <= 0.5),
        "is_target": (ratio > 0.5) & (ratio < 1.5),
    }
    return df.withColumns({n: F.when(t, F.lit(1)).otherwise(F.lit(0)) for n, t in tests.items()})


def time_to_next(
    df: DataFrame,
    keys: Sequence[str],
    time: str,
    tie: Sequence[str],
    name: str = "time_to_next_stop",
    piece_rows: int = PIECE_ROWS,
) -> DataFrame:
    """Seconds, with fraction, to the next event of the group."""
    return over_neighbours(
        df,
        keys,
        Along([time, *tie], epoch_micros(time), piece_rows),
        1,
        {name: lambda w: (epoch_micros(F.lag(time).over(w)) - epoch_micros(time)) / F.lit(1e6)},
        descending=True,
    )


def derived_load(
    df: DataFrame,
    trip: Sequence[str] = ("transit_date", "trip_id"),
    time: str = "scheduled_time",
    tie: Sequence[str] = ("stop_sequence",),
    piece_rows: int = PIECE_ROWS,
) -> DataFrame:
    """Load recomputed along a trip.

    The first and last stop are dropped; the next load is the start, boardings minus alightings are added from there.
    """
    rows = running_sum(
        df,
        trip,
        Along([time, *tie], epoch_micros(time), piece_rows),
        {"_rn": F.lit(1), "_sum": F.col("ons") - F.col("offs")},
    )
    second = F.col("_rn") == 2
    ends = rows.groupBy(*trip).agg(
        F.max("_rn").alias("_n"),
        F.max(F.when(second, F.col("load"))).alias("_load2"),
        F.max(F.when(second, F.col("_sum"))).alias("_sum2"),
    )
    return (
        rows.join(ends, list(trip))
        .filter((F.col("_rn") > 1) & (F.col("_rn") < F.col("_n")))
        .withColumn("derived_load", F.col("_load2") + F.col("_sum") - F.col("_sum2"))
        .drop("_rn", "_sum", "_n", "_load2", "_sum2")
    )
