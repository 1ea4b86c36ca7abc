"""Training rows of the same-day models: stop windows, their classes, encoded splits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridership.functions.bins import CLASS_BINS, TARGET_MAX, Bound, assign_class
from ridership.functions.times import time_window
from ridership.operators import clean, encode, enrich, quantiles, rollup
from ridership.operators.basic import cap_target, route_direction_key
from ridership.operators.split import date_split

REQUIRED = ("arrival_time", "sched_hdwy", "darksky_temperature")


def stop_windows(stops: DataFrame, holidays: DataFrame, school_breaks: DataFrame, minutes: int = 15) -> DataFrame:
    """Stored stop rows without bad loads and terminal stops, rolled up per date, route, stop and time window."""
    rows = clean.drop_groups_with_any(stops, clean.TRIP, clean.bad_load())
    if "zero_load_at_trip_end" in rows.columns:
        rows = rows.na.fill(0, subset=["zero_load_at_trip_end"])
    rows = clean.drop_terminal_stop(rows.na.drop(subset=list(REQUIRED)))
    rows = enrich.flag_school_break(enrich.flag_holiday(route_direction_key(rows), holidays), school_breaks)
    return rollup.stop_window_rollup(rows.withColumn("time_window", time_window("arrival_time", minutes)))


def classed_windows(windows: DataFrame) -> tuple[DataFrame, list[Bound]]:
    """Five load classes: two from the data, the top ones fixed; rows in no class are dropped."""
    bounds = quantiles.collect_bounds(
        quantiles.class_bounds(cap_target(windows, "load", TARGET_MAX), "load", CLASS_BINS, kind="linear")
    )
    classed = windows.withColumn("y_class", assign_class("load", bounds))
    return classed.filter(F.col("y_class").isNotNull()), bounds


def encode_and_split(
    df: DataFrame,
    ranges: Mapping[str, tuple[str, str]],
    one_hot: Sequence[str],
    indexed: Sequence[str],
    numeric: Sequence[str],
    scaler: str = "minmax",
) -> dict[str, DataFrame]:
    """One-hot columns and indexes from all rows, date ranges, numbers scaled by the ``train`` range."""
    rows = encode.one_hot(df, encode.fit_categories(df, one_hot))
    for c in indexed:
        rows = encode.apply_index(rows, encode.index_map(df, c), c)
    parts = date_split(rows, dict(ranges))
    fitted = encode.fit_scaler(parts["train"], numeric, scaler)
    return {name: encode.scale(part, fitted) for name, part in parts.items()}
