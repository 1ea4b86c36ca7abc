"""Roll-ups to trips, route windows and stop windows, resampling, counts and pivots."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridership.functions.times import epoch_seconds, time_window_rounded
from ridership.operators.basic import cap_target, route_direction_key


def first_of(col: str, order: Sequence[str]) -> Column:
    """First non-NULL value along ``order``: an ordered ``first`` that combines within tasks."""
    return F.min_by(F.col(col), F.when(F.col(col).isNotNull(), F.struct(*order)))


def last_of(col: str, order: Sequence[str]) -> Column:
    """Last non-NULL value along ``order`` (F16)."""
    return F.max_by(F.col(col), F.when(F.col(col).isNotNull(), F.struct(*order)))


FIRSTS = ("year", "month", "route_id", "route_direction_name", "block_abbr", "dayofweek", "hour")
MEANS = {
    "darksky_temperature": "temperature",
    "darksky_humidity": "humidity",
    "darksky_precipitation_intensity": "precipitation_intensity",
    "sched_hdwy": "scheduled_headway",
    "actual_hdwy": "actual_headways",
}


def trip_rollup(
    df: DataFrame,
    keys: Sequence[str] = ("transit_date", "trip_id"),
    order: Sequence[str] = ("arrival_time", "stop_sequence"),
    time: str = "arrival_time",
    firsts: Sequence[str] = FIRSTS,
    means: Mapping[str, str] = MEANS,
) -> DataFrame:
    """One row per trip and day (F1).

    ``y_reg100`` / ``y_reg095`` are the exact maximum and 95th percentile of the load. ``time`` may be the scheduled
    time. The list of loads is ``trip_loads``.
    """
    load = F.col("load").cast("int")
    return df.groupBy(*keys).agg(
        first_of(time, order).alias("arrival_time"),
        F.count("stop_id").alias("num_records"),
        *[first_of(c, order).alias(c) for c in firsts if c in df.columns],
        *[F.avg(F.col(c).cast("float")).alias(n) for c, n in means.items() if c in df.columns],
        F.max(load).cast("double").alias("y_reg100"),
        F.percentile(load, 0.95).alias("y_reg095"),
    )


def trip_loads(df: DataFrame, keys: Sequence[str] = ("transit_date", "trip_id")) -> DataFrame:
    """All loads of a trip as ``load_counts``, a sorted array of (load, n) (F1).

    It holds every load in the size of the distinct ones, whatever the number of rows;
    ``functions.arrays.expand_counts`` turns it into the list.
    """
    counts = df.filter(F.col("load").isNotNull()).groupBy(*keys, "load").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("load", "n"))).alias("load_counts"))


def finish_trips(trips: DataFrame, required: Sequence[str] = ("temperature", "scheduled_headway")) -> DataFrame:
    """The steps after ``trip_rollup``: route key, rounded half-hour window, target cap, trips lacking weather or headway.

    A trip is one row here, so the last step is a filter.
    """
    out = route_direction_key(trips).withColumn("time_window", time_window_rounded("arrival_time", "hour"))
    out = cap_target(out, "y_reg100")
    return out.na.drop(subset=[c for c in required if c in out.columns]).drop("num_records")


def rollup(df: DataFrame, keys: Sequence[str], spec: Mapping[str, str], order: Sequence[str]) -> DataFrame:
    """Group by ``keys`` with one of first, mean, max, sum, last or count per column."""
    fns = {
        "first": lambda c: first_of(c, order),
        "last": lambda c: last_of(c, order),
        "mean": F.avg,
        "max": F.max,
        "sum": F.sum,
        "count": F.count,
    }
    return df.groupBy(*keys).agg(*[fns[fn](c).alias(c) for c, fn in spec.items()])


ROUTE_WINDOW = ("transit_date", "route_id_direction", "time_window")
STOP_WINDOW = ("transit_date", "route_id_direction", "stop_id", "time_window")


def route_window_rollup(
    trips: DataFrame,
    target: str = "y_reg100",
    extra: Mapping[str, str] | None = None,
    order: Sequence[str] = ("arrival_time", "trip_id"),
) -> DataFrame:
    """Per date, route direction and time window: calendar firsts, weather means, highest headway and target (F2)."""
    spec = {c: "first" for c in ("year", "month", "day", "dayofweek", "hour", "is_holiday", "is_school_break")}
    spec |= {c: "mean" for c in ("temperature", "humidity", "precipitation_intensity", "traffic_speed")}
    spec |= {"scheduled_headway": "max", target: "max", **(extra or {})}
    return rollup(trips, ROUTE_WINDOW, {c: f for c, f in spec.items() if c in trips.columns}, order)


def stop_window_rollup(
    stops: DataFrame, spec: Mapping[str, str] | None = None, order: Sequence[str] = ("arrival_time", "stop_sequence")
) -> DataFrame:
    """Per date, route direction, stop and time window: firsts, means, highest headway and the sum of loads."""
    if spec is None:
        spec = {
            c: "first"
            for c in (
                "trip_id", "block_abbr", "arrival_time", "year", "month", "day", "hour", "is_holiday",
                "is_school_break", "dayofweek", "zero_load_at_trip_end", "stop_sequence",
            )
        }
        spec |= {c: "mean" for c in stops.columns if c.startswith("darksky_") or c == "traffic_speed"}
        spec |= {"sched_hdwy": "max", "load": "sum"}
    return rollup(stops, STOP_WINDOW, {c: f for c, f in spec.items() if c in stops.columns}, order)


def median_per_trip(df: DataFrame, target: str, key: str = "trip_id") -> DataFrame:
    """Median target per trip as ``<target>_expected`` (F4), from counts per value."""
    counts = df.groupBy(key, target).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(key).agg(F.percentile(target, 0.5, F.col("_n")).alias(f"{target}_expected"))


def trip_max_load(
    df: DataFrame, order: Sequence[str], keys: Sequence[str] = ("transit_date", "trip_id", "route_id_direction")
) -> DataFrame:
    """First vehicle and highest load per trip."""
    return df.groupBy(*keys).agg(first_of("vehicle_id", order).alias("vehicle_id"), F.max("load").alias("load"))


def _check_minutes(minutes: int) -> None:
    if 1440 % minutes:
        raise ValueError("the bin width must divide a day")


def _resample(df: DataFrame, keys: Sequence[str], ts: str, minutes: int, agg: Column, name: str) -> DataFrame:
    """Bins from the first to the last of each group; bins without rows carry NULL."""
    _check_minutes(minutes)
    keys = list(keys)
    width = minutes * 60
    bins = (
        df.filter(F.col(ts).isNotNull())
        .groupBy(*keys, F.floor(epoch_seconds(ts) / F.lit(width)).alias("_bin"))
        .agg(agg.alias(name))
    )
    span = bins.groupBy(*keys).agg(F.min("_bin").alias("_lo"), F.max("_bin").alias("_hi"))
    full = span.select(*keys, F.explode(F.sequence("_lo", "_hi")).alias("_bin"))
    return (
        full.join(bins, [*keys, "_bin"], "left")
        .withColumn(ts, F.timestamp_seconds(F.col("_bin") * F.lit(width)))
        .select(*keys, ts, name)
    )


def resample_mean(df: DataFrame, keys: Sequence[str], ts: str, value: str, minutes: int = 30) -> DataFrame:
    """Mean per bin, readings without a value dropped first."""
    return _resample(df.filter(F.col(value).isNotNull()), keys, ts, minutes, F.avg(value), value)


def resample_sum(df: DataFrame, keys: Sequence[str], ts: str, value: str, minutes: int = 60) -> DataFrame:
    """Sum per bin, 0 where there is none."""
    out = _resample(df, keys, ts, minutes, F.sum(value), value)
    return out.withColumn(value, F.coalesce(value, F.lit(0)))


def mode_per_group(df: DataFrame, keys: Sequence[str], col: str) -> DataFrame:
    """Most common non-NULL value per group, the lowest of several (F9), from counts per value."""
    counts = df.filter(F.col(col).isNotNull()).groupBy(*keys, col).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(*keys).agg(F.min_by(F.col(col), F.struct(-F.col("_n"), F.col(col))).alias(col))


def value_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("count"))


def top_groups(df: DataFrame, cols: Sequence[str], min_rows: int) -> DataFrame:
    """Groups with at least ``min_rows`` rows."""
    return value_counts(df, cols).filter(F.col("count") >= min_rows)


def pivot_counts(df: DataFrame, rows: Sequence[str], col: str, values: Sequence) -> DataFrame:
    """Table of counts with one column per listed value, 0 where there is none."""
    out = df.groupBy(*rows).pivot(col, list(values)).agg(F.count(F.lit(1)))
    return out.na.fill(0, subset=[str(v) for v in values])


def route_by_window_matrix(
    df: DataFrame, minutes: int = 30, route: str = "route_id_direction", window: str = "time_window", value: str = "y_pred"
) -> DataFrame:
    """One row per route and one column per time window, NULL where there is no prediction."""
    return df.groupBy(route).pivot(window, list(range(24 * 60 // minutes))).agg(F.max(value))
