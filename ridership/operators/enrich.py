"""Joins and enrichment.

No join carries a broadcast hint: the size limit of Catalyst and the adaptive re-plan decide, and a hot key on a
sort-merge join is split by the adaptive skew join.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridership.functions.times import gtfs_dayofweek, hms_to_hour
from ridership.operators.clean import dedup_keep_first
from ridership.operators.ordered import Along, running_last

WEATHER_KEYS = ("year", "month", "day", "hour")
UTC_OFFSET_SECONDS = 18000  # fixed value: the readings are shifted to GMT-5


def _ymdh(df: DataFrame, ts: Column) -> DataFrame:
    return df.withColumns({"year": F.year(ts), "month": F.month(ts), "day": F.dayofmonth(ts), "hour": F.hour(ts)})


def weather_hourly(
    raw: DataFrame, values: Sequence[str], time: str = "time", offset: int = UTC_OFFSET_SECONDS, prefix: str = "darksky_"
) -> DataFrame:
    """Hourly means in local time (D1); ``time`` is epoch seconds or a UTC timestamp."""
    epoch = F.col(time)
    if raw.schema[time].dataType.typeName() not in ("long", "integer"):
        epoch = F.unix_seconds(epoch.cast("timestamp"))
    local = F.timestamp_seconds(epoch - F.lit(offset))
    return (
        _ymdh(raw, local).groupBy(*WEATHER_KEYS).agg(*[F.avg(v).alias(f"{prefix}{v}") for v in values])
    )


def station_weather(
    raw: DataFrame,
    stations: Sequence[str],
    values: Sequence[str] = ("rh", "wind_spd", "app_temp", "temp", "snow", "precip"),
    prefix: str = "weatherbit_",
) -> DataFrame:
    """Hourly means over chosen stations (D3)."""
    kept = raw.filter(F.col("spatial_id").isin(list(stations)))
    return (
        _ymdh(kept, F.col("timestamp_local"))
        .groupBy(*WEATHER_KEYS)
        .agg(*[F.avg(v).alias(f"{prefix}{v}") for v in values])
    )


def join_weather(events: DataFrame, hourly: DataFrame) -> DataFrame:
    """Left join on year, month, day and hour."""
    return events.join(hourly, list(WEATHER_KEYS), "left")


def flag_dates(df: DataFrame, calendar: DataFrame, name: str, date: str = "transit_date", cal: str = "cal_date") -> DataFrame:
    """Whether the date is in the calendar (D4); repeated calendar dates count once."""
    days = calendar.select(F.col(cal).alias(date), F.lit(True).alias(name)).filter(F.col(date).isNotNull()).distinct()
    return df.join(days, date, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def flag_holiday(df: DataFrame, calendar: DataFrame) -> DataFrame:
    return flag_dates(df, calendar, "is_holiday")


def flag_school_break(df: DataFrame, calendar: DataFrame) -> DataFrame:
    return flag_dates(df, calendar, "is_school_break")


def join_trip_speed(
    df: DataFrame,
    speed: DataFrame,
    on_missing: str = "drop",
    keys: Sequence[str] = ("transit_date", "trip_id", "route_id_direction"),
    along: Along | None = None,
) -> DataFrame:
    """Left join of trip speeds.

    ``on_missing``: ``drop`` the row, ``backfill`` from the next row along an order of the whole table, or ``mean`` of
    the joined speeds.
    """
    out = df.join(speed.select(*keys, "traffic_speed"), list(keys), "left")
    if on_missing == "drop":
        return out.filter(F.col("traffic_speed").isNotNull())
    if on_missing == "backfill":
        return backfill(out, [], along, ["traffic_speed"])
    if on_missing == "mean":
        mean = out.agg(F.avg("traffic_speed")).scalar()
        return out.withColumn("traffic_speed", F.coalesce("traffic_speed", mean))
    raise ValueError(f"on_missing: {on_missing}")


def backfill(df: DataFrame, keys: Sequence[str], along: Along, cols: Sequence[str]) -> DataFrame:
    """Next non-NULL value along the order."""
    out = running_last(df, keys, along, {f"_next_{c}": F.col(c) for c in cols}, descending=True)
    return out.withColumns({c: F.col(f"_next_{c}") for c in cols}).drop(*[f"_next_{c}" for c in cols])


def speed_climatology(speed: DataFrame) -> DataFrame:
    """Mean speed per route, direction and time window."""
    return speed.groupBy("route_id_direction", "time_window").agg(F.avg("traffic_speed").alias("traffic_speed"))


def weather_for_date(hourly: DataFrame, day: date, last: date) -> DataFrame:
    """The hourly rows of a date, or of the last date on file if that is earlier."""
    d = min(day, last)
    return hourly.filter(
        (F.col("year") == d.year) & (F.col("month") == d.month) & (F.col("day") == d.day)
    ).drop("year", "month", "day")


def gtfs_version_in_force(
    events: DataFrame,
    feeds: DataFrame,
    keys: Sequence[str] = ("transit_date", "trip_id"),
    feed_date: str = "feed_date",
    cols: Sequence[str] = ("route_id", "direction_id"),
) -> DataFrame:
    """The schedule version each trip ran under: the latest feed dated on or before the transit date.

    Works on distinct (date, trip) pairs and the distinct versions of a trip, then joins back. All trip rows of the
    winning version are kept, as a version may list a trip under several routes.
    """
    transit_date, trip = keys
    versions = feeds.select(
        trip, F.col(feed_date).alias("gtfs_date"), *[F.col(c).alias(f"gtfs_{c}") for c in cols]
    ).distinct()
    # days and versions of a trip in one line: the latest version so far
    days = events.select(*keys).distinct().withColumns({"gtfs_date": F.lit(None).cast(feeds.schema[feed_date].dataType), "_day": F.lit(1)})
    starts = versions.select(F.col("gtfs_date").alias(transit_date), trip, "gtfs_date").distinct().withColumn("_day", F.lit(0))
    so_far = Window.partitionBy(trip).orderBy(transit_date, "_day").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    line = days.unionByName(starts).withColumn("gtfs_date", F.max("gtfs_date").over(so_far))
    best = line.filter((F.col("_day") == 1) & F.col("gtfs_date").isNotNull()).select(*keys, "gtfs_date")
    return events.join(best.join(versions, [trip, "gtfs_date"]), list(keys), "left")


def explode_weekdays(df: DataFrame, compat: bool = False, name: str = "dayofweek") -> DataFrame:
    """One row per weekday whose flag is 1."""
    flags = F.array(*[F.when(F.col(d) == 1, F.lit(n)) for d, n in gtfs_dayofweek(compat)])
    return df.withColumn(name, F.explode(F.array_compact(flags)))


def _scheduled_trips(gtfs: DataFrame, extra: Sequence[str], name: str, compat: bool) -> DataFrame:
    hour = hms_to_hour("arrival_time")
    rows = explode_weekdays(gtfs, compat).withColumn("hour", hour if compat else hour % F.lit(24))
    return (
        rows.groupBy(
            F.col("feed_date").alias("gtfs_date"),
            "dayofweek",
            "hour",
            F.col("route_id").alias("gtfs_route_id"),
            F.col("direction_id").alias("gtfs_direction_id"),
            *extra,
        )
        .agg(F.count("trip_id").alias(name))
    )


def scheduled_trips_per_route_hour(gtfs: DataFrame, compat: bool = False) -> DataFrame:
    """Scheduled trip rows per feed, weekday, hour, route and direction.

    ``compat`` numbers weekdays from Monday = 1 and leaves hours of 24 and more as they are.
    """
    return _scheduled_trips(gtfs, (), "gtfs_number_of_scheduled_trips", compat)


def scheduled_trips_per_stop_hour(gtfs: DataFrame, compat: bool = False) -> DataFrame:
    """As ``scheduled_trips_per_route_hour`` and per stop."""
    return _scheduled_trips(gtfs, ("stop_id",), "gtfs_number_of_scheduled_trips_at_stop", compat)


def join_scheduled_trips(events: DataFrame, counts: DataFrame) -> DataFrame:
    """Left join of scheduled counts on all key columns the two sides share."""
    keys = [c for c in counts.columns if c in events.columns]
    return events.join(counts, keys, "left")


MATCH_KEYS = ("transit_date", "block_abbr", "stop_id", "trip_id", "stop_sequence", "route_direction_name", "route_id")


def match_on_keys(a: DataFrame, b: DataFrame, order: Sequence[str], keys: Sequence[str] = MATCH_KEYS) -> DataFrame:
    """Inner join on the match keys, one row per key."""
    return dedup_keep_first(a.join(b, list(keys)), keys, order)


def unmatched(a: DataFrame, b: DataFrame, keys: Sequence[str] = MATCH_KEYS) -> DataFrame:
    """Rows of ``a`` without a partner."""
    return a.join(b.select(*keys).distinct(), list(keys), "left_anti")


def right_join_valid(a: DataFrame, b: DataFrame, keys: Sequence[str], required: Sequence[str]) -> DataFrame:
    """Right join, then drop the rows for which the left side gave nothing."""
    return a.join(b, list(keys), "right").na.drop(subset=list(required))


def block_trip_ids(
    df: DataFrame, keys: Sequence[str] = ("transit_date", "block_abbr"), trip: str = "trip_id", separator: str | None = None
) -> DataFrame:
    """The ordered trip ids of each block and day on every row (D14), with a ``separator`` as one text.

    Trips are made distinct before they are collected, so a list is as long as the block has trips that day. The text is made
    once per block and day, not on every row.
    """
    ids = F.array_sort(F.collect_list(trip))
    if separator is not None:
        ids = F.array_join(F.transform(ids, lambda x: x.cast("string")), separator)
    lists = df.select(*keys, trip).distinct().groupBy(*keys).agg(ids.alias("block_trip_ids"))
    return df.join(lists, list(keys), "left")


def full_outer_suffix(
    a: DataFrame, b: DataFrame, keys: Sequence[str], required: Sequence[str], suffixes: tuple[str, str] = ("_prev", "_next")
) -> DataFrame:
    """Full join with suffixed value columns; rows lacking ``required`` on both sides are dropped."""
    sides = [
        d.withColumnsRenamed({c: f"{c}{s}" for c in d.columns if c not in keys}) for d, s in zip((a, b), suffixes)
    ]
    return sides[0].join(sides[1], list(keys), "full").na.drop(
        how="all", subset=[f"{c}{s}" for c in required for s in suffixes]
    )


def concat(*dfs: DataFrame) -> DataFrame:
    """Union by name; a missing column becomes NULL."""
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), dfs)
