"""From raw inputs to the stop-level and trip-level tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from ridership.functions.times import calendar_parts, delay_seconds, dwell_seconds
from ridership.operators import clean, enrich, features, headway, rollup
from ridership.session import stage

WEATHER_VALUES = ("temperature", "humidity", "precipitation_intensity")


def stop_level(
    events: DataFrame,
    weather: DataFrame,
    tie: Sequence[str] = ("stop_sequence",),
    weather_values: Sequence[str] = WEATHER_VALUES,
    weather_time: str = "time",
) -> DataFrame:
    """Stop events with calendar parts, hourly weather, delay, dwell, headways and headway flags."""
    out = headway.actual_headway(headway.scheduled_headway(events, tie), tie)
    out = headway.headway_flags(calendar_parts(out))
    out = out.withColumns({"delay_time": delay_seconds(), "dwell_time": dwell_seconds()})
    return enrich.join_weather(out, enrich.weather_hourly(weather, weather_values, weather_time))


def preprocess(
    events: DataFrame, weather: DataFrame, gtfs: DataFrame, weather_time: str = "time", compat: bool = False
) -> DataFrame:
    """The feature store: bad and short trips dropped, weather, schedule version, scheduled trip counts, headways.

    The cleaned events and the stop level are stored on the way, as several steps read them.
    """
    kept = clean.drop_groups_with_any(events, clean.TRIP, clean.any_null("ons", "offs", "load"))
    kept = stage(clean.drop_short_groups(kept), "kept_events")
    stops = stage(stop_level(kept, weather, weather_time=weather_time), "stop_level")
    out = enrich.gtfs_version_in_force(stops, gtfs)
    out = enrich.join_scheduled_trips(out, enrich.scheduled_trips_per_route_hour(gtfs, compat))
    return enrich.join_scheduled_trips(out, enrich.scheduled_trips_per_stop_hour(gtfs, compat))


def trip_level(stops: DataFrame, order: Sequence[str] = ("arrival_time", "stop_sequence")) -> DataFrame:
    """Cleaned stop events rolled up to trips, with route key and rounded half-hour window.

    ``stops`` should be a stored table (``session.stage``), as the cleaning reads it once per rule.
    """
    return rollup.finish_trips(rollup.trip_rollup(clean.remove_null_events(stops), order=order))


def route_windows(
    trips: DataFrame, holidays: DataFrame, school_breaks: DataFrame, minutes: int = 30, target: str = "y_reg100"
) -> DataFrame:
    """Training rows: trips with calendar flags, their time window, rolled up per date, route and window."""
    flagged = enrich.flag_school_break(enrich.flag_holiday(trips, holidays), school_breaks)
    return rollup.route_window_rollup(features.trip_features(flagged, minutes), target)


def load_windows(events: DataFrame, min_rows: int = 2, minutes: int = 30) -> DataFrame:
    """Highest and 95th-percentile load per trip, then per date, route direction and time window, bad trips dropped."""
    good = clean.drop_groups_with_any(events, clean.TRIP, clean.bad_load())
    good = clean.drop_short_groups(good, min_rows=min_rows)
    trips = rollup.route_direction_key(
        rollup.trip_rollup(good, firsts=("route_id", "route_direction_name", "block_abbr"), means={})
    )
    trips = features.add_window_and_day(trips, minutes)
    return rollup.rollup(
        trips,
        rollup.ROUTE_WINDOW,
        {"day": "first", "num_records": "sum", "y_reg100": "max", "y_reg095": "max", "trip_id": "count"},
        ("arrival_time", "trip_id"),
    ).withColumnRenamed("trip_id", "trips")
