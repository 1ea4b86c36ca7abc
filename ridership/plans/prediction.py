"""Model inputs for a date that has not happened yet (M8, M9)."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridership.functions.times import window_start_ts
from ridership.operators import enrich
from ridership.operators.basic import between_dates, drop_nonfinite, same_weekday
from ridership.operators.features import past_features
from ridership.operators.ordered import Along
from ridership.plans.feature_store import trip_level
from ridership.session import stage

KEYS = ("route_id_direction", "time_window")


def _complete(
    windows: DataFrame,
    hourly: DataFrame,
    speed: DataFrame,
    holidays: DataFrame,
    school_breaks: DataFrame,
    day: date,
    weather_day: date,
    weather_last: date,
) -> DataFrame:
    """Weather of the hour, mean speed, calendar columns; remaining gaps take the next row's value."""
    rows = windows.withColumn("hour", F.floor(F.col("time_window") / F.lit(2)).cast("int"))
    rows = rows.join(enrich.weather_for_date(hourly, weather_day, weather_last), "hour")
    rows = rows.join(enrich.speed_climatology(speed), list(KEYS), "left").filter(F.col("traffic_speed").isNotNull())
    at = F.lit(day.isoformat()).cast("date")
    rows = rows.withColumns(
        {
            "transit_date": at,
            "arrival_time": window_start_ts(at, "time_window"),
            "year": F.lit(day.year),
            "month": F.lit(day.month),
            "day": F.lit(day.day),
            "dayofweek": F.dayofweek(at),
        }
    )
    rows = enrich.flag_school_break(enrich.flag_holiday(rows, holidays), school_breaks)
    rows = rows.withColumnsRenamed(
        {
            "darksky_temperature": "temperature",
            "darksky_humidity": "humidity",
            "darksky_precipitation_intensity": "precipitation_intensity",
        }
    )
    gaps = [c for c in rows.columns if c not in (*KEYS, "transit_date", "arrival_time")]
    # a row per route and window at most: one piece
    return enrich.backfill(stage(rows, "prediction_rows"), [], Along(KEYS, F.lit(0)), gaps)


def any_day_input(
    stops: DataFrame,
    hourly: DataFrame,
    speed: DataFrame,
    holidays: DataFrame,
    school_breaks: DataFrame,
    day: date,
    history: tuple[date, date],
    weather_last: date,
    compat: bool = False,
) -> DataFrame:
    """One row per route and window seen on the same weekday of the history (M8).

    Weather after the last date on file is that of the last date; with ``compat`` the predicted date is then replaced
    too.
    """
    trips = trip_level(same_weekday(stops, day, *history))
    windows = trips.groupBy(*KEYS).agg(F.max("scheduled_headway").alias("scheduled_headway"))
    shown = min(day, weather_last) if compat else day
    return _complete(windows, hourly, speed, holidays, school_breaks, shown, day, weather_last)


def day_ahead_input(
    stops: DataFrame,
    hourly: DataFrame,
    speed: DataFrame,
    holidays: DataFrame,
    school_breaks: DataFrame,
    day: date,
    weather_last: date,
    days_behind: int = 7,
    past_trips: int = 5,
    target: str = "y_reg100",
    scope: str = "global",
) -> DataFrame:
    """As ``any_day_input`` from the last days, with the lagged and rolling features (M9).

    ``scope='global'`` runs the features over all trips in time order, ``route`` within each route direction.
    """
    trips = trip_level(between_dates(stops, "transit_date", day - timedelta(days_behind), day - timedelta(1)))
    trips = stage(trips, "past_trips")
    past = drop_nonfinite(past_features(trips, past_trips, target, scope).na.drop(), "load_pct_change")
    peaks = ["load_pct_change", "act_headway_pct_change", "avg_past_act_headway", "avg_past_trips_loads"]
    windows = past.groupBy(*KEYS).agg(*[F.max(c).alias(c) for c in ["scheduled_headway", *peaks]])
    return _complete(windows, hourly, speed, holidays, school_breaks, day, day, weather_last)
