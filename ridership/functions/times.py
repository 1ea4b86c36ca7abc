"""Time expressions: epochs, calendar parts, time windows, cyclic signals, HH:MM:SS text."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The name of each hour of the day, hour 0 first.
WINDOW_OF_DAY = [
    "late_night", "late_night", "late_night", "late_night", "late_night", "late_night",
    "am_rush", "am_rush", "am_rush",
    "am", "am", "am", "am", "am",
    "pm_rush", "pm_rush", "pm_rush",
    "pm", "pm", "pm",
    "night", "night",
    "late_night", "late_night",
]

HOUR = 3600.0
DAY = 24 * HOUR
MONTH = 30.436875 * DAY
YEAR = 365.2425 * DAY


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def epoch_seconds(ts: Column | str) -> Column:
    """Whole seconds since 1970 (UTC), rounded down; also for timestamps without a zone."""
    return F.unix_seconds(_col(ts).cast("timestamp"))


def epoch_micros(ts: Column | str) -> Column:
    return F.unix_micros(_col(ts).cast("timestamp"))


def calendar_parts(df: DataFrame, date: str = "transit_date", ts: str = "arrival_time") -> DataFrame:
    """year, month, day and dayofweek (1 = Sunday) of the date, hour of the timestamp."""
    return df.withColumns(
        {
            "year": F.year(date),
            "month": F.month(date),
            "day": F.dayofmonth(date),
            "hour": F.hour(ts),
            "dayofweek": F.dayofweek(date),
        }
    )


def delay_seconds(scheduled: str = "scheduled_time", arrival: str = "arrival_time") -> Column:
    """Scheduled minus actual arrival; positive = early."""
    return epoch_seconds(scheduled) - epoch_seconds(arrival)


def dwell_seconds(departure: str = "departure_time", arrival: str = "arrival_time") -> Column:
    """Departure minus arrival."""
    return epoch_seconds(departure) - epoch_seconds(arrival)


def time_window(ts: Column | str, minutes: int) -> Column:
    """Number of the time window of the day, ``floor(minute // w + hour * 60 / w)``.

    Both terms are whole after flooring, so it is integer arithmetic; a ``minutes`` that does not divide 60 gives
    uneven windows.
    """
    t = _col(ts)
    return (F.floor(F.minute(t) / F.lit(minutes)) + F.floor(F.hour(t) * F.lit(60) / F.lit(minutes))).cast("int")


def time_window_fraction(ts: Column | str, minutes: int) -> Column:
    """As ``time_window`` without the last floor, two decimals (E9 variant)."""
    t = _col(ts)
    return F.round(F.floor(F.minute(t) / F.lit(minutes)) + F.hour(t) * F.lit(60.0 / minutes), 2)


def time_window_rounded(ts: Column | str, hour: Column | str | None = None) -> Column:
    """Half-hour window rounded half up instead of floored."""
    t = _col(ts)
    h = F.hour(t) if hour is None else _col(hour)
    return F.round(F.minute(t) / F.lit(30.0) + h * F.lit(2.0), 0).cast("double")


def window_of_day(hour: Column | str) -> Column:
    """Name of the part of the day."""
    names = F.array(*[F.lit(n) for n in WINDOW_OF_DAY])
    return F.try_element_at(names, _col(hour) + F.lit(1))


def cyclic_time_signals(df: DataFrame, ts: str, compat: bool = False) -> DataFrame:
    """sin and cos of the epoch at hour, day, month and year periods.

    ``compat`` keeps the year period as month length times month length in days.
    """
    sec = epoch_micros(ts) / F.lit(1e6)
    month_days = MONTH / DAY
    periods = {"hour": HOUR, "day": DAY, "month": MONTH, "year": MONTH * month_days * DAY if compat else YEAR}
    out = {}
    for name, p in periods.items():
        angle = sec * F.lit(2 * math.pi / p)
        out[f"{name}_sin"] = F.sin(angle)
        out[f"{name}_cos"] = F.cos(angle)
    return df.withColumns(out)


def window_start_ts(date: Column | str, window: Column | str, minutes: int = 30) -> Column:
    """Timestamp at which a time window of a date begins."""
    step = F.make_dt_interval(mins=(_col(window) * F.lit(minutes)).cast("int"))
    return _col(date).cast("timestamp") + step


def hms_to_seconds(text: Column | str) -> Column:
    """Seconds of "HH:MM:SS"; the hour may be 24 or more."""
    p = F.split(_col(text), ":")
    return p[0].cast("int") * F.lit(3600) + p[1].cast("int") * F.lit(60) + p[2].cast("int")


def hms_to_hour(text: Column | str) -> Column:
    """Hour of "HH:MM:SS", not wrapped."""
    return F.split(_col(text), ":")[0].cast("int")


def seconds_to_hms(seconds: Column | str) -> Column:
    """"HH:MM:SS" of seconds, wrapping at 24 h."""
    s = F.pmod(_col(seconds), F.lit(86400))
    return F.format_string(
        "%02d:%02d:%02d",
        F.floor(s / F.lit(3600)).cast("int"),
        F.floor(s % F.lit(3600) / F.lit(60)).cast("int"),
        (s % F.lit(60)).cast("int"),
    )


def gtfs_dayofweek(compat: bool = False) -> list[tuple[str, int]]:
    """Weekday flag columns with their number: 1 = Sunday as in the events, or Monday = 1 with ``compat``."""
    days = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]
    return [(d, i + 1 if compat else (i + 1) % 7 + 1) for i, d in enumerate(days)]


def day_number(ts: Column | str) -> Column:
    """Days since 1970 of the day a timestamp falls in."""
    return F.unix_date(_col(ts).cast("timestamp").cast("date"))
