"""Registration and the common output form."""

from __future__ import annotations

from collections.abc import Callable, Collection

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ridership.sources.bindings import with_bindings

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# Whole-number columns that hold NULL. Data frames made from the two engines keep such columns in different types, so
# both sides show them as doubles.
NULL_NUMBERS: dict[str, str] = {
    "b11_exclude_values": "vehicle_id",
    "b1_select_rename": "apc_load",
    "b4_drop_nulls": "vehicle_id",
    "b6_clip": "load",
    "c11_dedup_keep_first": "load",
    "d11_match_on_keys": "apc_load load",
    "d13_right_join_valid": "load",
    "d15_full_outer_suffix": "last_stop_next last_stop_prev",
    "d16_concat": "load",
    "d2_join_weather": "hour",
    "d8_gtfs_version_in_force": "gtfs_direction_id gtfs_route_id",
    "d9_join_scheduled_trips": "gtfs_number_of_scheduled_trips",
    "e1_calendar_parts": "hour",
    "e2_e3_delay_and_dwell": "delay_time dwell_time",
    "e4_scheduled_headway": "sched_hdwy",
    "e5_actual_headway": "actual_hdwy",
    "e9_time_window": "w120 w15 w30 w40 w50 w60",
    "f10_value_counts": "load",
    "f16_last_in_order": "arrival_time load",
    "f1_trip_rollup": "arrival_time hour",
    "f3_stop_window_rollup": "sched_hdwy",
    "f5_trip_max_load": "load vehicle_id",
    "feature_store": "actual_hdwy delay_time dwell_time gtfs_number_of_scheduled_trips gtfs_number_of_scheduled_trips_at_stop sched_hdwy",
    "g5_backfill": "arrival_time",
    "g6_sort_by": "load",
    "g7_top_k_per_group": "load",
    "h3_assign_class": "y_class",
    "h4_adjust_bins": "y_class",
    "i10_next_trips_after": "next_trip this_trip",
    "i11_decode_status": "merged_status",
    "i2_asof_backward": "arrival_time overload_id stop_sequence trip_id vehicle_id",
    "i2_asof_tolerance_2h": "trip_id",
    "i3_asof_forward": "arrival_time overload_id stop_sequence trip_id vehicle_id",
    "i4_match_disruptions": "arrival_time_next arrival_time_prev trip_id_next trip_id_prev",
    "i8_null_run_status": "status",
    "k2_recent_stop_compat": "y_pred_max y_pred_mean",
    "k2_recent_stop_max_mean": "max_load y_pred_max y_pred_mean",
    "l13_block_batches": "y",
    "n10_count_discrepancy": "load_diff",
    "n9_class_counts": "y_pred",
}


# Means of readings with two decimals often end exactly between two sixth places, where the order of summation decides
# the rounding; the nudge puts them on one side in both engines.
NUDGE = 1e-9


def shown(df: DataFrame, doubles: Collection[str] = ()) -> DataFrame:
    """Plain comparable columns: dates as text, timestamps as epoch microseconds, flags as 0/1, doubles to 6 places."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DateType):
            c = c.cast("string")
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.unix_micros(c.cast("timestamp"))
        elif isinstance(f.dataType, T.BooleanType):
            c = c.cast("int")
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = F.round(c.cast("double") + F.lit(NUDGE), 6) + F.lit(0.0).cast("double")
        cols.append((c.cast("double") if f.name in doubles else c).alias(f.name))
    return df.select(*cols)


def query(key: str, needs: str = "", sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``needs`` names the bindings the oracle text reads."""

    def add(fn: Query) -> Query:
        if key in QUERIES:
            raise KeyError(key)
        doubles = NULL_NUMBERS.get(key, "").split()
        QUERIES[key] = lambda spark, sf: shown(fn(spark, sf), doubles)
        if sql is not None:
            names = needs.split()
            text = with_bindings(names, sql) if names else sql.strip()
            casts = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in doubles)
            ORACLES[key] = f"SELECT * REPLACE ({casts}) FROM (\n{text}\n)" if casts else text
        return fn

    return add


def r(expr: str, name: str) -> str:
    """A double of the oracle to 6 places, without a negative zero."""
    return f"round(CAST({expr} AS DOUBLE) + {NUDGE}, 6) + 0.0 AS {name}"


def d(expr: str, name: str | None = None) -> str:
    """A date of the oracle as text."""
    return f"CAST({expr} AS VARCHAR) AS {name or expr}"


def sec(expr: str) -> str:
    """Whole epoch seconds in the oracle."""
    return f"CAST(floor(epoch({expr})) AS BIGINT)"


ROUTE = "CAST(route_id AS VARCHAR) || '_' || route_direction_name"

# further CTEs of the oracle texts; each begins with a comma and follows the bindings it needs
EV = f"""
, ev AS (SELECT *, year(transit_date) AS year, month(transit_date) AS month, day(transit_date) AS day,
    hour(arrival_time) AS hour, dayofweek(transit_date) + 1 AS dayofweek, {ROUTE} AS route_id_direction
  FROM stop_events)"""

HOURLY = """
, hourly AS (SELECT year(t) AS year, month(t) AS month, day(t) AS day, hour(t) AS hour,
    avg(temperature) AS darksky_temperature, avg(humidity) AS darksky_humidity,
    avg(precipitation_intensity) AS darksky_precipitation_intensity
  FROM (SELECT *, time_utc - INTERVAL 5 HOUR AS t FROM weather_raw) GROUP BY ALL)"""

STOPS = f"""{EV}{HOURLY}
, stops AS (SELECT ev.*, darksky_temperature, darksky_humidity, darksky_precipitation_intensity,
    {sec('scheduled_time')} - lag({sec('scheduled_time')}) OVER (
      PARTITION BY transit_date, route_id, route_direction_name, stop_id ORDER BY scheduled_time, stop_sequence)
      AS sched_hdwy,
    {sec('departure_time')} - lag({sec('departure_time')}) OVER (
      PARTITION BY transit_date, route_id, route_direction_name, stop_id ORDER BY departure_time, stop_sequence)
      AS actual_hdwy
  FROM ev LEFT JOIN hourly ON ev.year = hourly.year AND ev.month = hourly.month AND ev.day = hourly.day
    AND ev.hour = hourly.hour)"""


def cleaned(source: str, name: str = "cleaned") -> str:
    """The cleaning chain C4, C2, C6 over a CTE."""
    return f"""
, {name}_1 AS (SELECT * FROM {source} e WHERE NOT EXISTS (
    SELECT 1 FROM (SELECT transit_date, block_abbr FROM {source}
      GROUP BY transit_date, trip_id, vehicle_id, overload_id, block_abbr HAVING count(arrival_time) = 0) b
    WHERE b.transit_date = e.transit_date AND b.block_abbr = e.block_abbr))
, {name}_2 AS (SELECT * FROM {name}_1 e WHERE NOT EXISTS (
    SELECT 1 FROM {name}_1 b WHERE (b.load < 0 OR b.load IS NULL) AND b.transit_date = e.transit_date
      AND b.trip_id = e.trip_id AND b.overload_id = e.overload_id))
, {name} AS (SELECT * FROM {name}_2 e WHERE NOT EXISTS (
    SELECT 1 FROM {name}_2 b WHERE b.arrival_time IS NULL AND b.transit_date = e.transit_date
      AND b.trip_id = e.trip_id AND b.stop_id = e.stop_id))"""


def first(col: str, order: str = "arrival_time, stop_sequence") -> str:
    """Ordered first non-NULL value in the oracle."""
    return f"first({col} ORDER BY {order}) FILTER (WHERE {col} IS NOT NULL)"


def trips(source: str, name: str = "trips") -> str:
    """The trip roll-up with its finishing steps over a CTE of stop rows."""
    return f"""{cleaned(source, name + '_c')}
, {name}_r AS (SELECT transit_date, trip_id,
    {first('arrival_time')} AS arrival_time, {first('year')} AS year, {first('month')} AS month,
    {first('route_id')} AS route_id, {first('route_direction_name')} AS route_direction_name,
    {first('block_abbr')} AS block_abbr, {first('dayofweek')} AS dayofweek, {first('hour')} AS hour,
    avg(CAST(CAST(darksky_temperature AS FLOAT) AS DOUBLE)) AS temperature,
    avg(CAST(CAST(darksky_humidity AS FLOAT) AS DOUBLE)) AS humidity,
    avg(CAST(CAST(darksky_precipitation_intensity AS FLOAT) AS DOUBLE)) AS precipitation_intensity,
    avg(CAST(CAST(sched_hdwy AS FLOAT) AS DOUBLE)) AS scheduled_headway,
    avg(CAST(CAST(actual_hdwy AS FLOAT) AS DOUBLE)) AS actual_headways,
    CAST(max(load) AS DOUBLE) AS y_reg100, quantile_cont(load, 0.95) AS y_reg095
  FROM {name}_c GROUP BY transit_date, trip_id)
, {name} AS (SELECT *, {ROUTE} AS route_id_direction,
    round(minute(arrival_time) / 30.0 + hour * 2.0, 0) AS time_window
  FROM {name}_r WHERE y_reg100 <= 100 AND temperature IS NOT NULL AND scheduled_headway IS NOT NULL)"""


TRIPS = STOPS + trips("stops")


def window(ts: str, minutes: int) -> str:
    """Floored time window in the oracle."""
    return f"CAST(floor(minute({ts}) // {minutes} + hour({ts}) * 60 / {minutes}.0) AS INTEGER)"
