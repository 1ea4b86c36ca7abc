"""Declared schemas of the transit inputs, one ``StructType`` per table."""

from __future__ import annotations

from pyspark.sql.types import StructType


def _schema(ddl: str) -> StructType:
    return StructType.fromDDL(ddl)


STOP_EVENTS = _schema(
    """transit_date DATE, trip_id STRING, vehicle_id STRING, block_abbr INT, overload_id INT, route_id INT,
    route_direction_name STRING, pattern_num STRING, stop_id STRING, stop_id_original STRING, stop_name STRING,
    stop_id_list ARRAY<STRING>, stop_sequence_list ARRAY<INT>, stop_sequence INT, block_stop_order INT,
    arrival_time TIMESTAMP, departure_time TIMESTAMP, scheduled_time TIMESTAMP, load INT, ons INT, offs INT,
    load_factor DOUBLE, map_latitude DOUBLE, map_longitude DOUBLE, vehicle_capacity INT,
    zero_load_at_trip_end INT, year INT, month INT"""
)
WEATHER_RAW = _schema(
    """time BIGINT, temperature DOUBLE, humidity DOUBLE, nearest_storm_distance DOUBLE,
    precipitation_intensity DOUBLE, precipitation_probability DOUBLE, pressure DOUBLE, wind_gust DOUBLE,
    wind_speed DOUBLE"""
)
WEATHER_STATIONS = _schema(
    """spatial_id STRING, timestamp_local TIMESTAMP, rh DOUBLE, wind_spd DOUBLE, slp DOUBLE, app_temp DOUBLE,
    temp DOUBLE, snow DOUBLE, precip DOUBLE"""
)
GTFS_TRIPS = _schema(
    """trip_id STRING, date DATE, gtfs_file STRING, shape_id STRING, route_id STRING, direction_id INT,
    start_date DATE, end_date DATE, stop_id STRING, arrival_time STRING, monday INT, tuesday INT, wednesday INT,
    thursday INT, friday INT, saturday INT, sunday INT"""
)
CALENDAR = _schema("cal_date DATE")
TRIP_SPEED = _schema(
    "transit_date DATE, trip_id STRING, route_id_direction STRING, time_window INT, traffic_speed DOUBLE"
)
TRAFFIC = _schema("xd_id BIGINT, measurement_tstamp TIMESTAMP, speed DOUBLE")
DISRUPTIONS = _schema(
    """DATE STRING, TIME STRING, BLOCK INT, REASON STRING, START_STOP_ABBR STRING, START_STOP_NAME STRING,
    START_STOP_LATITUDE DOUBLE, START_STOP_LONGITUDE DOUBLE, COMMENTS STRING"""
)
MANUAL_CHECKS = _schema(
    """TRANSIT_DATE STRING, TRIP_ID STRING, BLOCK_ABBR INT, STOP_ID STRING, STOP_SEQUENCE INT, ROUTE_ID INT,
    ROUTE_DIRECTION_NAME STRING, VEHICLE_ID STRING, INITIAL_LOAD INT, LOAD INT, ONS INT, OFFS INT,
    trip_time STRING"""
)
