"""D1-D17."""

from datetime import date

from pyspark.sql import functions as F

from ridership.functions.times import calendar_parts, day_number
from ridership.operators import enrich
from ridership.operators.basic import route_direction_key
from ridership.operators.ordered import Along
from ridership.registry.base import EV, HOURLY, ROUTE, d, query, r
from ridership.sources.bindings import bind

VALUES = ("temperature", "humidity", "precipitation_intensity")
_HOURLY_COLS = ", ".join(r(f"darksky_{v}", f"darksky_{v}") for v in VALUES)


def hourly(spark, sf):
    return enrich.weather_hourly(bind(spark, sf, "weather_raw"), VALUES, "time_utc")


def trips_of(spark, sf):
    """Distinct trips per day with their first hour's window, a stand-in for a trip table."""
    ev = route_direction_key(bind(spark, sf, "stop_events"))
    return ev.groupBy("transit_date", "trip_id", "route_id_direction", "block_abbr").agg(
        F.min("scheduled_time").alias("arrival_time")
    )


TRIPS_OF = f"""
, trips_of AS (SELECT transit_date, trip_id, {ROUTE} AS route_id_direction, block_abbr,
    min(scheduled_time) AS arrival_time FROM stop_events GROUP BY ALL)"""


@query("d1_weather_hourly", "weather_raw", f"{HOURLY} SELECT year, month, day, hour, {_HOURLY_COLS} FROM hourly")
def _(spark, sf):
    return hourly(spark, sf)


@query(
    "d2_join_weather",
    "stop_events weather_raw",
    f"{EV}{HOURLY} SELECT event_id, hour, {_HOURLY_COLS} FROM ev LEFT JOIN hourly USING (year, month, day, hour)",
)
def _(spark, sf):
    ev = calendar_parts(bind(spark, sf, "stop_events"))
    joined = enrich.join_weather(ev, hourly(spark, sf))
    return joined.select("event_id", "hour", *[f"darksky_{v}" for v in VALUES])


@query(
    "d3_station_weather",
    "weather_stations",
    "SELECT year(timestamp_local) AS year, month(timestamp_local) AS month, day(timestamp_local) AS day, "
    "hour(timestamp_local) AS hour, "
    + ", ".join(r(f"avg({v})", f"weatherbit_{v}") for v in ("rh", "wind_spd", "app_temp", "temp", "snow", "precip"))
    + " FROM weather_stations WHERE spatial_id IN ('north', 'south') GROUP BY ALL",
)
def _(spark, sf):
    return enrich.station_weather(bind(spark, sf, "weather_stations"), ["north", "south"])


@query(
    "d4_flag_calendar",
    "stop_events holidays school_breaks",
    f"""SELECT event_id, {d('transit_date')},
      CASE WHEN transit_date IN (SELECT cal_date FROM holidays) THEN 1 ELSE 0 END AS is_holiday,
      CASE WHEN transit_date IN (SELECT cal_date FROM school_breaks) THEN 1 ELSE 0 END AS is_school_break
    FROM stop_events""",
)
def _(spark, sf):
    ev, holidays, breaks = bind(spark, sf, "stop_events", "holidays", "school_breaks")
    out = enrich.flag_school_break(enrich.flag_holiday(ev, holidays), breaks)
    return out.select("event_id", "transit_date", "is_holiday", "is_school_break")


_SPEED_JOIN = f"""{TRIPS_OF}
, joined AS (SELECT t.*, s.traffic_speed FROM trips_of t LEFT JOIN trip_speed s
    ON s.transit_date = t.transit_date AND s.trip_id = t.trip_id AND s.route_id_direction = t.route_id_direction)"""
_SPEED_COLS = ("transit_date", "trip_id", "route_id_direction", "traffic_speed")


@query(
    "d5_speed_drop",
    "stop_events trip_speed",
    f"""{_SPEED_JOIN} SELECT {d('transit_date')}, trip_id, route_id_direction, {r('traffic_speed', 'traffic_speed')}
    FROM joined WHERE traffic_speed IS NOT NULL""",
)
def _(spark, sf):
    return enrich.join_trip_speed(trips_of(spark, sf), bind(spark, sf, "trip_speed"), "drop").select(*_SPEED_COLS)


@query(
    "d5_speed_backfill",
    "stop_events trip_speed",
    f"""{_SPEED_JOIN} SELECT {d('transit_date')}, trip_id, route_id_direction,
      {r('''first_value(traffic_speed IGNORE NULLS) OVER (ORDER BY block_abbr, arrival_time, trip_id
        ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)''', 'traffic_speed')} FROM joined""",
)
def _(spark, sf):
    trips, speed = trips_of(spark, sf), bind(spark, sf, "trip_speed")
    out = enrich.join_trip_speed(
        trips,
        speed,
        "backfill",
        along=Along(
            ["block_abbr", "arrival_time", "trip_id"], F.col("block_abbr") * 1_000_000 + day_number("arrival_time")
        ),
    )
    return out.select(*_SPEED_COLS)


@query(
    "d5_speed_mean",
    "stop_events trip_speed",
    f"""{_SPEED_JOIN} SELECT {d('transit_date')}, trip_id, route_id_direction,
      {r('coalesce(traffic_speed, (SELECT avg(traffic_speed) FROM joined))', 'traffic_speed')} FROM joined""",
)
def _(spark, sf):
    return enrich.join_trip_speed(trips_of(spark, sf), bind(spark, sf, "trip_speed"), "mean").select(*_SPEED_COLS)


@query(
    "d6_speed_climatology",
    "trip_speed",
    f"""SELECT route_id_direction, time_window, {r('avg(traffic_speed)', 'traffic_speed')} FROM trip_speed
    GROUP BY route_id_direction, time_window""",
)
def _(spark, sf):
    return enrich.speed_climatology(bind(spark, sf, "trip_speed"))


@query(
    "d7_weather_for_date",
    "weather_raw",
    f"{HOURLY} SELECT hour, {_HOURLY_COLS} FROM hourly WHERE year = 2024 AND month = 1 AND day = 28",
)
def _(spark, sf):
    return enrich.weather_for_date(hourly(spark, sf), date(2024, 3, 1), date(2024, 1, 28))


VERSIONS = """
, versions AS (SELECT DISTINCT trip_id, feed_date, route_id AS gtfs_route_id, direction_id AS gtfs_direction_id
    FROM gtfs_trips)
, dated AS (SELECT e.*, v.feed_date AS gtfs_date, v.gtfs_route_id, v.gtfs_direction_id FROM ev e
    ASOF LEFT JOIN versions v ON e.trip_id = v.trip_id AND e.transit_date >= v.feed_date)"""


@query(
    "d8_gtfs_version_in_force",
    "stop_events gtfs_trips",
    f"""{EV}{VERSIONS} SELECT event_id, {d('transit_date')}, trip_id, {d('gtfs_date')}, gtfs_route_id,
      gtfs_direction_id FROM dated""",
)
def _(spark, sf):
    ev, gtfs = bind(spark, sf, "stop_events", "gtfs_trips")
    out = enrich.gtfs_version_in_force(ev, gtfs)
    return out.select("event_id", "transit_date", "trip_id", "gtfs_date", "gtfs_route_id", "gtfs_direction_id")


def _flags(compat: bool) -> str:
    days = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]
    parts = [
        f"SELECT *, {i + 1 if compat else (i + 1) % 7 + 1} AS dayofweek FROM gtfs_trips WHERE {day} = 1"
        for i, day in enumerate(days)
    ]
    return "\n, weekdays AS (" + "\n  UNION ALL ".join(parts) + ")"


def scheduled(name: str, extra: str, compat: bool) -> str:
    hour = "CAST(split_part(arrival_time, ':', 1) AS INTEGER)" + ("" if compat else " % 24")
    return f"""{_flags(compat)}
, scheduled AS (SELECT feed_date AS gtfs_date, dayofweek, {hour} AS hour, route_id AS gtfs_route_id,
    direction_id AS gtfs_direction_id{extra}, count(trip_id) AS {name} FROM weekdays GROUP BY ALL)"""


N, N_STOP = "gtfs_number_of_scheduled_trips", "gtfs_number_of_scheduled_trips_at_stop"
_SCHED_COLS = f"{d('gtfs_date')}, dayofweek, hour, gtfs_route_id, gtfs_direction_id"


@query("d9_scheduled_trips_per_route_hour", "gtfs_trips", f"{scheduled(N, '', False)} SELECT {_SCHED_COLS}, {N} FROM scheduled")
def _(spark, sf):
    return enrich.scheduled_trips_per_route_hour(bind(spark, sf, "gtfs_trips"))


@query("d9_scheduled_trips_compat", "gtfs_trips", f"{scheduled(N, '', True)} SELECT {_SCHED_COLS}, {N} FROM scheduled")
def _(spark, sf):
    return enrich.scheduled_trips_per_route_hour(bind(spark, sf, "gtfs_trips"), compat=True)


@query(
    "d9_join_scheduled_trips",
    "stop_events gtfs_trips",
    f"""{EV}{VERSIONS}{scheduled(N, '', False)} SELECT event_id, {N} FROM dated LEFT JOIN scheduled
    USING (gtfs_date, dayofweek, hour, gtfs_route_id, gtfs_direction_id)""",
)
def _(spark, sf):
    ev, gtfs = bind(spark, sf, "stop_events", "gtfs_trips")
    dated = enrich.gtfs_version_in_force(calendar_parts(ev), gtfs)
    return enrich.join_scheduled_trips(dated, enrich.scheduled_trips_per_route_hour(gtfs)).select("event_id", N)


@query(
    "d10_scheduled_trips_per_stop_hour",
    "gtfs_trips",
    f"{scheduled(N_STOP, ', stop_id', False)} SELECT {_SCHED_COLS}, stop_id, {N_STOP} FROM scheduled",
)
def _(spark, sf):
    return enrich.scheduled_trips_per_stop_hour(bind(spark, sf, "gtfs_trips"))


MATCHED = """
, matched AS (SELECT m.*, s.load AS apc_load, s.ons AS apc_ons, s.offs AS apc_offs
  FROM manual_checks m JOIN stop_events s USING (transit_date, block_abbr, stop_id, trip_id, stop_sequence,
    route_direction_name, route_id))"""


def matched(spark, sf):
    checks, ev = bind(spark, sf, "manual_checks", "stop_events")
    apc = ev.select(
        *enrich.MATCH_KEYS,
        F.col("load").alias("apc_load"),
        F.col("ons").alias("apc_ons"),
        F.col("offs").alias("apc_offs"),
        "event_id",
    )
    return enrich.match_on_keys(checks, apc, ["event_id"])


@query(
    "d11_match_on_keys",
    "manual_checks",
    f"{MATCHED} SELECT {d('transit_date')}, trip_id, stop_sequence, load, apc_load, ons, apc_ons, remark FROM matched",
)
def _(spark, sf):
    return matched(spark, sf).select(
        "transit_date", "trip_id", "stop_sequence", "load", "apc_load", "ons", "apc_ons", "remark"
    )


@query(
    "d12_unmatched",
    "manual_checks",
    f"""SELECT {d('transit_date')}, trip_id, stop_sequence FROM stop_events e WHERE NOT EXISTS (
      SELECT 1 FROM manual_checks m WHERE m.transit_date = e.transit_date AND m.trip_id = e.trip_id
        AND m.stop_sequence = e.stop_sequence AND m.stop_id = e.stop_id AND m.block_abbr = e.block_abbr
        AND m.route_id = e.route_id AND m.route_direction_name = e.route_direction_name)""",
)
def _(spark, sf):
    checks, ev = bind(spark, sf, "manual_checks", "stop_events")
    return enrich.unmatched(ev, checks).select("transit_date", "trip_id", "stop_sequence")


@query(
    "d13_right_join_valid",
    "manual_checks trip_speed",
    f"""SELECT {d('transit_date')}, trip_id, stop_sequence, load, {r('traffic_speed', 'traffic_speed')}
    FROM trip_speed JOIN manual_checks USING (transit_date, trip_id)""",
)
def _(spark, sf):
    speed, checks = bind(spark, sf, "trip_speed", "manual_checks")
    left = speed.select("transit_date", "trip_id", "traffic_speed")
    right = checks.select("transit_date", "trip_id", "stop_sequence", "load")
    return enrich.right_join_valid(left, right, ["transit_date", "trip_id"], ["traffic_speed"])


@query(
    "d14_block_trip_ids",
    "stop_events",
    f"""{TRIPS_OF}, lists AS (SELECT transit_date, block_abbr, string_agg(CAST(trip_id AS VARCHAR), ',' ORDER BY trip_id)
      AS block_trip_ids FROM (SELECT DISTINCT transit_date, block_abbr, trip_id FROM trips_of) GROUP BY ALL)
    SELECT {d('transit_date')}, block_abbr, trip_id, block_trip_ids FROM trips_of
    JOIN lists USING (transit_date, block_abbr)""",
)
def _(spark, sf):
    out = enrich.block_trip_ids(trips_of(spark, sf), separator=",")
    return out.select("transit_date", "block_abbr", "trip_id", "block_trip_ids")


@query(
    "d15_full_outer_suffix",
    "manual_checks trip_speed",
    f""", a AS (SELECT transit_date, trip_id, max(stop_sequence) AS last_stop FROM manual_checks GROUP BY ALL)
    , b AS (SELECT transit_date, trip_id, max(time_window) AS last_stop FROM trip_speed GROUP BY ALL)
    SELECT CAST(coalesce(a.transit_date, b.transit_date) AS VARCHAR) AS transit_date, coalesce(a.trip_id, b.trip_id) AS trip_id,
      a.last_stop AS last_stop_prev, b.last_stop AS last_stop_next
    FROM a FULL JOIN b ON a.transit_date = b.transit_date AND a.trip_id = b.trip_id""",
)
def _(spark, sf):
    checks, speed = bind(spark, sf, "manual_checks", "trip_speed")
    keys = ["transit_date", "trip_id"]
    a = checks.groupBy(*keys).agg(F.max("stop_sequence").alias("last_stop"))
    b = speed.groupBy(*keys).agg(F.max("time_window").alias("last_stop"))
    return enrich.full_outer_suffix(a, b, keys, ["last_stop"])


@query(
    "d16_concat",
    "manual_checks",
    """SELECT trip_id, stop_sequence, load, CAST(NULL AS VARCHAR) AS remark, 'automatic' AS source FROM stop_events
    UNION ALL SELECT trip_id, stop_sequence, load, remark, 'manual' FROM manual_checks""",
)
def _(spark, sf):
    ev, checks = bind(spark, sf, "stop_events", "manual_checks")
    automatic = ev.select("trip_id", "stop_sequence", "load", F.lit("automatic").alias("source"))
    manual = checks.select(F.lit("manual").alias("source"), "trip_id", "stop_sequence", "load", "remark")
    return enrich.concat(automatic, manual)


@query(
    "d17_explode_weekdays",
    "gtfs_trips",
    f"{_flags(False)} SELECT trip_id, {d('feed_date')}, stop_id, dayofweek FROM weekdays",
)
def _(spark, sf):
    return enrich.explode_weekdays(bind(spark, sf, "gtfs_trips")).select("trip_id", "feed_date", "stop_id", "dayofweek")


