"""The transit tables as SELECTs over the shared test tables; each text runs in Spark and in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ridership.session import configure

BINDINGS: dict[str, str] = {}
NEEDS: dict[str, tuple[str, ...]] = {}


def _bind(name: str, sql: str, *needs: str) -> None:
    BINDINGS[name] = sql.strip()
    NEEDS[name] = needs


_bind(
    "stop_events",
    """
SELECT event_id, event_id AS stop_sequence, CAST(ts AS DATE) AS transit_date, user_id AS trip_id,
  user_id % 20 AS block_abbr,
  CASE WHEN user_id % 29 = 0 AND event_id % 40 = 0 THEN NULL ELSE user_id % 23 END AS vehicle_id,
  user_id % 10 AS route_id, CASE WHEN user_id % 2 = 0 THEN 'TO' ELSE 'FROM' END AS route_direction_name,
  event_type AS stop_id, CASE WHEN event_id % 50 = 0 THEN 1 ELSE 0 END AS overload_id,
  CASE WHEN event_id % 101 = 0 THEN NULL ELSE ts END AS arrival_time,
  ts + ((event_id * 37) % 600 - 300) * INTERVAL '1' SECOND AS scheduled_time,
  ts + (event_id % 45) * INTERVAL '1' SECOND AS departure_time,
  CASE WHEN event_id % 397 = 0 THEN NULL WHEN event_id % 389 = 0 THEN -1
       ELSE CAST(floor(value / 4) AS INT) END AS load,
  event_id % 7 AS ons, event_id % 5 AS offs
FROM events
""",
)
_bind(
    "weather_raw",
    """
SELECT ts + INTERVAL '5' HOUR AS time_utc, value AS temperature, CAST(event_id % 100 AS DOUBLE) / 100 AS humidity,
  CASE WHEN event_id % 11 = 0 THEN NULL ELSE CAST(event_id % 13 AS DOUBLE) / 13 END AS precipitation_intensity
FROM events WHERE event_type = 'view'
""",
)
_bind("holidays", "SELECT DISTINCT CAST(ts AS DATE) AS cal_date FROM events WHERE extract(DAY FROM ts) IN (1, 15)")
_bind(
    "school_breaks",
    "SELECT DISTINCT CAST(ts AS DATE) AS cal_date FROM events WHERE extract(DAY FROM ts) BETWEEN 20 AND 26",
)
_bind(
    "gtfs_trips",
    """
SELECT t.trip_id, t.feed_date, t.trip_id % 10 AS route_id, t.trip_id % 2 AS direction_id, t.stop_id,
  lpad(CAST((t.trip_id + t.k * 5) % 27 AS VARCHAR(2)), 2, '0') || ':' ||
  lpad(CAST(t.trip_id % 60 AS VARCHAR(2)), 2, '0') || ':00' AS arrival_time,
  1 AS monday, 1 AS tuesday, 1 AS wednesday, 1 AS thursday, 1 AS friday,
  CASE WHEN t.trip_id % 3 = 0 THEN 1 ELSE 0 END AS saturday, CASE WHEN t.trip_id % 4 = 0 THEN 1 ELSE 0 END AS sunday
FROM (SELECT DISTINCT user_id AS trip_id, event_type AS stop_id, DATE '2024-01-04' AS feed_date, 0 AS k FROM events
  UNION ALL SELECT DISTINCT user_id, event_type, DATE '2024-01-10', 1 FROM events
  UNION ALL SELECT DISTINCT user_id, event_type, DATE '2024-01-20', 2 FROM events) t
""",
)
_bind(
    "disruptions",
    """
SELECT event_id AS disruption_id, ts + INTERVAL '7' MINUTE AS disruption_ts, user_id % 20 AS block_abbr,
  event_type AS start_stop,
  CASE event_id % 4 WHEN 0 THEN 'Mechanical' WHEN 1 THEN 'Accident' WHEN 2 THEN 'Weather' ELSE 'Operator' END AS reason
FROM events WHERE event_type = 'error'
""",
)
_bind(
    "traffic",
    """
SELECT user_id % 15 AS xd_id, ts AS measurement_tstamp, CASE WHEN event_id % 17 = 0 THEN NULL ELSE value END AS speed
FROM events WHERE event_type = 'click'
""",
)
# a third of the checks carries a trip that no event has
_bind(
    "manual_checks",
    """
SELECT transit_date, block_abbr, stop_id, CASE WHEN event_id % 3 = 1 THEN trip_id + 1000000 ELSE trip_id END AS trip_id,
  stop_sequence, route_direction_name, route_id, vehicle_id,
  load + (event_id % 11) - 5 AS load, ons + (event_id % 3) - 1 AS ons, offs,
  CASE WHEN event_id % 6 = 0 THEN 'load_error' ELSE 'clean' END AS remark
FROM stop_events
""",
    "stop_events",
)
_bind(
    "scored",
    """
SELECT l_orderkey AS trip_id, l_linenumber AS stop_sequence, CAST(l_shipdate AS DATE) AS transit_date,
  l_suppkey % 48 AS time_window, l_orderkey % 3 AS kfold, l_quantity AS load,
  l_quantity + (l_orderkey % 13) - 6 AS load_pred
FROM lineitem
""",
)
_bind(
    "route_points",
    """
SELECT user_id AS trip_id, CAST(ts AS DATE) AS transit_date, event_id AS seq,
  -87.0E0 + CAST((user_id * 7 + event_id) % 400 AS DOUBLE) / 1000 AS lon,
  36.0E0 + CAST((user_id * 3 + event_id * 5) % 300 AS DOUBLE) / 1000 AS lat
FROM events
""",
)
_bind(
    "road_segments",
    """
SELECT p_partkey AS xd_id, -87.0E0 + CAST((p_partkey * 13) % 400 AS DOUBLE) / 1000 AS lon0,
  36.0E0 + CAST((p_partkey * 17) % 300 AS DOUBLE) / 1000 AS lat0,
  -87.0E0 + CAST((p_partkey * 13) % 400 + 2 AS DOUBLE) / 1000 AS lon1,
  36.0E0 + CAST((p_partkey * 17) % 300 + 2 AS DOUBLE) / 1000 AS lat1
FROM part
""",
)
# trip speeds as a stored table would hold them: mean reading per trip and day, for the trips that have one
_bind(
    "trip_speed",
    """
SELECT CAST(ts AS DATE) AS transit_date, user_id AS trip_id,
  CAST(user_id % 10 AS VARCHAR(3)) || '_' || CASE WHEN user_id % 2 = 0 THEN 'TO' ELSE 'FROM' END AS route_id_direction,
  CAST(min(extract(HOUR FROM ts)) * 2 AS INT) AS time_window, avg(value) AS traffic_speed
FROM (SELECT ts, user_id, CASE WHEN event_id % 17 = 0 THEN NULL ELSE value END AS value FROM events WHERE event_type = 'click') c
WHERE value IS NOT NULL GROUP BY CAST(ts AS DATE), user_id
""",
)
# the second weather provider: stations instead of one point
_bind(
    "weather_stations",
    """
SELECT CASE event_id % 3 WHEN 0 THEN 'north' WHEN 1 THEN 'south' ELSE 'east' END AS spatial_id,
  ts AS timestamp_local, CAST(event_id % 90 AS DOUBLE) AS rh, value / 10 AS wind_spd, value AS app_temp,
  value + 1 AS temp, CAST(event_id % 4 AS DOUBLE) AS snow, CAST(event_id % 9 AS DOUBLE) / 9 AS precip
FROM events WHERE event_type = 'view'
""",
)

BASE_TABLES = ("events", "lineitem", "part")


def bind(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame | tuple[DataFrame, ...]:
    """The named bindings as DataFrames over the Parquet files of ``sf_dir``."""
    configure(spark)
    for t in BASE_TABLES:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    done: dict[str, DataFrame] = {}

    def one(name: str) -> DataFrame:
        if name in BASE_TABLES:
            return spark.table(name)
        if name not in done:
            for n in NEEDS[name]:
                one(n).createOrReplaceTempView(n)
            done[name] = spark.sql(BINDINGS[name])
        return done[name]

    out = tuple(one(n) for n in names)
    return out[0] if len(out) == 1 else out


def with_bindings(names: tuple[str, ...] | list[str], body: str) -> str:
    """DuckDB text: the bindings as CTEs, then ``body`` (a SELECT, or further CTEs after a leading comma)."""
    order: list[str] = []

    def add(n: str) -> None:
        for m in NEEDS[n]:
            add(m)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    ctes = ",\n".join(f"{n} AS (\n{BINDINGS[n]}\n)" for n in order)
    return f"WITH {ctes}\n{body.strip()}"
