"""F1-F16 and the flagship roll-up."""

from pyspark.sql import functions as F

from ridership.functions.bins import LOAD_CLASSES, assign_class
from ridership.functions.times import calendar_parts, time_window
from ridership.operators import quantiles, rollup
from ridership.operators.basic import route_direction_key
from ridership.operators.clean import remove_null_events
from ridership.operators.enrich import flag_holiday, flag_school_break
from ridership.plans import feature_store
from ridership.registry.base import EV, STOPS, TRIPS, cleaned, d, first, query, r, sec, window
from ridership.registry.enrichment import MATCHED, matched
from ridership.session import stage
from ridership.sources.bindings import bind

TRIP_NUMBERS = (
    "temperature", "humidity", "precipitation_intensity", "scheduled_headway", "actual_headways", "y_reg100", "y_reg095",
)


def stops(spark, sf):
    ev, weather = bind(spark, sf, "stop_events", "weather_raw")
    return stage(feature_store.stop_level(ev, weather, weather_time="time_utc"), "stop_level")


def trips(spark, sf):
    return feature_store.trip_level(stops(spark, sf))


def stored_trips(spark, sf):
    return stage(trips(spark, sf), "trip_level")


@query(
    "load_windows",
    "stop_events",
    f""", bad AS (SELECT DISTINCT transit_date, trip_id, overload_id FROM stop_events WHERE load < 0 OR load IS NULL)
    , good AS (SELECT * FROM stop_events e WHERE NOT EXISTS (SELECT 1 FROM bad b WHERE b.transit_date = e.transit_date
        AND b.trip_id = e.trip_id AND b.overload_id = e.overload_id)
      QUALIFY count(*) OVER (PARTITION BY transit_date, trip_id, overload_id) >= 2)
    , trips AS (SELECT transit_date, trip_id, {first('arrival_time')} AS arrival_time, count(stop_id) AS num_records,
        min(CAST(route_id AS VARCHAR) || '_' || route_direction_name) AS route_id_direction,
        max(load) AS y_reg100, quantile_cont(load, 0.95) AS y_reg095 FROM good GROUP BY transit_date, trip_id)
    SELECT {d('transit_date')}, route_id_direction, {window('arrival_time', 30)} AS time_window,
      CAST(day(transit_date) AS INTEGER) AS day, CAST(sum(num_records) AS BIGINT) AS num_records,
      {r('max(y_reg100)', 'y_reg100')}, {r('max(y_reg095)', 'y_reg095')}, count(*) AS trips
    FROM trips GROUP BY ALL""",
)
def _(spark, sf):
    return feature_store.load_windows(bind(spark, sf, "stop_events"))


_NUMBERS = ", ".join(r(c, c) for c in TRIP_NUMBERS)


@query(
    "f1_trip_rollup",
    "stop_events weather_raw",
    f"""{STOPS}, rolled AS (SELECT transit_date, trip_id, {first('arrival_time')} AS arrival_time,
        count(stop_id) AS num_records, {first('year')} AS year, {first('hour')} AS hour,
        {first('route_id')} AS route_id, {first('route_direction_name')} AS route_direction_name,
        {first('block_abbr')} AS block_abbr,
        avg(CAST(CAST(darksky_temperature AS FLOAT) AS DOUBLE)) AS temperature,
        avg(CAST(CAST(darksky_humidity AS FLOAT) AS DOUBLE)) AS humidity,
        avg(CAST(CAST(darksky_precipitation_intensity AS FLOAT) AS DOUBLE)) AS precipitation_intensity,
        avg(sched_hdwy) AS scheduled_headway, avg(actual_hdwy) AS actual_headways,
        max(load) AS y_reg100, quantile_cont(load, 0.95) AS y_reg095,
        string_agg(CAST(load AS VARCHAR), ',' ORDER BY load) AS loads
      FROM stops GROUP BY transit_date, trip_id)
    SELECT {d('transit_date')}, trip_id, CAST(epoch_us(arrival_time) AS BIGINT) AS arrival_time, num_records, year, hour,
      route_id, route_direction_name, block_abbr, {_NUMBERS}, coalesce(loads, '') AS loads FROM rolled""",
)
def _(spark, sf):
    rows = stops(spark, sf)
    keys = ["transit_date", "trip_id"]
    out = rollup.trip_rollup(rows).join(rollup.trip_loads(rows), keys, "left")
    loads = F.flatten(F.transform("load_counts", lambda x: F.array_repeat(x["load"].cast("string"), x["n"].cast("int"))))
    return out.select(
        "transit_date", "trip_id", "arrival_time", "num_records", "year", "hour", "route_id", "route_direction_name",
        "block_abbr", *TRIP_NUMBERS, F.coalesce(F.array_join(loads, ","), F.lit("")).alias("loads"),
    )


@query(
    "f1_trip_level",
    "stop_events weather_raw",
    f"""{TRIPS} SELECT {d('transit_date')}, trip_id, route_id_direction, CAST(time_window AS DOUBLE) AS time_window,
      year, month, dayofweek, hour, block_abbr, {_NUMBERS} FROM trips""",
)
def _(spark, sf):
    return trips(spark, sf).select(
        "transit_date", "trip_id", "route_id_direction", "time_window", "year", "month", "dayofweek", "hour",
        "block_abbr", *TRIP_NUMBERS,
    )


_ALL = "year, month, day, dayofweek, hour, is_holiday, is_school_break".split(", ")

ROUTE_WINDOWS = f"""{TRIPS}
, flagged AS (SELECT *, day(transit_date) AS day, {window('arrival_time', 30)} AS tw,
    CASE WHEN transit_date IN (SELECT cal_date FROM holidays) THEN 1 ELSE 0 END AS is_holiday,
    CASE WHEN transit_date IN (SELECT cal_date FROM school_breaks) THEN 1 ELSE 0 END AS is_school_break
  FROM trips WHERE humidity IS NOT NULL AND precipitation_intensity IS NOT NULL AND actual_headways IS NOT NULL
    AND hour IS NOT NULL AND arrival_time IS NOT NULL)
, route_windows AS (SELECT transit_date, route_id_direction, tw AS time_window,
    {', '.join(f"{first(c, 'arrival_time, trip_id')} AS {c}" for c in _ALL)},
    avg(temperature) AS temperature, avg(humidity) AS humidity,
    avg(precipitation_intensity) AS precipitation_intensity, max(scheduled_headway) AS scheduled_headway,
    max(y_reg100) AS y_reg100 FROM flagged GROUP BY transit_date, route_id_direction, tw)"""


def route_windows(spark, sf, minutes=30):
    holidays, breaks = bind(spark, sf, "holidays", "school_breaks")
    return feature_store.route_windows(trips(spark, sf), holidays, breaks, minutes)


@query(
    "f2_route_window_rollup",
    "stop_events weather_raw holidays school_breaks",
    f"""{ROUTE_WINDOWS} SELECT {d('transit_date')}, route_id_direction, time_window, {', '.join(_ALL)},
      {', '.join(r(c, c) for c in ('temperature', 'humidity', 'precipitation_intensity', 'scheduled_headway', 'y_reg100'))}
    FROM route_windows""",
)
def _(spark, sf):
    return route_windows(spark, sf)


@query(
    "f3_stop_window_rollup",
    "stop_events weather_raw holidays school_breaks",
    f"""{STOPS}{cleaned('stops')}, w AS (SELECT *, {window('arrival_time', 15)} AS time_window,
        CASE WHEN transit_date IN (SELECT cal_date FROM holidays) THEN 1 ELSE 0 END AS is_holiday,
        CASE WHEN transit_date IN (SELECT cal_date FROM school_breaks) THEN 1 ELSE 0 END AS is_school_break FROM cleaned)
    SELECT {d('transit_date')}, route_id_direction, stop_id, time_window, {first('trip_id')} AS trip_id,
      {first('block_abbr')} AS block_abbr, CAST(epoch_us({first('arrival_time')}) AS BIGINT) AS arrival_time,
      {', '.join(f'{first(c)} AS {c}' for c in (*_ALL, 'stop_sequence'))},
      {', '.join(r(f'avg({c})', c) for c in ('darksky_temperature', 'darksky_humidity', 'darksky_precipitation_intensity'))},
      max(sched_hdwy) AS sched_hdwy, CAST(sum(load) AS BIGINT) AS load
    FROM w GROUP BY transit_date, route_id_direction, stop_id, time_window""",
)
def _(spark, sf):
    holidays, breaks = bind(spark, sf, "holidays", "school_breaks")
    rows = route_direction_key(remove_null_events(stops(spark, sf)))
    rows = flag_school_break(flag_holiday(rows, holidays), breaks)
    return rollup.stop_window_rollup(rows.withColumn("time_window", time_window("arrival_time", 15)))


@query(
    "f4_median_per_trip",
    "stop_events",
    f"SELECT trip_id, {r('median(load)', 'load_expected')} FROM stop_events GROUP BY trip_id",
)
def _(spark, sf):
    return rollup.median_per_trip(bind(spark, sf, "stop_events"), "load")


@query(
    "f5_trip_max_load",
    "stop_events",
    f"""{EV} SELECT {d('transit_date')}, trip_id, route_id_direction,
      {first('vehicle_id', 'scheduled_time, event_id')} AS vehicle_id, max(load) AS load
    FROM ev GROUP BY transit_date, trip_id, route_id_direction""",
)
def _(spark, sf):
    return rollup.trip_max_load(route_direction_key(bind(spark, sf, "stop_events")), ["scheduled_time", "event_id"])


def _resampled(table: str, key: str, ts: str, agg: str, where: str, fill: str) -> str:
    return f""", bins AS (SELECT {key}, {sec(ts)} // 1800 AS b, {agg} AS v FROM {table} WHERE {where} GROUP BY ALL)
    , spans AS (SELECT {key}, unnest(generate_series(min(b), max(b))) AS b FROM bins GROUP BY {key})
    SELECT spans.{key}, CAST(spans.b * 1800000000 AS BIGINT) AS {ts}, {fill} FROM spans LEFT JOIN bins
      ON bins.{key} = spans.{key} AND bins.b = spans.b"""


@query(
    "f6_resample_mean",
    "traffic",
    _resampled("traffic", "xd_id", "measurement_tstamp", "avg(speed)", "speed IS NOT NULL", r("v", "speed")),
)
def _(spark, sf):
    return rollup.resample_mean(bind(spark, sf, "traffic"), ["xd_id"], "measurement_tstamp", "speed", 30)


@query(
    "f7_resample_sum",
    "stop_events",
    _resampled("stop_events", "route_id", "arrival_time", "sum(ons)", "arrival_time IS NOT NULL",
               "CAST(coalesce(v, 0) AS BIGINT) AS ons"),
)
def _(spark, sf):
    return rollup.resample_sum(bind(spark, sf, "stop_events"), ["route_id"], "arrival_time", "ons", 30)


_ECDF = """, hourly_ons AS (SELECT route_id, stop_id, hour(arrival_time) AS hour, CAST(sum(ons) AS BIGINT) AS ons
    FROM stop_events WHERE arrival_time IS NOT NULL GROUP BY route_id, stop_id, transit_date, hour(arrival_time))
  , curve AS (SELECT DISTINCT route_id, stop_id, ons AS value,
      cume_dist() OVER (PARTITION BY route_id, stop_id ORDER BY ons) AS cdf FROM hourly_ons)"""


def _curve(spark, sf):
    ev = bind(spark, sf, "stop_events").filter("arrival_time IS NOT NULL")
    ons = ev.groupBy("route_id", "stop_id", "transit_date", F.hour("arrival_time").alias("hour")).agg(
        F.sum("ons").alias("ons")
    )
    return quantiles.ecdf(ons, "ons", ["route_id", "stop_id"])


@query("f8_ecdf", "stop_events", f"{_ECDF} SELECT route_id, stop_id, value, {r('cdf', 'cdf')} FROM curve")
def _(spark, sf):
    return _curve(spark, sf)


@query(
    "f8_ecdf_inverse",
    "stop_events",
    f"""{_ECDF}, steps AS (SELECT *, lag(cdf) OVER w AS c0, lag(value) OVER w AS v0 FROM curve
      WINDOW w AS (PARTITION BY route_id, stop_id ORDER BY value))
    , asked AS (SELECT *, unnest([0.25, 0.5, 0.85]::DOUBLE[]) AS p FROM steps)
    SELECT route_id, stop_id, p, {r('CASE WHEN cdf = p THEN value ELSE v0 + (p - c0) / (cdf - c0) * (value - v0) END', 'x')}
    FROM asked WHERE cdf = p OR (c0 < p AND p < cdf)""",
)
def _(spark, sf):
    return quantiles.ecdf_inverse(_curve(spark, sf), [0.25, 0.5, 0.85], ["route_id", "stop_id"])


@query(
    "f9_mode_per_group",
    "manual_checks",
    f"""SELECT {d('transit_date')}, trip_id, remark FROM (SELECT transit_date, trip_id, remark, count(*) AS n
      FROM manual_checks GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY transit_date, trip_id
      ORDER BY n DESC, remark) = 1""",
)
def _(spark, sf):
    return rollup.mode_per_group(bind(spark, sf, "manual_checks"), ["transit_date", "trip_id"], "remark")


@query("f10_value_counts", "stop_events", "SELECT load, count(*) AS count FROM stop_events GROUP BY load")
def _(spark, sf):
    return rollup.value_counts(bind(spark, sf, "stop_events"), ["load"])


@query(
    "f10_top_groups",
    "stop_events",
    f"{EV} SELECT route_id_direction, stop_id, count(*) AS count FROM ev GROUP BY ALL HAVING count(*) >= 20",
)
def _(spark, sf):
    return rollup.top_groups(route_direction_key(bind(spark, sf, "stop_events")), ["route_id_direction", "stop_id"], 20)


_CLASS = (
    "CASE WHEN {c} BETWEEN 0 AND 9 THEN 0 WHEN {c} BETWEEN 10 AND 16 THEN 1 WHEN {c} BETWEEN 17 AND 55 THEN 2 "
    "WHEN {c} BETWEEN 56 AND 75 THEN 3 WHEN {c} BETWEEN 76 AND 100 THEN 4 END"
)
CLASSED = f""", classed AS (SELECT *, {_CLASS.format(c='load')} AS y_true, {_CLASS.format(c='load_pred')} AS y_pred
  FROM scored)"""


def classed(spark, sf):
    scored = bind(spark, sf, "scored")
    return scored.withColumns(
        {"y_true": assign_class("load", LOAD_CLASSES), "y_pred": assign_class("load_pred", LOAD_CLASSES)}
    )


@query(
    "f11_pivot_counts",
    "scored",
    f"""{CLASSED} SELECT time_window, {', '.join(f'count(*) FILTER (WHERE y_pred = {i}) AS "{i}"' for i in range(5))}
    FROM classed GROUP BY time_window""",
)
def _(spark, sf):
    return rollup.pivot_counts(classed(spark, sf), ["time_window"], "y_pred", range(5))


@query(
    "f12_route_by_window_matrix",
    "scored",
    f"""{CLASSED} SELECT trip_id % 50 AS route_id_direction,
      {', '.join(f'max(y_pred) FILTER (WHERE time_window = {i}) AS "{i}"' for i in range(48))}
    FROM classed GROUP BY ALL""",
)
def _(spark, sf):
    routed = classed(spark, sf).withColumn("route_id_direction", F.col("trip_id") % 50)
    return rollup.route_by_window_matrix(routed)


@query(
    "f13_describe",
    "stop_events",
    """, cells AS (SELECT 'load' AS "column", CAST(load AS DOUBLE) AS x FROM stop_events
      UNION ALL SELECT 'ons', ons FROM stop_events UNION ALL SELECT 'value', value FROM events)
    SELECT "column", count(x) AS count, """
    + ", ".join(
        [r("avg(x)", "mean"), r("stddev_samp(x)", "std"), r("min(x)", "min"), r("max(x)", "max")]
        + [r(f"quantile_cont(x, 0.{p})", f"p{p}") for p in (25, 50, 75)]
    )
    + """ FROM cells GROUP BY "column\"""",
)
def _(spark, sf):
    ev, raw = bind(spark, sf, "stop_events", "events")
    both = ev.select("event_id", "load", "ons").join(raw.select("event_id", "value"), "event_id")
    return quantiles.describe(both, ["load", "ons", "value"])


_DIFFS = f"{MATCHED}, diffs AS (SELECT *, load - apc_load AS load_diff, ons - apc_ons AS ons_diff FROM matched)"


@query(
    "f14_normal_fit_ci",
    "manual_checks",
    f"""{_DIFFS}, fit AS (SELECT avg(load_diff) AS mu, stddev_pop(load_diff) AS sigma FROM diffs)
    SELECT {r('mu', 'mu')}, {r('sigma', 'sigma')}, {r(f'mu - {quantiles.NORMAL_Z_95} * sigma', 'ci_lo')},
      {r(f'mu + {quantiles.NORMAL_Z_95} * sigma', 'ci_hi')} FROM fit""",
)
def _(spark, sf):
    diffs = matched(spark, sf).withColumn("load_diff", F.col("load") - F.col("apc_load"))
    return quantiles.normal_fit_ci(diffs, "load_diff")


@query(
    "f15_kde",
    "manual_checks",
    f"""{_DIFFS}, s AS (SELECT CAST(count(load_diff) AS DOUBLE) AS n,
        stddev_samp(load_diff) * pow(count(load_diff), -0.2) AS h FROM diffs)
    , grid AS (SELECT unnest(generate_series(-25, 25)) / 1.0 AS x)
    SELECT x, {r('sum(exp(-0.5 * pow((x - load_diff) / h, 2)) / (n * h * sqrt(2 * pi())))', 'density')}
    FROM diffs, s, grid WHERE load_diff IS NOT NULL GROUP BY x""",
)
def _(spark, sf):
    diffs = matched(spark, sf).withColumn("load_diff", F.col("load") - F.col("apc_load"))
    return quantiles.kde(diffs, "load_diff", range(-25, 26))


@query(
    "f16_last_in_order",
    "stop_events",
    f"""{EV} SELECT {d('transit_date')}, trip_id, CAST(epoch_us(max(arrival_time)) AS BIGINT) AS arrival_time,
      last(load ORDER BY arrival_time NULLS FIRST, event_id) FILTER (WHERE load IS NOT NULL) AS load
    FROM ev GROUP BY transit_date, trip_id""",
)
def _(spark, sf):
    ev = calendar_parts(bind(spark, sf, "stop_events"))
    order = ["arrival_time", "event_id"]
    return ev.groupBy("transit_date", "trip_id").agg(
        rollup.last_of("arrival_time", order).alias("arrival_time"), rollup.last_of("load", order).alias("load")
    )
