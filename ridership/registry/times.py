"""E1-E15 (E1 is with the cleaning queries)."""

import math

from pyspark.sql import functions as F

from ridership.functions import arrays, times
from ridership.functions.times import calendar_parts, epoch_micros
from ridership.operators import headway
from ridership.operators.basic import route_direction_key
from ridership.registry.base import EV, d, query, r, sec, window
from ridership.sources.bindings import bind

_HEADWAYS = f"""
, headways AS (SELECT *, {sec('scheduled_time')} - lag({sec('scheduled_time')}) OVER (
      PARTITION BY transit_date, route_id, route_direction_name, stop_id ORDER BY scheduled_time, event_id) AS sched_hdwy,
    {sec('departure_time')} - lag({sec('departure_time')}) OVER (
      PARTITION BY transit_date, route_id, route_direction_name, stop_id ORDER BY departure_time, event_id) AS actual_hdwy
  FROM stop_events)"""


@query(
    "e2_e3_delay_and_dwell",
    "stop_events",
    f"""SELECT event_id, {sec('scheduled_time')} - {sec('arrival_time')} AS delay_time,
      {sec('departure_time')} - {sec('arrival_time')} AS dwell_time FROM stop_events""",
)
def _(spark, sf):
    ev = bind(spark, sf, "stop_events")
    return ev.select(
        "event_id", times.delay_seconds().alias("delay_time"), times.dwell_seconds().alias("dwell_time")
    )


@query("e4_scheduled_headway", "stop_events", f"{_HEADWAYS} SELECT event_id, sched_hdwy FROM headways")
def _(spark, sf):
    ev = bind(spark, sf, "stop_events")
    return headway.scheduled_headway(ev, ["event_id"]).select("event_id", "sched_hdwy")


@query("e5_actual_headway", "stop_events", f"{_HEADWAYS} SELECT event_id, actual_hdwy FROM headways")
def _(spark, sf):
    return headway.actual_headway(bind(spark, sf, "stop_events"), ["event_id"]).select("event_id", "actual_hdwy")


@query(
    "e6_headway_flags",
    "stop_events",
    f"""{_HEADWAYS}, ratios AS (SELECT *, CASE WHEN sched_hdwy <> 0 THEN actual_hdwy / sched_hdwy END AS q FROM headways)
    SELECT event_id, CASE WHEN actual_hdwy > sched_hdwy AND q >= 1.5 THEN 1 ELSE 0 END AS is_gapped,
      CASE WHEN actual_hdwy < sched_hdwy AND q BETWEEN 0 AND 0.5 THEN 1 ELSE 0 END AS is_bunched,
      CASE WHEN q > 0.5 AND q < 1.5 THEN 1 ELSE 0 END AS is_target FROM ratios""",
)
def _(spark, sf):
    ev = headway.scheduled_headway(bind(spark, sf, "stop_events"), ["event_id"])
    flagged = headway.headway_flags(headway.actual_headway(ev, ["event_id"]))
    return flagged.select("event_id", "is_gapped", "is_bunched", "is_target")


@query(
    "e7_time_to_next",
    "stop_events",
    f"""SELECT event_id, {r('''(epoch_us(lead(arrival_time) OVER (PARTITION BY route_id, route_direction_name, block_abbr
      ORDER BY arrival_time, event_id)) - epoch_us(arrival_time)) / 1e6''', 'time_to_next_stop')}
    FROM stop_events WHERE arrival_time IS NOT NULL""",
)
def _(spark, sf):
    ev = bind(spark, sf, "stop_events").filter("arrival_time IS NOT NULL")
    keys = ["route_id", "route_direction_name", "block_abbr"]
    out = headway.time_to_next(ev, keys, "arrival_time", ["event_id"])
    return out.select("event_id", "time_to_next_stop")


@query(
    "e8_derived_load",
    "stop_events",
    """, ranked AS (SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY transit_date, trip_id) AS n
      FROM stop_events WHERE load IS NOT NULL WINDOW w AS (PARTITION BY transit_date, trip_id ORDER BY scheduled_time, event_id))
    , inner_stops AS (SELECT * FROM ranked WHERE rn > 1 AND rn < n)
    SELECT event_id, CAST(first_value(load) OVER w + sum(CASE WHEN rn > 2 THEN ons - offs ELSE 0 END) OVER w AS BIGINT)
      AS derived_load FROM inner_stops WINDOW w AS (PARTITION BY transit_date, trip_id ORDER BY scheduled_time, event_id)""",
)
def _(spark, sf):
    ev = bind(spark, sf, "stop_events").filter("load IS NOT NULL")
    return headway.derived_load(ev, tie=["event_id"]).select("event_id", "derived_load")


_WINDOWS = (15, 30, 40, 50, 60, 120)


@query(
    "e9_time_window",
    "stop_events",
    f"SELECT event_id, {', '.join(f'{window('arrival_time', w)} AS w{w}' for w in _WINDOWS)}, "
    + r("round(minute(arrival_time) // 40 + hour(arrival_time) * 1.5, 2)", "w40_fraction")
    + " FROM stop_events",
)
def _(spark, sf):
    ev = bind(spark, sf, "stop_events")
    return ev.select(
        "event_id",
        *[times.time_window("arrival_time", w).alias(f"w{w}") for w in _WINDOWS],
        times.time_window_fraction("arrival_time", 40).alias("w40_fraction"),
    )


@query(
    "e10_time_window_rounded",
    "stop_events",
    f"SELECT event_id, {r('round(minute(arrival_time) / 30.0 + hour(arrival_time) * 2, 0)', 'time_window')} FROM stop_events",
)
def _(spark, sf):
    return bind(spark, sf, "stop_events").select("event_id", times.time_window_rounded("arrival_time").alias("time_window"))


@query(
    "e11_window_of_day",
    "stop_events",
    """SELECT event_id, CASE WHEN hour(arrival_time) < 6 OR hour(arrival_time) >= 22 THEN 'late_night'
      WHEN hour(arrival_time) < 9 THEN 'am_rush' WHEN hour(arrival_time) < 14 THEN 'am'
      WHEN hour(arrival_time) < 17 THEN 'pm_rush' WHEN hour(arrival_time) < 20 THEN 'pm'
      ELSE CASE WHEN arrival_time IS NOT NULL THEN 'night' END END AS window_of_day FROM stop_events""",
)
def _(spark, sf):
    ev = calendar_parts(bind(spark, sf, "stop_events"))
    return ev.select("event_id", times.window_of_day("hour").alias("window_of_day"))


def _signals(year: float) -> str:
    periods = {"hour": times.HOUR, "day": times.DAY, "month": times.MONTH, "year": year}
    return ", ".join(
        r(f"{fn}(epoch_us(scheduled_time) / 1e6 * {2 * math.pi / p!r})", f"{name}_{fn}")
        for name, p in periods.items()
        for fn in ("sin", "cos")
    )


@query("e12_cyclic_time_signals", "stop_events", f"SELECT event_id, {_signals(times.YEAR)} FROM stop_events")
def _(spark, sf):
    out = times.cyclic_time_signals(bind(spark, sf, "stop_events"), "scheduled_time")
    return out.select("event_id", *[f"{p}_{fn}" for p in ("hour", "day", "month", "year") for fn in ("sin", "cos")])


@query(
    "e12_cyclic_compat",
    "stop_events",
    f"SELECT event_id, {_signals(times.MONTH * (times.MONTH / times.DAY) * times.DAY)} FROM stop_events",
)
def _(spark, sf):
    out = times.cyclic_time_signals(bind(spark, sf, "stop_events"), "scheduled_time", compat=True)
    return out.select("event_id", *[f"{p}_{fn}" for p in ("hour", "day", "month", "year") for fn in ("sin", "cos")])


@query(
    "e13_window_start_ts",
    "stop_events",
    f"""SELECT event_id, CAST(epoch_us(CAST(transit_date AS TIMESTAMP)) + CAST({window('scheduled_time', 30)} AS BIGINT) * 1800000000
      AS BIGINT) AS starts_at FROM stop_events""",
)
def _(spark, sf):
    ev = bind(spark, sf, "stop_events").withColumn("tw", times.time_window("scheduled_time", 30))
    return ev.select("event_id", epoch_micros(times.window_start_ts("transit_date", "tw")).alias("starts_at"))


@query(
    "e14_hms",
    "gtfs_trips",
    """, parts AS (SELECT *, CAST(split_part(arrival_time, ':', 1) AS INTEGER) AS h,
      CAST(split_part(arrival_time, ':', 2) AS INTEGER) AS m, CAST(split_part(arrival_time, ':', 3) AS INTEGER) AS s
      FROM gtfs_trips)
    SELECT trip_id, CAST(feed_date AS VARCHAR) AS feed_date, stop_id, h * 3600 + m * 60 + s AS seconds, h AS hour,
      lpad(CAST(h % 24 AS VARCHAR), 2, '0') || ':' || lpad(CAST(m AS VARCHAR), 2, '0') || ':' ||
      lpad(CAST(s AS VARCHAR), 2, '0') AS wrapped FROM parts""",
)
def _(spark, sf):
    gtfs = bind(spark, sf, "gtfs_trips").withColumn("seconds", times.hms_to_seconds("arrival_time"))
    return gtfs.select(
        "trip_id",
        "feed_date",
        "stop_id",
        "seconds",
        times.hms_to_hour("arrival_time").alias("hour"),
        times.seconds_to_hms("seconds").alias("wrapped"),
    )


@query(
    "e15_array_percentile_mean",
    "stop_events",
    f"""{EV}, lists AS (SELECT transit_date, route_id_direction, list_sort(list(load) FILTER (WHERE load IS NOT NULL)) AS a
      FROM ev GROUP BY ALL)
    SELECT {d('transit_date')}, route_id_direction, a[CAST(floor((len(a) - 1) * 0.95) AS INTEGER) + 1] AS p95,
      a[1] AS p0, {r('list_avg(a)', 'mean_load')} FROM lists""",
)
def _(spark, sf):
    # the list comes from counts per value, expanded within its row
    ev = route_direction_key(bind(spark, sf, "stop_events")).filter("load IS NOT NULL")
    per = ev.groupBy("transit_date", "route_id_direction", "load").agg(F.count("*").alias("n"))
    lists = per.groupBy("transit_date", "route_id_direction").agg(
        F.array_sort(F.collect_list(F.struct("load", "n"))).alias("counts")
    )
    loads = arrays.expand_counts("counts", "load")
    return lists.select(
        "transit_date",
        "route_id_direction",
        arrays.lower_percentile(loads, 95).alias("p95"),
        arrays.lower_percentile(loads, 0).alias("p0"),
        arrays.array_mean(loads).alias("mean_load"),
    )
