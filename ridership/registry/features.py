"""G1-G7, H1-H6 and K1-K4."""

from pyspark.sql import functions as F

from ridership.functions import bins
from ridership.functions.times import calendar_parts, epoch_micros
from ridership.operators import baseline, enrich, features, ordered, quantiles
from ridership.operators.basic import route_direction_key
from ridership.operators.ordered import Along
from ridership.registry.base import EV, TRIPS, d, query, r, window
from ridership.registry.rollups import stored_trips
from ridership.sources.bindings import bind

NEEDS = "stop_events weather_raw"
_ORDER = "ORDER BY transit_date, arrival_time, route_id_direction, block_abbr, trip_id"
_PART = {"route": "PARTITION BY route_id_direction", "global": ""}


def past_features(scope: str, n: int, source: str = "trips", name: str = "past") -> str:
    """G1 and G2 over a CTE of trips."""
    w = f"({_PART[scope]} {_ORDER})"
    frame = f"({_PART[scope]} {_ORDER} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"

    def pct(c: str, alias: str) -> str:
        return f"""CASE WHEN lag({c}, 2) OVER w = 0 AND lag({c}) OVER w <> 0 THEN sign(lag({c}) OVER w) * CAST('inf' AS DOUBLE)
          WHEN lag({c}, 2) OVER w = 0 THEN NULL ELSE lag({c}) OVER w / lag({c}, 2) OVER w - 1 END AS {alias}"""

    def q95(c: str, alias: str) -> str:
        lst = f"list_sort(list({c}) FILTER (WHERE {c} IS NOT NULL) OVER {frame})"
        return f"{lst}[CAST(floor((len({lst}) - 1) * 0.95) AS INTEGER) + 1] AS {alias}"

    return f"""
, {name}_f AS (SELECT *, last_value(y_reg100 IGNORE NULLS) OVER w AS f_load,
    last_value(actual_headways IGNORE NULLS) OVER w AS f_hdwy FROM {source} WINDOW w AS {w})
, {name} AS (SELECT *, {pct('f_load', 'load_pct_change')}, {pct('f_hdwy', 'act_headway_pct_change')},
    {q95('actual_headways', 'avg_past_act_headway')}, {q95('y_reg100', 'avg_past_trips_loads')}
  FROM {name}_f WINDOW w AS {w})"""


PAST = ("load_pct_change", "act_headway_pct_change", "avg_past_act_headway", "avg_past_trips_loads")
_KEY = f"{d('transit_date')}, trip_id"


def _register_scope(scope: str) -> None:
    @query(
        f"g1_lag_and_pct_change_{scope}",
        NEEDS,
        f"{TRIPS}{past_features(scope, 5)} SELECT {_KEY}, {r(PAST[0], PAST[0])}, {r(PAST[1], PAST[1])} FROM past",
    )
    def _(spark, sf):
        trips = stored_trips(spark, sf)
        out = features.lag_and_pct_change(
            trips, {"y_reg100": PAST[0], "actual_headways": PAST[1]}, scope, features.trip_order()
        )
        return out.select("transit_date", "trip_id", *PAST[:2])

    @query(
        f"g2_rolling_lower_quantile_{scope}",
        NEEDS,
        f"{TRIPS}{past_features(scope, 5)} SELECT {_KEY}, {r(PAST[2], PAST[2])}, {r(PAST[3], PAST[3])} FROM past",
    )
    def _(spark, sf):
        trips, cols = stored_trips(spark, sf), {"actual_headways": PAST[2], "y_reg100": PAST[3]}
        out = features.rolling_lower_quantile(trips, cols, 5, 0.95, scope, features.trip_order())
        return out.select("transit_date", "trip_id", *PAST[2:])

    @query(
        f"g3_day_ahead_features_{scope}",
        NEEDS,
        f"""{TRIPS}{past_features(scope, 20)} SELECT {d('transit_date')}, route_id_direction, block_abbr,
          {window('arrival_time', 30)} AS time_window, CAST(day(transit_date) AS INTEGER) AS day, {r('y_reg100', 'y_reg100')},
          {r('load_pct_change', 'load_pct_change')},
          {r("CASE WHEN isinf(act_headway_pct_change) THEN NULL ELSE act_headway_pct_change END", 'act_headway_pct_change')},
          {r(PAST[2], PAST[2])}, {r(PAST[3], PAST[3])} FROM past
        WHERE load_pct_change IS NOT NULL AND NOT isinf(load_pct_change) AND act_headway_pct_change IS NOT NULL
          AND avg_past_act_headway IS NOT NULL AND avg_past_trips_loads IS NOT NULL AND humidity IS NOT NULL
          AND precipitation_intensity IS NOT NULL AND hour IS NOT NULL""",
    )
    def _(spark, sf):
        out = features.day_ahead_features(stored_trips(spark, sf), 30, 20, scope=scope)
        return out.select(
            "transit_date", "route_id_direction", "block_abbr", "time_window", "day", "y_reg100", *PAST
        )


for _scope in ("route", "global"):
    _register_scope(_scope)


@query(
    "g4_trip_features",
    NEEDS,
    f"""{TRIPS} SELECT {_KEY}, CAST(day(transit_date) AS INTEGER) AS day, {window('arrival_time', 20)} AS time_window
    FROM trips WHERE humidity IS NOT NULL AND precipitation_intensity IS NOT NULL AND actual_headways IS NOT NULL
      AND arrival_time IS NOT NULL AND hour IS NOT NULL""",
)
def _(spark, sf):
    return features.trip_features(stored_trips(spark, sf), 20).select("transit_date", "trip_id", "day", "time_window")


@query(
    "g5_backfill",
    "stop_events",
    """SELECT event_id, first_value(load IGNORE NULLS) OVER w AS load,
      CAST(epoch_us(first_value(arrival_time IGNORE NULLS) OVER w) AS BIGINT) AS arrival_time FROM stop_events
    WINDOW w AS (PARTITION BY route_id ORDER BY scheduled_time, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""",
)
def _(spark, sf):
    ev = bind(spark, sf, "stop_events")
    along = Along(["scheduled_time", "event_id"], epoch_micros("scheduled_time"))
    out = enrich.backfill(ev, ["route_id"], along, ["load", "arrival_time"])
    return out.select("event_id", "load", "arrival_time")


@query(
    "g7_top_k_per_group",
    "stop_events",
    """SELECT event_id, route_id, stop_id, load FROM stop_events
    QUALIFY row_number() OVER (PARTITION BY route_id, stop_id ORDER BY transit_date DESC, event_id DESC) <= 10""",
)
def _(spark, sf):
    last = ordered.top_k(
        bind(spark, sf, "stop_events"), ["route_id", "stop_id"], [F.col("transit_date").desc(), F.col("event_id").desc()], 10
    )
    return last.select("event_id", "route_id", "stop_id", "load")


_LOWER = "a[CAST(floor((len(a) - 1) * {q}) AS INTEGER) + 1]"
_SORTED = ", s AS (SELECT list_sort(list(load)) AS a FROM stop_events WHERE load IS NOT NULL AND load <= 100)"


@query(
    "h1_lower_percentiles",
    "stop_events",
    f"{_SORTED} SELECT {', '.join(f'{_LOWER.format(q=q)} AS q{i}' for i, q in enumerate((0.0, 0.33, 0.66, 1.0)))} FROM s",
)
def _(spark, sf):
    return quantiles.lower_percentiles(bind(spark, sf, "stop_events").filter("load <= 100"), "load", bins.CLASS_BINS)


@query(
    "h2_class_bounds",
    "stop_events",
    f"""{_SORTED}, q AS (SELECT {', '.join(f'CAST({_LOWER.format(q=q)} AS DOUBLE) AS q{i}'
      for i, q in enumerate((0.0, 0.33, 0.66, 1.0)))} FROM s)
    SELECT q0 AS lo0, q1 AS hi0, q1 + 1 AS lo1, q2 AS hi1, q2 + 1 AS lo2, q3 AS hi2 FROM q""",
)
def _(spark, sf):
    return quantiles.class_bounds(bind(spark, sf, "stop_events").filter("load <= 100"), "load")


@query(
    "h2_class_bounds_linear",
    "stop_events",
    f""", q AS (SELECT quantile_cont(load, 0.0) AS q0, quantile_cont(load, 0.33) AS q1, quantile_cont(load, 0.66) AS q2
      FROM stop_events WHERE load <= 100)
    SELECT {r('q0', 'lo0')}, {r('q1', 'hi0')}, {r('q1 + 1', 'lo1')}, {r('q2', 'hi1')}, {r('q2 + 1', 'lo2')},
      {r('55', 'hi2')}, {r('56', 'lo3')}, {r('75', 'hi3')}, {r('76', 'lo4')}, {r('100', 'hi4')} FROM q""",
)
def _(spark, sf):
    return quantiles.class_bounds(bind(spark, sf, "stop_events").filter("load <= 100"), "load", kind="linear")


def _cut(edges) -> str:
    """Right-closed intervals of the load in the oracle, -1 outside."""
    tests = " ".join(f"WHEN load > {lo} AND load <= {hi} THEN {i}" for i, (lo, hi) in enumerate(edges))
    return f"CASE {tests} ELSE -1 END"


@query(
    "h3_assign_class",
    "stop_events",
    """SELECT event_id, CASE WHEN load BETWEEN 0 AND 9 THEN 0 WHEN load BETWEEN 10 AND 16 THEN 1
      WHEN load BETWEEN 17 AND 55 THEN 2 WHEN load BETWEEN 56 AND 75 THEN 3 WHEN load BETWEEN 76 AND 100 THEN 4 END
      AS y_class FROM stop_events""",
)
def _(spark, sf):
    return bind(spark, sf, "stop_events").select("event_id", bins.assign_class("load", bins.LOAD_CLASSES).alias("y_class"))


@query(
    "h4_adjust_bins",
    "stop_events",
    """SELECT event_id, CASE WHEN load BETWEEN 56 AND 75 THEN 3 WHEN load BETWEEN 76 AND 100 THEN 4
      WHEN load BETWEEN 0 AND 9 THEN 0 WHEN load BETWEEN 10 AND 15 THEN 1 WHEN load BETWEEN 16 AND 120 THEN 2 END AS y_class
    FROM stop_events""",
)
def _(spark, sf):
    three = bins.assign_class("load", [(0, 9), (10, 15), (16, 120)])
    ev = bind(spark, sf, "stop_events").withColumn("three", three)
    return ev.select("event_id", bins.adjust_bins("load", "three").alias("y_class"))


@query(
    "h5_interval_cut",
    "stop_events",
    f"SELECT event_id, {_cut([(-1, 9), (9, 16), (16, 55), (55, 75), (75, 100)])} AS y_class FROM stop_events",
)
def _(spark, sf):
    return bind(spark, sf, "stop_events").select("event_id", bins.interval_cut("load").alias("y_class"))


@query(
    "h6_same_day_cut",
    "stop_events",
    f"SELECT event_id, {_cut([(-1, 6), (7, 12), (13, 55), (56, 75), (76, 100)])} AS y_class FROM stop_events",
)
def _(spark, sf):
    return bind(spark, sf, "stop_events").select("event_id", bins.same_day_cut("load").alias("y_class"))


def _lookback(days: int) -> str:
    return f"""(SELECT t.transit_date, t.trip_id, t.route_id_direction, t.y_reg100,
      coalesce(quantile_cont(h.y_reg100, 0.01), -1) AS y_pred FROM trips t LEFT JOIN trips h
      ON h.trip_id = t.trip_id AND h.route_id_direction = t.route_id_direction
        AND h.transit_date >= t.transit_date - {days} AND h.transit_date < t.transit_date GROUP BY ALL)"""


def _register_lookback(weeks: int) -> None:
    @query(
        f"k1_lookback_percentile_{weeks}w",
        NEEDS,
        f"{TRIPS} SELECT {_KEY}, route_id_direction, {r('y_reg100', 'y_reg100')}, {r('y_pred', 'y_pred')} "
        f"FROM {_lookback(7 * weeks)}",
    )
    def _(spark, sf):
        out = baseline.lookback_percentile(stored_trips(spark, sf), 7 * weeks)
        return out.select("transit_date", "trip_id", "route_id_direction", "y_reg100", "y_pred")


for _weeks in (1, 4):
    _register_lookback(_weeks)

_STOP_KEY = ("route_id_direction", "stop_id", "hour", "dayofweek")


def _load_class(v: str) -> str:
    return (
        f"CASE WHEN {v} BETWEEN 0 AND 9 THEN 0 WHEN {v} BETWEEN 10 AND 16 THEN 1 WHEN {v} BETWEEN 17 AND 55 THEN 2 "
        f"WHEN {v} BETWEEN 56 AND 75 THEN 3 WHEN {v} BETWEEN 76 AND 100 THEN 4 END"
    )


_RECENT = f"""max_load, {r('mean_load', 'mean_load')}, {_load_class('max_load')} AS y_pred_max,
  {_load_class('mean_load')} AS y_pred_mean"""


def _keyed_stops(spark, sf):
    ev = route_direction_key(calendar_parts(bind(spark, sf, "stop_events")))
    return ev.filter("arrival_time IS NOT NULL AND load IS NOT NULL")


@query(
    "k2_recent_stop_max_mean",
    "stop_events",
    f"""{EV}, rows_ AS (SELECT * FROM ev WHERE arrival_time IS NOT NULL AND load IS NOT NULL)
    , asked AS (SELECT DISTINCT {', '.join(_STOP_KEY)}, transit_date FROM rows_)
    , ranked AS (SELECT a.*, h.load FROM asked a LEFT JOIN rows_ h ON {' AND '.join(f'h.{c} = a.{c}' for c in _STOP_KEY)}
        AND h.transit_date < a.transit_date
      QUALIFY row_number() OVER (PARTITION BY {', '.join(f'a.{c}' for c in (*_STOP_KEY, 'transit_date'))}
        ORDER BY h.transit_date DESC, h.event_id DESC) <= 10)
    , agg AS (SELECT {', '.join(_STOP_KEY)}, transit_date, max(load) AS max_load, avg(load) AS mean_load FROM ranked GROUP BY ALL)
    SELECT {', '.join(_STOP_KEY)}, {d('transit_date')}, {_RECENT} FROM agg""",
)
def _(spark, sf):
    ev = _keyed_stops(spark, sf)
    return baseline.recent_stop_max_mean(ev, ["event_id"], keys=_STOP_KEY)


@query(
    "k2_recent_stop_compat",
    "stop_events",
    f"""{EV}, ranked AS (SELECT * FROM ev WHERE arrival_time IS NOT NULL AND load IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY {', '.join(_STOP_KEY)} ORDER BY transit_date DESC, event_id DESC) <= 10)
    , agg AS (SELECT {', '.join(_STOP_KEY)}, max(load) AS max_load, avg(load) AS mean_load FROM ranked GROUP BY ALL)
    SELECT {', '.join(_STOP_KEY)}, {_RECENT} FROM agg""",
)
def _(spark, sf):
    return baseline.recent_stop_max_mean(
        _keyed_stops(spark, sf), ["event_id"], keys=_STOP_KEY, compat=True
    )


@query(
    "k3_rolling_max_class",
    "stop_events",
    f""", c AS (SELECT event_id, trip_id, {_load_class('load')} AS y_class FROM stop_events)
    SELECT event_id, CASE WHEN row_number() OVER w > 5 THEN max(y_class) OVER (PARTITION BY trip_id ORDER BY event_id
      ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) ELSE -1 END AS y_pred_roll FROM c
    WINDOW w AS (PARTITION BY trip_id ORDER BY event_id)""",
)
def _(spark, sf):
    ev = bind(spark, sf, "stop_events").withColumn("y_class", bins.assign_class("load", bins.LOAD_CLASSES))
    along = Along(["stop_sequence"], F.col("stop_sequence"))
    return baseline.rolling_max_class(ev, 5, ["trip_id"], along).select("event_id", "y_pred_roll")


def _report(tags: dict[int, int]) -> str:
    parts = [
        f"SELECT {tag} AS past, {_load_class('y_reg100')} AS y_true, {_load_class('y_pred')} AS y_pred_class "
        f"FROM {_lookback(7 * weeks)}"
        for weeks, tag in tags.items()
    ]
    return f"""{TRIPS}, all_ AS ({' UNION ALL '.join(parts)})
    SELECT past, y_true, y_pred_class, count(*) AS n FROM all_ WHERE y_pred_class IS NOT NULL GROUP BY ALL"""


def _register_report(name: str, tags: dict[int, int], compat: bool) -> None:
    @query(name, NEEDS, _report(tags))
    def _(spark, sf):
        out = baseline.baseline_report(stored_trips(spark, sf), compat=compat)
        return out.groupBy("past", "y_true", "y_pred_class").agg(F.count("*").alias("n"))


_register_report("k4_baseline_report", {1: 1, 2: 2, 4: 4}, False)
_register_report("k4_baseline_report_compat", {1: 4, 2: 2, 4: 1}, True)

