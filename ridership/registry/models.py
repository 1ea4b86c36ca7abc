"""M1-M9. Fitted models are checked by their rows only; the inputs around them have oracle texts."""

from datetime import date

from pyspark.sql import functions as F

from ridership.functions.bins import HIGH_LOAD_BOUNDS
from ridership.operators import boosting, models
from ridership.operators.encode import hot_column
from ridership.operators.enrich import weather_hourly
from ridership.plans import prediction
from ridership.plans.feature_store import WEATHER_VALUES
from ridership.plans.feature_store import route_windows as build_route_windows
from ridership.registry.base import STOPS, d, query, r, trips
from ridership.registry.features import past_features
from ridership.registry.rollups import ROUTE_WINDOWS, route_windows, stops, stored_trips
from ridership.session import scratch_path, stage
from ridership.sources.bindings import bind

NEEDS = "stop_events weather_raw holidays school_breaks"
KEYS = ["transit_date", "route_id_direction", "time_window"]
FEATURES = models.ROUTE_FEATURES
SWEEP = [1, 10, 20, 30, 40, 50, 60, 120]
# fixed values: the grid the settings of a search are drawn from
SPACE = {
    "max_depth": range(2, 24, 6),
    "n_estimators": range(100, 1100, 400),
    "learning_rate": [0.1, 0.01, 0.05, 0.005],
    "gamma": [0.0, 0.05, 0.1, 0.2],
}


def training_rows(spark, sf):
    return stage(route_windows(spark, sf), "route_windows")


_LOWER = "a[CAST(floor((len(a) - 1) * {q}) AS INTEGER) + 1]"


@query(
    "m1_prepare_training",
    NEEDS,
    f"""{ROUTE_WINDOWS}, capped AS (SELECT * FROM route_windows WHERE y_reg100 < 100)
    , q AS (SELECT {', '.join(f'{_LOWER.format(q=q)} AS q{i}' for i, q in enumerate((0.0, 0.33, 0.66, 1.0)))}
      FROM (SELECT list_sort(list(y_reg100)) AS a FROM capped))
    SELECT {d('transit_date')}, {r('y_reg100', 'y_reg100')}, {r('temperature', 'temperature')},
      CASE WHEN y_reg100 BETWEEN 56 AND 75 THEN 3 WHEN y_reg100 BETWEEN 76 AND 100 THEN 4
        WHEN y_reg100 BETWEEN q0 AND q1 THEN 0 WHEN y_reg100 BETWEEN q1 + 1 AND q2 THEN 1
        WHEN y_reg100 BETWEEN q2 + 1 AND q3 THEN 2 END AS y_class,
      dense_rank() OVER (ORDER BY hour) - 1 AS hour_ix, dense_rank() OVER (ORDER BY day) - 1 AS day_ix,
      {', '.join(f"CASE WHEN dayofweek = {i} THEN 1 ELSE 0 END AS dayofweek_{i}" for i in range(1, 8))},
      CASE WHEN route_id_direction = '1_FROM' THEN 1 ELSE 0 END AS route_1_from
    FROM capped, q""",
)
def _(spark, sf):
    features = models.Features(("route_id_direction", "dayofweek"), ("hour", "day"), ("temperature",))
    out, _, bounds = models.prepare_training(training_rows(spark, sf), features, five=True)
    assert bounds[2:] == HIGH_LOAD_BOUNDS
    return out.select(
        "transit_date", "y_reg100", "temperature", "y_class", "hour_ix", "day_ix",
        *[hot_column(out, "dayofweek", i) for i in range(1, 8)], hot_column(out, "route_id_direction", "1_FROM").alias("route_1_from"),
    )


def _predicted(df):
    return df.select("transit_date", "route_id_direction", "time_window", "y_reg100", "y_pred")


@query("m2_cascade")
def _(spark, sf):
    rows = training_rows(spark, sf)
    return _predicted(models.predict_cascade(models.fit_cascade(rows, FEATURES), rows))


def _classed_rows(spark, sf):
    rows = training_rows(spark, sf)
    classed, _ = models.prepare_classes(rows, "y_reg100")
    return classed.filter("y_class IS NOT NULL")


@query("m3_forest")
def _(spark, sf):
    rows = _classed_rows(spark, sf)
    return _predicted(models.predict(models.fit_forest(rows, FEATURES), rows, FEATURES))


@query("m3_boosted_ovr")
def _(spark, sf):
    rows = _classed_rows(spark, sf)
    return _predicted(models.predict(models.fit_boosted_ovr(rows, FEATURES), rows, FEATURES))


@query("m3_mlp")
def _(spark, sf):
    rows = _classed_rows(spark, sf)
    return _predicted(models.predict(models.fit_mlp(rows, FEATURES), rows, FEATURES))


@query("m2_boosted_cascade")
def _(spark, sf):
    rows = training_rows(spark, sf)
    return _predicted(boosting.predict_boosted_cascade(boosting.fit_boosted_cascade(rows, FEATURES), rows, FEATURES))


# a load that follows from the hour, so that the right answer of a fitted cascade is known
_KNOWN = f"""{ROUTE_WINDOWS}, capped AS (SELECT * REPLACE (CAST(hour * 4 AS DOUBLE) AS y_reg100) FROM route_windows)
, q AS (SELECT {', '.join(f'{_LOWER.format(q=q)} AS q{i}' for i, q in enumerate((0.33, 0.66), 1))}
  FROM (SELECT list_sort(list(y_reg100)) AS a FROM capped))
SELECT {d('transit_date')}, route_id_direction, CAST(time_window AS DOUBLE) AS time_window, {r('y_reg100', 'y_reg100')},
  CASE WHEN y_reg100 <= q1 THEN 0 WHEN y_reg100 <= q2 THEN 1
    WHEN y_reg100 >= 76 THEN 4 WHEN y_reg100 >= 56 THEN 3 ELSE 2 END AS y_pred
FROM capped, q"""


@query("m7_boosted_cascade_loaded", NEEDS, _KNOWN)
def _(spark, sf):
    rows = training_rows(spark, sf).withColumn("y_reg100", (F.col("hour") * 4).cast("double"))
    path = scratch_path(spark, "models")
    boosting.save_models(boosting.fit_boosted_cascade(rows, FEATURES, n_estimators=20), path)
    out = _predicted(boosting.predict_boosted_cascade(boosting.load_models(rows, path), rows, FEATURES))
    return out.withColumn("time_window", F.col("time_window").cast("double"))


@query("m4_random_search")
def _(spark, sf):
    rows = boosting.cascade_halves(training_rows(spark, sf))
    return boosting.random_search(rows, FEATURES, SPACE, KEYS)


@query("m5_window_sweep")
def _(spark, sf):
    trips_, holidays, breaks = stored_trips(spark, sf), *bind(spark, sf, "holidays", "school_breaks")

    def rows_for(minutes):
        return models.prepare_classes(stage(build_route_windows(trips_, holidays, breaks, minutes), "sweep"))[0]

    out = models.window_sweep(rows_for, SWEEP, FEATURES, KEYS)
    return out.select("transit_date", "route_id_direction", "time_window", "time_window_param", "kfold", "y_true", "y_pred")


@query("m6_per_route_models")
def _(spark, sf):
    features = models.Features(tuple(c for c in FEATURES.categorical if c != "route_id_direction"), FEATURES.ordinal, FEATURES.numeric)
    ranges = {
        "train": ("2024-01-01", "2024-01-18"),
        "val": ("2024-01-18", "2024-01-24"),
        "test": ("2024-01-24", "2024-01-31"),
    }
    rows = stage(_classed_rows(spark, sf), "classed")
    return _predicted(models.per_route_models(rows, features, ranges))


@query("m7_save_load")
def _(spark, sf):
    rows = training_rows(spark, sf)
    path = scratch_path(spark, "cascade")
    models.fit_cascade(rows, FEATURES).save(path)
    return _predicted(models.predict_cascade(models.Cascade.load(path, FEATURES), rows))


def _completed(windows: str, day: str, weather_day: str, extra: str, shown: str) -> str:
    """Weather of the hour, mean speed, calendar columns and backfill over a CTE of (route, window) rows."""
    gaps = ["temperature", "humidity", "precipitation_intensity", "scheduled_headway", "traffic_speed"]
    gaps += [c for c in extra.split(", ") if c]
    filled = ", ".join(
        r(f"first_value({c} IGNORE NULLS) OVER (ORDER BY route_id_direction, time_window "
          f"ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)", c)
        for c in gaps
    )
    return f"""
, clim AS (SELECT route_id_direction, time_window, avg(traffic_speed) AS traffic_speed FROM trip_speed GROUP BY ALL)
, complete AS (SELECT w.*, h.darksky_temperature AS temperature, h.darksky_humidity AS humidity,
    h.darksky_precipitation_intensity AS precipitation_intensity, c.traffic_speed
  FROM {windows} w JOIN hourly h ON h.hour = CAST(floor(w.time_window / 2) AS INTEGER)
    AND make_date(CAST(h.year AS INTEGER), CAST(h.month AS INTEGER), CAST(h.day AS INTEGER)) = {weather_day}
  JOIN clim c ON c.route_id_direction = w.route_id_direction AND c.time_window = w.time_window)
SELECT route_id_direction, CAST(time_window AS DOUBLE) AS time_window, CAST(floor(time_window / 2) AS INTEGER) AS hour,
  CAST(epoch_us(CAST({shown} AS TIMESTAMP)) + CAST(time_window AS BIGINT) * 1800000000 AS BIGINT) AS arrival_time,
  {d(shown, 'transit_date')}, CAST(year({shown}) AS INTEGER) AS year, CAST(month({shown}) AS INTEGER) AS month,
  CAST(day({shown}) AS INTEGER) AS day, dayofweek({shown}) + 1 AS dayofweek,
  CASE WHEN {shown} IN (SELECT cal_date FROM holidays) THEN 1 ELSE 0 END AS is_holiday,
  CASE WHEN {shown} IN (SELECT cal_date FROM school_breaks) THEN 1 ELSE 0 END AS is_school_break, {filled}
FROM complete"""


def _any_day(shown: str) -> str:
    return f"""{STOPS}
, hist AS (SELECT * FROM stops WHERE transit_date BETWEEN DATE '2024-01-01' AND DATE '2024-01-30'
    AND dayofweek(transit_date) = dayofweek(DATE '2024-02-06'))
{trips('hist')}
, windows AS (SELECT route_id_direction, time_window, max(scheduled_headway) AS scheduled_headway FROM trips GROUP BY ALL)
{_completed('windows', "DATE '2024-02-06'", "DATE '2024-01-29'", '', shown)}"""


def _prediction_sides(spark, sf):
    weather, speed, holidays, breaks = bind(spark, sf, "weather_raw", "trip_speed", "holidays", "school_breaks")
    return weather_hourly(weather, WEATHER_VALUES, "time_utc"), speed, holidays, breaks


def _register_any_day(name: str, compat: bool, shown: str) -> None:
    @query(name, f"{NEEDS} trip_speed", _any_day(shown))
    def _(spark, sf):
        return prediction.any_day_input(
            stops(spark, sf),
            *_prediction_sides(spark, sf),
            day=date(2024, 2, 6),
            history=(date(2024, 1, 1), date(2024, 1, 30)),
            weather_last=date(2024, 1, 29),
            compat=compat,
        )


_register_any_day("m8_any_day_input", False, "DATE '2024-02-06'")
_register_any_day("m8_any_day_input_compat", True, "DATE '2024-01-29'")


@query(
    "m9_day_ahead_input",
    f"{NEEDS} trip_speed",
    f"""{STOPS}
, hist AS (SELECT * FROM stops WHERE transit_date BETWEEN DATE '2024-01-19' AND DATE '2024-01-25')
{trips('hist')}{past_features('global', 5)}
, windows AS (SELECT route_id_direction, time_window, max(scheduled_headway) AS scheduled_headway,
    max(load_pct_change) AS load_pct_change, max(act_headway_pct_change) AS act_headway_pct_change,
    max(avg_past_act_headway) AS avg_past_act_headway, max(avg_past_trips_loads) AS avg_past_trips_loads FROM past
  WHERE load_pct_change IS NOT NULL AND NOT isinf(load_pct_change) AND act_headway_pct_change IS NOT NULL
    AND avg_past_act_headway IS NOT NULL AND avg_past_trips_loads IS NOT NULL AND humidity IS NOT NULL
    AND precipitation_intensity IS NOT NULL AND hour IS NOT NULL AND actual_headways IS NOT NULL
  GROUP BY ALL)
{_completed('windows', "DATE '2024-01-26'", "DATE '2024-01-26'",
            'load_pct_change, act_headway_pct_change, avg_past_act_headway, avg_past_trips_loads', "DATE '2024-01-26'")}""",
)
def _(spark, sf):
    return prediction.day_ahead_input(
        stops(spark, sf), *_prediction_sides(spark, sf), day=date(2024, 1, 26), weather_last=date(2024, 1, 29)
    )

