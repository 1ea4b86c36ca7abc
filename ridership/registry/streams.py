"""The stop events delivered day by day as a stream, run to its end."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridership.operators.basic import route_direction_key
from ridership.registry.base import ROUTE, query, r, sec
from ridership.session import scratch_path
from ridership.sources.bindings import bind
from ridership.streaming import live, replay

DAYS = 5  # of a delivery; events keep no order within one, so the delay is as long
LATE_DAYS = 20  # one event in 97 comes this much later, which is too late


def _delivered(events: DataFrame, name: str) -> DataFrame:
    """The events as a stream, and after them one far in the future, which closes what is open."""
    day = F.unix_date("transit_date") + F.when((F.col("event_id") % 97 == 0) & F.col("_early"), LATE_DAYS).otherwise(0)
    last = events.agg(F.max("transit_date")).scalar()
    events = events.withColumn("_early", F.col("transit_date") < F.date_sub(last, LATE_DAYS))
    path, parts = replay.deliver_by(events, day, DAYS, name)
    later = F.expr("INTERVAL 400 DAYS")
    end = events.orderBy(F.desc("event_id")).limit(1)
    end = end.withColumns({"event_id": F.lit(-1).cast(events.schema["event_id"].dataType), "route_id": F.lit(-1).cast(events.schema["route_id"].dataType)})
    end = end.withColumns({c: F.coalesce(F.col(c), F.col("scheduled_time")) + later for c in ("arrival_time", "scheduled_time", "departure_time")})
    replay.deliver(end, path, parts)
    return replay.watch(events, path, files=1)


_ON_TIME = f"""
, on_time AS (SELECT * FROM stop_events
  WHERE NOT (event_id % 97 = 0 AND transit_date < (SELECT max(transit_date) FROM stop_events) - {LATE_DAYS}))"""


@query(
    "s1_live_stop_windows",
    "stop_events",
    f"""{_ON_TIME}
    SELECT CAST(epoch_us(time_bucket(INTERVAL 15 MINUTE, arrival_time)) AS BIGINT) AS window_start, {ROUTE} AS route_id_direction, stop_id,
      count(*) AS n_events, CAST(sum(load) AS DOUBLE) AS load, CAST(max(load) AS DOUBLE) AS max_load, {r('avg(load)', 'mean_load')},
      CAST(last(vehicle_id ORDER BY arrival_time, event_id) FILTER (WHERE vehicle_id IS NOT NULL) AS DOUBLE) AS last_vehicle
    FROM on_time WHERE arrival_time IS NOT NULL GROUP BY ALL""",
)
def _(spark, sf):
    events = route_direction_key(bind(spark, sf, "stop_events"))
    stream = live.live_stop_windows(_delivered(events, "s1_events"), delay=f"{DAYS} days")
    out = replay.run_available(stream, scratch_path(spark, "s1")).table
    return out.withColumns({c: F.col(c).cast("double") for c in ("load", "max_load", "last_vehicle")})


@query(
    "s2_live_headways",
    "stop_events",
    f"""{_ON_TIME}
    , headways AS (SELECT event_id,
        {sec('scheduled_time')} - lag({sec('scheduled_time')}) OVER (PARTITION BY transit_date, route_id, route_direction_name, stop_id
          ORDER BY scheduled_time, event_id) AS sched_hdwy,
        {sec('departure_time')} - lag({sec('departure_time')}) OVER (PARTITION BY transit_date, route_id, route_direction_name, stop_id
          ORDER BY departure_time, event_id) AS actual_hdwy FROM on_time)
    , ratios AS (SELECT *, CASE WHEN sched_hdwy <> 0 THEN actual_hdwy / sched_hdwy END AS q FROM headways)
    SELECT event_id, CAST(sched_hdwy AS DOUBLE) AS sched_hdwy, CAST(actual_hdwy AS DOUBLE) AS actual_hdwy,
      CASE WHEN actual_hdwy > sched_hdwy AND q >= 1.5 THEN 1 ELSE 0 END AS is_gapped,
      CASE WHEN actual_hdwy < sched_hdwy AND q BETWEEN 0 AND 0.5 THEN 1 ELSE 0 END AS is_bunched,
      CASE WHEN q > 0.5 AND q < 1.5 THEN 1 ELSE 0 END AS is_target FROM ratios""",
)
def _(spark, sf):
    stream = live.live_headways(_delivered(bind(spark, sf, "stop_events"), "s2_events"), delay=f"{DAYS} days")
    out = replay.run_available(stream, scratch_path(spark, "s2")).table.drop("scheduled_time", "departure_time")
    return out.withColumns({c: F.col(c).cast("double") for c in ("sched_hdwy", "actual_hdwy")})
