"""B1-B11 and C1-C11."""

from pyspark.sql import functions as F

from ridership.functions.times import calendar_parts
from ridership.operators import basic, clean
from ridership.registry.base import EV, ROUTE, cleaned, d, query, r
from ridership.sources.bindings import bind


@query(
    "b1_select_rename",
    "stop_events",
    """SELECT event_id AS "EVENT_ID", trip_id AS "TRIP_ID", stop_id AS "STOP_ID", load AS apc_load FROM stop_events""",
)
def _(spark, sf):
    df = basic.select_cols(bind(spark, sf, "stop_events"), ["event_id", "trip_id", "stop_id", "load", "ons"])
    df = basic.drop_if_present(df, ["ons", "not_there"])
    df = basic.rename_all(df, lambda c: f"apc_{c}", only=["load"])
    return basic.rename_all(df, str.upper, only=["event_id", "trip_id", "stop_id"])


_RANGE = """SELECT event_id, {d} FROM stop_events WHERE transit_date {lo} DATE '2024-01-08'
    AND transit_date {hi} DATE '2024-01-15'"""


def _register_range(closed: str, lo: str, hi: str) -> None:
    @query(f"b2_between_dates_{closed}", "stop_events", _RANGE.format(d=d("transit_date"), lo=lo, hi=hi))
    def _(spark, sf):
        ev = bind(spark, sf, "stop_events")
        return basic.between_dates(ev, "transit_date", "2024-01-08", "2024-01-15", closed).select(
            "event_id", "transit_date"
        )


for _closed, _lo, _hi in [("both", ">=", "<="), ("left", ">=", "<"), ("neither", ">", "<")]:
    _register_range(_closed, _lo, _hi)


@query(
    "b3_same_weekday",
    "stop_events",
    f"""SELECT event_id, {d('transit_date')}, (dayofweek(transit_date) + 6) % 7 AS monday_zero,
      dayofweek(transit_date) + 1 AS weekday FROM stop_events
    WHERE transit_date BETWEEN DATE '2024-01-03' AND DATE '2024-01-28'
      AND dayofweek(transit_date) = dayofweek(DATE '2024-02-06')""",
)
def _(spark, sf):
    ev = basic.same_weekday(bind(spark, sf, "stop_events"), "2024-02-06", "2024-01-03", "2024-01-28")
    ev = ev.withColumn("monday_zero", F.weekday("transit_date"))
    return ev.select(
        "event_id", "transit_date", "monday_zero", basic.spark_weekday("monday_zero").alias("weekday")
    )


@query(
    "b4_drop_nulls",
    "stop_events",
    """SELECT event_id, load, CAST(epoch_us(arrival_time) AS BIGINT) AS arrival_time, vehicle_id
    FROM stop_events WHERE load IS NOT NULL AND arrival_time IS NOT NULL""",
)
def _(spark, sf):
    ev = bind(spark, sf, "stop_events").select("event_id", "load", "arrival_time", "vehicle_id")
    ev = basic.drop_nulls(ev, ["load", "vehicle_id", "arrival_time"], how="all")
    return basic.drop_nulls(ev, ["load", "arrival_time"])


@query(
    "b4_drop_nonfinite",
    "stop_events",
    f"SELECT event_id, {r('ons / offs', 'ratio')} FROM stop_events WHERE offs <> 0",
)
def _(spark, sf):
    ratio = F.when((F.col("offs") == 0) & (F.col("ons") > 0), F.lit(float("inf"))).when(
        (F.col("offs") == 0), F.lit(float("nan"))
    )
    ev = bind(spark, sf, "stop_events").withColumn("ratio", ratio.otherwise(F.try_divide("ons", "offs")))
    return basic.drop_nonfinite(ev, "ratio").select("event_id", "ratio")


@query(
    "b5_fill_nulls",
    "stop_events",
    """SELECT event_id, coalesce(load, 0) AS load, coalesce(vehicle_id, -1) AS vehicle_id,
      coalesce(CASE WHEN load > 20 THEN 'high' END, 'NULL') AS level FROM stop_events""",
)
def _(spark, sf):
    ev = bind(spark, sf, "stop_events").withColumn("level", F.when(F.col("load") > 20, "high"))
    return basic.fill_nulls(ev, {"load": 0, "vehicle_id": -1, "level": "NULL"}).select(
        "event_id", "load", "vehicle_id", "level"
    )


@query(
    "b6_clip",
    "stop_events",
    "SELECT event_id, CASE WHEN load < 0 THEN 0 WHEN load > 30 THEN 30 ELSE load END AS load FROM stop_events",
)
def _(spark, sf):
    return basic.clip(bind(spark, sf, "stop_events"), "load", 0, 30).select("event_id", "load")


@query(
    "b7_route_direction_key",
    "stop_events",
    f"SELECT {ROUTE} AS route_id_direction, count(*) AS n FROM stop_events GROUP BY ALL",
)
def _(spark, sf):
    keyed = basic.route_direction_key(bind(spark, sf, "stop_events"))
    return keyed.groupBy("route_id_direction").agg(F.count("*").alias("n"))


@query(
    "b8_date_extent",
    "stop_events",
    f"SELECT {d('min(transit_date)', 'earliest')}, {d('max(transit_date)', 'latest')} FROM stop_events",
)
def _(spark, sf):
    return basic.date_extent(bind(spark, sf, "stop_events"))


@query("b9_cap_target", "stop_events", "SELECT event_id, load FROM stop_events WHERE load <= 40")
def _(spark, sf):
    return basic.cap_target(bind(spark, sf, "stop_events"), "load", 40).select("event_id", "load")


@query("b9_cap_target_strict", "stop_events", "SELECT event_id, load FROM stop_events WHERE load < 40")
def _(spark, sf):
    return basic.cap_target(bind(spark, sf, "stop_events"), "load", 40, strict=True).select("event_id", "load")


@query(
    "b10_normalise_nulls",
    "stop_events",
    """SELECT event_id, CASE WHEN vehicle_id IS NULL THEN NULL WHEN vehicle_id = 5 THEN NULL
      ELSE CAST(vehicle_id AS VARCHAR) END AS vehicle_id FROM stop_events""",
)
def _(spark, sf):
    vehicle = F.when(F.col("vehicle_id") == 5, "NULL").otherwise(F.col("vehicle_id").cast("string"))
    ev = bind(spark, sf, "stop_events").withColumn("vehicle_id", vehicle)
    return basic.normalise_nulls(ev, ["vehicle_id"]).select("event_id", "vehicle_id")


@query(
    "b11_exclude_values",
    "stop_events",
    "SELECT event_id, vehicle_id FROM stop_events WHERE vehicle_id NOT IN (3, 4) OR vehicle_id IS NULL",
)
def _(spark, sf):
    return basic.exclude_values(bind(spark, sf, "stop_events"), "vehicle_id", [3, 4]).select("event_id", "vehicle_id")


@query(
    "g6_sort_by",
    "stop_events",
    "SELECT trip_id, stop_sequence, load FROM stop_events ORDER BY trip_id, stop_sequence",
)
def _(spark, sf):
    return basic.sort_by(bind(spark, sf, "stop_events").select("trip_id", "stop_sequence", "load"), ["trip_id", "stop_sequence"])


_NO_BAD = """SELECT event_id, trip_id, load FROM stop_events e WHERE NOT EXISTS (
    SELECT 1 FROM stop_events b WHERE ({cond}) AND b.transit_date = e.transit_date AND b.trip_id = e.trip_id
      AND b.overload_id = e.overload_id)"""


@query(
    "c1_drop_groups_with_null",
    "stop_events",
    _NO_BAD.format(cond="b.ons IS NULL OR b.offs IS NULL OR b.load IS NULL"),
)
def _(spark, sf):
    kept = clean.drop_groups_with_any(bind(spark, sf, "stop_events"), clean.TRIP, clean.any_null("ons", "offs", "load"))
    return kept.select("event_id", "trip_id", "load")


@query("c2_drop_negative_load", "stop_events", _NO_BAD.format(cond="b.load < 0 OR b.load IS NULL"))
def _(spark, sf):
    kept = clean.drop_groups_with_any(bind(spark, sf, "stop_events"), clean.TRIP, clean.bad_load())
    return kept.select("event_id", "trip_id", "load")


@query(
    "c3_drop_short_groups",
    "stop_events",
    """SELECT event_id, trip_id FROM stop_events
    QUALIFY count(*) OVER (PARTITION BY transit_date, trip_id, overload_id) >= 4""",
)
def _(spark, sf):
    return clean.drop_short_groups(bind(spark, sf, "stop_events")).select("event_id", "trip_id")


_ALL_NULL = """, bad AS (SELECT DISTINCT transit_date, block_abbr FROM stop_events
    GROUP BY transit_date, trip_id, vehicle_id, overload_id, block_abbr
    HAVING sum(CASE WHEN arrival_time IS NULL THEN 1 ELSE 0 END) = count(*))"""


@query(
    "c4_drop_blocks_all_null",
    "stop_events",
    f"""{_ALL_NULL} SELECT event_id, block_abbr FROM stop_events e WHERE NOT EXISTS (SELECT 1 FROM bad b
      WHERE b.transit_date = e.transit_date AND b.block_abbr = e.block_abbr)""",
)
def _(spark, sf):
    return clean.drop_blocks_all_null(bind(spark, sf, "stop_events")).select("event_id", "block_abbr")


@query(
    "c5_quarantine",
    "stop_events",
    f"""{_ALL_NULL} SELECT event_id, block_abbr, 'arrival_times_null' AS remark FROM stop_events e
    WHERE EXISTS (SELECT 1 FROM bad b WHERE b.transit_date = e.transit_date AND b.block_abbr = e.block_abbr)""",
)
def _(spark, sf):
    ev = bind(spark, sf, "stop_events")
    return clean.quarantine(ev, clean.blocks_all_null(ev), "arrival_times_null").select("event_id", "block_abbr", "remark")


@query(
    "c6_drop_stops_null_arrival",
    "stop_events",
    """SELECT event_id, stop_id FROM stop_events e WHERE NOT EXISTS (SELECT 1 FROM stop_events b
      WHERE b.arrival_time IS NULL AND b.transit_date = e.transit_date AND b.trip_id = e.trip_id
        AND b.stop_id = e.stop_id)""",
)
def _(spark, sf):
    return clean.drop_stops_null_arrival(bind(spark, sf, "stop_events")).select("event_id", "stop_id")


@query(
    "c7_duplicate_stop_blocks",
    sql=f"""SELECT DISTINCT {d('CAST(l_shipdate AS DATE)', 'transit_date')}, l_suppkey AS block_abbr FROM (
      SELECT l_orderkey, min(l_suppkey) AS l_suppkey, min(l_shipdate) AS l_shipdate
      FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)""",
)
def _(spark, sf):
    # the block and date of a repeated key are its lowest, so that the key alone decides
    rows = bind(spark, sf, "lineitem")
    low = rows.groupBy("l_orderkey", "l_linenumber").agg(
        F.min("l_suppkey").alias("block_abbr"), F.min("l_shipdate").cast("date").alias("transit_date")
    )
    keyed = rows.select("l_orderkey", "l_linenumber").join(low, ["l_orderkey", "l_linenumber"])
    return clean.duplicate_stop_blocks(keyed, ["transit_date", "block_abbr", "l_orderkey", "l_linenumber"])


@query(
    "c8_null_vehicle_blocks",
    "stop_events",
    f"SELECT DISTINCT {d('transit_date')}, block_abbr FROM stop_events WHERE vehicle_id IS NULL",
)
def _(spark, sf):
    return clean.null_vehicle_blocks(bind(spark, sf, "stop_events"))


@query(
    "c9_drop_trips_missing",
    "stop_events",
    """SELECT event_id, trip_id FROM stop_events e WHERE NOT EXISTS (SELECT 1 FROM stop_events b
      WHERE (b.arrival_time IS NULL OR b.vehicle_id IS NULL) AND b.transit_date = e.transit_date
        AND b.trip_id = e.trip_id)""",
)
def _(spark, sf):
    kept = clean.drop_trips_missing(bind(spark, sf, "stop_events"), ["arrival_time", "vehicle_id"])
    return kept.select("event_id", "trip_id")


@query(
    "c10_drop_terminal_stop",
    "stop_events",
    """SELECT event_id, block_abbr, stop_sequence FROM stop_events
    QUALIFY stop_sequence <> max(stop_sequence) OVER (PARTITION BY block_abbr)""",
)
def _(spark, sf):
    return clean.drop_terminal_stop(bind(spark, sf, "stop_events")).select("event_id", "block_abbr", "stop_sequence")


@query(
    "c11_dedup_keep_first",
    "stop_events",
    f"""SELECT {d('transit_date')}, trip_id, stop_id, event_id, load FROM stop_events
    QUALIFY row_number() OVER (PARTITION BY transit_date, trip_id, stop_id ORDER BY scheduled_time, event_id) = 1""",
)
def _(spark, sf):
    ev = bind(spark, sf, "stop_events")
    first = clean.dedup_keep_first(ev, ["transit_date", "trip_id", "stop_id"], ["scheduled_time", "event_id"])
    return first.select("transit_date", "trip_id", "stop_id", "event_id", "load")


@query(
    "c_cleaning_chain",
    "stop_events",
    f"{cleaned('stop_events')} SELECT event_id, {d('transit_date')}, trip_id, load FROM cleaned",
)
def _(spark, sf):
    return clean.remove_null_events(bind(spark, sf, "stop_events")).select("event_id", "transit_date", "trip_id", "load")


@query(
    "e1_calendar_parts",
    "stop_events",
    f"{EV} SELECT event_id, year, month, day, hour, dayofweek FROM ev",
)
def _(spark, sf):
    ev = calendar_parts(bind(spark, sf, "stop_events"))
    return ev.select("event_id", "year", "month", "day", "hour", "dayofweek")


