"""A1-A9."""

from pyspark.sql import functions as F

from ridership.operators.basic import rename_all
from ridership.registry.base import d, query, r
from ridership.session import configure, scratch_path
from ridership.sources import io
from ridership.sources.bindings import bind


@query(
    "a1_read_table",
    sql=f"SELECT event_type, count(*) AS n, {r('sum(value)', 'total')} FROM events GROUP BY event_type",
)
def _(spark, sf):
    configure(spark)
    events = io.read_table(spark, f"{sf}/events.parquet")
    return events.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


@query(
    "a2_read_csv",
    "disruptions",
    f"""SELECT disruption_id, {d('CAST(disruption_ts AS DATE)', 'disruption_date')},
      CAST(epoch_us(date_trunc('second', disruption_ts)) AS BIGINT) AS disruption_ts, block_abbr, reason,
      CASE WHEN block_abbr = 3 THEN NULL ELSE CAST(CAST(disruption_ts AS DATE) AS VARCHAR) END AS checked
    FROM disruptions""",
)
def _(spark, sf):
    src = bind(spark, sf, "disruptions")
    path = scratch_path(spark, "disruptions_csv")
    # some dates are no dates, as in a hand-kept log
    io.write_csv(
        src.select(
            "disruption_id",
            F.date_format("disruption_ts", "MM/dd/yy").alias("date"),
            F.date_format("disruption_ts", "MM/dd/yy HH:mm:ss").alias("time"),
            "block_abbr",
            "reason",
            F.when(F.col("block_abbr") == 3, "not a date")
            .otherwise(F.date_format("disruption_ts", "yyyyMMdd"))
            .alias("checked"),
        ),
        path,
    )
    back = io.read_csv(
        spark,
        path,
        "DISRUPTION_ID BIGINT, DATE STRING, TIME STRING, BLOCK_ABBR BIGINT, REASON STRING, CHECKED STRING",
        date_cols={"DATE": "MM/dd/yy", "CHECKED": "yyyyMMdd"},
        ts_cols={"TIME": "MM/dd/yy HH:mm:ss"},
    )
    return rename_all(back, str.lower).withColumnsRenamed({"date": "disruption_date", "time": "disruption_ts"})


@query(
    "a3_read_json_records",
    "weather_raw",
    f"""SELECT CAST(floor(epoch(time_utc)) AS BIGINT) AS time, {r('temperature', 'temperature')},
      {r('humidity', 'humidity')}, {r('precipitation_intensity', 'precipitation_intensity')} FROM weather_raw""",
)
def _(spark, sf):
    raw = bind(spark, sf, "weather_raw")
    path = scratch_path(spark, "weather_json")
    raw.select(
        F.unix_seconds(F.col("time_utc").cast("timestamp")).alias("time"),
        "temperature",
        "humidity",
        "precipitation_intensity",
    ).write.json(path)
    return io.read_json_records(
        spark, path, "time BIGINT, temperature DOUBLE, humidity DOUBLE, precipitation_intensity DOUBLE"
    )


@query(
    "a4_write_partitioned",
    "scored",
    f"""SELECT CAST(year(transit_date) AS INTEGER) AS year, CAST(month(transit_date) AS INTEGER) AS month,
      count(*) AS n, {r('sum(load)', 'total')} FROM scored GROUP BY ALL""",
)
def _(spark, sf):
    scored = bind(spark, sf, "scored")
    path = scratch_path(spark, "scored_by_month")
    dated = scored.withColumns({"year": F.year("transit_date"), "month": F.month("transit_date")})
    io.write_partitioned(dated, path)
    return spark.read.parquet(path).groupBy("year", "month").agg(F.count("*").alias("n"), F.sum("load").alias("total"))


@query(
    "a5_write_compressed",
    "stop_events",
    "SELECT stop_id, count(*) AS n, CAST(sum(load) AS BIGINT) AS total FROM stop_events GROUP BY stop_id",
)
def _(spark, sf):
    path = scratch_path(spark, "stop_events_gz")
    io.write_compressed(bind(spark, sf, "stop_events"), path)
    return spark.read.parquet(path).groupBy("stop_id").agg(F.count("*").alias("n"), F.sum("load").alias("total"))


@query(
    "a6_write_csv",
    "manual_checks",
    """SELECT strftime(transit_date, '%Y%m%d') AS "TRANSIT_DATE", stop_id AS "STOP_ID", count(*) AS n,
      CAST(sum(load) AS BIGINT) AS total FROM manual_checks GROUP BY ALL""",
)
def _(spark, sf):
    path = scratch_path(spark, "manual_csv")
    checks = bind(spark, sf, "manual_checks").select("transit_date", "trip_id", "stop_id", "load", "ons", "offs")
    io.write_csv(checks, path, {"transit_date": "yyyyMMdd"})
    back = io.read_csv(
        spark,
        path,
        "TRANSIT_DATE STRING, TRIP_ID BIGINT, STOP_ID STRING, LOAD INT, ONS INT, OFFS INT",
    )
    return back.groupBy("TRANSIT_DATE", "STOP_ID").agg(F.count("*").alias("n"), F.sum("LOAD").alias("total"))


@query(
    "a7_materialize",
    "stop_events",
    f"SELECT {d('transit_date')}, count(*) AS n, CAST(max(load) AS INTEGER) AS peak FROM stop_events GROUP BY transit_date",
)
def _(spark, sf):
    path = scratch_path(spark, "daily")

    def build():
        return (
            bind(spark, sf, "stop_events")
            .groupBy("transit_date")
            .agg(F.count("*").alias("n"), F.max("load").alias("peak"))
        )

    io.materialize(spark, path, build)
    return io.materialize(spark, path, build)


@query(
    "a8_sql",
    "stop_events",
    f"""SELECT {d('transit_date')}, trip_id, count(stop_id) AS n, CAST(max(load) AS INTEGER) AS peak
    FROM stop_events WHERE load >= 0 GROUP BY transit_date, trip_id""",
)
def _(spark, sf):
    return io.sql(
        spark,
        {"apc": bind(spark, sf, "stop_events")},
        """SELECT transit_date, trip_id, count(stop_id) AS n, max(load) AS peak FROM apc
           WHERE load >= :lowest GROUP BY transit_date, trip_id""",
        {"lowest": 0},
    )


@query(
    "a9_from_rows",
    "stop_events",
    """SELECT CASE stop_id WHEN 'click' THEN 10 WHEN 'view' THEN 20 WHEN 'error' THEN 30 ELSE 40 END AS zone, count(*) AS n
    FROM stop_events GROUP BY ALL""",
)
def _(spark, sf):
    rows = [("click", "10"), ("view", "20"), ("error", "30"), ("purchase", "40"), ("signup", "40")]
    zones = io.from_rows(spark, rows, ["stop_id", "zone"], {"zone": "int"})
    return bind(spark, sf, "stop_events").join(zones, "stop_id").groupBy("zone").agg(F.count("*").alias("n"))


