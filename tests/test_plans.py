"""What the physical plans must and must not hold."""

import re

from conftest import SMALL
from oracle import plan_of
from pyspark.sql import functions as F

from ridership.operators import clean, headway, metrics, ordered
from ridership.registry import QUERIES
from ridership.sources.bindings import bind

def test_cleaning_is_an_anti_join(spark):
    ev = bind(spark, SMALL, "stop_events")
    plan = plan_of(clean.drop_groups_with_any(ev, clean.TRIP, clean.bad_load()))
    assert "LeftAnti" in plan


def test_scan_reads_only_needed_columns(spark):
    spark.read.parquet(f"{SMALL}/lineitem.parquet").createOrReplaceTempView("lineitem")
    plan = plan_of(QUERIES["n9_class_counts"](spark, SMALL))
    schema = re.search(r"ReadSchema: struct<([^>]*)>", plan).group(1)
    assert set(re.findall(r"(\w+):", schema)) == {"l_orderkey", "l_quantity"}


def test_filter_reaches_the_scan(spark):
    events = spark.read.parquet(f"{SMALL}/events.parquet").filter("event_id > 100 AND event_type = 'view'")
    assert "PushedFilters: [IsNotNull(event_id), IsNotNull(event_type), GreaterThan(event_id,100)" in plan_of(events)
    plan = plan_of(QUERIES["d1_weather_hourly"](spark, SMALL))
    assert "EqualTo(event_type,view)" in plan


def test_top_k_limits_before_the_shuffle(spark):
    ev = bind(spark, SMALL, "stop_events")
    plan = plan_of(ordered.top_k(ev, ["route_id"], [F.col("event_id")], 3))
    assert plan.index("WindowGroupLimit") < plan.index("Exchange") < plan.rindex("WindowGroupLimit")


def test_no_extra_rows_without_a_large_group(spark):
    """The branch of the cut groups is found empty at run time."""
    out = headway.scheduled_headway(bind(spark, SMALL, "stop_events"), ["event_id"])
    out.collect()
    final = plan_of(out).split("== Initial Plan ==")[0]
    assert "WindowGroupLimit" not in final and "explode" not in final.lower()


def test_windows_have_partitions(spark):
    ev = bind(spark, SMALL, "stop_events")
    plan = plan_of(headway.actual_headway(ev, ["event_id"]))
    assert "Exchange SinglePartition" not in plan


def test_sweep_reads_stops_once_per_side(spark):
    diffs = metrics.count_discrepancy(
        bind(spark, SMALL, "manual_checks").withColumns({f"apc_{c}": F.col(c) for c in ("load", "ons", "offs")})
    )
    plan = plan_of(metrics.threshold_sweep(diffs))
    # one pass for the error counts of all settings, one for the most common remark
    assert plan.count("FileScan") == 2
