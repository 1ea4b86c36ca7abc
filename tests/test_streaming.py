"""Live windows and headways: restarts, order of arrival, late rows, state that goes."""

import random
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from ridership.operators import headway
from ridership.session import scratch_path
from ridership.streaming import live, replay

START = datetime(2024, 1, 1, 6)
SCHEMA = "event_id long, transit_date date, route_id long, route_direction_name string, stop_id string, vehicle_id long, load int, scheduled_time timestamp, departure_time timestamp, arrival_time timestamp"


def events(n, seed=1):
    """``n`` stop events in the order of their departures; half of them at one stop."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        t = START + timedelta(seconds=60 * i + rng.randrange(50))
        stop = "hot" if i % 2 else f"s{i % 5}"
        out.append((i, t.date(), 1, "TO", stop, i % 7 if i % 5 else None, None if i % 11 == 0 else i % 30, t + timedelta(seconds=rng.randrange(-200, 200)), t, t))
    return out


def delivered(spark, parts):
    path = scratch_path(spark, "deliveries")
    for k, rows in enumerate(parts):
        replay.deliver(spark.createDataFrame(rows, SCHEMA).coalesce(1), path, k)
    return path


def closing(days=30):
    t = START + timedelta(days=days)
    return (-1, t.date(), -1, "TO", "none", None, None, t, t, t)


def gaps(df):
    return sorted((r.event_id, r.sched_hdwy, r.actual_hdwy, r.is_gapped, r.is_bunched, r.is_target) for r in df.collect())


def batch_gaps(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return gaps(headway.headway_flags(headway.actual_headway(headway.scheduled_headway(df, ["event_id"]), ["event_id"])))


def test_headways_across_a_restart_and_out_of_order(spark):
    rows = events(240)
    # within the delay, events come in any order
    mixed = sorted(rows, key=lambda r: (r[0] // 20, random.Random(r[0]).random()))
    parts = [mixed[i : i + 40] for i in range(0, 240, 40)]
    path, out = delivered(spark, parts[:3]), scratch_path(spark, "out")
    like = spark.createDataFrame([], SCHEMA)
    first = replay.run_available(live.live_headways(replay.watch(like, path, 1), "40 minutes"), out)
    answered = first.table.count()
    assert 0 < answered < 120 and first.batches >= 3
    for k, part in enumerate([*parts[3:], [closing()]], 3):
        replay.deliver(spark.createDataFrame(part, SCHEMA).coalesce(1), path, k)
    second = replay.run_available(live.live_headways(replay.watch(like, path, 1), "40 minutes"), out)
    assert gaps(second.table) == batch_gaps(spark, rows)
    assert (first.late, second.late) == (0, 0)


def test_late_events_are_left_out_and_counted(spark):
    rows = events(120)
    late = [r for r in rows if r[0] in (3, 4, 10, 31)]
    kept = [r for r in rows if r not in late]
    path = delivered(spark, [kept[:60], kept[60:], late, [closing()]])
    run = replay.run_available(live.live_headways(replay.watch(spark.createDataFrame([], SCHEMA), path, 1)), scratch_path(spark, "out"))
    assert gaps(run.table) == batch_gaps(spark, kept)
    assert run.late == 4


def test_forgotten_stops_start_anew(spark):
    a = [r for r in events(12) if r[4] == "hot"]
    later = [(100 + r[0], r[1], *r[2:7], *[t + timedelta(hours=5) for t in r[7:]]) for r in a]
    path = delivered(spark, [a, [closing(days=0)[:7] + (START + timedelta(hours=4),) * 3], later, [closing()]])
    like = spark.createDataFrame([], SCHEMA)
    run = replay.run_available(live.live_headways(replay.watch(like, path, 1), forget=3600), scratch_path(spark, "out"))
    first = min(later, key=lambda r: r[8])
    got = {r.event_id: r.actual_hdwy for r in run.table.filter("event_id >= 100").collect()}
    assert len(got) == len(later) and got[first[0]] is None and sum(v is None for v in got.values()) == 1


def test_windows_close_with_the_watermark(spark):
    rows = events(90)
    late = [r for r in rows if r[0] in (2, 3)]
    kept = [r for r in rows if r not in late]
    path, out = delivered(spark, [kept[:50], kept[50:], late, [closing()]]), scratch_path(spark, "out")
    stream = replay.watch(spark.createDataFrame([], SCHEMA), path, 1)
    run = replay.run_available(live.live_stop_windows(stream, keys=("route_id", "stop_id")), out)
    assert run.late == 2
    got = {(r.window_start, r.stop_id): (r.n_events, r.load, r.max_load, r.last_vehicle) for r in run.table.collect()}
    want = {}
    for r in kept:
        start = r[9].replace(minute=r[9].minute // 15 * 15, second=0, microsecond=0)
        want.setdefault((start, r[4]), []).append(r)
    loads = lambda g: [r[6] for r in g if r[6] is not None]
    last = lambda g: max(((r[9], r[5]) for r in g if r[5] is not None), default=(0, None))[1]
    assert {(k[0].replace(tzinfo=None), k[1]): v for k, v in got.items()} == {
        k: (len(g), sum(loads(g)) if loads(g) else None, max(loads(g), default=None), last(g)) for k, g in want.items()
    }


def test_deliveries_keep_their_order_and_all_rows(spark):
    df = spark.range(100).withColumn("day", F.when(F.col("id") % 10 < 9, (F.col("id") % 9).cast("int")))
    path, parts = replay.deliver_by(df, F.col("day"), 4, "days")
    assert parts == 3
    of = [{r.day for r in spark.read.parquet(f"{path}/part-{k:06d}").collect()} for k in range(parts)]
    assert of == [{0, 1, 2, 3, None}, {4, 5, 6, 7}, {8}]


@pytest.mark.parametrize("make", [live.live_headways, lambda s: live.live_stop_windows(s, keys=("route_id", "stop_id"))])
def test_empty_stream(spark, make):
    path = delivered(spark, [[]])
    assert replay.run_available(make(replay.watch(spark.createDataFrame([], SCHEMA), path, 1)), scratch_path(spark, "out")).table.count() == 0


def test_a_batch_sets_few_timers():
    """However many events wait at a stop, one timer brings them up and one forgets the stop."""

    class Kept:
        def __init__(self):
            self.value = None

        def get(self):
            return self.value

        def update(self, value):
            self.value = value

        put = update

        def appendList(self, rows):  # noqa: N802
            self.value = [*(self.value or []), *rows]

        def exists(self):
            return bool(self.value)

        def clear(self):
            self.value = None

    class Handle:
        def __init__(self):
            self.timers = []

        def getListState(self, *_):  # noqa: N802
            return Kept()

        getValueState = getListState

        def registerTimer(self, at):  # noqa: N802
            self.timers.append(at)

    class Times:
        def __init__(self, at):
            self.at = at

        def getCurrentWatermarkInMs(self):  # noqa: N802
            return self.at

    stop = live.Headways("event_id", 3600)
    stop.init(handle := Handle())
    part = pd.DataFrame({"event_id": range(1000), "scheduled_us": [i * 1_000_000 for i in range(1000)], "departure_us": [i * 1_000_000 for i in range(1000)]})
    list(stop.handleInputRows((1,), iter([part]), None))
    assert len(handle.timers) <= 2 and min(handle.timers) == 1
    (first,) = stop.handleExpiredTimer((1,), Times(499_000), None)
    assert first["event_id"].tolist() == list(range(500)) and min(handle.timers[2:]) == 500_001
    # rows that come at the same watermark wait for the next
    list(stop.handleInputRows((1,), iter([part.tail(1)]), None))
    (none,) = stop.handleExpiredTimer((1,), Times(499_000), None)
    assert len(none) == 0 and handle.timers[-1] == 499_001
    (rest,) = stop.handleExpiredTimer((1,), Times(2_000_000), None)
    assert len(rest) == 501
