"""Live stop windows (S1) and live headways with bunching flags (S2) over a stream of stop events.

Both drop what comes after the watermark and answer once, in append mode, when the watermark says that nothing more can
change an answer. So the rows are those of the batch operators over the rows that were not late, in whatever order and in
however many batches the events come, and across restarts.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ridership.functions.times import epoch_micros
from ridership.operators.headway import STOP, headway_flags

DELAY = "10 minutes"
FORGET_SECONDS = 2 * 24 * 3600


def live_stop_windows(stream: DataFrame, delay: str = DELAY, minutes: int = 15, time: str = "arrival_time", keys: Sequence[str] = ("route_id_direction", "stop_id")) -> DataFrame:
    """Load per tumbling window of ``minutes`` and ``keys``: window_start, n_events, load (sum), max_load, mean_load, last
    vehicle (S1).

    Sums are kept per window until the watermark passes its end; events of a window that has passed are dropped. A hot
    stop is a few partial sums per task. Rows without a time are left out; NULL loads count as events without a load.
    """
    w = F.window(time, f"{minutes} minutes")
    out = (
        stream.filter(F.col(time).isNotNull())
        .withColumn(time, F.col(time).cast("timestamp"))
        .withWatermark(time, delay)
        .groupBy(w.alias("_window"), *keys)
        .agg(
            F.count(F.lit(1)).alias("n_events"),
            F.sum(F.col("load").cast("long")).alias("load"),
            F.max("load").alias("max_load"),
            F.avg("load").alias("mean_load"),
            F.max(F.when(F.col("vehicle_id").isNotNull(), F.struct(time, "event_id", "vehicle_id")))["vehicle_id"].alias("last_vehicle"),
        )
    )
    return out.select(F.col("_window.start").alias("window_start"), *keys, "n_events", "load", "max_load", "mean_load", "last_vehicle")


class Headways(StatefulProcessor):
    """State of one stop: events whose gaps are not settled, and the last settled time in each of two orders.

    Times are microseconds. An event is settled in an order once the watermark has passed its time in it; it is answered
    once both are. One timer, at the first time that waits, brings all up that the watermark has passed and sets the next; one
    more, after ``forget`` quiet seconds, drops what is left.
    """

    WAITING = "event_id long, scheduled long, departure long, sched_hdwy long, actual_hdwy long, sched_done boolean, actual_done boolean"
    LAST = "scheduled long, departure long, settled long, latest long"

    def __init__(self, tie: str, forget: int):
        self.tie = tie
        self.forget = forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.WAITING)
        self.last = handle.getValueState("last", self.LAST)

    def handleInputRows(self, key: tuple[Any, ...], rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        new = [tuple(map(int, r)) for part in rows for r in part[[self.tie, "scheduled_us", "departure_us"]].itertuples(index=False)]
        if new:
            self.waiting.appendList([(*r, None, None, False, False) for r in new])
            scheduled, departure, settled, latest = self.last.get() or (None, None, None, None)
            times = {max(r[1:]) for r in new}
            latest = max(times | ({latest} if latest is not None else set()))
            self.last.update((scheduled, departure, settled, latest))
            self.handle.registerTimer(min(times) // 1000 + 1)
            self.handle.registerTimer(latest // 1000 + self.forget * 1000)
        yield pd.DataFrame()

    def _settle(self, rows: list[list], time: int, gap: int, done: int, to: int, before: int | None) -> int | None:
        """Gaps of the rows up to ``to`` in one order; the last time settled in it."""
        for r in sorted((r for r in rows if not r[done] and r[time] <= to), key=lambda r: (r[time], r[0])):
            # whole seconds of both times, as the batch operator takes them
            quiet = before is None or r[time] - before > self.forget * 1_000_000
            r[gap] = None if quiet else r[time] // 1_000_000 - before // 1_000_000
            r[done] = True
            before = r[time]
        return before

    def handleExpiredTimer(self, key: tuple[Any, ...], timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        to = timerValues.getCurrentWatermarkInMs() * 1000
        last = self.last.get()
        if last is None:
            yield pd.DataFrame()
            return
        scheduled, departure, settled, latest = last
        if settled is None or settled < to:
            rows = [list(r) for r in self.waiting.get()]
            scheduled = self._settle(rows, 1, 3, 5, to, scheduled)
            departure = self._settle(rows, 2, 4, 6, to, departure)
            whole = [r for r in rows if r[5] and r[6]]
            left = [tuple(r) for r in rows if not (r[5] and r[6])]
            if left:
                self.waiting.put(left)
                self.handle.registerTimer(min(max(r[1], r[2]) for r in left) // 1000 + 1)
            else:
                self.waiting.clear()
            self.last.update((scheduled, departure, to, latest))
            if not left and latest // 1000 + self.forget * 1000 <= to // 1000:
                self.last.clear()
            if whole:
                out = pd.DataFrame({"event_id": [r[0] for r in whole]})
                for name, i in (("scheduled", 1), ("departure", 2), ("sched_hdwy", 3), ("actual_hdwy", 4)):
                    out[name] = pd.array([r[i] for r in whole], dtype="Int64")
                yield out
                return
        elif self.waiting.exists():
            # what came since goes with the next watermark
            self.handle.registerTimer(to // 1000 + 1)
        yield pd.DataFrame()

    def close(self) -> None:
        pass


def live_headways(stream: DataFrame, delay: str = DELAY, tie: str = "event_id", keys: Sequence[str] = STOP, forget: int = FORGET_SECONDS) -> DataFrame:
    """Scheduled and actual headway of every stop event and its gapped, bunched and on-target flags.

    Event time is the earlier of the scheduled and the departure time, so that the watermark holds for both orders. A row
    goes out when the watermark has passed both its times: all events before it at its stop are known then, late ones
    excepted, which are left out and counted (``replay.late_rows``). State is a stop's events of the last ``delay`` and two
    times, and is gone ``forget`` seconds after its last event; a longer gap is none, whether the state still stood or not. Ties go by ``tie``, a whole number that names the event.
    Rows without one of the two times are left out.
    """
    both = stream.filter(F.col("scheduled_time").isNotNull() & F.col("departure_time").isNotNull())
    timed = both.select(
        *keys, F.col(tie).cast("long").alias(tie), F.least("scheduled_time", "departure_time").cast("timestamp").alias("event_time"),
        epoch_micros("scheduled_time").alias("scheduled_us"), epoch_micros("departure_time").alias("departure_us"),
    ).withWatermark("event_time", delay)
    out = timed.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=Headways(tie, forget),
        outputStructType="event_id long, scheduled long, departure long, sched_hdwy long, actual_hdwy long",
        outputMode="Append",
        timeMode="EventTime",
    )
    out = out.select(F.col("event_id").alias(tie), F.timestamp_micros("scheduled").alias("scheduled_time"), F.timestamp_micros("departure").alias("departure_time"), "sched_hdwy", "actual_hdwy")
    return headway_flags(out)
