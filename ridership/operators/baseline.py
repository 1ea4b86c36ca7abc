"""Look-back baselines (K1-K4)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ridership.functions.bins import LOAD_CLASSES, Bound, assign_class
from ridership.operators.ordered import PIECE_ROWS, Along, over_neighbours, top_k

LOOKBACK_WEEKS = (1, 2, 4)


def _lookbacks(
    df: DataFrame, days: Mapping[str, int], pct: float, target: str, keys: Sequence[str], date: str
) -> DataFrame:
    """Add a percentile per look-back: ``days`` maps the new column to its length.

    Rows are first counted per day and value, so the one window of a trip and route holds its days and values, not its
    rows; every look-back is a range of days in that window.
    """
    keys = list(keys)
    counted = df.groupBy(*keys, date, target).agg(F.count(F.lit(1)).alias("_n"))
    by_day = Window.partitionBy(*keys).orderBy(F.unix_date(date))
    cols = {
        name: F.percentile(target, pct / 100.0, F.col("_n")).over(by_day.rangeBetween(-n, -1)) for name, n in days.items()
    }
    # all values of a day have the same past
    past = counted.select(*keys, date, *[c.alias(name) for name, c in cols.items()]).dropDuplicates([*keys, date])
    return df.join(past, [*keys, date], "left").withColumns({n: F.coalesce(n, F.lit(-1.0)) for n in days})


def lookback_percentile(
    df: DataFrame,
    days: int,
    pct: float = 1.0,
    target: str = "y_reg100",
    keys: Sequence[str] = ("trip_id", "route_id_direction"),
    date: str = "transit_date",
    name: str = "y_pred",
) -> DataFrame:
    """Percentile of the target of the same trip and route over the ``days`` before the date, -1 if there is none (K1)."""
    return _lookbacks(df, {name: days}, pct, target, keys, date)


STOP_KEY = ("route_id_direction", "stop_sequence", "hour", "block_abbr", "dayofweek")


def recent_stop_max_mean(
    df: DataFrame,
    tie: Sequence[str],
    k: int = 10,
    keys: Sequence[str] = STOP_KEY,
    date: str = "transit_date",
    bounds: Sequence[Bound] = LOAD_CLASSES,
    compat: bool = False,
    piece_rows: int = PIECE_ROWS,
) -> DataFrame:
    """Maximum and mean of the last ``k`` loads of a stop, and their classes (K2).

    One row per key and date from the loads of earlier dates. With ``compat`` one row per key from its latest loads,
    whatever the date.
    """
    keys = list(keys)
    if compat:
        last = top_k(df, keys, [F.col(date).desc(), *[F.col(t).desc() for t in tie]], k)
        out = last.groupBy(*keys).agg(F.max("load").alias("max_load"), F.avg("load").alias("mean_load"))
    else:
        rows = df.select(*keys, date, *tie, "load", F.lit(1).alias("_row"))
        probes = df.select(*keys, date).distinct().withColumn("_row", F.lit(0))
        # every probe is followed by a row, so 2k entries hold at least k rows
        recent = over_neighbours(
            rows.unionByName(probes, allowMissingColumns=True),
            keys,
            Along([date, "_row", *tie], F.unix_date(date), piece_rows),
            2 * k,
            {"_loads": lambda w: F.collect_list(F.when(F.col("_row") == 1, F.struct("load"))).over(w.rowsBetween(-2 * k, -1))},
            carry=["load"],
        ).filter(F.col("_row") == 0)
        loads = F.slice(F.reverse("_loads"), 1, k)["load"]
        total = F.aggregate(F.array_compact(loads), F.lit(0.0), lambda a, x: a + x.cast("double"))
        out = recent.select(
            *keys,
            date,
            F.array_max(loads).alias("max_load"),
            F.try_divide(total, F.size(F.array_compact(loads))).alias("mean_load"),
        )
    return out.withColumns(
        {"y_pred_max": assign_class("max_load", bounds), "y_pred_mean": assign_class("mean_load", bounds)}
    )


def rolling_max_class(df: DataFrame, past: int, keys: Sequence[str], along: Along, cls: str = "y_class") -> DataFrame:
    """Highest class of the ``past`` rows before, from row ``past`` of the trip on, -1 before that (K3)."""
    return over_neighbours(
        df,
        keys,
        along,
        past,
        {
            "y_pred_roll": lambda w: F.when(
                F.count(F.lit(1)).over(w.rowsBetween(-past, -1)) == past, F.max(cls).over(w.rowsBetween(-past, -1))
            ).otherwise(F.lit(-1))
        },
        carry=[cls],
    )


def baseline_report(
    df: DataFrame,
    pct: float = 1.0,
    target: str = "y_reg100",
    bounds: Sequence[Bound] = LOAD_CLASSES,
    weeks: Sequence[int] = LOOKBACK_WEEKS,
    compat: bool = False,
) -> DataFrame:
    """True and predicted class per look-back, rows without a prediction dropped, tagged with ``past`` in weeks (K4).

    ``compat`` gives the longest look-back the smallest tag and the other way round.
    """
    tags = dict(zip(sorted(weeks), sorted(weeks, reverse=compat)))
    names = {n: f"_past{n}" for n in tags}
    keys = ("trip_id", "route_id_direction")
    scored = _lookbacks(df, {name: 7 * n for n, name in names.items()}, pct, target, keys, "transit_date")
    each = F.array(*[F.struct(F.col(names[n]).alias("y_pred"), F.lit(tag).alias("past")) for n, tag in tags.items()])
    return (
        scored.withColumn("_each", F.explode(each))
        .withColumns(
            {
                "y_pred": F.col("_each.y_pred"),
                "y_true": assign_class(target, bounds),
                "y_pred_class": assign_class("_each.y_pred", bounds),
                "past": F.col("_each.past"),
            }
        )
        .drop("_each", *names.values())
        .filter(F.col("y_pred_class").isNotNull())
    )
