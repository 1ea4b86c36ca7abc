"""Lagged and rolling trip features."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from ridership.functions.times import time_window
from ridership.operators.basic import drop_nonfinite
from ridership.operators.ordered import PIECE_ROWS, SLOT, Along, cut_pieces, over_neighbours, running_last

ORDER = ("transit_date", "arrival_time", "route_id_direction", "block_abbr", "trip_id")


def scope_keys(scope: str) -> list[str]:
    """``route``: each route direction is its own series. ``global``: one series over the whole table."""
    return {"route": ["route_id_direction"], "global": []}[scope]


DAY_MICROS = 86_400_000_000


def trip_order(piece_rows: int = PIECE_ROWS) -> Along:
    """Trips by transit date, then arrival; an arrival after midnight counts as the end of its transit date."""
    midnight = F.unix_micros(F.col("transit_date").cast("timestamp"))
    since = F.coalesce(F.unix_micros(F.col("arrival_time").cast("timestamp")) - midnight, F.lit(0))
    return Along(ORDER, midnight + F.least(F.greatest(since, F.lit(0)), F.lit(DAY_MICROS - 1)), piece_rows)


def _relative_change(now: Column, then: Column) -> Column:
    infinite = F.signum(now.cast("double")) * F.lit(float("inf"))
    return F.when((then == 0) & (now != 0), infinite).otherwise(F.try_divide(now, then) - F.lit(1))


def _filled(df: DataFrame, cols: Sequence[str], scope: str, along: Along) -> DataFrame:
    """The latest non-NULL values, with the pieces left on the rows for the pass that follows."""
    pieces = cut_pieces(df, scope_keys(scope), along)
    return running_last(pieces, scope_keys(scope), along, {f"_f_{c}": F.col(c) for c in cols})


def _pct_exprs(cols: Mapping[str, str]) -> dict[str, Callable[[WindowSpec], Column]]:
    return {
        name: lambda w, c=c: _relative_change(F.lag(f"_f_{c}", 1).over(w), F.lag(f"_f_{c}", 2).over(w))
        for c, name in cols.items()
    }


def _quantile_exprs(cols: Mapping[str, str], n: int, q: float) -> dict[str, Callable[[WindowSpec], Column]]:
    return {
        name: lambda w, c=c: lower_quantile_of(F.collect_list(c).over(w.rowsBetween(-n, -1)), q)
        for c, name in cols.items()
    }


def lag_and_pct_change(
    df: DataFrame, cols: Mapping[str, str], scope: str = "route", along: Along | None = None
) -> DataFrame:
    """Relative change of the lagged column: the previous row against the one before it (G1).

    A NULL takes the latest value before it. A change from 0 is infinite, 0 to 0 is NULL. ``cols`` maps column -> new
    name.
    """
    along = along or trip_order()
    fills = [f"_f_{c}" for c in cols]
    filled = _filled(df, list(cols), scope, along)
    return over_neighbours(filled, scope_keys(scope), along, 2, _pct_exprs(cols), carry=fills).drop(SLOT, *fills)


def lower_quantile_of(values: Column, q: float) -> Column:
    at = F.floor((F.size(values) - F.lit(1)) * F.lit(q)).cast("int")
    return F.get(F.array_sort(values), at)


def rolling_lower_quantile(
    df: DataFrame,
    cols: Mapping[str, str],
    n: int,
    q: float = 0.95,
    scope: str = "route",
    along: Along | None = None,
) -> DataFrame:
    """Lower quantile of the ``n`` rows before each row, the row itself excluded; NULLs do not count."""
    along = along or trip_order()
    return over_neighbours(df, scope_keys(scope), along, n, _quantile_exprs(cols, n, q), carry=list(cols))


def past_features(
    df: DataFrame,
    past_trips: int,
    target: str = "y_reg100",
    scope: str = "route",
    along: Along | None = None,
) -> DataFrame:
    """G1 and G2 of load and headway in one pass over the ordered rows."""
    along = along or trip_order()
    changes = {target: "load_pct_change", "actual_headways": "act_headway_pct_change"}
    quantiles = {"actual_headways": "avg_past_act_headway", target: "avg_past_trips_loads"}
    fills = [f"_f_{c}" for c in changes]
    return over_neighbours(
        _filled(df, list(changes), scope, along),
        scope_keys(scope),
        along,
        max(2, past_trips),
        {**_pct_exprs(changes), **_quantile_exprs(quantiles, past_trips, 0.95)},
        carry=[*changes, *fills],
    ).drop(SLOT, *fills)


def add_window_and_day(df: DataFrame, minutes: int) -> DataFrame:
    return df.withColumns({"day": F.dayofmonth("transit_date"), "time_window": time_window("arrival_time", minutes)})


def trip_features(df: DataFrame, minutes: int = 30) -> DataFrame:
    """Time window and day of month, rows with any NULL dropped."""
    return add_window_and_day(df, minutes).na.drop()


def day_ahead_features(
    df: DataFrame,
    minutes: int = 30,
    past_trips: int = 20,
    target: str = "y_reg100",
    scope: str = "route",
    along: Along | None = None,
) -> DataFrame:
    """Window, percentage changes and rolling quantiles of load and headway."""
    out = add_window_and_day(df, minutes)
    out = past_features(out, past_trips, target, scope, along)
    out = out.drop("trip_id", "arrival_time", "actual_headways").na.drop()
    out = drop_nonfinite(out, "load_pct_change")
    headway = F.col("act_headway_pct_change")
    return out.withColumn("act_headway_pct_change", F.when(F.abs(headway) < F.lit(float("inf")), headway))
