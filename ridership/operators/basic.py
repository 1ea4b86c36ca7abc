"""Projection, filters and NULL handling."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def select_cols(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(*cols)


def drop_if_present(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.drop(*cols)


def rename_all(df: DataFrame, fn: Callable[[str], str], only: Sequence[str] | None = None) -> DataFrame:
    """Rename every column (or those in ``only``) through ``fn``, e.g. ``str.upper`` (B1)."""
    names = df.columns if only is None else only
    return df.withColumnsRenamed({c: fn(c) for c in names})


def between_dates(
    df: DataFrame,
    col: str,
    lo: date | str,
    hi: date | str,
    closed: str = "both",
    partition_cols: tuple[str, str] | None = None,
) -> DataFrame:
    """Rows in a date range (B2); ``closed`` is ``both``, ``left`` or ``neither``.

    ``partition_cols`` names the stored year and month columns, so the scan skips other folders too.
    """
    lo_c, hi_c = F.lit(str(lo)).cast("date"), F.lit(str(hi)).cast("date")
    c = F.col(col)
    above = c > lo_c if closed == "neither" else c >= lo_c
    below = c <= hi_c if closed == "both" else c < hi_c
    out = df.filter(above & below)
    if partition_cols:
        year, month = partition_cols
        (y0, m0), (y1, m1) = ((int(p) for p in str(d).split("-")[:2]) for d in (lo, hi))
        ym = F.col(year) * F.lit(12) + F.col(month)
        out = out.filter(F.col(year).between(y0, y1) & ym.between(y0 * 12 + m0, y1 * 12 + m1))
    return out


def same_weekday(df: DataFrame, target: date | str, lo: date | str, hi: date | str, col: str = "transit_date") -> DataFrame:
    """Rows of a closed range that fall on the weekday of ``target``."""
    dow = F.dayofweek(F.lit(str(target)).cast("date"))
    return between_dates(df, col, lo, hi).filter(F.dayofweek(col) == dow)


def spark_weekday(monday_zero: Column | str) -> Column:
    """Weekday counted from Monday = 0 to the numbering 1 = Sunday."""
    c = F.col(monday_zero) if isinstance(monday_zero, str) else monday_zero
    return (c + F.lit(1)) % F.lit(7) + F.lit(1)


def drop_nulls(df: DataFrame, cols: Sequence[str] | None = None, how: str = "any") -> DataFrame:
    return df.na.drop(how=how, subset=list(cols) if cols else None)


def drop_nonfinite(df: DataFrame, col: str) -> DataFrame:
    """Drop NULL, NaN and infinite values of a double column."""
    c = F.col(col)
    return df.filter(c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))


def fill_nulls(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    return df.na.fill(dict(values))


def clip(df: DataFrame, col: str, lo: float | None = None, hi: float | None = None) -> DataFrame:
    """Bound a column, NULL stays NULL."""
    c = F.col(col)
    out = c
    if lo is not None:
        out = F.when(c < F.lit(lo), F.lit(lo)).otherwise(out)
    if hi is not None:
        out = F.when(c > F.lit(hi), F.lit(hi)).otherwise(out)
    return df.withColumn(col, out.cast(df.schema[col].dataType))


def route_direction_key(
    df: DataFrame, route: str = "route_id", direction: str = "route_direction_name", name: str = "route_id_direction"
) -> DataFrame:
    """``route_direction`` text key; a NULL part is left out."""
    return df.withColumn(name, F.concat_ws("_", F.col(route).cast("string"), F.col(direction)))


def date_extent(df: DataFrame, col: str = "transit_date") -> DataFrame:
    return df.agg(F.min(col).alias("earliest"), F.max(col).alias("latest"))


def cap_target(df: DataFrame, col: str, maximum: float = 100, strict: bool = False) -> DataFrame:
    """Keep targets up to the maximum, or below it with ``strict``."""
    return df.filter(F.col(col) < F.lit(maximum) if strict else F.col(col) <= F.lit(maximum))


def normalise_nulls(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """The text "NULL" becomes NULL."""
    return df.withColumns({c: F.nullif(F.col(c), F.lit("NULL")) for c in cols})


def exclude_values(df: DataFrame, col: str, values: Sequence) -> DataFrame:
    """Drop the listed values, keep NULL."""
    return df.filter(F.col(col).isNull() | ~F.col(col).isin(list(values)))


def sort_by(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Ordered output (G6); windows carry their own order and need no sort before them."""
    return df.orderBy(*cols)
