"""Errors, rates and confusion counts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridership.operators.enrich import concat
from ridership.operators.ordered import top_k
from ridership.operators.rollup import mode_per_group, pivot_counts


def rmse_by_window(df: DataFrame, folds: Sequence[int], y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """Root mean squared error per time window, one column per fold."""
    err = F.sqrt(F.avg(F.pow((F.col(y) - F.col(p)).cast("double"), F.lit(2.0))))
    return df.groupBy("time_window").pivot("kfold", list(folds)).agg(err)


def mse_first_k(
    df: DataFrame, k: int | None, keys: Sequence[str], order: Sequence[str], y: str = "y_true", p: str = "y_pred"
) -> DataFrame:
    """Mean squared error of each trip over its first ``k`` steps, or all of them."""
    head = df if k is None else top_k(df, keys, [F.col(c) for c in order], k)
    return head.groupBy(*keys).agg(F.avg(F.pow((F.col(y) - F.col(p)).cast("double"), F.lit(2.0))).alias("mse"))


def abs_error_histogram(
    df: DataFrame, classes: int = 5, windows: int = 48, pair: bool = True, compat: bool = False
) -> DataFrame:
    """Counts of the absolute class error per time window, windows without rows included.

    ``pair`` merges two half-hour windows into an hour. ``compat`` leaves out the last window.
    """
    n = windows - 1 if compat else windows
    err = df.withColumn("y_error", F.abs(F.col("y_true") - F.col("y_pred")).cast("int"))
    errors = list(range(classes))
    counts = pivot_counts(err, ["time_window"], "y_error", errors)
    names = [str(e) for e in errors]
    full = df.sparkSession.range(n).select(F.col("id").cast("int").alias("time_window"))
    full = full.join(counts.withColumn("time_window", F.col("time_window").cast("int")), "time_window", "left")
    full = full.na.fill(0, subset=names)
    if not pair:
        return full
    return full.groupBy(F.floor(F.col("time_window") / F.lit(2)).cast("int").alias("hour")).agg(
        *[F.sum(f"`{c}`").alias(c) for c in names]
    )


def compare_models(frames: Mapping[str, DataFrame], index: str, col: str) -> DataFrame:
    """One column per model, side by side by ``index``."""
    tagged = concat(*[d.select(index, col).withColumn("model", F.lit(m)) for m, d in frames.items()])
    return tagged.groupBy(index).pivot("model", list(frames)).agg(F.max(col))


def _outside(col: str, lo: Column | float, hi: Column | float) -> Column:
    """1 if a difference is not in the closed range; NULL counts as outside."""
    return F.when((F.col(col) >= lo) & (F.col(col) <= hi), 0).otherwise(1)


TRIP = ("transit_date", "trip_id")


def trip_error_rate(df: DataFrame, diff: str, lo: float, hi: float, keys: Sequence[str] = TRIP) -> DataFrame:
    """Good and bad stops per trip, the share of bad ones and the most common remark."""
    rates = df.groupBy(*keys).agg(
        F.sum(_outside(diff, F.lit(lo), F.lit(hi))).alias("bad"), F.count(F.lit(1)).alias("_n")
    )
    return (
        rates.join(mode_per_group(df, keys, "remark"), list(keys), "left")
        .withColumns({"good": F.col("_n") - F.col("bad"), "error_rate": F.col("bad") / F.col("_n")})
        .drop("_n")
    )


def _ratios(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    zero = F.lit(0.0)
    return {
        "precision": F.coalesce(F.try_divide(tp, tp + fp), zero),
        "recall": F.coalesce(F.try_divide(tp, tp + fn), zero),
        "f1": F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), zero),
    }


def precision_recall_f1(df: DataFrame, truth: Column, pred: Column, by: Sequence[str] = ()) -> DataFrame:
    """Binary confusion counts with precision, recall and F1, 0 where undefined."""

    def n(cond: Column) -> Column:
        return F.coalesce(F.sum(cond.cast("int")), F.lit(0))

    counts = df.groupBy(*by).agg(
        n(truth & pred).alias("tp"), n(~truth & pred).alias("fp"), n(truth & ~pred).alias("fn"), n(~truth & ~pred).alias("tn")
    )
    return counts.withColumns(_ratios(F.col("tp"), F.col("fp"), F.col("fn")))


def threshold_sweep(
    df: DataFrame, tolerances: Sequence[int] = range(21), rates: Sequence[float] = tuple(i / 10 for i in range(11))
) -> DataFrame:
    """N5 and N6 for load and boardings, over every tolerance and error rate, in one job.

    One pass counts the bad stops of a trip at every tolerance; the settings are then unfolded per trip, not per stop.
    ``df`` needs ``load_diff``, ``ons_diff`` and ``remark``; stops without a load difference are left out.
    """
    valid = df.filter(F.col("load_diff").isNotNull())
    params = ["load", "ons"]
    trips = valid.groupBy(*TRIP).agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.sum(_outside(f"{p}_diff", F.lit(-t), F.lit(t))).alias(f"{p}_{t}") for p in params for t in tolerances],
    )
    trips = trips.join(mode_per_group(valid, TRIP, "remark"), list(TRIP), "left")
    cells = F.array(
        *[
            F.struct(F.lit(p).alias("param"), F.lit(t).alias("tolerance"), F.col(f"{p}_{t}").alias("bad"))
            for p in params
            for t in tolerances
        ]
    )
    settings = (
        trips.select("remark", "_n", F.explode(cells).alias("c"))
        .select("remark", "c.param", "c.tolerance", (F.col("c.bad") / F.col("_n")).alias("rate"))
        .withColumn("threshold", F.explode(F.array(*[F.lit(float(r)) for r in rates])))
    )
    return precision_recall_f1(
        settings,
        F.col("rate") >= F.col("threshold"),
        F.coalesce(F.col("remark") != "clean", F.lit(True)),
        ["param", "tolerance", "threshold"],
    )


def confusion_matrix(df: DataFrame, labels: Sequence[int], y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """Counts of true by predicted class with every label present."""
    true = df.sparkSession.createDataFrame([(int(v),) for v in labels], f"{y} int")
    counts = pivot_counts(df.filter(F.col(y).isin(list(labels))), [y], p, labels)
    out = true.join(counts.withColumn(y, F.col(y).cast("int")), y, "left")
    return out.na.fill(0, subset=[str(v) for v in labels])


def accuracy(df: DataFrame, y: str = "y_true", p: str = "y_pred", by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.avg((F.col(y) == F.col(p)).cast("double")).alias("accuracy"))


def class_counts(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("count"))


def count_discrepancy(df: DataFrame, cols: Sequence[str] = ("load", "ons", "offs"), other: str = "apc_") -> DataFrame:
    """Manual minus automatic count per column as ``<col>_diff``."""
    return df.withColumns({f"{c}_diff": F.col(c) - F.col(f"{other}{c}") for c in cols})
