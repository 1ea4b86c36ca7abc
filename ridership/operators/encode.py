"""Encoders and scalers.

An index map is a table, made without a single-task sort, and serves any number of values. The wide one-hot form has a column
per value by definition, so its values are read to the driver; the sparse form (``one_hot_sparse``) takes its slots from a
table and serves columns whose values grow with the data.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridership.session import stage

def fit_categories(df: DataFrame, cols: Sequence[str]) -> dict[str, list]:
    """Sorted distinct values per column."""
    return {c: sorted(r[0] for r in df.select(c).filter(F.col(c).isNotNull()).distinct().collect()) for c in cols}


def one_hot(df: DataFrame, categories: Mapping[str, Sequence]) -> DataFrame:
    """A 0/1 column ``<col>_<value>`` per category."""
    hot = {
        f"{c}_{v}": F.coalesce((F.col(c) == F.lit(v)).cast("int"), F.lit(0)) for c, values in categories.items() for v in values
    }
    return df.select(*[c for c in df.columns if c not in hot], *[x.alias(n) for n, x in hot.items()])


def hot_column(df: DataFrame, col: str, value: object) -> Column:
    """The 0/1 column of one value of ``one_hot``, which is 0 throughout where no row that was fitted has the value."""
    name = f"{col}_{value}"
    return (F.col(f"`{name}`") if name in df.columns else F.lit(0)).alias(name)


def one_hot_inverse(df: DataFrame, categories: Mapping[str, Sequence]) -> DataFrame:
    """The category columns back from their 0/1 columns, which are dropped."""
    back = {
        c: F.coalesce(*[F.when(F.col(f"{c}_{v}") == 1, F.lit(v)) for v in values]) for c, values in categories.items()
    }
    return df.withColumns(back).drop(*[f"{c}_{v}" for c, values in categories.items() for v in values])


def category_slots(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Table (column, value, slot): the slots of the sparse one-hot form (L5), values as text.

    Slots count from 0 in sorted order of a column's values; a column's slots follow those of the columns before it.
    """
    maps = [
        index_map(df, c).select(F.lit(i).alias("_at"), F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value"), F.col(f"`{c}_ix`").alias("_ix"))
        for i, c in enumerate(cols)
    ]
    every = stage(reduce(DataFrame.unionByName, maps), "slots")
    # a row per column
    before = Window.orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    first = every.groupBy("_at").count().select("_at", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_first"))
    return every.join(first, "_at").select("column", "value", (F.col("_first") + F.col("_ix")).cast("int").alias("slot"))


def one_hot_sparse(df: DataFrame, slots: DataFrame, cols: Sequence[str], name: str = "hot") -> DataFrame:
    """The category columns as one sparse vector (L5): struct of ``size``, ``indices`` (ascending) and ``values``.

    A row has as many entries as it has known categories, however many values the columns have; NULL and values without a
    slot add none. The columns given stay.
    """
    out = df
    for i, c in enumerate(cols):
        own = slots.filter(F.col("column") == c).select(F.col("value").alias(f"_value{i}"), F.col("slot").alias(f"_slot{i}"))
        out = out.join(own, F.col(f"`{c}`").cast("string") == F.col(f"_value{i}"), "left")
    indices = F.array_compact(F.array(*[F.col(f"_slot{i}") for i in range(len(cols))]))
    size = slots.agg(F.count(F.lit(1)).cast("int")).scalar()
    vector = F.struct(size.alias("size"), indices.alias("indices"), F.transform(indices, lambda _: F.lit(1.0)).alias("values"))
    return out.select(*[F.col(f"`{c}`") for c in df.columns if c != name], vector.alias(name))


def one_hot_long(df: DataFrame, name: str = "hot") -> DataFrame:
    """Rows (the other columns, ``slot``, ``value``) of a sparse vector (L5); a row without an entry gives none."""
    rest = [F.col(f"`{c}`") for c in df.columns if c != name]
    return df.select(*rest, F.inline(F.arrays_zip(F.col(f"{name}.indices").alias("slot"), F.col(f"{name}.values").alias("value"))))


def one_hot_sparse_inverse(df: DataFrame, slots: DataFrame, types: Mapping[str, str], name: str = "hot") -> DataFrame:
    """The category columns, of the given types, back from their sparse vector, which is dropped."""
    out = df
    for i, (c, kind) in enumerate(types.items()):
        own = slots.filter(F.col("column") == c)
        low, high = own.agg(F.min("slot")).scalar(), own.agg(F.max("slot")).scalar()
        # a column has one entry at most
        found = F.get(F.filter(F.col(f"{name}.indices"), lambda s: s.between(F.col("_low"), F.col("_high"))), F.lit(0))  # noqa: B023
        out = out.withColumns({"_low": low, "_high": high}).withColumn("_own", found).drop("_low", "_high")
        back = own.select(F.col("slot").alias("_own"), F.col("value").cast(kind).alias(f"_back{i}"))
        out = out.join(back, "_own", "left").drop("_own")
    given = [F.col(f"`{c}`") for c in df.columns if c != name and c not in types]
    return out.select(*given, *[F.col(f"_back{i}").alias(c) for i, c in enumerate(types)])


def index_map(df: DataFrame, col: str) -> DataFrame:
    """Mapping table value -> 0-based index in sorted order.

    The distinct values are sorted over all tasks and stored with their task and place; a value's index is its place
    plus the values of the tasks before, of which there is one row each.
    """
    values = df.select(col).filter(F.col(col).isNotNull()).distinct()
    # the high bits of the id count the sorted tasks, the low 33 the rows of a task
    placed = stage(values.orderBy(col).withColumn("_id", F.monotonically_increasing_id()), f"index_{col}")
    placed = placed.withColumn("_task", F.shiftright("_id", 33))
    before = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    tasks = placed.groupBy("_task").count().select("_task", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    place = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_before")
    return placed.join(tasks, "_task").select(col, place.cast("int").alias(f"{col}_ix"))


def apply_index(df: DataFrame, mapping: DataFrame, col: str) -> DataFrame:
    """Add ``<col>_ix`` (L6); a value not in the map gets NULL."""
    return df.join(mapping, col, "left")


def index_inverse(df: DataFrame, mapping: DataFrame, col: str) -> DataFrame:
    """The value back from its index, which is dropped."""
    return df.join(mapping, f"{col}_ix", "left").drop(f"{col}_ix")


def fit_scaler(df: DataFrame, cols: Sequence[str], kind: str = "minmax") -> dict[str, tuple[float, float]]:
    """Shift and width per column (L7): minimum and range, or mean and population standard deviation."""
    pair = {
        "minmax": lambda c: (F.min(c), F.max(c) - F.min(c)),
        "standard": lambda c: (F.avg(c), F.stddev_pop(c)),
    }[kind]
    aggs = [a.cast("double").alias(f"{n}{i}") for i, c in enumerate(cols) for n, a in zip(("shift", "width"), pair(c))]
    row = df.agg(*aggs).first()
    # a constant column is only shifted
    return {c: (row[f"shift{i}"], row[f"width{i}"] or 1.0) for i, c in enumerate(cols)}


def scale(df: DataFrame, scaler: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Apply a fitted scaler."""
    return df.withColumns({c: (F.col(c) - F.lit(m)) / F.lit(w) for c, (m, w) in scaler.items()})


def align_columns(df: DataFrame, columns: Sequence[str], numeric: Sequence[str] = ()) -> DataFrame:
    """The training columns in training order, numeric text cast, rows with NULL dropped.

    Text that is no number becomes NULL.
    """
    cols = [F.col(f"`{c}`").try_cast("double").alias(c) if c in numeric else F.col(f"`{c}`") for c in columns]
    return df.select(*cols).na.drop()
