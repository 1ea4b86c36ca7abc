"""Ordered windows that stay distributed when one group holds a large share of the rows.

A plain ``Window.partitionBy(keys)`` puts a whole group into one task. Here a group of more than ``piece_rows`` rows is
cut along its order, and windows run per ``(keys, piece)``. What a piece needs from the pieces before it comes as a few
extra rows:

* ``over_neighbours`` - frames of n rows (lag, lead, rolling statistics, sequences): copies of the n rows before the
  piece.
* ``running`` functions - sums, counts and last values: one seed row per piece with the total of the pieces before it.

One pass over keys and positions sizes the groups when the operator is called. Where no group is too large the plan is the
plain window, with one read of the input. Otherwise the large groups are cut at approximate quantiles of their own
positions, and again piece by piece until each is small enough or holds one position only, where the next column of the
order takes over; so the pieces are bounded at any number of rows, and equal positions can be cut. The one window that
spans a large group sees a few rows per piece. With ``keys=[]`` the same code gives an order over the whole table.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ridership.session import stage

SLOT = "_slot"
COPY = "_copy"
SEED = "_seed"

PIECE_ROWS = 5_000_000
FAN = 1000  # pieces a group is cut into at once; a piece that is still too large is cut again
STEP = 1024
NUMBER = "decimal(38, 0)"  # of pieces: room for twelve cuts of a cut
ACCURACY = 10_000


@dataclass(frozen=True)
class Along:
    """An order: its columns (complete, for a repeatable result) and a number that never decreases along it.

    A NULL position stands for the start of the order. ``piece_rows`` None says that the groups are known to fit.
    """

    order: Sequence[str]
    pos: Column
    piece_rows: int | None = PIECE_ROWS


def _sorts(cols: Sequence[str], descending: bool) -> list[Column]:
    return [F.col(c).desc_nulls_last() if descending else F.col(c).asc_nulls_first() for c in cols]


# Cut points: approximate quantiles of the positions, as many as the size asks for. The shares are one text literal, which
# keeps the plan short.
_SHARES = ",".join(str(i / FAN) for i in range(1, FAN))
_QUANTILES = f"percentile_approx(_p, CAST(split('{_SHARES}', ',') AS ARRAY<DOUBLE>), {ACCURACY})"

# Number of cut points at or below the position: a binary search by halving steps.
_STEPS = ", ".join(str(1 << k) for k in range(FAN.bit_length() - 1, -1, -1))
_PIECE = f"aggregate(array({_STEPS}), 0, (at, step) -> IF(get(_cuts, at + step - 1) <= _p, at + step, at))"


def _positions(df: DataFrame, along: Along) -> list[Column]:
    """The position, then the columns of the order as numbers, up to the first that is none."""
    out = [along.pos]
    for c in along.order:
        kind = df.schema[c].dataType
        if isinstance(kind, T.DateType):
            out.append(F.unix_date(c))
        elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            out.append(F.unix_micros(F.col(c).cast("timestamp")))
        elif isinstance(kind, T.NumericType):
            out.append(F.col(c))
        else:
            break
    return [F.coalesce(c.cast("double"), F.lit(-1.7e308)) for c in out]


def _too_large(rows: DataFrame, group: Sequence[str], places: Sequence[str], piece_rows: int) -> DataFrame:
    """Groups to be cut, and the first position (``_by``) in which their rows differ."""
    ends = [f(p).alias(f"{n}{p}") for p in places for n, f in (("_min", F.min), ("_max", F.max))]
    sized = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"), *ends).filter(F.col("_n") > piece_rows)
    # beyond 2^53 equal doubles may be different positions, so no later column decides there
    tests = [
        t
        for i, p in enumerate(places)
        for t in (f"WHEN _min{p} < _max{p} THEN {i}", f"WHEN abs(_max{p}) > 9e15 AND _max{p} > -1.7e308 THEN NULL")
    ]
    by = F.expr(f"CASE {' '.join(tests)} END")
    low = F.get(F.array(*[F.col(f"_min{p}") for p in places]), by)
    return sized.select(*group, "_n", by.alias("_by"), low.alias("_low")).filter("_by IS NOT NULL")


def fits(df: DataFrame, keys: Sequence[str], along: Along) -> bool:
    """Whether no group has more than ``piece_rows`` rows, so that later orders on the same keys need no look."""
    sized = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return (sized.agg(F.max("_n")).first()[0] or 0) <= along.piece_rows


def cut_pieces(df: DataFrame, keys: Sequence[str], along: Along) -> DataFrame:
    """Add the piece of each row as ``_slot``, NULL in a group left whole.

    The functions below do this themselves; call it first where several of them follow on the same keys and order.
    """
    whole = F.lit(None).cast(NUMBER)
    if along.piece_rows is None:
        return df.withColumn(SLOT, whole)
    named = [f"_k{i}" for i in range(len(keys))]
    group = [*named, SLOT]
    positions = _positions(df, along)
    places = [f"_p{i}" for i in range(len(positions))]
    narrow = df.select(
        *[F.col(k).alias(n) for k, n in zip(keys, named)], *[c.alias(p) for c, p in zip(positions, places)]
    ).withColumn(SLOT, whole)
    levels: list[DataFrame] = []
    while levels or not fits(narrow, named, along):
        large = stage(_too_large(narrow, group, places, along.piece_rows), "large_groups")
        if large.isEmpty():
            break
        pieces = f"least(ceil(max(_n) / {along.piece_rows}), {FAN})"
        at = f"CAST(floor(i * {FAN} / {pieces}) AS INT) - 1"
        cuts = F.expr(
            f"array_distinct(filter(transform(sequence(1, {pieces} - 1), i -> get({_QUANTILES}, {at})), c -> c > max(_low)))"
        )
        same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_l{c}")) for c in group])
        renamed = large.withColumnsRenamed({c: f"_l{c}" for c in group})
        own = narrow.join(renamed, same).withColumn("_p", F.get(F.array(*places), F.col("_by")))
        # the rows of the first position are parted from the others, however many they are
        second = F.min(F.when(F.col("_p") > F.col("_low"), F.col("_p")))
        level = own.groupBy(*[f"_l{c}" for c in group], "_by").agg(F.array_sort(F.array_union(F.array(second), cuts)).alias("_cuts"))
        levels.append(stage(level, "cut_points"))
        narrow = _cut_once(narrow, levels[-1], group, len(levels) == 1, places)
    out = df.withColumn(SLOT, whole)
    for i, level in enumerate(levels):
        rows = out.withColumns({n: F.col(k) for k, n in zip(keys, named)} | dict(zip(places, positions)))
        out = _cut_once(rows, level, group, i == 0, places).drop(*named, *places)
    return out


def _cut_once(rows: DataFrame, level: DataFrame, group: Sequence[str], first: bool, places: Sequence[str]) -> DataFrame:
    """Number the pieces of the groups in ``level``; the numbers of all pieces keep their order."""
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_l{c}")) for c in group])
    slot = F.when(F.col("_cuts").isNotNull(), (F.coalesce(SLOT, F.lit(0)) * STEP + F.expr(_PIECE)).cast(NUMBER))
    return (
        rows.join(level, same, "left")
        .withColumn("_p", F.get(F.array(*places), F.col("_by")))
        .withColumn(SLOT, slot if first else F.coalesce(slot, (F.col(SLOT) * STEP).cast(NUMBER)))
        .drop("_p", "_by", "_cuts", *[f"_l{c}" for c in group])
    )


def _pieces(df: DataFrame, keys: Sequence[str], along: Along) -> tuple[DataFrame, DataFrame, list[str]]:
    """All rows with their piece, the rows of cut groups only, and the columns to drop in the end."""
    given = SLOT in df.columns
    rows = df if given else cut_pieces(df, keys, along)
    return rows, rows.filter(F.col(SLOT).isNotNull()), [] if given else [SLOT]


def over_neighbours(
    df: DataFrame,
    keys: Sequence[str],
    along: Along,
    before: int,
    exprs: Mapping[str, Callable[[WindowSpec], Column]],
    descending: bool = False,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Add window expressions whose frame reaches at most ``before`` rows back along the order.

    ``descending`` runs the order backwards, so "before" means the rows that follow. ``carry`` names the columns,
    besides keys and order, that the expressions read from other rows.
    """
    piece = [*keys, SLOT]
    sorts = _sorts(along.order, descending)
    rows, cut_rows, helpers = _pieces(df, keys, along)
    needed = list(dict.fromkeys([*keys, *along.order, *carry]))
    # the last rows of each piece; the filter on row_number limits each task's output before the shuffle
    from_end = Window.partitionBy(*piece).orderBy(*_sorts(along.order, not descending))
    tails = (
        cut_rows.select(*needed, SLOT)
        .withColumn("_n", F.row_number().over(from_end))
        .filter(F.col("_n") <= before)
        .drop("_n")
    )
    group = Window.partitionBy(*keys).orderBy(*sorts)
    copies = (
        tails.select(
            SLOT,
            F.collect_list(F.struct(*needed)).over(group.rowsBetween(-before, -1)).alias("_prev"),
            (~F.lag(SLOT).over(group).eqNullSafe(F.col(SLOT))).alias("_starts"),
        )
        .filter("_starts")
        .select(SLOT, F.explode("_prev").alias("_r"))
        .select(*[F.col("_r")[c].alias(c) for c in needed], SLOT, F.lit(True).alias(COPY))
    )
    w = Window.partitionBy(*piece).orderBy(*sorts)
    return (
        rows.withColumn(COPY, F.lit(False))
        .unionByName(copies, allowMissingColumns=True)
        .withColumns({name: f(w) for name, f in exprs.items()})
        .filter(~F.col(COPY))
        .drop(COPY, *helpers)
    )


def _running(
    df: DataFrame,
    keys: Sequence[str],
    along: Along,
    summary: Mapping[str, Column],
    carry: Callable[[str, WindowSpec], Column],
    step: Callable[[str, WindowSpec], Column],
    descending: bool,
) -> DataFrame:
    piece = [*keys, SLOT]
    rows, cut_rows, helpers = _pieces(df, keys, along)
    pieces = Window.partitionBy(*keys).orderBy(*_sorts([SLOT], descending))
    before = pieces.rowsBetween(Window.unboundedPreceding, -1)
    seeds = (
        cut_rows.groupBy(*piece)
        .agg(*[agg.alias(f"_s_{name}") for name, agg in summary.items()])
        .select(*piece, *[carry(f"_s_{name}", before).alias(f"_s_{name}") for name in summary], F.lit(0).alias(SEED))
    )
    w = (
        Window.partitionBy(*piece)
        .orderBy(SEED, *_sorts(along.order, descending))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        rows.withColumn(SEED, F.lit(1))
        .unionByName(seeds, allowMissingColumns=True)
        .withColumns({name: step(name, w) for name in summary})
        .filter(F.col(SEED) == 1)
        .drop(SEED, *helpers, *[f"_s_{name}" for name in summary])
    )


def running_sum(
    df: DataFrame, keys: Sequence[str], along: Along, sums: Mapping[str, Column], descending: bool = False
) -> DataFrame:
    """Add running sums, the current row included; ``lit(1)`` as the summed value gives the row number."""
    valued = df.withColumns({f"_v_{n}": F.coalesce(c, F.lit(0)) for n, c in sums.items()})
    out = _running(
        valued,
        keys,
        along,
        {n: F.sum(f"_v_{n}") for n in sums},
        lambda s, before: F.sum(s).over(before),
        lambda n, w: F.sum(F.coalesce(f"_s_{n}", f"_v_{n}")).over(w),
        descending,
    )
    return out.drop(*[f"_v_{n}" for n in sums])


def row_numbers(df: DataFrame, keys: Sequence[str], along: Along, name: str, descending: bool = False) -> DataFrame:
    """Row number of each row within its group."""
    return running_sum(df, keys, along, {name: F.lit(1)}, descending)


def running_last(
    df: DataFrame, keys: Sequence[str], along: Along, lasts: Mapping[str, Column], descending: bool = False
) -> DataFrame:
    """Add the latest non-NULL value up to the current row; with ``descending`` the next one from it on."""
    valued = df.withColumns({f"_v_{n}": c for n, c in lasts.items()})
    pick = F.min_by if descending else F.max_by

    def latest(n: str) -> Column:
        return pick(F.col(f"_v_{n}"), F.when(F.col(f"_v_{n}").isNotNull(), F.struct(*along.order)))

    out = _running(
        valued,
        keys,
        along,
        {n: latest(n) for n in lasts},
        lambda s, before: F.last(s, ignorenulls=True).over(before),
        lambda n, w: F.last(F.coalesce(f"_s_{n}", f"_v_{n}"), ignorenulls=True).over(w),
        descending,
    )
    return out.drop(*[f"_v_{n}" for n in lasts])


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group (G7); Spark limits each task's rows per group before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= k).drop("_n")
