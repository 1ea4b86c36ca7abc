"""Fixed-length sequences for sequence models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridership.operators.ordered import Along, over_neighbours, row_numbers


def _windows(
    df: DataFrame, length: int, cols: Sequence[str], keys: Sequence[str], along: Along, step: int = 1
) -> DataFrame:
    """Every run of ``length`` rows as ``seq``, one row per run at its last row; shorter runs are left out."""
    rows = df if step == 1 else row_numbers(df, keys, along, "_rn")
    runs = over_neighbours(
        rows,
        keys,
        along,
        length - 1,
        {"seq": lambda w: F.collect_list(F.struct(*cols)).over(w.rowsBetween(-(length - 1), 0))},
        carry=cols,
    ).filter(F.size("seq") == length)
    if step > 1:
        runs = runs.filter((F.col("_rn") - length) % step == 0).drop("_rn")
    return runs


def sliding_sequences(
    df: DataFrame,
    past: int,
    future: int,
    cols: Sequence[str],
    label: str,
    keys: Sequence[str],
    along: Along,
    step: int = 1,
) -> DataFrame:
    """x = ``past`` rows of all columns, y = the label of the ``future`` rows after them."""
    runs = _windows(df, past + future, cols, keys, along, step)
    return runs.withColumns({"x": F.slice("seq", 1, past), "y": F.slice("seq", past + 1, future)[label]}).drop("seq")


def encoder_decoder_sequences(
    df: DataFrame,
    past: int,
    future: int,
    cols: Sequence[str],
    label: str,
    keys: Sequence[str],
    along: Along,
    offset: int = 0,
) -> DataFrame:
    """As L9 with a gap of ``offset`` rows before the labels and a decoder input of -1.

    The decoder input covers the gap too: ``future + offset`` rows.
    """
    out_len = future + offset
    runs = _windows(df, past + out_len, cols, keys, along)
    blank = F.array_repeat(F.array_repeat(F.lit(-1), len(cols)), out_len)
    return runs.withColumns(
        {"x": F.slice("seq", 1, past), "decoder_input": blank, "y": F.slice("seq", past + offset + 1, future)[label]}
    ).drop("seq")


def window_spec(
    df: DataFrame,
    input_width: int,
    label_width: int,
    shift: int,
    cols: Sequence[str],
    keys: Sequence[str],
    along: Along,
    label_columns: Sequence[str] | None = None,
) -> DataFrame:
    """Inputs = the first ``input_width`` rows, labels = the last ``label_width`` of ``input_width + shift``."""
    total = input_width + shift
    runs = _windows(df, total, cols, keys, along)
    chosen = list(label_columns or cols)
    labels = F.transform(
        F.slice("seq", total - label_width + 1, label_width), lambda r: F.struct(*[r[c].alias(c) for c in chosen])
    )
    return runs.withColumns({"inputs": F.slice("seq", 1, input_width), "labels": labels}).drop("seq")


def deterministic_future_sequences(
    df: DataFrame,
    window: int,
    forecast: int,
    cols: Sequence[str],
    n_deterministic: int,
    keys: Sequence[str],
    along: Along,
) -> DataFrame:
    """Past rows with all columns, future rows with the last ``n_deterministic`` columns, label = first column."""
    runs = _windows(df, window + forecast, cols, keys, along)
    known = list(cols)[-n_deterministic:]
    ahead = F.slice("seq", window + 1, forecast)
    return runs.withColumns(
        {
            "x_past": F.slice("seq", 1, window),
            "x_future": F.transform(ahead, lambda r: F.struct(*[r[c].alias(c) for c in known])),
            "y": ahead[cols[0]],
        }
    ).drop("seq")


def block_batches(
    df: DataFrame, w: int, cols: Sequence[str], label: str, keys: Sequence[str], along: Along
) -> DataFrame:
    """Disjoint blocks of ``w + 1`` rows: x = the first ``w``, y = the label of the last (L13); no partial block."""
    numbered = row_numbers(df, keys, along, "_rn").withColumn("batch", F.floor((F.col("_rn") - 1) / F.lit(w + 1)))
    rows = F.array_sort(F.collect_list(F.struct("_rn", *dict.fromkeys([*cols, label]))))
    return (
        numbered.groupBy(*keys, "batch")
        .agg(rows.alias("_rows"))
        .filter(F.size("_rows") == w + 1)
        .select(
            *keys,
            "batch",
            F.transform(F.slice("_rows", 1, w), lambda r: F.struct(*[r[c].alias(c) for c in cols])).alias("x"),
            F.col("_rows")[w][label].alias("y"),
        )
    )
