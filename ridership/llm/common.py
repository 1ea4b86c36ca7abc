"""Helpers shared by the operators: tables, stored steps, a bounded filter on keys, connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ridership.session import discard, stage

BITMAP = 32_768  # bits of one row of Spark's bitmap functions
BATCH_ROWS = 1_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(df: DataFrame) -> None:
    """Let Python workers get texts in batches of few rows: whole texts are large, and each batch is held twice."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def maybe_in(df: DataFrame, keys: DataFrame, key: Column, bits: int = 1 << 23) -> DataFrame:
    """Rows whose key may be in ``keys`` (one column ``key``); rows that may not go before a shuffle would move them.

    A bitmap of ``bits`` bits (1 MB) is broadcast, whatever the size of ``keys``; some rows pass that are not in it, so
    an exact join follows.
    """
    slot = F.pmod(F.xxhash64(F.lit(11), F.col("key")), F.lit(bits))
    marks = (
        keys.select(slot.alias("_slot"))
        .groupBy(F.expr(f"_slot div {BITMAP}").alias("_bucket"))
        .agg(F.expr(f"bitmap_construct_agg(_slot % {BITMAP})").alias("_marks"))
    )
    own = F.pmod(F.xxhash64(F.lit(11), key), F.lit(bits))
    byte = F.conv(F.hex(F.expr("substring(_marks, CAST(_own % 32768 DIV 8 AS INT) + 1, 1)")), 16, 10).cast("int")
    return (
        df.withColumn("_own", own)
        .withColumn("_bucket", F.expr(f"_own div {BITMAP}"))
        .join(F.broadcast(marks), "_bucket")
        .filter(byte.bitwiseAND(F.expr("shiftleft(1, CAST(_own % 8 AS INT))")) != 0)
        .drop("_own", "_bucket", "_marks")
    )


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of ``edges`` (a, b: long): one row (node, label) per node; the label is one of its nodes.

    Each round every node moves to the neighbour, or itself, that comes first in a seeded order of the round, and the
    edges are rewritten; their number falls by a constant factor, and a star is gone after about one round. All steps
    are joins and aggregates; a node with very many neighbours is a minimum with partial sums. Each round is stored
    under the shared folder, and the one before it goes.
    """
    edges = stage(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), name)
    labels = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("label", F.col("node"))
    step = 0
    while not edges.isEmpty():
        both = edges.select("a", "b").union(edges.select("b", "a"))
        order = lambda c: F.struct(F.xxhash64(F.lit(step), F.col(c)).alias("h"), F.col(c).alias("v"))  # noqa: E731, B023
        to = both.groupBy("a").agg(F.min(order("b")).alias("_to")).select("a", F.least("_to", order("a"))["v"].alias("to"))
        to = stage(to, f"{name}_to")
        moved_labels = stage(
            labels.join(to, F.col("label") == F.col("a"), "left").select("node", F.coalesce("to", "label").alias("label")),
            f"{name}_labels",
        )
        moved = edges.join(to.select("a", F.col("to").alias("ta")), "a").join(to.select(F.col("a").alias("b"), F.col("to").alias("tb")), "b")
        left = stage(
            moved.filter("ta <> tb").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct(),
            f"{name}_edges",
        )
        # both are stored, so nothing reads the tables of the round again
        discard(edges, to, labels)
        edges, labels = left, moved_labels
        step += 1
    return labels
