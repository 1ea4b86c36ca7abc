"""Stored tables as streams, and streams into tables; files and checkpoints lie under the shared folder."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ridership.session import scratch_path

PROGRESS_KEPT = 100_000  # reports of batches that a query keeps, for the count of late rows


def deliver(rows: DataFrame, path: str, part: int) -> None:
    """Write the next delivery of a stream: a folder of files that ``watch`` takes up after the ones before it."""
    rows.write.parquet(f"{path}/part-{part:06d}")


def deliver_by(df: DataFrame, order: Column, size: int, name: str) -> tuple[str, int]:
    """Write a table as deliveries of ``size`` steps of ``order`` (a whole number, such as a day), in that order.

    Returns the folder and the number of deliveries. Rows where ``order`` is NULL come with the first. The driver runs one
    write per delivery, so the number is that of the steps, not of the rows.
    """
    path = scratch_path(df.sparkSession, name)
    low, high = df.agg(F.min(order), F.max(order)).first()
    low, high = low or 0, high or 0
    parts = (high - low) // size + 1
    of = F.coalesce(F.expr(f"({{o}} - {low}) div {size}".replace("{o}", "_order")), F.lit(0))
    for k in range(parts):
        deliver(df.withColumn("_order", order).filter(of == k).drop("_order"), path, k)
    return path, parts


def watch(like: DataFrame, path: str, files: int) -> DataFrame:
    """The deliveries under a folder as a stream of rows with the columns of ``like``, ``files`` files a batch."""
    return like.sparkSession.readStream.schema(like.schema).option("maxFilesPerTrigger", files).parquet(f"{path}/part-*")


@dataclass(frozen=True)
class Run:
    """What a finished run of a stream has written, and how many rows came too late for it."""

    table: DataFrame
    late: int
    batches: int


def late_rows(query: StreamingQuery) -> int:
    """Rows that a query's stateful operators left out because they came after the watermark."""
    return sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])


def run_available(stream: DataFrame, path: str) -> Run:
    """Take up all that is there, append the results to a table under ``path``, and stop.

    A second run with the same ``path`` goes on where the first one stopped: offsets, state and watermark are in the
    checkpoint beside the table. Each batch is written once, whatever is lost in between.
    """
    spark = stream.sparkSession
    # state with timers needs this store; its files go to the checkpoint
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", str(PROGRESS_KEPT))
    query = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("path", f"{path}/rows")
        .option("checkpointLocation", f"{path}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return Run(spark.read.schema(stream.schema).parquet(f"{path}/rows"), late_rows(query), len(query.recentProgress))
