"""Sharding (operator 7): a two-pass external shuffle into shards with row counts at most one apart.

Pass 1 scatters whole records into memory-sized buckets by a seeded hash of ``doc_id`` and a text checksum. Pass 2
shuffles each bucket by Fisher-Yates with a generator seeded by the bucket and writes it. The shuffled order of the
table is bucket after bucket; it is cut into equal shards, so a bucket's rows go to at most a few shards and each row's
shard and slot follow from its place. A bucket's rows are put into a fixed order first, so a task that runs again
writes the same rows.

Defined cases: a NULL text has size 1 and checksum 0 and is written as NULL; a NULL ``doc_id`` is kept; repeated rows are each placed;
an empty table gives no rows; of other columns those named in ``carry`` are written.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ridership.session import scratch_path, stage

SHARDS = 16
BUCKET_BYTES = 16 << 20


def shard_documents(docs: DataFrame, shards: int = SHARDS, seed: int = 7, bucket_bytes: int = BUCKET_BYTES, path: str | None = None, carry: Sequence[str] = ()) -> DataFrame:
    """Write the shuffled shards under ``path`` (default: a fresh one in the shared folder) and return them.

    Columns: doc_id, text, the carried ones, size, text_crc32, shard, slot. Rows of a shard are read in order of slot.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
        *[F.col(c) for c in carry if c not in ("doc_id", "text")],
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    total = rows.agg(F.sum("size")).first()[0] or 0
    buckets = max(1, -(-total // bucket_bytes))
    rows = rows.withColumn("_bucket", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text_crc32"), F.lit(buckets)))
    # one row per bucket; its window sees as many rows as there are buckets
    counts = rows.groupBy("_bucket").count()
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    places = stage(counts.select("_bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_first"), F.sum("count").over(whole).alias("_rows")), "buckets")
    scattered = rows.join(places, "_bucket").repartition(int(buckets), "_bucket")
    names = ["doc_id", "text", *[c for c in carry if c not in ("doc_id", "text")], "size", "text_crc32"]

    def shuffle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        data = pa.Table.from_batches(got)
        bucket = data.column("_bucket").to_numpy()
        for k in np.unique(bucket):
            own = data.take(np.flatnonzero(bucket == k))
            own = own.take(pc.sort_indices(own, [(c, "ascending") for c in ("doc_id", "text_crc32", "size")]))
            own = own.take(np.random.default_rng([seed, int(k)]).permutation(len(own)))  # Fisher-Yates
            n = own.column("_rows")[0].as_py()
            place = own.column("_first")[0].as_py() + np.arange(len(own), dtype=np.int64)
            shard = place * shards // n
            slot = place - -(-shard * n // shards)
            out = own.select(names).append_column("shard", pa.array(shard.astype(np.int32))).append_column("slot", pa.array(slot))
            yield from out.combine_chunks().to_batches(2000)

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", shard int, slot long"
    path = path or scratch_path(spark, "shards")
    written = scattered.mapInArrow(shuffle, schema)
    written.write.partitionBy("shard").parquet(path)
    return spark.read.schema(written.schema).parquet(path)


def crc32(text: str | None) -> int:
    return zlib.crc32((text or "").encode())
