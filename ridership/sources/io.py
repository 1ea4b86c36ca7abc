"""Readers and writers."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_table(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """Parquet scan of a file or folder (A1)."""
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    return r.parquet(path)


def read_csv(
    spark: SparkSession,
    path: str,
    schema: StructType,
    date_cols: Mapping[str, str] | None = None,
    ts_cols: Mapping[str, str] | None = None,
) -> DataFrame:
    """CSV with a header and a declared schema (A2).

    ``date_cols`` / ``ts_cols`` map text columns to Spark date patterns (``MM/dd/yy``, ``yyyyMMdd``); text that does
    not parse becomes NULL.
    """
    df = spark.read.option("header", True).option("mode", "FAILFAST").schema(schema).csv(path)
    for c, fmt in (date_cols or {}).items():
        df = df.withColumn(c, F.try_to_timestamp(F.col(c), F.lit(fmt)).cast("date"))
    for c, fmt in (ts_cols or {}).items():
        df = df.withColumn(c, F.try_to_timestamp(F.col(c), F.lit(fmt)))
    return df


def read_json_records(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """JSON lines with a declared schema (A3)."""
    return spark.read.schema(schema).json(path)


def write_partitioned(
    df: DataFrame, path: str, by: Sequence[str] = ("year", "month"), mode: str = "overwrite", dynamic: bool = False
) -> None:
    """Partitioned Parquet (A4); ``dynamic`` replaces only the partitions present in ``df``.

    Rows of a partition are brought together first, which keeps the number of files down; the adaptive planner splits a
    partition that is too large for one task.
    """
    w = df.hint("rebalance", *[F.col(c) for c in by]).write.partitionBy(*by).mode(mode)
    if dynamic:
        w = w.option("partitionOverwriteMode", "dynamic")
    w.parquet(path)


def write_compressed(df: DataFrame, path: str, codec: str = "gzip", mode: str = "overwrite") -> None:
    """Parquet with a chosen codec (A5)."""
    df.write.mode(mode).option("compression", codec).parquet(path)


def write_csv(df: DataFrame, path: str, date_cols: Mapping[str, str] | None = None, mode: str = "overwrite") -> None:
    """CSV with a header, upper-case column names and formatted dates."""
    fmt = date_cols or {}
    cols = [(F.date_format(c, fmt[c]) if c in fmt else F.col(c)).alias(c.upper()) for c in df.columns]
    df.select(*cols).write.mode(mode).option("header", True).csv(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists on whatever file system it names."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath)


def materialize(spark: SparkSession, path: str, build: Callable[[], DataFrame], codec: str = "gzip") -> DataFrame:
    """The stored table if its commit marker is there, else build it, write it and read it back."""
    if not path_exists(spark, f"{path}/_SUCCESS"):
        write_compressed(build(), path, codec)
    return spark.read.parquet(path)


def sql(spark: SparkSession, views: Mapping[str, DataFrame], query: str, args: Mapping | None = None) -> DataFrame:
    """Register views and run a SQL text with named parameters."""
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return spark.sql(query, args=dict(args or {}))


def from_rows(
    spark: SparkSession, rows: Sequence[tuple], names: Sequence[str], casts: Mapping[str, str] | None = None
) -> DataFrame:
    """A small local table with typed casts."""
    df = spark.createDataFrame(list(rows), list(names))
    for c, t in (casts or {}).items():
        df = df.withColumn(c, F.col(c).cast(t))
    return df
