"""Session settings and the shared scratch folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession


# removes the shuffle files of a query when it has ended
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def get_spark(app: str = "ridership", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the operators rely on; extra settings by keyword (dots as ``__``)."""
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    if master:
        b = b.master(master)
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return configure(b.getOrCreate())


def configure(spark: SparkSession) -> SparkSession:
    """Set what the results depend on (UTC) and what skewed keys need (adaptive skew joins)."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    # a hot key is split even where that adds a shuffle further up the plan
    spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir`` of the session.

    Only a local master, where all tasks share one disk, gets a temporary folder where the session names none.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named is None:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="ridership-"))
        named = spark.sparkContext.getCheckpointDir()
    return named


_made: list[str] = []
_stored: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder; ``clear`` or the end of the program removes it."""
    folder = f"{shared_dir(spark).rstrip('/')}/ridership-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(clear)
    _made.append(folder)
    return f"{folder}/{name}"


def clear() -> None:
    """Remove what this program has stored under the shared folder, if its session still runs."""
    spark = SparkSession.getActiveSession()
    if spark is None or spark.sparkContext._jsc is None:
        return
    for folder in _made:
        _remove(spark, folder)
    _made.clear()


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def discard(*tables: DataFrame) -> None:
    """Remove tables of ``stage`` that no later step reads; what is no such table stays.

    Only for tables whose readers are stored themselves, so that a lost executor never asks for them again.
    """
    for df in tables:
        path = _stored.pop(df, None)
        if path:
            folder = path.rsplit("/", 1)[0]
            _remove(df.sparkSession, folder)
            _made.remove(folder)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a table under the shared folder and read it back.

    Operators that meet their input more than once (group cleaning, ordered windows) then scan a stored table with only
    the columns they need, instead of computing a long plan again, and a lost executor costs a scan. The shuffle files of
    the plan go once the table is written, so the disk holds those of one step at a time.
    """
    path = scratch_path(df.sparkSession, name)
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _stored[out] = path
    return out
