"""Session helper for tests, benchmarks and local use; a cluster passes its own session."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Rows that are broadcast at most.
BROADCAST = 100_000
#: Shuffle files of a query go when it ends, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Folders of the steps that stored_alone() removes.
_steps: list[list[str]] = []


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, memory: str = "6g") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("huemill")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def reachable(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package where it isn't installed: its folder joins their search path."""
    folder = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if folder not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, folder])
    return spark


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the one that driver and executors share (spark.checkpoint.dir)."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints"
        context.setCheckpointDir(folder)
    folder = f"{context.getCheckpointDir()}/{uuid.uuid4().hex}"
    if _steps:
        _steps[-1].append(folder)
    return folder


def materialised(df: DataFrame) -> DataFrame:
    """df once, in the shared folder: later reads, and reads after a lost executor, don't run it again. It lies there as Parquet, which takes a fraction of a checkpoint's room.

    Spark would broadcast what it reads by the size of its files, and millions of rows may take few bytes there: frames of more than BROADCAST rows are joined by sorting.
    """
    spark = df.sparkSession
    folder, rows, before = shared_folder(spark), Observation(), spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.observe(rows, F.count(F.lit(1)).alias("n")).write.option("compression", "zstd").parquet(folder)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    stored = spark.read.schema(df.schema).parquet(folder)
    return stored.hint("merge") if rows.get["n"] > BROADCAST else stored


def stored_alone(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """What make returns, stored; the steps that it has stored on the way are removed, so that its parts must not be read any more."""
    _steps.append([])
    try:
        out = materialised(make())
    finally:
        *made, kept = _steps.pop() or [""]
    if _steps:
        _steps[-1].append(kept)
    for folder in made:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return out


def broadcast_if_small(df: DataFrame, most: int = BROADCAST) -> DataFrame:
    """df with the hint to broadcast it, if it has few rows; else as it is, to be joined by a shuffle. df should be cheap to count."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
