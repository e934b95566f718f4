"""Session settings and reliable materialisation."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Sequence
from multiprocessing.pool import ThreadPool

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT = "spark.checkpoint.dir"
TOGETHER = 4_000_000  # rows of a table over which independent steps run at once


def local_session(cores: str = "8", app: str = "forecourt") -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", cores if cores.isdigit() else "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.log.level", "ERROR")
        .getOrCreate()
    )
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir. Only a local master may leave it unset: one machine runs all."""
    named = spark.conf.get(CHECKPOINT, None) or spark.sparkContext.getConf().get(CHECKPOINT, None)
    if named:
        return named
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError(f"{CHECKPOINT} must name a folder that all executors share")
    return os.path.join(tempfile.gettempdir(), "forecourt-checkpoints")


def materialize(df: DataFrame) -> DataFrame:
    """Run the plan once and cut its lineage with a reliable checkpoint, which survives lost executors."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str = "rows") -> DataFrame:
    """As ``materialize``, for tables as long as the input: written as Parquet and read again.

    A checkpoint holds whole rows as they are in memory and reads them whole; of this, later steps read the columns
    they use. Columns that Parquet has no type for, or that differ in case only, take the checkpoint.
    """
    if any("void" in t or "interval" in t for _, t in df.dtypes) or len({c.lower() for c in df.columns}) < len(df.columns):
        return materialize(df)
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def together[T](rows: DataFrame, steps: Sequence[Callable[[], T]], most: int = TOGETHER) -> list[T]:
    """The results of steps that do not need each other, over the kept table ``rows``.

    Over few rows the driver's planning takes most of the time, so they run at once. Over more than ``most`` rows each
    keeps all cores busy, and the next begins when the cached rows of the last are gone.
    """
    if len(steps) < 2 or rows.count() > most:
        return [step() for step in steps]
    with ThreadPool(len(steps)) as pool:
        return pool.map(lambda step: step(), steps, chunksize=1)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a written table, next to the checkpoints."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
