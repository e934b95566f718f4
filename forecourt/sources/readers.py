"""Readers. CSV columns stay text: typing is the cleaning plan's job, not the reader's guess."""

from __future__ import annotations

import fnmatch
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from forecourt import constants as K
from forecourt.operators.demand import multiplier_table

PREFERENCE = ("parquet", "csv")


def read_table(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Parquet or CSV by extension, of one path or several of the same kind."""
    paths = [path] if isinstance(path, str) else list(path)
    if all(p.rstrip("/").lower().endswith(".parquet") for p in paths):
        return spark.read.parquet(*paths)
    return spark.read.option("header", True).option("escape", '"').csv(paths)


def list_sources(spark: SparkSession, folder: str, patterns: Sequence[str] = K.SOURCE_GLOBS) -> list[str]:
    """Sources in a folder, one per stem: Parquet is preferred over CSV.

    A source is a direct child with a known extension: a file, or a directory of part files.
    Only names are read, through Hadoop, so any file system works.
    """
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    children = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
    names = [child.getPath().getName() for child in children]
    return prefer(f"{folder.rstrip('/')}/{n}" for n in names if any(fnmatch.fnmatch(n, g) for g in patterns))


def prefer(paths) -> list[str]:
    best: dict[str, str] = {}
    for path in sorted(paths):
        stem, _, ext = path.rpartition(".")
        if ext.lower() not in PREFERENCE:
            continue
        held = best.get(stem)
        if held is None or PREFERENCE.index(ext.lower()) < PREFERENCE.index(held.rpartition(".")[2].lower()):
            best[stem] = path
    return [best[s] for s in sorted(best)]


def read_sources(spark: SparkSession, folder: str, patterns: Sequence[str] = K.SOURCE_GLOBS) -> DataFrame:
    """All sources in one table; ``source`` is the file's stem."""
    paths = list_sources(spark, folder, patterns)
    if not paths:
        raise FileNotFoundError(f"no source files in {folder}")
    # Headers may differ from source to source, so each is its own branch of the union.
    return union_sources(read_table(spark, p).withColumn("source", F.lit(stem(p))) for p in paths)


def stem(path: str) -> str:
    return path.rstrip("/").rsplit("/", 1)[-1].rpartition(".")[0]


def union_sources(frames) -> DataFrame:
    """Union by name; a column missing in one source is null there."""
    out = None
    for frame in frames:
        out = frame if out is None else out.unionByName(frame, allowMissingColumns=True)
    return out


def read_partition(spark: SparkSession, folder: str, stem: str) -> DataFrame:
    """One named source, in the preferred format."""
    paths = list_sources(spark, folder, [f"{stem}.*"])
    if not paths:
        raise FileNotFoundError(f"no source {stem} in {folder}")
    return read_table(spark, paths[0])


def single_source(df: DataFrame, name: str, column: str = "source") -> DataFrame:
    return df.where(F.col(column) == name)


def read_multipliers(spark: SparkSession, path: str, strip_suffix: str | None = None) -> DataFrame:
    """The multiplier table from CSV. A missing file is an error, not a neutral table."""
    return multiplier_table(spark.read.option("header", True).option("escape", '"').csv(path), strip_suffix)
