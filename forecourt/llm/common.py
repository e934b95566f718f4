"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from forecourt.session import scratch_path

BATCH_BYTES = 4 << 20  # text handed on at once by Python tasks


ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def map_arrow(df: DataFrame, run, schema: str | T.StructType) -> DataFrame:
    """``mapInArrow`` in workers that find this package where the driver has it (or where ``--py-files`` put it)."""
    importable(df.sparkSession)
    return df.mapInArrow(run, schema)


def importable(spark: SparkSession) -> None:
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [env.get("PYTHONPATH"), ROOT]))


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


#: Spark's setting to delete an execution's shuffle files at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts the lineage, survives lost executors.

    The shuffle files of the write serve nothing afterwards and are deleted with its end.
    """
    path, conf = scratch_path(df.sparkSession, name), df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)
    again = df.sparkSession.read.schema(df.schema).parquet(path)
    again.scratch = path
    return again


def discard(*tables: DataFrame) -> None:
    """Delete the files of ``written`` tables that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.scratch)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


BITS = 1 << 26  # of a bitmap of keys: 8 MB, whatever their number
BLOCK = 1 << 15  # bits in a row of it, as Spark's functions make them


def bit_of(*keys: Column) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(BITS))


def bitmap(at: DataFrame) -> DataFrame:
    """(block, bits) with a bit set for each value of the one column of ``at``: BITS / BLOCK rows of 4 KB at most."""
    marks = at.toDF("at").select(F.expr(f"at div {BLOCK}").alias("block"), (F.col("at") % BLOCK).alias("bit"))
    return marks.groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bits"))


def split_by_keys(df: DataFrame, at: Column, marks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of ``df`` whose bit is not set in the ``bitmap``, and the others: only these need an exact join with the keys."""
    spot, block, bits = fresh("spot"), fresh("block"), fresh("bits")
    held = F.broadcast(marks.select(F.col("block").alias(block), F.col("bits").alias(bits)))
    with_bits = df.withColumn(spot, at).join(held, F.expr(f"{spot} div {BLOCK}") == F.col(block), "left")
    byte = f"cast(conv(hex(substring({bits}, cast({spot} % {BLOCK} div 8 as int) + 1, 1)), 16, 10) as int)"
    is_set = F.coalesce(F.expr(f"shiftright({byte}, cast({spot} % 8 as int)) & 1 = 1"), F.lit(False))
    back = lambda rows: rows.drop(spot, block, bits)
    return back(with_bits.where(~is_set)), back(with_bits.where(is_set))


def fresh(prefix: str) -> str:
    """A column name that no input has."""
    return f"__{prefix}_{uuid.uuid4().hex[:8]}"


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds about ``limit`` bytes of text, or a single longer row."""
    for batch in batches:
        start, size = 0, 0
        for i, n in enumerate(pc.binary_length(batch.column(column)).to_pylist()):
            size += n or 0
            if size >= limit:
                yield batch.slice(start, i + 1 - start)
                start, size = i + 1, 0
        if start < batch.num_rows:
            yield batch.slice(start)
