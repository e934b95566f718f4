"""Token ids as ORC files: integer run-length encoded stripes in doc_id order, with row indexes and Bloom filters.

Texts are dealt by doc_id ranges and sorted, each task encodes its range and writes it as
ORC: ids as a list of integers (run-length encoded), a row index entry every ``ROWS``
documents, a Bloom filter on doc_id. Splits are read stripe by stripe in parallel; a filter
on doc_id prunes files and stripes by their minima and maxima and row groups by the filter.
Each row keeps where it starts within its file; one row per file then gives the files' own
starts, so no ids move for the positions.

Null texts are empty documents, which still get the end id. Null doc_ids come first. Rows
that share a doc_id stand in the order of their texts. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from forecourt.llm import tokens
from forecourt.llm.common import map_arrow, slices

ROWS = 1000  # documents between entries of the row index
STRIPE = 64 << 20
SCHEMA = "file int, doc_id long, local_start long, n_tokens long, ids array<int>"


def write(docs: DataFrame, path: str, out: str, end_id: int = 2, kind: str = "byte", stripe_bytes: int = STRIPE, index_rows: int = ROWS) -> None:
    """Encode every text, append the end id and write ORC files in ascending doc_id order to ``out``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = tokens.load(kind, path).encode, array("I", [end_id]).tobytes()
        file, at = TaskContext.get().partitionId(), 0
        for batch in slices(batches):
            ids = [encode(t or "") + end for t in batch.column("text").to_pylist()]
            lengths = np.array([len(i) // 4 for i in ids], np.int64)
            ends = np.cumsum(lengths)
            lists = pa.ListArray.from_arrays(np.concatenate([[0], ends]).astype(np.int32), np.frombuffer(b"".join(ids), np.int32))
            columns = [np.full(len(ids), file, np.int32), batch.column("doc_id"), at + ends - lengths, lengths, lists]
            at += int(ends[-1])
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=["file", "doc_id", "local_start", "n_tokens", "ids"])

    ordered = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    options = {
        "orc.compress": "ZSTD", "orc.stripe.size": str(stripe_bytes), "orc.row.index.stride": str(index_rows),
        "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01",
    }
    map_arrow(ordered, run, SCHEMA).write.options(**options).orc(out)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The documents of the files; filter on doc_id to prune by metadata."""
    return spark.read.schema(SCHEMA).orc(path)


def file_starts(stored: DataFrame) -> DataFrame:
    """Ids in all files before each; reads one narrow column, and has a row per file."""
    sizes = stored.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # over one row per file
    return sizes.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long").alias("file_start"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            values, offsets = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            sums = [zlib.crc32(values[a:b].astype("<u4").tobytes()) for a, b in zip(offsets, offsets[1:])]
            kept = [batch.column(c) for c in ("file", "doc_id", "local_start", "n_tokens")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sums, pa.int64())], names=["file", "doc_id", "local_start", "n_tokens", "ids_crc32"])

    stored = read(spark, path)
    sums = map_arrow(stored, run, "file int, doc_id long, local_start long, n_tokens long, ids_crc32 long")
    start = (F.col("file_start") + F.col("local_start")).alias("start")
    return sums.join(file_starts(stored), "file").select("doc_id", start, "n_tokens", "ids_crc32")
