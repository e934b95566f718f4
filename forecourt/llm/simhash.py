"""SimHash near-duplicates through covering locality-sensitive hashing.

Every bit of a fingerprint gets a non-zero vector of radius + 1 bits; a table keeps the bits
whose vector has an odd product with the table's own vector. Any ``radius`` differing bits
leave a table that keeps none of them, so every pair within the radius meets in one of the
2^(radius + 1) - 1 tables: seven for radius 2, each keeping 36 or 37 of 64 bits.

Equal fingerprints are one node from the start. A bucket of two nodes is compared; nodes of
larger buckets are checked without forming pairs: two of them are at most two bits apart
exactly if they, each with at most one bit turned, have a value in common. Such a value has
65 nodes around it at most, and all of them lie within the radius of each other.

Null texts are empty: fingerprint zero, linked like any other. Rows that share a doc_id are
one document given twice. Null doc_ids take part but name no component while another
doc_id does. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from forecourt.llm.common import bit_of, bitmap, map_arrow, slices, split_by_keys, written
from forecourt.llm.graph import components

BITS = 64
RADIUS = 2
SEED = 42


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64 bits of the shingles' hashes, each by majority."""
    words = (text or "").encode("utf-8").lower().split()  # of bytes: A-Z and ASCII white space only
    if not words:
        return 0
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    return majority(np.fromiter((digest(g, SEED) for g in grams), "<u8"))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        bits = np.unpackbits(hashes[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp) with the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = np.array([fingerprint(t, shingle) for t in batch.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found)], names=["doc_id", "fp"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, fp long")


def covering_masks(radius: int = RADIUS) -> list[int]:
    """One mask of kept bits per table."""
    size = (1 << (radius + 1)) - 1
    vector = [1 + i % size for i in range(BITS)]
    return [sum(1 << i for i in range(BITS) if (vector[i] & table).bit_count() % 2) for table in range(1, size + 1)]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def links(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp``: enough of them to join all that are within the radius."""
    if radius != 2:
        raise ValueError("the check of large buckets is made for radius 2")
    masks = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for t, m in enumerate(covering_masks(radius))])
    placed = nodes.select("fp", F.explode(masks).alias("p")).select("fp", "p.t", "p.key")
    buckets = placed.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b"))
    buckets = written(buckets.where("n > 1"), "buckets")
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius
    two = buckets.where((F.col("n") == 2) & close).select("a", "b")
    crowded = placed.join(buckets.where("n > 2").select("t", "key"), ["t", "key"], "left_semi").select("fp").distinct()
    turned = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(_signed(1 << i))) for i in range(BITS)])
    around = crowded.select("fp", F.explode(turned).alias("value")).groupBy("value").agg(F.collect_list("fp").alias("near"))
    around = around.where(F.size("near") > 1).select(F.array_min("near").alias("a"), F.explode("near").alias("b")).where("a <> b")
    return two.unionByName(around).distinct()


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id): the smallest doc_id that links lead to."""
    marked = written(fingerprints(docs, shingle), "fingerprints")
    nodes = written(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    found = components(links(nodes, radius))
    roots = found.select(F.col("root").alias("fp"), "root").distinct().unionByName(found.select(F.col("node").alias("fp"), "root"))
    member = roots.join(nodes, "fp")
    smallest = member.groupBy("root").agg(F.min("first").alias("component"))
    component = roots.join(smallest, "root").select("fp", "component")
    # Written, so that the last join is one of two plain shuffles, of which Spark splits large partitions.
    named = written(nodes.join(component, "fp", "left").select("fp", F.coalesce("component", "first").alias("component_id")), "named")
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, text): the first two name a document; equal keys are one document given twice."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), "text")


def first_rows(docs: DataFrame, marked: DataFrame, found: DataFrame) -> DataFrame:
    """The row of each component that stands first by doc_id (null last), text hash and hash of all columns.

    ``marked`` holds the key and the ``node`` of every row, ``found`` the ``root`` of every node
    but the roots. Of rows with one key and equal columns one stays.
    """
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash")
    best = marked.groupBy("node").agg(F.min(order).alias("o")).join(found, "node", "left")
    first = best.groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("o").alias("o")).select(F.col("o.doc_id").alias("__d"), F.col("o.text_hash").alias("__t"))
    rows = marked.groupBy(F.col("doc_id").alias("__d"), F.col("text_hash").alias("__t")).agg(F.count(F.lit(1)).alias("n"))
    first, rows = written(first, "firsts"), written(rows, "rows")
    match = rows["__d"].eqNullSafe(first["__d"]) & (rows["__t"] == first["__t"])
    gone = written(rows.join(first, match, "left_anti").drop("n"), "copies")
    again = written(rows.where("n > 1").join(first, match, "left_semi").drop("n"), "repeated")
    # Texts that are certainly kept stay where they are; only those that may be gone or repeated are joined.
    key_of = lambda d, t: bit_of(d, t).alias("at")
    marks = written(bitmap(gone.unionByName(again).select(key_of(F.col("__d"), F.col("__t")))), "marks")
    hashed = lambda rows: F.xxhash64(F.coalesce(rows["text"], F.lit("")))
    plain, some = split_by_keys(docs, key_of(docs["doc_id"].cast("long"), hashed(docs)), marks)
    doc, text = some["doc_id"].cast("long"), hashed(some)
    same = lambda keys: doc.eqNullSafe(keys["__d"]) & (text == keys["__t"])
    kept = some.join(gone, same(gone), "left_anti")
    if again.isEmpty():
        return plain.unionByName(kept)
    hashable = [f"`{f.name}`" for f in docs.schema if "map<" not in f.dataType.simpleString()]
    several = some.join(again, same(again), "left_semi").groupBy(doc.alias("__d"), text.alias("__t"))
    one = several.agg(F.min_by(F.struct(*[f"`{c}`" for c in docs.columns]), F.xxhash64(*hashable)).alias("one")).select("one.*")
    return plain.unionByName(kept.join(again, same(again), "left_anti")).unionByName(one)
