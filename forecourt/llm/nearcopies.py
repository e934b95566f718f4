"""Near copies by exact similarity of word shingles: SimHash tables and MinHash bands find candidates, shingle sets decide.

Two documents are linked if the sets of their five-word shingles have a Jaccard similarity of
0.8 or more. Equal sets are one node from the start. Candidates come from the covering tables
of SimHash fingerprints (equal ones and those at most two bits apart) and, as copies at 0.8
differ in more bits than such tables reach, from 24 bands of five minimum hashes: of pairs at
0.8 one in 14000 (0.67^24) shares no band, of closer ones fewer.

Nodes of one fingerprint share a bucket too. Each of the rounds before the last chooses a leader in
every bucket that still holds several components (outside the largest one, from the second
round on, and never the same again), the node with most company in all its buckets, and compares
it with the bucket's nodes of other components: a round is linear in the buckets' sizes and
leaves few components. The last round compares all nodes of a bucket that are still in different
components, in tiles of ``TILE`` by ``TILE`` nodes, so that no candidate is left out and no task
holds a bucket. Pairs whose sizes or odd bits exclude 0.8 are never written.

A set's odd bits say of each of 512 classes of shingles whether the set holds an odd number of them.
Where two sets' bits differ, at least one shingle is in only one of them, so that the number of
differing bits bounds their difference from below: no link is lost. In a group whose members are all
somewhat alike, nearly all pairs below 0.8 end there, as a count of bits inside the join. Sets of more
than about 800 shingles differ in too many bits to tell, and are compared as before.

Only texts in a comparison get their sets written, chosen by a bitmap of fixed size, and sets
travel once for each pair. What a round has written is deleted when its links are known.

Words are those of the fingerprint (A-Z lowered, ASCII white space); a shorter text is one
shingle, an empty or null one has none and is a copy of other such ones. Rows that share a
doc_id are told apart by their texts; null ids take part. Other columns are ignored, or kept
by ``keep``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from forecourt.llm import simhash
from forecourt.llm.common import BITS, BLOCK, bit_of, bitmap, discard, map_arrow, slices, split_by_keys, written
from forecourt.llm.graph import components
from forecourt.llm.simhash import first_rows, keyed

SHINGLE = 5
BANDS, ROWS = 24, 5
ROUNDS = 3
TILE = 256
ODD = 8  # longs of odd bits
SEED = 42
_FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, (2, BANDS * ROWS), np.uint64)
_FACTORS[0] |= np.uint64(1)

SKETCH = "doc_id long, text_hash long, node binary, size int, fp long, bands array<long>, odd array<long>"
SETS = "node binary, grams array<long>"


def grams(text: str | None, n: int = SHINGLE) -> np.ndarray:
    """The hashes of all shingles, in order."""
    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    found = map(b" ".join, zip(*(words[i:] for i in range(n)))) if len(words) >= n else [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(g, SEED) for g in found), "<u8")


def shingles(text: str | None) -> np.ndarray:
    """The distinct shingles' hashes, ascending."""
    return np.unique(grams(text))


def bands(hashes: np.ndarray) -> tuple[list[int]]:
    """A key for each band; a set without shingles has none."""
    if not len(hashes):
        return ([],)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 1 << 10):
        least = np.minimum(least, (hashes[at : at + (1 << 10), None] * _FACTORS[0] + _FACTORS[1]).min(axis=0))
    return ([xxhash.xxh64_intdigest(b.tobytes(), i) - (1 << 63) for i, b in enumerate(least.reshape(BANDS, ROWS))],)


def odd_bits(hashes: np.ndarray) -> list[int]:
    """A bit for each class of distinct hashes: whether their number is odd."""
    odd = np.bincount((hashes & np.uint64(64 * ODD - 1)).astype(np.int64), minlength=64 * ODD) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8").tolist()


def sketches(docs: DataFrame) -> DataFrame:
    """Key, node (a hash of the set), size, fingerprint, bands and odd bits of every row."""
    names = [c.split()[0] for c in SKETCH.split(", ")]
    types = [pa.binary(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = []
            for text in batch.column("text").to_pylist():
                all_of_them = grams(text)
                distinct = np.unique(all_of_them)
                fp = int(np.uint64(simhash.majority(all_of_them)).view(np.int64))
                found.append((xxhash.xxh3_128_digest(distinct.tobytes()), len(distinct), fp, *bands(distinct), odd_bits(distinct)))
            columns = [batch.column("doc_id"), batch.column("text_hash"), *[pa.array(c, t) for c, t in zip(zip(*found), types)]]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return map_arrow(keyed(docs), run, SKETCH)


def _marks(heads: DataFrame) -> bytes:
    """A bitmap of the keys (doc_id, text_hash) of ``heads``: BITS / 8 bytes at most reach the driver."""
    out = np.zeros(BITS >> 3, np.uint8)
    for block, marked in bitmap(heads.select(bit_of(F.col("doc_id"), F.col("text_hash")))).collect():
        out[block * BLOCK // 8 :][: BLOCK // 8] = np.frombuffer(bytes(marked), np.uint8)
    return out.tobytes()


def _sets(docs: DataFrame, heads: DataFrame) -> DataFrame:
    """(node, grams) of the rows that ``heads`` names, and of a few more."""
    marks = docs.sparkSession.sparkContext.broadcast(_marks(heads))
    rows = keyed(docs).withColumn("at", bit_of(F.col("doc_id"), F.col("text_hash")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.frombuffer(marks.value, np.uint8)
        for batch in slices(batches):
            at = batch.column("at").to_numpy()
            wanted = batch.column("text").filter(pa.array((bitmap[at >> 3] >> (at & 7) & 1).astype(bool)))
            sets = [shingles(t) for t in wanted.to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["node", "grams"])

    return map_arrow(rows.select("at", "text"), run, SETS)


def _similar(docs: DataFrame, pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Of ``pairs`` (a, b) those with a similarity of 0.8 or more: 9 times the common shingles are 4 times both sizes."""
    wanted = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    heads = written(nodes.join(wanted, "node", "left_semi").select("node", "doc_id", "text_hash"), "heads")
    sets = written(_sets(docs, heads), "sets")
    one, two = sets.select(F.col("node").alias("b"), F.col("grams").alias("gb")), sets.select(F.col("node").alias("a"), F.col("grams").alias("ga"))
    common = F.size(F.array_intersect("ga", "gb"))
    found = pairs.join(one, "b").join(two, "a").where(9 * common >= 4 * (F.size("ga") + F.size("gb"))).select("a", "b")
    found = written(found, "near")
    discard(heads, sets)
    return found


def _by_fingerprint(nodes: DataFrame) -> DataFrame:
    """Candidates (a, b) from the covering tables: nodes of one fingerprint with one of them, and those of linked fingerprints."""
    some = written(nodes.where("size > 0").groupBy("fp").agg(F.min("node").alias("a")), "fingerprints")
    equal = nodes.where("size > 0").join(some, "fp").where("a <> node").select("a", F.col("node").alias("b"))
    links = simhash.links(some.select("fp"))
    one, two = some.select(F.col("fp").alias("fa"), "a"), some.select(F.col("fp").alias("fb"), F.col("a").alias("b"))
    near = links.select(F.col("a").alias("fa"), F.col("b").alias("fb")).join(one, "fa").join(two, "fb").select("a", "b")
    return equal.unionByName(near)


def _close(a: str, b: str) -> str:
    return f"5 * least({a}, {b}) >= 4 * greatest({a}, {b})"  # no similarity is above the sizes' ratio


def _even(a: str, b: str) -> str:
    """Whether columns ``odd{a}`` and ``odd{b}`` allow 0.8: then 9 times the difference is at most both sizes. Without bits, yes."""
    differing = " + ".join(f"bit_count(get(odd{a}, {i}) ^ get(odd{b}, {i}))" for i in range(ODD))
    return f"coalesce(9 * ({differing}) <= size{a} + size{b}, true)"


def _members(nodes: DataFrame) -> DataFrame:
    """(key, node, size, company, odd) of the nodes in buckets of two or more; company: over all a node's buckets."""
    keys = F.when(F.col("size") > 0, F.concat("bands", F.array(F.xxhash64("fp"))))
    placed = nodes.select("node", "size", F.explode(keys).alias("key")).select("key", "node", "size")
    buckets = written(placed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "buckets")
    marks = written(bitmap(buckets.select(bit_of(F.col("key")))), "marks")
    _, shared = split_by_keys(placed, bit_of(F.col("key")), marks)  # most bands are in no other node: they stay where they are
    together = written(shared.join(buckets, "key"), "together")
    company = together.groupBy("node").agg(F.sum("n").alias("company"))
    members = written(together.drop("n").join(company.join(nodes.select("node", "odd"), "node"), "node"), "members")
    discard(buckets, marks, together)
    return members


def _candidates(members: DataFrame, roots: DataFrame | None, led: DataFrame | None, last: bool) -> tuple[DataFrame, DataFrame | None]:
    """Pairs (a, b) of a round, and the leaders (key, node) of all rounds so far. ``members`` without odd bits are told apart by size."""
    if "odd" not in members.columns:
        members = members.withColumn("odd", F.lit(None).cast("array<long>"))
    if roots is None:
        named = members.withColumn("root", F.col("node"))
        free = named
    else:
        named = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        sizes = named.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"))
        mixed = sizes.groupBy("key").agg(F.max(F.struct("n", "root"))["root"].alias("main"), F.count(F.lit(1)).alias("roots")).where("roots > 1")
        named = written(named.join(mixed.select("key", "main"), "key"), "named")
        free = named.where("root <> main").join(led, ["key", "node"], "left_anti")
    if last:
        return _distinct(_rest(named)), led
    lead = free.groupBy("key").agg(F.max(F.struct("company", "node", "size", "root", "odd")).alias("l"))
    lead = written(lead.select("key", F.col("l.node").alias("a"), F.col("l.size").alias("size_a"), F.col("l.root").alias("root_a"), F.col("l.odd").alias("odd_a")), "leads")
    pairs = named.join(lead, "key").where("root <> root_a").where(_close("size_a", "size")).where(_even("_a", "")).select("a", F.col("node").alias("b"))
    leaders = lead.select("key", F.col("a").alias("node"))
    return _distinct(pairs), leaders if led is None else led.unionByName(leaders)


def _distinct(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _rest(named: DataFrame) -> DataFrame:
    """Pairs of nodes of one bucket and different components: each tile of a bucket meets each, in a group of its own."""
    tiles = named.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / TILE).alias("tiles"))
    dealt = named.join(tiles, "key").withColumn("tile", F.pmod(F.xxhash64("node"), "tiles"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1))
    one = dealt.select("key", F.col("tile").alias("ta"), every.alias("tb"), F.col("node").alias("a"), F.col("size").alias("size_a"), F.col("root").alias("root_a"), F.col("odd").alias("odd_a"))
    two = dealt.select("key", every.alias("ta"), F.col("tile").alias("tb"), F.col("node").alias("b"), F.col("size").alias("size_b"), F.col("root").alias("root_b"), F.col("odd").alias("odd_b"))
    return one.join(two, ["key", "ta", "tb"]).where("a < b AND root_a <> root_b").where(_close("size_a", "size_b")).where(_even("_a", "_b")).select("a", "b")


def links(docs: DataFrame, sketched: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(node, root) of the nodes of all components of several, but the roots."""
    head = F.min_by(F.struct("doc_id", "text_hash", "size", "fp", "bands", "odd"), F.struct("doc_id", "text_hash")).alias("h")
    nodes = written(sketched.groupBy("node").agg(head).select("node", "h.*"), "nodes")
    members = _members(nodes)
    pairs, led = _candidates(members, None, None, rounds == 1)
    pairs = written(_distinct(pairs.unionByName(_by_fingerprint(nodes))), "pairs")
    near = _similar(docs, pairs, nodes)
    found, seen = written(components(near), "found"), pairs
    for r in range(1, rounds):
        pairs, led = _candidates(members, found, led, r == rounds - 1)
        pairs = written(pairs.join(seen, ["a", "b"], "left_anti"), "pairs")
        if pairs.isEmpty():
            continue  # the last round may still have some
        more, last = _similar(docs, pairs, nodes), found
        if not more.isEmpty():
            near = near.unionByName(more)
            found = written(components(near), "found")
            discard(last)
        seen = seen.unionByName(pairs)
    discard(nodes, members)
    return found


def keep(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for each group of near copies (see ``first_rows``), with all its columns."""
    sketched = written(sketches(docs), "sketches")
    found = links(docs, sketched)
    marked = written(sketched.select("doc_id", "text_hash", "node"), "marked")
    discard(sketched)
    return first_rows(docs, marked, found)
