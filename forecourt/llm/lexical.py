"""Ranked lexical search: document FP-trees, searched by branch and bound.

One pass reduces every document to its length and its counts of the items' terms. Terms are
put in order of frequency; documents, as sequences of their terms in that order, share the
paths of a trie, built over ``SHARD`` documents at a time. Every node knows, for each term
of its subtree, the highest count tf in one document, and the smallest length measure m: as
a term's score grows with tf and falls with m, their sum over an item's terms bounds every
score below. Each item goes through the trie depth first, best bound first, and leaves out
subtrees that cannot reach its k-th best. What a task has found bounds its next trees. Paths
without branches are one edge; small siblings share a leaf.

Each task gives k documents for each item at most, of which the first are chosen in two
steps. Items are taken in blocks of about ``BLOCK`` bytes of text, each with its own pass, so
what the tasks are sent is bounded whatever the number of items.

Null texts hold no term. Rows are ranked each, repeated or not; null doc_ids come last among
equal scores. Equal item rows are one item; a null item_id is an id like any other, and an
item without terms has no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from forecourt.llm.common import map_arrow, slices, written

SHARD = 1 << 14
ENTRIES = 1 << 21  # terms of all documents of a tree
LEAF = 64
BLOCK = 8 << 20
SALTS = 256
SCALE = 1_000_000_000

_KEEP = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).lower()


def terms(text: bytes | None) -> list[bytes]:
    """Runs of letters, digits and non-ASCII characters, A-Z lowered."""
    return (text or b"").translate(_KEEP).split()


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


VECTORS = "doc_id long, n long, term array<int>, tf array<int>"


def vectors(docs: DataFrame, number: dict[bytes, int]) -> DataFrame:
    """Length of every document with a term, and its counts of the ``number``ed ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = number.keys()
        for batch in slices(batches):
            ids, n, term, tf = [], [], [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                if found := terms(text):
                    counts = Counter(found)
                    both = [*(counts.keys() & known)]
                    ids.append(doc_id)
                    n.append(len(found))
                    term.append([number[t] for t in both])
                    tf.append([counts[t] for t in both])
            columns = [pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(term, pa.list_(pa.int32())), pa.array(tf, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "term", "tf"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")), run, VECTORS)


def gains(w: np.ndarray, tf: np.ndarray, m: np.ndarray | int) -> np.ndarray:
    """What a term adds to a score."""
    return w * (SCALE * tf // (1000 * tf + 8 * m))


@dataclass
class Node:
    """A subtree: its documents' range in order, its terms with their highest tf, its smallest m and doc_id."""

    first: int
    last: int
    term: np.ndarray
    tf: np.ndarray
    m: int
    least_id: tuple
    children: list[Node] = field(default_factory=list)


@dataclass
class Tree:
    """Documents in the order of their term sequences; ``start`` has where each one's entries begin."""

    doc_id: np.ndarray
    missing: np.ndarray  # ids that are null
    m: np.ndarray
    start: np.ndarray
    term: np.ndarray  # by rank of frequency, ascending within a document
    tf: np.ndarray
    root: Node | None = None

    def grow(self, leaf: int = LEAF) -> Tree:
        shared = self._shared()
        n = len(self.doc_id)
        # Ranges still to be made nodes of; children come before their parents in ``made``, reversed.
        root = [0, n, None]
        todo, made = [root], []
        while todo:
            part = todo.pop()
            made.append(part)
            first, last, _ = part
            inside = shared[first + 1 : last]
            depth = int(inside.min()) if len(inside) else 0
            part.append([])
            if last - first <= leaf or depth >= self._longest(first, last):
                continue
            cuts = [first, *(first + 1 + np.flatnonzero(inside == depth)).tolist(), last]
            begin = cuts[0]
            for a, b in zip(cuts, cuts[1:]):
                if b - a > leaf or b - begin > leaf:  # small siblings until now, then this one
                    if a > begin:
                        part[3].append([begin, a, None])
                    begin = a
                    if b - a > leaf:
                        part[3].append([a, b, None])
                        begin = b
            if last > begin:
                part[3].append([begin, last, None])
            if len(part[3]) == 1:
                part[3] = []
            todo += part[3]
        for part in reversed(made):
            children = [c[2] for c in part[3]]
            part[2] = self._node(part[0], part[1], children)
        self.root = root[2]
        return self

    def _shared(self) -> np.ndarray:
        """How many terms each document's sequence has in common with the one before it."""
        out = np.zeros(len(self.doc_id), np.int64)
        for i in range(1, len(out)):
            a, b = self.term[self.start[i - 1] : self.start[i]], self.term[self.start[i] : self.start[i + 1]]
            k = min(len(a), len(b))
            differ = np.flatnonzero(a[:k] != b[:k])
            out[i] = differ[0] if len(differ) else k
        return out

    def _longest(self, first: int, last: int) -> int:
        return int(np.diff(self.start[first : last + 1]).max())

    def _node(self, first: int, last: int, children: list[Node]) -> Node:
        if children:
            term, tf = np.concatenate([c.term for c in children]), np.concatenate([c.tf for c in children])
            m, least_id = min(c.m for c in children), min(c.least_id for c in children)
        else:
            at = slice(self.start[first], self.start[last])
            term, tf = self.term[at], self.tf[at]
            m = int(self.m[first:last].min())
            least_id = min(zip(self.missing[first:last].tolist(), self.doc_id[first:last].tolist()))
        order = np.argsort(term, kind="stable")
        term = term[order]
        begins = np.flatnonzero(np.diff(term, prepend=-1))
        return Node(first, last, term[begins], np.maximum.reduceat(tf[order], begins), m, least_id, children)

    def bound(self, node: Node, term: np.ndarray, w: np.ndarray) -> int:
        at = np.searchsorted(node.term, term)
        here = node.term[np.minimum(at, len(node.term) - 1)] == term
        return int(gains(w[here], node.tf[at[here]], node.m).sum())

    def scores(self, node: Node, w_of: np.ndarray) -> np.ndarray:
        """Exact scores of a leaf's documents, given every term's weight in the item, or 0."""
        begin, end = self.start[node.first], self.start[node.last]
        term = self.term[begin:end]
        at = np.flatnonzero(w_of[term])
        doc = np.searchsorted(self.start[node.first : node.last + 1], begin + at, side="right") - 1
        out = np.zeros(node.last - node.first, np.int64)
        np.add.at(out, doc, gains(w_of[term[at]], self.tf[begin:end][at], self.m[node.first : node.last][doc]))
        return out


@dataclass
class Best:
    """An item's best documents so far, in order."""

    k: int
    score: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    missing: np.ndarray = field(default_factory=lambda: np.zeros(0, bool))
    doc_id: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    def beaten_by(self, score: int, least_id: tuple) -> bool:
        if score <= 0 or not self.k:
            return False
        if len(self.score) < self.k or score > self.score[-1]:
            return True
        return score == self.score[-1] and least_id < (bool(self.missing[-1]), int(self.doc_id[-1]))

    def offer(self, score: np.ndarray, missing: np.ndarray, doc_id: np.ndarray) -> None:
        least = self.score[-1] if len(self.score) == self.k else 1
        at = np.flatnonzero(score >= max(least, 1))
        if not len(at):
            return
        score, missing, doc_id = (np.concatenate([a, b[at]]) for a, b in ((self.score, score), (self.missing, missing), (self.doc_id, doc_id)))
        order = np.lexsort((doc_id, missing, -score))[: self.k]
        self.score, self.missing, self.doc_id = score[order], missing[order], doc_id[order]


def search(tree: Tree, term: np.ndarray, w: np.ndarray, w_of: np.ndarray, best: Best) -> int:
    """Depth first, the best bound first; the number of documents scored. ``w_of`` has ``w`` at ``term``, 0 elsewhere."""
    scored, stack = 0, [(tree.bound(tree.root, term, w), tree.root)]
    while stack:
        bound, node = stack.pop()
        if not best.beaten_by(bound, node.least_id):
            continue
        if node.children:
            below = [(tree.bound(c, term, w), c) for c in node.children]
            stack += sorted((x for x in below if best.beaten_by(x[0], x[1].least_id)), key=lambda x: x[0])
        else:
            at = slice(node.first, node.last)
            best.offer(tree.scores(node, w_of), tree.missing[at], tree.doc_id[at])
            scored += node.last - node.first
    return scored


def trees(batches: Iterator[pa.RecordBatch], rank: np.ndarray, documents: int, length: int, shard: int = SHARD, entries: int = ENTRIES) -> Iterator[Tree]:
    """Trees over the documents that have any of the terms; ``rank``: each term's place by frequency."""
    held, n, size = [], 0, 0
    for batch in batches:
        for at in range(0, batch.num_rows, shard):
            part = batch.slice(at, shard)
            held.append(part)
            n, size = n + part.num_rows, size + len(part.column("term").flatten())
            if n >= shard or size >= entries:
                yield _tree(held, rank, documents, length)
                held, n, size = [], 0, 0
    if n:
        yield _tree(held, rank, documents, length)


def _tree(held: list[pa.RecordBatch], rank: np.ndarray, documents: int, length: int) -> Tree:
    table = pa.Table.from_batches(held).combine_chunks()
    doc_id, n = table.column("doc_id"), table.column("n").to_numpy()
    lists = table.column("term")
    sizes = np.diff(np.append(0, np.cumsum(pc.list_value_length(lists).to_numpy())))
    term, tf = rank[np.asarray(pc.list_flatten(lists))], np.asarray(pc.list_flatten(table.column("tf"))).astype(np.int64)
    doc = np.repeat(np.arange(len(n)), sizes)
    order = np.lexsort((term, doc))
    term, tf = term[order], tf[order]
    start = np.append(0, np.cumsum(sizes))
    keys = [term[a:b].astype(">u4").tobytes() for a, b in zip(start, start[1:])]  # bytes in the order of the sequences
    by_path = np.array(sorted(range(len(n)), key=keys.__getitem__), np.int64)
    at = np.concatenate([np.arange(start[i], start[i + 1]) for i in by_path])
    m = 10 + 90 * n[by_path] * documents // length
    missing = np.asarray(doc_id.is_null())[by_path]
    return Tree(np.asarray(doc_id.fill_null(0))[by_path], missing, m, np.append(0, np.cumsum(sizes[by_path])), term[at], tf[at]).grow()


def rank(docs: DataFrame, items: DataFrame, k: int = 10, block: int = BLOCK) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k documents of the highest score above 0, ties by doc_id."""
    rows = items.select("item_id", F.col("text").cast("binary").alias("text")).where("text IS NOT NULL").distinct()
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // block) or 1
    rows = rows.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    return reduce(DataFrame.unionByName, (_rank_block(docs, rows.where(F.col("block") == b).drop("block"), k) for b in range(blocks)))


def _rank_block(docs: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    spark = docs.sparkSession
    found = rows.toArrow()  # a block of bounded size
    number: dict[bytes, int] = {}
    wanted = [[number.setdefault(t, len(number)) for t in sorted(set(terms(x)))] for x in found.column("text").to_pylist()]
    stored = written(vectors(docs, number), "vectors")
    documents, length = stored.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(number), np.int64)
    counts = stored.select(F.explode("term").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).toArrow()  # a row for each of the block's terms
    df[counts.column("term").to_numpy()] = counts.column("df").to_numpy()
    by_frequency = np.lexsort((np.arange(len(df)), -df))
    place = np.empty(len(df), np.int32)
    place[by_frequency] = np.arange(len(df))
    w = np.array([weight(documents, d) for d in df[by_frequency].tolist()], np.int64)
    asked = [np.sort(place[np.array(t, np.int64)]) for t in wanted]
    sent = spark.sparkContext.broadcast((place, w, asked))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, w, asked = sent.value
        best, w_of = [Best(k) for _ in asked], np.zeros(len(w), np.int64)
        for tree in trees(batches, place, documents, length):
            for term, mine in zip(asked, best):
                w_of[term] = w[term]
                search(tree, term, w[term], w_of, mine)
                w_of[term] = 0
        items = np.repeat(np.arange(len(best)), [len(b.score) for b in best])
        join = lambda parts, kind: np.concatenate([np.zeros(0, kind), *parts])
        doc_id = pa.array(join([b.doc_id for b in best], np.int64), mask=join([b.missing for b in best], bool))
        yield pa.RecordBatch.from_arrays([pa.array(items, pa.int64()), doc_id, pa.array(join([b.score for b in best], np.int64))], names=["item", "doc_id", "score"])

    near = map_arrow(stored.where(F.size("term") > 0), run, "item long, doc_id long, score long")
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    part = F.pmod(F.spark_partition_id(), F.lit(SALTS))
    near = near.withColumn("part", part).withColumn("r", F.row_number().over(Window.partitionBy("item", "part").orderBy(*order))).where(F.col("r") <= k)
    near = near.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
    kind = rows.schema["item_id"].dataType
    names = spark.createDataFrame(pa.table({"item": pa.array(range(found.num_rows), pa.int64()), "item_id": found.column("item_id")})).withColumn("item_id", F.col("item_id").cast(kind))
    return near.join(names, "item").select("item_id", "rank", "doc_id", "score")
