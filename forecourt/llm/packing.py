"""Best-fit packing of documents into sequences, improved by swap-based local search.

Documents are encoded once into a narrow table of pieces (no token moves afterwards). Pieces
are dealt evenly to shards of a fixed expected size; each shard starts from best-fit
decreasing and then empties its least filled sequences by exchanges that raise the sum of
squared fills: a move, one document for one, or two for one. Sequences that stay underfull
go on to a next round with as many shards as their pieces need, where the search exchanges
documents between the sequences of different shards. A lone piece beside which not even the
shortest piece left fits is closed. Rounds end with one shard, or when one empties no
sequence. So no task ever holds much more than a shard, whatever the lengths.

Null texts are empty documents, which still hold the end id. Rows that share a doc_id are
packed each. An empty table gives an empty result. Other columns of the input are ignored.
"""

from __future__ import annotations

import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from forecourt.llm import tokens
from forecourt.llm.common import importable, map_arrow, slices, written

CAPACITY = 4096
SHARD = 8192  # pieces in a shard, expected
ROUNDS = 127  # that a bin's number can name
SLACK = 64  # a sequence with more room than this is underfull

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = f"{PIECES}, bin long, fill long"


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 1, kind: str = "word") -> DataFrame:
    """Encode ``text``, add the end id, cut longer documents: one row per piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = tokens.load(kind, path).encode, array("I", [end_id]).tobytes()
        names = ("doc_id", "piece", "start", "length", "ids_crc32")
        types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        for batch in slices(batches):
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = encode(text or "") + end
                for i, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc, i, at // 4, len(part) // 4, zlib.crc32(part)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, PIECES)


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """Bin of each item: longest first, into the fullest bin that has room."""
    bins = np.empty(len(lengths), np.int64)
    room: list[tuple[int, int]] = []  # (free, bin), ascending
    count = 0
    for i in np.argsort(-lengths, kind="stable"):
        n = int(lengths[i])
        at = bisect_left(room, (n, -1))
        if at < len(room):
            free, b = room.pop(at)
        else:
            free, b = capacity, count
            count += 1
        bins[i] = b
        if free > n:
            insort(room, (free - n, b))
    return bins


def fewest(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """A lower bound of the number of bins (Martello and Toth): every item over half the capacity
    needs its own, and those over capacity - k leave no room for items of k or more."""
    if not len(lengths):
        return 0
    n = np.sort(lengths.astype(np.int64))
    upto = np.concatenate([[0], np.cumsum(n)])
    half = np.searchsorted(n, capacity // 2, "right")
    k = np.unique(np.append(n[:half], 0))
    small, full = np.searchsorted(n, k, "left"), np.searchsorted(n, capacity - k, "right")
    room = (full - half) * capacity - (upto[full] - upto[half])
    more = -(-(upto[half] - upto[small] - room) // capacity)
    return int((len(n) - half + np.maximum(0, more)).max())


def local_search(lengths: np.ndarray, bins: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """Empty the least filled bins by exchanges with fuller ones, while there may be a bin too many.

    Every exchange takes tokens from the bin being emptied to one at least as full, so the sum
    of squared fills grows and the search ends. It stops at a lower bound of the number of bins,
    or when no bin can be emptied.
    """
    lengths, bins = lengths.astype(np.int64), np.unique(bins, return_inverse=True)[1].astype(np.int64)
    count = int(bins.max(initial=-1)) + 1
    fill = np.bincount(bins, lengths, count).astype(np.int64)
    least = fewest(lengths, capacity)
    alive, stuck = count, set()
    while alive > least:
        open_ = [b for b in np.argsort(fill, kind="stable").tolist() if 0 < fill[b] < capacity and b not in stuck]
        if not open_:
            break
        b = open_[0]
        while fill[b] and _exchange(lengths, bins, fill, b, capacity):
            pass
        if fill[b]:
            stuck.add(b)
        else:
            alive -= 1
            stuck.clear()  # the exchanges before may have made room elsewhere
    return bins


def _exchange(lengths: np.ndarray, bins: np.ndarray, fill: np.ndarray, b: int, capacity: int) -> bool:
    """The exchange that takes most tokens out of ``b``: a move, one for one, or else two for one."""
    own = np.flatnonzero(bins == b)
    fuller = (fill >= fill[b]) & (fill < capacity)
    fuller[b] = False
    targets = np.flatnonzero(fuller)
    if not len(targets):
        return False
    room = capacity - fill[targets]
    for i in own[np.argsort(-lengths[own], kind="stable")]:
        fits = np.flatnonzero(room >= lengths[i])
        if len(fits):
            return _apply(lengths, bins, fill, [i], [], b, targets[fits[np.argmin(room[fits])]])
    others = np.flatnonzero(fuller[bins])
    space = capacity - fill[bins[others]]
    found = _best_swap(lengths[own], lengths[others], space)
    if found:
        i, j = found
        return _apply(lengths, bins, fill, [own[i]], [others[j]], b, bins[others[j]])
    first, second = np.triu_indices(len(own), 1)
    sums, at = np.unique(lengths[own[first]] + lengths[own[second]], return_index=True)
    found = _best_swap(sums, lengths[others], space)
    if found:
        k, j = at[found[0]], found[1]
        return _apply(lengths, bins, fill, [own[first[k]], own[second[k]]], [others[j]], b, bins[others[j]])
    return False


def _best_swap(gives: np.ndarray, takes: np.ndarray, space: np.ndarray) -> tuple[int, int] | None:
    best, pair = 0, None
    values, at = np.unique(gives, return_index=True)
    for value, i in zip(values[::-1].tolist(), at[::-1].tolist()):
        gain = value - takes
        gain[gain > space] = 0
        j = int(gain.argmax()) if len(gain) else 0
        if len(gain) and gain[j] > best:
            best, pair = int(gain[j]), (i, j)
    return pair


def _apply(lengths, bins, fill, out: list[int], back: list[int], b: int, target: int) -> bool:
    moved = int(lengths[out].sum() - lengths[back].sum())
    bins[out], bins[back] = target, b
    fill[target] += moved
    fill[b] -= moved
    return True


def _round(items: DataFrame, shards: int, number: int, capacity: int) -> DataFrame:
    """Search within each shard; ``bin`` is unique over all rounds and shards."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        lengths = rows["length"].to_numpy()
        start = best_fit_decreasing(lengths, capacity) if number == 0 else rows["bin"].to_numpy()
        bins = local_search(lengths, start, capacity)
        fill = np.bincount(bins, lengths).astype(np.int64)
        # rounds are few, shards below 2^28 and bins of a shard below 2^28
        rows = rows.drop(columns="shard").assign(bin=(number << 56) + (int(key[0]) << 28) + bins, fill=fill[bins])
        return rows[[c.split()[0] for c in PLACED.split(", ")]]

    importable(items.sparkSession)
    return items.groupBy("shard").applyInPandas(run, PLACED)


def place(items: DataFrame, capacity: int = CAPACITY, shard: int = SHARD) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to a table of pieces; runs one job per round."""
    items = written(items, "pieces")
    shards = max(1, -(-items.count() // shard))
    deal = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards))  # even, whatever the keys
    items, done, number = items.withColumns({"bin": F.lit(0).cast("long"), "shard": deal}), [], 0
    bins = None
    while True:
        out = written(_round(items, shards, number, capacity), f"packed{number}")
        if shards == 1 or number + 1 == ROUNDS or (bins is not None and bins == out.select("bin").distinct().count()):
            done.append(out)
            break
        underfull = F.col("fill") < capacity - SLACK
        shortest = out.where(underfull).agg(F.min("length")).first()[0]
        if shortest is not None:  # a lone piece with less room than this can share with none
            underfull &= (F.col("fill") > F.col("length")) | (F.col("fill") <= capacity - shortest)
        done.append(out.where(~underfull))
        left, bins = out.where(underfull).agg(F.count(F.lit(1)), F.count_distinct("bin")).first()
        if not left:
            break
        shards, number = max(1, -(-left // shard)), number + 1
        deal = F.pmod(F.xxhash64("bin", F.lit(number)), F.lit(shards))  # the pieces of a sequence stay together
        items = out.where(underfull).drop("fill").withColumn("shard", deal)
    placed = done[0]
    for part in done[1:]:
        placed = placed.unionByName(part)
    return _offsets(placed)


def _offsets(placed: DataFrame) -> DataFrame:
    """Places within each sequence; a sequence has at most ``capacity`` rows."""
    from pyspark.sql import Window

    order = Window.partitionBy("bin").orderBy("doc_id", "piece", "ids_crc32").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("length").over(order), F.lit(0)).cast("long")
    return placed.select(*[c.split()[0] for c in PIECES.split(", ")], F.col("bin").alias("sequence_id"), offset.alias("offset"))


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 1, shard: int = SHARD) -> DataFrame:
    """Pack whole documents into sequences of at most ``capacity`` tokens; only longer documents are cut."""
    return place(pieces(docs, path, capacity, end_id), capacity, shard)
