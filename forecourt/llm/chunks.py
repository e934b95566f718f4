"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over the last bytes marks the ends of chunks, so that equal passages give
equal chunks wherever they stand. Documents are first dealt by the smallest hash among their
chunks (copies and near copies share it), as a rebalanced exchange in which Spark splits a
dealing that grows too large. Each task then encodes a chunk when it first meets it and
reuses its ids afterwards. A chunk's ids hold as they are only between the first and the
last blank that surely parts two pre-tokens; what lies around a join is encoded again, over
as many chunks as it takes until both sides reach such a blank, so the result is exact.

Null texts are empty: no ids. Equal rows are encoded each. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from forecourt.llm import tokens
from forecourt.llm.common import map_arrow, slices

WINDOW = 32  # bytes that a mark depends on; a power of two
MASK = 0xFF  # a chunk has 256 bytes on average
FACTOR = np.uint32(0x9E3779B1)
HELD = 64 << 20  # bytes of chunks a task remembers

#: White space after another character begins a pre-token, whatever follows.
PART = re.compile(r"(?<=[^\s\x1c-\x1f])[ \n]")

DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def rolling_hash(data: bytes, window: int = WINDOW) -> np.ndarray:
    """Hash of the ``window`` bytes up to each place, by doubling: H(2w)[i] = H(w)[i] + F^w * H(w)[i - w]."""
    h = np.frombuffer(data, np.uint8).astype(np.uint32) + np.uint32(1)
    factor, width = FACTOR, 1
    with np.errstate(over="ignore"):
        while width < window:
            h[width:] = h[width:] + factor * h[:-width]
            factor, width = factor * factor, width * 2
        return (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)


def cuts(data: bytes) -> list[int]:
    """Ends of chunks, the last one included; never within a character."""
    h = rolling_hash(data)
    marks = np.flatnonzero((h >> np.uint32(24)) & np.uint32(MASK) == 0) + 1
    marks = marks[marks < len(data)]
    starts = np.frombuffer(data, np.uint8)[marks] & 0xC0 != 0x80
    return [*marks[starts].tolist(), len(data)]


def chunked(data: bytes) -> list[bytes]:
    ends = cuts(data) if data else []
    return [data[a:b] for a, b in zip([0, *ends], ends)]


class Encoder:
    """Encodes documents out of chunks; one per task."""

    def __init__(self, tokenizer):
        self.tokenizer, self.known, self.size = tokenizer, {}, 0
        self.chunks_met = self.chunks_encoded = 0

    def chunk(self, raw: bytes) -> tuple[str, bytes | None, str]:
        """Text before the first parting blank, ids up to the last one, text from there on; ids None if there is none."""
        self.chunks_met += 1
        found = self.known.get(raw)
        if found is None:
            text = raw.decode("utf-8")
            at = [m.start() for m in PART.finditer(text)]
            if at:
                found = (text[: at[0]], self.tokenizer.encode(text[at[0] : at[-1]]), text[at[-1] :])
            else:
                found = (text, None, "")
            self.chunks_encoded += 1
            if self.size > HELD:
                self.known, self.size = {}, 0
            self.known[raw] = found
            self.size += 3 * len(raw) + 200
        return found

    def encode(self, text: str) -> bytes:
        ids, open_ = [], ""
        for head, inner, tail in map(self.chunk, chunked(text.encode("utf-8"))):
            open_ += head
            if inner is not None:  # both ends of what is open are certain now
                ids += [self.tokenizer.encode(open_), inner]
                open_ = tail
        ids.append(self.tokenizer.encode(open_))
        return b"".join(ids)


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids as binary of little-endian 32-bit integers, decoded text) of every row."""
    return _encoded(docs, path, "doc_id long, ids binary, decoded string", lambda doc, ids, text: (doc, ids, text))


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Number of ids and digests of ids and decoded text."""
    sha = lambda data: hashlib.sha256(data).hexdigest()
    return _encoded(docs, path, DIGESTS, lambda doc, ids, text: (doc, len(ids) // 4, sha(ids), sha(text.encode("utf-8"))))


def _encoded(docs: DataFrame, path: str, schema: str, row) -> DataFrame:
    types = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    fields = [tuple(f.split()) for f in schema.split(", ")]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keys = [smallest_chunk(t.encode("utf-8")) if t else 0 for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.int64())], names=["doc_id", "text", "deal"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = tokens.load("byte", path)
        encoder = Encoder(tokenizer)
        for batch in slices(batches):
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = encoder.encode(text or "")
                rows.append(row(doc, ids, tokenizer.decode(ids)))
            yield pa.RecordBatch.from_arrays([pa.array(c, types[t]) for c, (_, t) in zip(zip(*rows), fields)], names=[n for n, _ in fields])

    dealt = map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), deal, "doc_id long, text string, deal long")
    return map_arrow(dealt.hint("rebalance", F.col("deal")).select("doc_id", "text"), run, schema)


def smallest_chunk(data: bytes) -> int:
    """Smallest hash among the chunk ends: documents with most chunks in common mostly share it."""
    h = rolling_hash(data)
    ends = h[(h >> np.uint32(24)) & np.uint32(MASK) == 0]
    return int(ends.min()) if len(ends) else int(h[-1])
