import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from forecourt.llm import packing

from . import cases

PATH = public_tokenizers.path("word_bpe_49k.json")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=60), st.booleans())
def test_search_keeps_items_and_never_needs_more_bins(lengths, alone):
    lengths = np.array(lengths, np.int64)
    start = np.arange(len(lengths)) if alone else packing.best_fit_decreasing(lengths, 100)
    bins = packing.local_search(lengths, start, 100)
    fill = np.bincount(bins, lengths) if len(bins) else np.zeros(0)
    assert len(bins) == len(lengths) and (fill <= 100).all()
    assert len(set(bins)) <= max(len(set(start)), 0) and len(set(bins)) >= -(-lengths.sum() // 100)


def test_exchanges_empty_a_bin():
    lengths = np.array([60, 30, 55, 35, 10, 10], np.int64)  # 90, 90 and 20: one for one and moves give two bins
    assert len(set(packing.local_search(lengths, np.array([0, 0, 1, 1, 2, 2]), 100))) == 2


def test_two_for_one():
    lengths = np.array([70, 20, 15, 10], np.int64)  # neither fits alone beside 70 + 20, but both together replace 20
    assert len(set(packing.local_search(lengths, np.array([0, 0, 1, 1]), 100))) == 2  # the bound: 115 tokens
    assert packing._exchange(lengths, np.array([0, 0, 1, 1]), np.array([90, 25]), 1, 100)


@pytest.mark.parametrize("shard", [8192, 4])
def test_pack(spark, shard):
    got = [r.asDict() for r in packing.pack(cases.docs(spark), PATH, capacity=64, shard=shard).collect()]
    library = Tokenizer.from_file(PATH)
    want = []
    for doc, text in cases.DOCS:
        ids = library.encode(text or "", add_special_tokens=False).ids + [1]
        want += [(doc, i, at, len(ids[at : at + 64]), zlib.crc32(np.array(ids[at : at + 64], "<u4").tobytes())) for i, at in enumerate(range(0, len(ids), 64))]
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(want)
    by: dict = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    total = sum(r["length"] for r in got)
    assert len(by) <= -(-total // 64) + (1 if shard > 100 else 12)


def test_empty(spark):
    assert packing.pack(cases.docs(spark, []), PATH).count() == 0


@pytest.mark.parametrize("short", [0, 12])
def test_stuck_sequences_never_meet_in_one_group(spark, monkeypatch, short):
    largest, plain = [], packing._round

    def watched(items, shards, *rest):
        largest.append(items.groupBy("shard").count().agg({"count": "max"}).first()[0])
        return plain(items, shards, *rest)

    monkeypatch.setattr(packing, "_round", watched)
    rows = [(i, 0, 0, 51 + i % 45, i) for i in range(600)] + [(i, 0, 0, 1 + i % 3, i) for i in range(600, 600 + short)]
    got = packing.place(spark.createDataFrame(rows, packing.PIECES), 100, 16).collect()
    assert sorted(r.doc_id for r in got) == [r[0] for r in rows]
    fill: dict = {}
    for r in got:
        fill[r.sequence_id] = fill.get(r.sequence_id, 0) + r.length
    assert max(fill.values()) <= 100 and len(fill) >= 600
    assert max(largest) <= 4 * 16


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=60))
def test_lower_bound(lengths):
    lengths = np.array(lengths, np.int64)
    bound = packing.fewest(lengths, 100)
    assert -(-lengths.sum() // 100) <= bound <= len(set(packing.best_fit_decreasing(lengths, 100)))
    assert packing.fewest(np.array([51, 60, 70, 99]), 100) == 4
