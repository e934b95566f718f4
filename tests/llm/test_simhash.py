import random
import re
from itertools import combinations

import xxhash
from hypothesis import given, settings, strategies as st

from forecourt.llm import simhash

from . import cases


def brute_fingerprint(text: str | None, n: int = 3) -> int:
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def brute_components(rows: list[tuple]) -> dict:
    """rows: (id, fingerprint)."""
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        if (rows[i][1] ^ rows[j][1]).bit_count() <= 2:
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    least: dict = {}
    for i, (doc, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), doc), doc)
    return {doc: least[find(i)] for i, (doc, _) in enumerate(rows)}


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 2**64 - 1), st.sets(st.integers(0, 63), max_size=2))
def test_some_table_holds_every_pair_within_the_radius(x, turned):
    y = x
    for bit in turned:
        y ^= 1 << bit
    masks = simhash.covering_masks(2)
    assert len(masks) == 7 and any(x & m == y & m for m in masks)
    assert all(36 <= m.bit_count() <= 37 for m in masks)


def test_documents(spark):
    got = {r.doc_id: r for r in simhash.near_duplicates(cases.docs(spark)).select("doc_id", simhash.hex16(simhash.F.col("fp")).alias("hex"), "component_id").collect()}
    rows = [(d, brute_fingerprint(t)) for d, t in cases.DOCS]
    want = brute_components(rows)
    assert {d: (f"{f:016x}", want[d]) for d, f in rows} == {d: (r.hex, r.component_id) for d, r in got.items()}
    assert want[9] == want[8] == 7 and want[3] == want[2] == 1


def test_crowded_buckets_and_chains(spark):
    rnd = random.Random(0)
    centre = rnd.getrandbits(64)
    fps = {rnd.getrandbits(64) for _ in range(300)} | {centre ^ 1 << i for i in range(40)} | {centre ^ 3 << i for i in range(0, 60, 2)}
    chain = rnd.getrandbits(64)
    for i in range(60):  # each two bits from the one before
        fps.add(chain)
        chain ^= 1 << (2 * i % 64) | 1 << ((2 * i + 5) % 64)
    rows = list(enumerate(sorted(fps)))
    nodes = spark.createDataFrame([(simhash._signed(f),) for _, f in rows], "fp long")
    links = {tuple(sorted((a % 2**64, b % 2**64))) for a, b in simhash.links(nodes).collect()}
    assert all((a ^ b).bit_count() <= 2 for a, b in links)
    number = {f: i for i, f in rows}
    from forecourt.llm.graph import components

    edges = spark.createDataFrame([(number[a], number[b]) for a, b in links], "a long, b long")
    found = {r.node: r.root for r in components(edges).collect()}
    assert {i: found.get(i, i) for i, _ in rows} == brute_components(rows)


def test_empty_and_null_ids(spark):
    assert simhash.near_duplicates(cases.docs(spark, [])).count() == 0
    got = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(cases.docs(spark, [(None, "a b"), (4, "a b"), (None, "zz")])).collect()}
    assert got == {(None, 4), (4, 4), (None, None)}
