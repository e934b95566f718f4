import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from forecourt.llm import lexical

from . import cases


def words(text):
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", "".join(c.lower() if c.isascii() else c for c in text or ""))


def brute(docs, items, k=10):
    held = [(d, len(words(t)), Counter(words(t))) for d, t in docs if words(t)]
    total, length = len(held), sum(n for _, n, _ in held)
    df = Counter(w for _, _, c in held for w in c)
    out = []
    for item, text in {(i, t) for i, t in items}:
        found = []
        for d, n, c in held:
            m = 100 - 90 + (90 * n * total) // length
            score = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 8 * m)) for w in set(words(text)) if c[w])
            if score > 0:
                found.append((-score, d is None, d or 0, d))
        out += [(item, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(found, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=str)


def run(spark, docs, items, **how):
    extra = {c: F.lit(1) for c in ("n", "term", "tf", "item", "score", "rank", "part", "block")}
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3).withColumns(extra)
    q = spark.createDataFrame(items, "item_id long, text string").withColumns(extra)
    return sorted((tuple(r) for r in lexical.rank(d, q, **how).collect()), key=str)


ITEMS = [(1, cases.COPY[:200]), (1, "another text of item one, One"), (2, None), (3, ""), (4, "... !"), (None, "A b x tail"), (5, "nowhere-found"), (6, cases.prose(40, 9)), (6, cases.prose(40, 9)), (7, "é 日本 ß_ſ")]


@pytest.mark.parametrize("block", [lexical.BLOCK, 300])
def test_as_by_hand(spark, block):
    rnd = random.Random(6)
    few = cases.prose(60, 50).split()
    docs = [*cases.DOCS, (None, "a b x"), (None, "a b x"), (20, "a b x"), (21, "tail"), (22, "one " * 70_000)]
    docs += [(100 + i, " ".join(rnd.choices(few, k=rnd.randint(1, 80)))) for i in range(150)] + [(300 + i, cases.COPY) for i in range(30)]
    want = brute(docs, [*ITEMS, (8, " ".join(few[:25]))])
    assert len({r[0] for r in want}) == 5 and run(spark, docs, [*ITEMS, (8, " ".join(few[:25]))], block=block) == want


def test_empty(spark):
    assert run(spark, [], ITEMS) == [] and run(spark, cases.DOCS, []) == [] and run(spark, [(1, None)], ITEMS) == []


def shard(rows: int, width: int, seed: int):
    """A tree over random vectors, some of them equal, and its documents by order."""
    rnd = np.random.default_rng(seed)
    docs = [np.sort(rnd.choice(width, rnd.integers(1, min(12, width)), replace=False, p=(p := 1 / np.arange(1, width + 1)) / p.sum())) for _ in range(rows)]
    docs += docs[: rows // 3]
    docs.sort(key=lambda d: d.astype(">u4").tobytes())
    start = np.append(0, np.cumsum([len(d) for d in docs]))
    n = len(docs)
    return lexical.Tree(rnd.permutation(n), np.zeros(n, bool), rnd.integers(10, 400, n), start, np.concatenate(docs).astype(np.int32), rnd.integers(1, 9, start[-1]))


def test_trie_bounds_hold_and_prune():
    tree = shard(3000, 400, 1).grow(leaf=8)
    w = np.sort(np.random.default_rng(2).integers(0, 9000, 400))
    nodes, todo = [], [tree.root]
    while todo:
        node = todo.pop()
        nodes.append(node)
        todo += node.children
        if node.children:
            assert [node.first, *(c.last for c in node.children)] == [*(c.first for c in node.children), node.last]
    assert len(nodes) > 300
    scored = 0
    for q in range(30):
        term = np.sort(np.random.default_rng(q).choice(400, 9, replace=False)).astype(np.int32)
        w_of = np.zeros(400, np.int64)
        w_of[term] = w[term]
        every = tree.scores(lexical.Node(0, len(tree.m), term, term, 0, ()), w_of)
        for node in nodes:
            assert tree.bound(node, term, w[term]) >= every[node.first : node.last].max()
        best = lexical.Best(10)
        scored += lexical.search(tree, term, w[term], w_of, best)
        order = np.lexsort((tree.doc_id, -every))[:10]
        order = order[every[order] > 0]
        assert best.doc_id.tolist() == tree.doc_id[order].tolist() and best.score.tolist() == every[order].tolist()
    assert scored < 30 * len(tree.m) / 4  # most documents lie below nodes left out


def test_equal_documents_are_one_leaf():
    many = lexical.Tree(np.arange(500), np.zeros(500, bool), np.full(500, 20), np.arange(501) * 2, np.tile([1, 3], 500).astype(np.int32), np.ones(1000, np.int64)).grow()
    assert not many.root.children and shard(1, 5, 3).grow().root.last == 1
    best, w_of = lexical.Best(3), np.array([0, 5, 0, 7])
    lexical.search(many, np.array([1, 3]), np.array([5, 7]), w_of, best)
    assert best.doc_id.tolist() == [0, 1, 2]
