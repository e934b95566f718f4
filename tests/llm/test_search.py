import numpy as np
import pytest
from pyspark.sql import functions as F

from forecourt.llm import search


def brute(rows, step, k, same=True):
    kept = []
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            kept.append((i, [int(np.floor(1024.0 * float(np.float32(x)))) for x in v]))
    out = []
    for q, a in kept:
        if q % step == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in kept if not same or i != q)
            out += [(q, r, i, -s) for r, (s, i) in enumerate(scores[:k], 1)]
    return sorted(out)


def run(spark, rows, step=10, k=10):
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3).withColumns({"score": F.lit(1), "v": F.lit(2), "norm": F.lit(3), "block": F.lit(4)})
    v = search.integers(d)
    return sorted(tuple(r) for r in search.top_k(v, v.where(f"vec_id % {step} = 0"), k).collect())


@pytest.mark.parametrize("block", [8192, 50])
def test_random_skewed_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(search, "BLOCK", block)
    monkeypatch.setattr(search, "QUERY_BLOCK", block // 2)
    monkeypatch.setattr(search, "STEP", 32)
    monkeypatch.setattr(search, "SEEDS", 40)
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 12)) * np.geomspace(3, 0.01, 12) * rng.lognormal(0, 1, (400, 1))
    rows = [(i, [float(a) for a in v]) for i, v in enumerate(x.astype(np.float32))]
    assert run(spark, rows) == brute(rows, 10, 10)


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (10, [1.0, 2.0]), (1, None), (2, [1.0, None]), (3, [nan, 1.0]), (4, [inf, 0.0]), (5, []), (20, []), (6, [3.0]), (7, [1.0, 2.0, 5.0]), (8, [1.0, 2.0]), (9, [-1.0, -2.0]), (30, [0.0, 0.0]), (None, [1.0])]
    assert run(spark, rows, k=4) == brute(rows, 10, 4)
    assert run(spark, [(0, [1.0]), (0, [2.0]), (1, [1.0]), (1, [1.0])], k=3)[0] == (0, 1, 1, 2097152)
    assert run(spark, []) == [] and run(spark, [(1, [1.0])]) == []


def test_large_components(spark):
    rows = [(0, [1e12, 3.0]), (1, [2e3, 1.0]), (2, [1e12, -1.0]), (3, [-1e12, 0.5])]
    got = {(q, v): s for q, _, v, s in run(spark, rows)}
    assert got[0, 2] == 2**63 - 1 and got[0, 3] == -(2**63) and got[0, 1] == 2**63 - 1
