import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from forecourt.llm import hmm

from . import cases

SCHEMA = "doc_id long, text string"
END = object()


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if c.isascii() else c for c in text or "")) + [END]


def fold(doc_id):
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 7 == 2


def plain(rows, states, rounds, head, hot):
    """Base and model scores by loops over one text at a time; the order of words, and the first model, are the module's."""
    train = [words(t) for d, t in rows if not fold(d)]
    n = Counter(w for t in train for w in t)
    total, distinct = sum(n.values()), len(n)
    p0 = lambda w: (n[w] + 1) / (total + distinct + 1)
    name = lambda w: b"" if w is END else w.encode()
    ranked = sorted(n, key=lambda w: (-n[w], name(w)))
    for least in sorted(set(n.values())):  # whole steps of frequency (each count is a step of its own here)
        if sum(c >= least for c in n.values()) <= hot:
            break
    else:
        least = total + 1
    ranked = [w for w in ranked if n[w] >= least and len(name(w)) <= 64]
    k = min(head, len(ranked))
    base = hmm.Base(total, distinct, [name(w) for w in ranked], np.array([n[w] for w in ranked], np.int64))
    chain, first = hmm.first_model(base, states, head)
    place = {w: i for i, w in enumerate(ranked[:k])}
    emit = lambda w: first[place.get(w, k)]
    start, move = chain.start, chain.move

    def forward(text):
        out, alpha = [], None
        for w in text:
            alpha = (start if alpha is None else alpha @ move) * emit(w)
            out.append((alpha / alpha.sum(), alpha.sum()))
            alpha = out[-1][0]
        return out

    for r in range(rounds + 1):
        starts, moves, seen = np.ones(states), np.ones((states, states)), {}
        for text in train:
            f, beta = forward(text), np.ones(states)
            for t in range(len(text) - 1, -1, -1):
                key = text[t] if r == rounds or text[t] in place else None
                seen[key] = seen.get(key, 0) + f[t][0] * beta
                if t:
                    came = emit(text[t]) * beta / f[t][1]
                    moves += move * np.outer(f[t - 1][0], came)
                    beta = move @ came
                else:
                    starts += f[0][0] * beta
        start, move = starts / starts.sum(), moves / moves.sum(axis=1, keepdims=True)
        totals = sum(seen.values()) if seen else np.zeros(states)
        rest = 1 - sum(map(p0, place))
        table = {w: 0.9 * seen.get(w, 0) / totals + 0.1 * (rest if w is None else p0(w)) for w in [*seen, *place]} if seen else {}
        if r < rounds:
            emit = lambda w, table=table: table[w if w in place else None]
        else:
            emit = lambda w, table=table: table.get(w, np.full(states, (0.1 if seen else 1.0) * p0(w)))
    out = []
    for d, t in rows:
        text = words(t)
        score = sum(np.log10(s) for _, s in forward(text))
        out.append((d, fold(d), len(text), sum(n[w] > 0 for w in text), total, sum(np.log10(p0(w)) for w in text), score))
    return out


def texts():
    rnd = random.Random(4)
    one, two = "the of and in to 日本 x".split(), "der die und das ß É x".split()
    rows = [(i, " ".join(rnd.choices((one, two)[i % 2], k=rnd.randint(1, 40)))) for i in range(60)]
    rows += [(60, None), (61, ""), (62, " \n\t "), (None, "the only one"), (64, rows[3][1]), (3, rows[3][1]), (65, "The THE the rare" + "x" * 80)]
    rows += [(100 + i, cases.prose(60, 70 + i) + " unknown%d" % i) for i in range(12)]
    return rows


def run(spark, rows, **how):
    d = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumns({c: F.lit(1) for c in ("word", "n", "row", "rest", "ids", "held_out", "score", "told")})
    return [tuple(r) for r in hmm.score(d, **how).collect()]


def same(got, want, rel=2e-5):
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[6])
    assert len(got) == len(want)
    for g, w in zip(sorted(got, key=key), sorted(want, key=key)):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5], rel=1e-9) and g[6] == pytest.approx(w[6], rel=rel), (g, w)


@pytest.mark.parametrize(("head", "hot"), [(6, 25), (1000, 1000), (4, 0)])
def test_as_by_loops(spark, head, hot):
    rows = texts()
    same(run(spark, rows, head=head, hot=hot, states=3, rounds=2, unit=1 << 24), plain(rows, 3, 2, head, hot))


def test_learns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = hmm.score(docs).where("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert (got[0] - got[1]) / got[2] > 0.15


def test_emissions_sum_to_one(spark):
    rows = spark.createDataFrame(texts(), SCHEMA)
    counted = hmm.word_counts(rows.where(~hmm.held_out("doc_id")).select(F.col("text").cast("binary").alias("text")))
    base = hmm.base_of(counted, 30)
    coded = hmm.coded(rows, spark.sparkContext.broadcast(base.words))
    model = hmm.fit(coded, base, states=3, rounds=1, head=9)
    rest = model.rest.toPandas()
    e = np.vstack([model.emissions(model.hot, base.n), model.emissions(np.stack(rest.e), rest.n.to_numpy()), model.emissions(np.zeros((1, 3)), np.zeros(1))])
    assert len(base.words) <= 30 and len(e) == base.distinct + 1 and e.sum(axis=0) == pytest.approx(np.ones(3)) and model.chain.move.sum(axis=1) == pytest.approx(np.ones(3))
    assert set(rest.n) <= {r.n for r in counted.collect()} and rest.n.sum() + base.n.sum() == base.tokens


def test_spans_change_nothing():
    rnd = np.random.default_rng(1)
    chain = hmm.Chain(rnd.dirichlet(np.ones(3)), rnd.dirichlet(np.ones(3), 3))
    lengths = np.array([1, 40, 7, 23, 7])
    side = hmm.Batch(lengths)
    table = rnd.uniform(0.1, 1, (lengths.sum(), 3))

    def gather(span):
        words, other = np.zeros_like(table), {}
        for kind, at, x in hmm.expected(chain, side, lambda i, j: table[i:j], span):
            if kind == "word":
                words[at : at + len(x)] = x
            else:
                other[kind] = x
        return words, other

    (a, x), (b, y) = gather(1000), gather(6)
    assert len(hmm._spans(side, 6)) > 10
    emit = lambda i, j: table[i:j]
    assert hmm.likelihoods(chain, side, emit) == pytest.approx(hmm.likelihoods(chain, side, emit, 6))
    assert np.allclose(a, b) and np.allclose(a.sum(axis=1), 1) and np.allclose(x["move"], y["move"]) and np.allclose(x["start"], y["start"])
    assert x["move"].sum() == pytest.approx(lengths.sum() - len(lengths))


def test_long_text(spark, monkeypatch):
    rows = [(1, cases.LONG), (2, "a b"), (3, cases.LONG.upper())]
    same(run(spark, rows, head=50, hot=100, states=2, rounds=1, unit=1 << 24), plain(rows, 2, 1, 50, 100), 1e-4)


def test_empty_and_untrained(spark):
    assert run(spark, []) == []
    alone = next(i for i in range(50) if fold(i))
    assert run(spark, [(alone, "a b"), (alone, None)]) in ([(alone, True, 3, 0, 0, 0.0, 0.0), (alone, True, 1, 0, 0, 0.0, 0.0)], [(alone, True, 1, 0, 0, 0.0, 0.0), (alone, True, 3, 0, 0, 0.0, 0.0)])
