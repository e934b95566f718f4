import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from forecourt.llm import phrases

from . import cases

SCHEMA = "doc_id long, text string, lang string"


def brute(rows, least, first):
    f, n = {}, Counter()
    for _, text, lang in rows:
        lang = lang if lang is not None else "und"
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", "".join(c.lower() if c.isascii() else c for c in text or "")):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for m in range(1, 5):
                for i in range(len(words) - m + 1):
                    f.setdefault(lang, Counter())[tuple(words[i : i + m])] += 1
    out = []
    for lang, counts in f.items():
        found = []
        some = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        for p, a in some.items():
            score, k = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
            around = [b for q, b in some.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if not any(100 * b >= 80 * a for b in around):
                found.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, r, p.decode(), -a, x, y, n[lang], -s) for r, (s, a, p, x, y) in enumerate(sorted(found)[:first], 1)]
    return sorted(out)


def rows():
    rnd = random.Random(8)
    few = ["A", "b", "é", "日本", "x\t y", "The", "q.", "r,s", "\x0b", "v\n", "zz\x1c", " w"]
    made = [" ".join(rnd.choices(few, k=rnd.randint(1, 400))) for _ in range(60)]
    made += ["one two three four " * 30, "one two three four. " * 40, "p p " * 500, cases.prose(3000, 4) + " one two three"]
    made += [None, "", " \t ", "...", made[0], made[0]]
    return [(i if i % 7 else None, t, [None, "en", "fr", "en", ""][i % 5]) for i, t in enumerate(made)]


def run(spark, given, least=30, first=2000, **limits):
    d = spark.createDataFrame(given, SCHEMA).repartition(3).withColumns({c: F.lit(1) for c in ("phrase", "n", "part", "run", "a", "l", "rank", "score")})
    return sorted(tuple(r) for r in phrases.collocations(d, least, first, **limits).collect())


@pytest.mark.parametrize("limits", [{}, {"burst": 3, "held": 40, "pairs": 50}, {"bits": 8}])
def test_as_by_hand(spark, limits):
    want = brute(rows(), 20, 2000)
    assert len(want) > 60 and run(spark, rows(), 20, **limits) == want


def test_first_of_each_language(spark):
    assert run(spark, rows(), 5, 20) == brute(rows(), 5, 20)


def test_trie_keeps_all_counts():
    rnd, want, got, inner = random.Random(2), Counter(), Counter(), False
    trie = phrases.HatTrie(burst=4)
    for _ in range(300):
        some = [[b"w%d" % rnd.randint(0, 6) for _ in range(rnd.randint(1, 4))] for _ in range(20)]
        want.update(b" ".join(p) for p in some)
        ids = [(trie.numbered(p).tolist() + [0, 0, 0])[:4] for p in some]
        trie.add(np.array([i[0] for i in ids]), np.array([i[1] << 42 | i[2] << 21 | i[3] for i in ids]))
        inner |= any(type(c) is dict for c in trie.root.values())
        if trie.size > 300:
            spilled, times, prefix = trie.spill(0.5)
            assert 100 < len(spilled) == len(times) == len(prefix) and trie.size < 300
            got.update(dict(phrases.merged([phrases.packed(sorted(zip(spilled, times)))], 1)))
    spilled, times, _ = trie.spill()
    got.update(dict(zip(spilled, times)))
    assert got == want and inner and not trie.root


def test_runs_merge():
    runs = [phrases.packed(sorted(r)) for r in ([(b"a b", 2), (b"c", 1)], [(b"a b", 3), (b"a c", 4)], [(b"c", 9)])]
    hashes, times = np.array([3, 5, 1 << 47], np.uint64), np.array([1, 300, 2], np.uint64)
    assert [x.tolist() for x in phrases.unpacked_hashes(phrases.packed_hashes(hashes, times))] == [hashes.tolist(), times.tolist()]
    assert list(phrases.merged(runs, 5)) == [(b"a b", 5), (b"c", 10)] and list(phrases.merged([], 1)) == []


def test_empty(spark):
    assert run(spark, []) == [] and run(spark, [(1, None, None)]) == []
