import random
from collections import Counter

import corpus_pipeline
from forecourt.llm import nearcopies, simhash

from . import cases


def grams(text):
    words = (text or "").encode().lower().split()  # of bytes: A-Z and ASCII white space only
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def similar(rows: list[tuple]) -> list[tuple]:
    """All pairs (i, j) of places with a similarity of 0.8 or more, found by shared shingles among each one's rarest fifth."""
    sets = [grams(t) for _, t in rows]
    often = Counter(g for s in sets for g in s)
    by_gram, found = {}, set()
    for i, s in enumerate(sets):
        order = sorted(s, key=lambda g: (often[g], g))
        for g in order[: len(s) - -(-4 * len(s) // 5) + 1] or [None]:
            found.update((j, i) for j in by_gram.get(g, ()) if 4 * max(len(s), len(sets[j])) <= 5 * min(len(s), len(sets[j])))
            by_gram.setdefault(g, []).append(i)
    return [(j, i) for j, i in found if 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j]))]


def brute(rows: list[tuple]) -> set:
    """The smallest id of each component; rows: (id, text)."""
    root = {d: d for d, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in similar(rows):
        a, b = find(rows[i][0]), find(rows[j][0])
        root[max(a, b)] = min(a, b)
    return {d for d in root if find(d) == d}


def changed(text: str, n: int, seed: int) -> str:
    words, rnd = text.split(), random.Random(seed)
    for i in rnd.sample(range(len(words)), n):
        words[i] = f"other{seed}x{i}"
    return " ".join(words)


def test_planted_near_copies(spark):
    rows, number = [], iter(range(1, 10_000))
    for k in range(12):
        base = cases.prose(200, 100 + k)
        rows += [(next(number), t) for t in (base, changed(base, 1 + k % 5, k), changed(base, 30, 50 + k))]
    base = cases.prose(150, 300)
    rows += [(next(number), changed(base, 2, 1000 + i)) for i in range(60)]  # a large group, some below 0.8 to each other
    step = cases.prose(250, 301)
    for i in range(15):  # each near the one before it, the ends far apart
        rows.append((next(number), step))
        step = changed(step, 4, 2000 + i)
    rows += [(next(number), t) for t in (None, "", " \n", "One", "one", "one two")]
    want = brute(rows)
    far = [(simhash.fingerprint(s) ^ simhash.fingerprint(t)).bit_count() > 2 for (_, s), (_, t) in zip(rows[:36:3], rows[1:36:3])]
    assert any(far) and len(want) < len(rows) - 60
    got = [r.doc_id for r in corpus_pipeline.near_duplicates(spark, cases.docs(spark, rows), "").collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_pairs_share_a_band():
    rnd = random.Random(3)
    for k in range(200):
        text = cases.prose(rnd.randint(60, 400), k)
        other = changed(text, max(1, len(text.split()) // 50), k)
        if len(similar([(0, text), (1, other)])):
            assert set(nearcopies.bands(nearcopies.shingles(text))[0]) & set(nearcopies.bands(nearcopies.shingles(other))[0])


def recall(spark, rows) -> float:
    """Of the pairs at 0.8 or more between different texts, the share whose texts end in one component."""
    docs = cases.docs(spark, rows)
    sketched = nearcopies.written(nearcopies.sketches(docs), "sketches")
    root = {r.node: r.root for r in nearcopies.links(docs, sketched).collect()}
    node = {r.doc_id: bytes(r.node) for r in sketched.collect()}
    of = [root.get(node[d], node[d]) for d, _ in rows]
    pairs = similar(rows)
    assert len(pairs) > 20
    return sum(of[i] == of[j] for i, j in pairs) / len(pairs)


def test_recall_on_a_given_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    assert recall(spark, docs) == 1.0


def test_recall_in_a_group_around_the_threshold(spark):
    base, rnd = cases.prose(300, 800), random.Random(5)
    rows = [(i, changed(base, rnd.randint(3, 12), 3000 + i)) for i in range(400)]  # mutually 0.6 to 0.9, the original not among them
    assert len(similar(rows)) > 400 and recall(spark, rows) > 0.98


def test_few_rounds_find_less_never_more(spark):
    rows = [(i, changed(cases.prose(200, 900 + i % 4), 1 + i % 9, i)) for i in range(60)]
    docs = cases.docs(spark, rows)
    sketched = nearcopies.written(nearcopies.sketches(docs), "sketches")
    one, three = ({r.node: r.root for r in nearcopies.links(docs, sketched, rounds).collect()} for rounds in (1, 3))
    assert set(one) <= set(three)


def test_keep_with_null_and_repeated_ids(spark):
    def kept(rows):
        return sorted(((r.doc_id, r.text) for r in nearcopies.keep(cases.docs(spark, rows)).collect()), key=str)

    a, b, c = "a b", "zz", cases.prose(60, 9)
    assert kept([(None, a), (4, a), (None, b), (1, c), (7, c), (7, b), (7, "unlike")]) == sorted([(4, a), (7, b), (1, c), (7, "unlike")], key=str)
    assert kept([(None, a), (None, a), (None, c), (5, b), (5, b), (5, b.upper())])[-2:] == sorted([(None, a), (None, c)], key=str)
    assert nearcopies.keep(cases.docs(spark)).columns == cases.docs(spark).columns


def test_empty(spark):
    assert nearcopies.keep(cases.docs(spark, [])).count() == 0
