"""No candidate of a bucket is left out, however many components it holds."""

from forecourt.llm import nearcopies
from tests.llm import cases
from tests.llm.test_nearcopies import changed, similar


def test_last_round_has_every_pair_of_components(spark):
    size = 2 * nearcopies.TILE + 30
    rows = [(1, bytes([i >> 8, i & 255]), 100, size) for i in range(size)]
    members = spark.createDataFrame(rows, "key long, node binary, size int, company long")
    roots = spark.createDataFrame([(bytes([0, i]), bytes([0, 0])) for i in range(1, 5)], "node binary, root binary")
    led = spark.createDataFrame([], "key long, node binary")
    pairs, _ = nearcopies._candidates(members, roots, led, True)
    assert pairs.count() == size * (size - 1) // 2 - 10  # the five of one component need no comparison


def test_a_crowd_that_leaders_do_not_join(spark):
    """Pairs of copies, all unlike each other but in one bucket: a few leaders and neighbours reach few of them."""
    texts = [(2 * i + j, cases.prose(120, 50 + i) + (" x" if j else "")) for i in range(24) for j in range(2)]
    docs = cases.docs(spark, texts)
    sketched = nearcopies.sketches(docs).toPandas()
    crowd = 7  # one band key, alone, for all of them, as if a minimum were common to all
    sketched["bands"] = [[crowd] for _ in range(len(sketched))]
    sketched["fp"] = [i << 20 | 0x5555 << (i % 7) for i in range(len(sketched))]
    found = nearcopies.links(docs, nearcopies.written(spark.createDataFrame(sketched, nearcopies.SKETCH), "crowd"))
    assert found.count() == 24


def test_pairs_of_a_crowd_below_the_threshold_are_not_made(spark):
    """A group of texts mutually about 0.7 alike: the links are among the pairs, and hardly any other."""
    base = cases.prose(150, 700)
    texts = [changed(base, 1 + i % 6, 5000 + i) for i in range(400)]
    sets = [nearcopies.shingles(t) for t in texts]
    linked = {(i, j) for i, j in similar(list(enumerate(texts)))}
    rows = [(1, bytes([i >> 8, i & 255]), len(s), 400, nearcopies.odd_bits(s)) for i, s in enumerate(sets)]
    members = spark.createDataFrame(rows, "key long, node binary, size int, company long, odd array<long>")
    roots = spark.createDataFrame([(b"x", b"x")], "node binary, root binary")
    led = spark.createDataFrame([], "key long, node binary")
    pairs, _ = nearcopies._candidates(members, roots, led, True)
    number = lambda node: node[0] << 8 | node[1]
    made = {(number(r.a), number(r.b)) for r in pairs.collect()}
    assert linked <= made and 0 < len(linked) and len(made) < len(linked) + 400 * 399 // 40


def test_odd_bits_never_exclude_a_link():
    for k in range(300):
        text = cases.prose(20 + 7 * k, k)
        other = changed(text, max(1, len(text.split()) // (30 + k % 60)), k)
        a, b = nearcopies.shingles(text), nearcopies.shingles(other)
        differing = sum(((x ^ y) & (1 << 64) - 1).bit_count() for x, y in zip(nearcopies.odd_bits(a), nearcopies.odd_bits(b)))
        assert differing <= len(set(a.tolist()) ^ set(b.tolist()))
