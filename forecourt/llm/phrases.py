"""Phrase collocation mining: phrases of two to four words, counted by HAT-tries in sorted runs.

Each task counts phrases in a trie whose upper nodes are word ids and whose leaves are hash
containers of the word ids that follow; a container that grows beyond ``BURST`` entries
becomes a node with a container for each next word. When a trie holds ``HELD`` entries, its
largest subtrees are spilled whole, each as sorted runs, one for each prefix partition (a
hash of the first three words at most). The runs of a partition meet in one task, which
merges them; there is a partition for every ``PER_PARTITION`` bytes of text. Word ids are
a trie's own; runs hold the words.

Texts are read twice. The first time words are counted, and pairs of words by hash, in sorted
runs of numbers that are merged in the same way. A longer phrase is no more frequent than its
pairs, so the second time only pairs whose hash is frequent enough, and phrases of three and
four words all of whose pairs are, go into the tries. Which hashes these are is told to the
tasks as a bitmap of ``BITS`` positions, whatever their number; where two share a position or
a hash the only effect is that more is counted. All counts are exact.

A null text holds no word; a null language is ``und``. Rows are counted each, repeated or
not, and doc_ids are not looked at. Other columns are ignored. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window, functions as F

from forecourt.llm.common import importable, map_arrow, slices, written

BITS = 1 << 26
BLOCK = 1 << 15  # bits in one of Spark's bitmaps
BURST = 8192
HELD = 600_000
PAIRS = 1 << 21  # hashes of pairs that a task holds
PER_PARTITION = 6 << 20  # bytes of text for each prefix partition
NAMES = 1 << 20  # words that a trie numbers before it is emptied; less than 1 << ID_BITS
ID_BITS = 21
_ID = (1 << ID_BITS) - 1
_LAST_TWO = (1 << 2 * ID_BITS) - 1

_FOLD = bytes(46 if chr(b) in ".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b for b in range(256)).lower()
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def words_of(text: bytes | None) -> list[bytes]:
    """The words in order, with a full stop, which no word holds, wherever a piece ends."""
    return (text or b"").translate(_FOLD).replace(b".", b" . ").split()


class _Container(dict):
    """A hash container: counts by the remaining ids. Another class than inner nodes, which are plain dicts by id."""


class HatTrie:
    """Counts of phrases: a first word's id and up to three more, packed into one integer from the left; id 0 is none."""

    def __init__(self, burst: int = BURST):
        self.burst = burst
        self._clear()

    def _clear(self) -> None:
        self.size, self.root = 0, {}
        self.ids = _Ids()
        self.hashes = np.zeros(0, np.uint64)

    def numbered(self, words: list[bytes]) -> np.ndarray:
        """Their ids; 0 for a full stop."""
        return np.fromiter(map(self.ids.__getitem__, words), np.int64, len(words))

    def hashed(self) -> np.ndarray:
        """Hashes of all words so far, by id."""
        if len(self.hashes) < len(self.ids.names):
            more = [xxhash.xxh64_intdigest(w) for w in self.ids.names[len(self.hashes) :]]
            self.hashes = np.concatenate([self.hashes, np.array(more, np.uint64)])
        return self.hashes

    def add(self, first: np.ndarray, rest: np.ndarray) -> None:
        """Count phrases, each once for every time it is given."""
        if not len(first):
            return
        order = np.lexsort((rest, first))
        first, rest = first[order], rest[order]
        starts = np.flatnonzero(np.concatenate([[True], (first[1:] != first[:-1]) | (rest[1:] != rest[:-1])]))
        times = np.diff(np.append(starts, len(first))).tolist()
        first, rest = first[starts], rest[starts].tolist()
        begins = np.flatnonzero(np.concatenate([[True], first[1:] != first[:-1]])).tolist()
        for key, i, j in zip(first[begins].tolist(), begins, [*begins[1:], len(first)]):
            child = self.root.get(key)
            if child is None:
                child = self.root[key] = _Container()
            if type(child) is _Container:
                self._count(child, rest[i:j], times[i:j])
                if len(child) > self.burst:
                    self.root[key] = _split(child)
            else:
                for r, n in zip(rest[i:j], times[i:j]):
                    below = child.get(r >> 2 * ID_BITS)
                    if below is None:
                        below = child[r >> 2 * ID_BITS] = _Container()
                    self._count(below, [(r & _LAST_TWO) << ID_BITS], [n])

    def _count(self, container: _Container, rest: list[int], times: list[int]) -> None:
        before, get = len(container), container.get
        for r, n in zip(rest, times):
            container[r] = get(r, 0) + n
        self.size += len(container) - before

    def spill(self, share: float = 1.0) -> tuple[list[bytes], list[int], np.ndarray]:
        """Take whole subtrees of the root, the largest first, until ``share`` of the entries are out: phrases, counts, prefix hashes."""
        sizes = sorted(((_entries(c), k) for k, c in self.root.items()), reverse=True)
        first, rest, times, wanted = [], [], [], share * self.size
        for n, key in sizes:
            if len(first) >= wanted:
                break
            child = self.root.pop(key)
            first += [key] * n
            if type(child) is _Container:
                rest += child
                times += child.values()
            else:
                for second, below in child.items():
                    rest += [second << 2 * ID_BITS | r >> ID_BITS for r in below]
                    times += below.values()
            self.size -= n
        names, hashes = self.ids.names, self.hashed()
        phrases = [_phrase(names, a, r) for a, r in zip(first, rest)]
        packed_rest = np.array(rest, np.int64)
        second, third = packed_rest >> 2 * ID_BITS, packed_rest >> ID_BITS & _ID
        prefix = (hashes[np.array(first, np.int64)] * _MIX[0] + np.where(second > 0, hashes[second] * _MIX[1], 0) + np.where(third > 0, hashes[third] * _MIX[2], 0)) if first else np.zeros(0, np.uint64)
        if not self.root:
            self._clear()
        return phrases, times, prefix


class _Ids(dict):
    """Word ids in order of appearance."""

    def __init__(self):
        self.names = [b"."]
        self[b"."] = 0

    def __missing__(self, word: bytes) -> int:
        self.names.append(word)
        got = self[word] = len(self.names) - 1
        return got


def _split(full: _Container) -> dict:
    node: dict = {}
    for r, n in full.items():
        node.setdefault(r >> 2 * ID_BITS, _Container())[(r & _LAST_TWO) << ID_BITS] = n
    return node


def _entries(child) -> int:
    return len(child) if type(child) is _Container else sum(map(len, child.values()))


def _phrase(names: list[bytes], first: int, rest: int) -> bytes:
    second, third, fourth = rest >> 2 * ID_BITS, rest >> ID_BITS & _ID, rest & _ID
    if not second:
        return names[first]
    if not third:
        return names[first] + b" " + names[second]
    words = (names[first], names[second], names[third], names[fourth])
    return b" ".join(words if fourth else words[:3])


def pair_hashes(lang: str, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """48 bits for each pair, given the words' hashes."""
    at = (np.uint64(xxhash.xxh64_intdigest(lang.encode())) ^ first) * _MIX[0]
    at = (at ^ at >> np.uint64(29) ^ second) * _MIX[1]
    return (at ^ at >> np.uint64(32)) * _MIX[0] >> np.uint64(16)


def _bitmap(hashes: DataFrame, bits: int) -> bytes:
    """``bits`` bits, one set for each hash; what reaches the driver is bits / 8 bytes at most."""
    marks = hashes.select((F.col("hash") % bits).alias("at")).select(F.expr(f"at div {BLOCK}").alias("block"), (F.col("at") % BLOCK).alias("bit"))
    out = np.zeros(-(-bits // BLOCK) * BLOCK >> 3, np.uint8)
    for block, marked in marks.groupBy("block").agg(F.bitmap_construct_agg("bit")).collect():
        out[block * BLOCK // 8 :][: BLOCK // 8] = np.frombuffer(bytes(marked), np.uint8)
    return out[: bits >> 3].tobytes()


def marked(bitmap: bytes, hashes: np.ndarray) -> np.ndarray:
    at = hashes % np.uint64(8 * len(bitmap))
    return (np.frombuffer(bitmap, np.uint8)[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def packed(run: list[tuple[bytes, int]]) -> bytes:
    """A sorted run: its phrases by lines, then their counts; no word holds a line feed."""
    phrases = b"\n".join(p for p, _ in run)
    counts = np.array([n for _, n in run], "<i8")
    return zstandard.compress(len(phrases).to_bytes(8, "little") + phrases + counts.tobytes(), 1)


def unpacked(run: bytes) -> tuple[list[bytes], np.ndarray]:
    data = zstandard.decompress(run)
    end = 8 + int.from_bytes(data[:8], "little")
    return data[8:end].split(b"\n"), np.frombuffer(data, "<i8", offset=end)


def merged(runs: list[bytes], least: int) -> Iterator[tuple[bytes, int]]:
    """Phrases that occur ``least`` times or more in all of the sorted runs."""
    phrases: list[bytes] = []
    counts = []
    for run in runs:
        mine, n = unpacked(run)
        phrases += mine
        counts.append(n)
    if not phrases:
        return
    n = np.concatenate(counts)
    order = sorted(range(len(phrases)), key=phrases.__getitem__)  # finds and merges the runs as they are
    last, total = phrases[order[0]], 0
    for i in order:
        if phrases[i] != last:
            if total >= least:
                yield last, int(total)
            last, total = phrases[i], 0
        total += n[i]
    if total >= least:
        yield last, int(total)


def packed_hashes(hashes: np.ndarray, times: np.ndarray) -> bytes:
    """A sorted run of numbers, as differences with bytes of equal weight together."""
    steps = np.diff(hashes, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T
    return zstandard.compress(len(hashes).to_bytes(8, "little") + steps.tobytes() + times.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def unpacked_hashes(run: bytes) -> tuple[np.ndarray, np.ndarray]:
    data = zstandard.decompress(run)
    n = int.from_bytes(data[:8], "little")
    steps, times = (np.ascontiguousarray(np.frombuffer(data, np.uint8, 8 * n, at).reshape(8, n).T).view("<u8").ravel() for at in (8, 8 + 8 * n))
    return np.cumsum(steps, dtype=np.uint64), times


RUN = "lang string, kind string, part int, run binary, n long"
_NAMES = [c.split()[0] for c in RUN.split(", ")]


def _rows(lang: str, kind: str, parts: list[int], runs: list[bytes], times: list[int]) -> pa.RecordBatch:
    k = len(runs)
    columns = [pa.array([lang] * k, pa.string()), pa.array([kind] * k, pa.string()), pa.array(parts, pa.int32()), pa.array(runs, pa.binary()), pa.array(times, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, names=_NAMES)


def _dealt(part: np.ndarray) -> list[np.ndarray]:
    """Places of the entries of each part, ascending."""
    order = np.argsort(part, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(part[order])) + 1) if len(part) else []


def _phrase_rows(lang: str, kind: str, phrases: list[bytes], times: list[int], prefix: np.ndarray, partitions: int) -> pa.RecordBatch:
    part = ((prefix >> np.uint64(11)) % np.uint64(partitions)).astype(np.int64)
    places = _dealt(part)
    runs = [sorted((phrases[i], times[i]) for i in at.tolist()) for at in places]
    return _rows(lang, kind, [int(part[at[0]]) for at in places], [*map(packed, runs)], [sum(n for _, n in r) for r in runs])


def _by_language(batch: pa.RecordBatch) -> dict[str, bytes]:
    texts: dict[str, list] = {}
    for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
        texts.setdefault(lang, []).append(text)
    return {lang: b".".join(some) for lang, some in texts.items()}


def first_runs(texts: DataFrame, partitions: int, pairs: int = PAIRS) -> DataFrame:
    """Sorted runs of words, and of hashes of pairs of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, HatTrie] = {}
        counted: dict[str, np.ndarray] = {}
        hashes: list[np.ndarray] = []

        def words_out(lang: str) -> pa.RecordBatch:
            trie, n = words.pop(lang), counted.pop(lang)
            at = np.flatnonzero(n[1:]) + 1
            return _phrase_rows(lang, "word", [trie.ids.names[i] for i in at.tolist()], n[at].tolist(), trie.hashed()[at], partitions)

        def pairs_out() -> pa.RecordBatch:
            found, n = np.unique(np.concatenate(hashes or [np.zeros(0, np.uint64)]), return_counts=True)
            hashes.clear()
            part = (found % np.uint64(partitions)).astype(np.int64)
            places = _dealt(part)  # in order, so each run is sorted
            return _rows("", "pair", [int(part[at[0]]) for at in places], [packed_hashes(found[at], n[at]) for at in places], [int(n[at].sum()) for at in places])

        for batch in slices(batches):
            for lang, text in _by_language(batch).items():
                trie = words.setdefault(lang, HatTrie())
                ids = trie.numbered(words_of(text))
                hashed, n = trie.hashed(), counted.get(lang, np.zeros(0, np.int64))
                counted[lang] = np.bincount(ids, minlength=len(hashed)) + np.pad(n, (0, len(hashed) - len(n)))
                both = (ids[:-1] > 0) & (ids[1:] > 0)
                hashes.append(pair_hashes(lang, hashed[ids[:-1][both]], hashed[ids[1:][both]]))
                if len(trie.ids) > NAMES:
                    yield words_out(lang)
            if sum(map(len, hashes)) > pairs:
                yield pairs_out()
        for lang in [*words]:
            yield words_out(lang)
        yield pairs_out()

    return map_arrow(texts, run, RUN)


def phrase_runs(texts: DataFrame, partitions: int, linked, held: int = HELD, burst: int = BURST) -> DataFrame:
    """Sorted runs of phrases of two to four words all of whose pairs ``linked``, a broadcast bitmap, marks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries: dict[str, HatTrie] = {}
        spilled = lambda lang, share: _phrase_rows(lang, "phrase", *tries[lang].spill(share), partitions)
        for batch in slices(batches):
            for lang, text in _by_language(batch).items():
                trie = tries.setdefault(lang, HatTrie(burst))
                ids = trie.numbered(words_of(text))
                hashed = trie.hashed()
                fine = (ids[:-1] > 0) & (ids[1:] > 0)
                fine[fine] = marked(linked.value, pair_hashes(lang, hashed[ids[:-1][fine]], hashed[ids[1:][fine]]))
                at = np.flatnonzero(fine)
                rest = ids[at + 1] << 2 * ID_BITS
                trie.add(ids[at], rest)
                for n in (2, 3):  # another word where its pair with the last one is marked
                    more = at + n < len(ids)
                    more[more] = fine[at[more] + n - 1]
                    at, rest = at[more], rest[more] | ids[at[more] + n] << (3 - n) * ID_BITS
                    trie.add(ids[at], rest)
                if len(trie.ids) > NAMES:
                    yield spilled(lang, 1.0)
            while sum(t.size for t in tries.values()) > held:
                yield spilled(max(tries, key=lambda k: tries[k].size), 0.5)
        for lang in tries:
            yield spilled(lang, 1.0)

    return map_arrow(texts, run, RUN)


def _frequent_hashes(runs: DataFrame, least: int) -> DataFrame:
    """(hash) of the pairs whose hash was met ``least`` times or more."""
    importable(runs.sparkSession)

    def run(table: pa.Table) -> pa.Table:
        found = [unpacked_hashes(r) for r in table.column("run").to_pylist()]
        hashes, times = (np.concatenate(c) for c in zip(*found))
        order = np.argsort(hashes, kind="stable")
        starts = np.flatnonzero(np.diff(hashes[order], prepend=~hashes[order[:1]]))
        enough = np.add.reduceat(times[order], starts) >= least
        return pa.table({"hash": pa.array(hashes[order][starts][enough].astype(np.int64))})

    return runs.groupBy("part").applyInArrow(run, "hash long")


def _merge(runs: DataFrame, least: int) -> DataFrame:
    """(lang, phrase, n) of the phrases with ``least`` or more; one task holds one language's part."""
    importable(runs.sparkSession)

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        lang = key[0].as_py()
        found = list(merged(table.column("run").to_pylist(), least))
        return pa.table({"lang": pa.array([lang] * len(found), pa.string()), "phrase": pa.array([p for p, _ in found], pa.binary()), "n": pa.array([n for _, n in found], pa.int64())})

    return runs.select("lang", "part", "run").groupBy("lang", "part").applyInArrow(run, "lang string, phrase binary, n long")


def counts(docs: DataFrame, least: int, bits: int = BITS, pairs: int = PAIRS, **limits: int) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, n) of all phrases of up to four words with ``least`` or more, and (lang, n) of all words."""
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("binary").alias("text")).where("text IS NOT NULL")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    partitions = max(8, -(-size // PER_PARTITION))
    runs = written(first_runs(texts, partitions, pairs), "first_runs")
    words = runs.where("kind = 'word'")
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    linked = docs.sparkSession.sparkContext.broadcast(_bitmap(_frequent_hashes(runs.where("kind = 'pair'"), least), bits))
    longer = written(phrase_runs(texts, partitions, linked, **limits), "phrase_runs")
    return _merge(words.unionByName(longer), least), totals


def collocations(docs: DataFrame, least: int = 30, first: int = 2000, **limits: int) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first phrases of each language by their weakest cut.

    A cut's score is floor(2000000 a / (l + r)); the lowest counts, the smallest cut of equal ones. Phrases
    inside a longer one that is at least 0.8 times as frequent are left out. ``limits`` go to ``counts``.
    """
    grams, totals = counts(docs, least, **limits)
    grams = written(grams.select("lang", F.col("phrase").cast("string").alias("phrase"), F.col("n").alias("a")), "grams")
    split = grams.withColumn("w", F.split("phrase", " ")).withColumn("m", F.size("w")).where("m > 1")
    part = lambda start, length: F.array_join(F.slice("w", start, length), " ")
    cuts = split.select("lang", "phrase", "a", "w", "m", F.explode(F.sequence(F.lit(1), F.col("m") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("head"), part(F.col("k") + 1, F.col("m") - F.col("k")).alias("tail"))
    head, tail = grams.select("lang", F.col("phrase").alias("head"), F.col("a").alias("l")), grams.select("lang", F.col("phrase").alias("tail"), F.col("a").alias("r"))
    wide = lambda c: F.col(c).cast("decimal(19,0)")  # noqa: E731  products pass 64 bits
    scored = cuts.join(head, ["lang", "head"]).join(tail, ["lang", "tail"])
    scored = scored.withColumn("d", wide("l") + wide("r")).withColumn("up", F.lit(2_000_000).cast("decimal(7,0)") * wide("a")).withColumn("score", F.expr("up div d"))
    weakest = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("c"))
    # What lies inside a longer phrase: for each phrase, the most frequent one around it.
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.col("m") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("m") - n + 1), lambda i: F.array_join(F.slice("w", i, n), " "))))
    inside = split.where("m > 2").select("lang", F.explode(spans).alias("phrase"), F.col("a").alias("around")).groupBy("lang", "phrase").agg(F.max("around").alias("around"))
    kept = weakest.join(inside, ["lang", "phrase"], "left").where(F.col("around").isNull() | (F.lit(100) * wide("around") < F.lit(80) * wide("a")))
    kept = kept.join(totals, "lang").select("lang", "phrase", "a", "c.l", "c.r", "n", F.col("c.score").alias("score"))
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(best).cast("long")).where(F.col("rank") <= first)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
