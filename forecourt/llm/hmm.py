"""Hidden Markov language model: latent states over words, trained by Baum-Welch, scored by the scaled forward recursion.

A text is its words (A-Z lowered, ASCII white space between) and one end. The base model is
the words' counts plus one, over all tokens and one unknown word. In the hidden Markov model
each of ``STATES`` states emits a word with probability 0.9 E(word) / E + 0.1 base(word),
where E are the state's expected counts; so every word has a probability, and those of a
state sum to one.

Training sums expected counts over all training texts: each task runs the forward-backward
recursion over its texts, many at a time in order of length, and its counts, in whole
1/1024ths so that their order of addition doesn't matter, are added by word. For ``ROUNDS``
rounds the ``HEAD`` most frequent words have counts of their own and all others share those
of one class, whose words are emitted as in the base model; a last round gives every word of
the training texts its own counts. Each round can only raise the training texts' likelihood
(but for the share of the base model, which is fixed).

The counts of the ``HOT`` most frequent words (of 64 bytes at most) are broadcast for
scoring; those of all others are a table that is joined to the texts' remaining words. A long
text is worked through in spans of ``SPAN`` tokens, keeping the state at each start, so memory
is bounded by a text's ids and one span.

Null texts are empty: an end alone. Rows are scored each, repeated or not; a null doc_id
counts as an empty one for the fold and is returned as null. Without training texts every
probability is that of the one unknown word, 1, and scores are 0. Other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from forecourt.llm.common import discard, map_arrow, slices, written

STATES = 8
ROUNDS = 4
HEAD = 1 << 15
HOT = 1 << 19
WORD_BYTES = 64
OWN = 0.9  # of a state's emissions, the part that its own counts give
STAY = 0.9  # probability of staying in a state, at first
UNIT = 1024
SPAN = 1 << 19  # tokens whose states are held at once
BUFFER = 3 << 20  # tokens that a task works on together
WORDS = 500_000
SEED = 5
END = b""


def held_out(doc_id: str | Column) -> Column:
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 7 == 2


def tokens(text: bytes | None) -> list[bytes]:
    """The words in order, then the end."""
    found = (text or b"").lower().split()
    found.append(END)
    return found


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n) over all ``texts``; a task sends a word once for every ``WORDS`` it holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            found = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())], names=["word", "n"])
            held.clear()
            return found

        for batch in slices(batches):
            for text in batch.column("text").to_pylist():
                held.update(tokens(text))
            if len(held) > WORDS:
                yield out()
        yield out()

    return map_arrow(texts.select("text"), run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Base:
    """Add-one unigrams: all training tokens, distinct ones, and the most frequent words with their counts."""

    tokens: int
    distinct: int
    words: list[bytes]
    n: np.ndarray

    def p(self, n: np.ndarray | int) -> np.ndarray | float:
        return (n + 1.0) / (self.tokens + self.distinct + 1)


def base_of(counted: DataFrame, hot: int = HOT) -> Base:
    """``hot`` words at most: those of the highest steps of frequency, 64 to each doubling, that fit as a whole."""
    total, distinct = counted.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    short = counted.where(F.octet_length("word") <= WORD_BYTES).withColumn("step", F.floor(F.log2("n") * 64))
    least, room = 1 << 62, hot
    for step, words in sorted(short.groupBy("step").count().collect(), reverse=True):  # 64 * 63 rows at most
        room -= words
        if room < 0:
            break
        least = step
    top = short.where(F.col("step") >= least).select("word", "n").toArrow()
    rows = sorted(zip(top.column("n").to_pylist(), top.column("word").to_pylist()), key=lambda r: (-r[0], r[1]))
    return Base(total, distinct, [w for _, w in rows], np.array([n for n, _ in rows], np.int64))


CODED = "row long, doc_id long, held_out boolean, ids array<int>, rest array<binary>"


def coded(docs: DataFrame, words) -> DataFrame:
    """Texts as numbers of the frequent words, -1 for others, which follow as they are. ``words``: a broadcast list."""
    names = [c.split()[0] for c in CODED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {w: i for i, w in enumerate(words.value)}
        for batch in slices(batches):
            ids, rest = [], []
            for text in batch.column("text").to_pylist():
                found = tokens(text)
                mine = np.fromiter(map(known.get, found, repeat(-1)), np.int32, len(found))
                ids.append(mine)
                rest.append([found[i] for i in np.flatnonzero(mine < 0).tolist()])
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, ids)]), pa.int32()), pa.array(np.concatenate(ids)))
            kept = [batch.column(c) for c in names[:3]]
            yield pa.RecordBatch.from_arrays([*kept, lists, pa.array(rest, pa.list_(pa.binary()))], names=names)

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), held_out("doc_id").alias("held_out"), F.col("text").cast("binary").alias("text"))
    return map_arrow(rows, run, CODED)


@dataclass
class Chain:
    """Start and transition probabilities."""

    start: np.ndarray  # (states)
    move: np.ndarray  # (states, states), by the state left


class Batch:
    """Sequences side by side in order of length, the longest first: step t holds the t-th token of those that have one."""

    def __init__(self, lengths: np.ndarray):
        self.order = np.argsort(-lengths, kind="stable")
        sorted_lengths = lengths[self.order]
        steps = int(sorted_lengths[0])
        self.active = np.searchsorted(-sorted_lengths, -np.arange(1, steps + 1), side="right")  # sequences at each step
        self.starts = np.concatenate([[0], np.cumsum(self.active)])
        # Where each token, text by text, stands when the tokens are arranged step by step.
        rank = np.empty(len(lengths), np.int32)
        rank[self.order] = np.arange(len(lengths), dtype=np.int32)
        step = np.arange(lengths.sum(), dtype=np.int32) - np.repeat((np.cumsum(lengths) - lengths).astype(np.int32), lengths)
        narrow = np.int32 if self.starts[-1] < 1 << 31 else np.int64
        self.place = self.starts.astype(narrow)[step]
        self.place += np.repeat(rank, lengths)

    def arranged(self, values: np.ndarray) -> np.ndarray:
        out = np.empty_like(values)
        out[self.place] = values
        return out


def _spans(batch: Batch, span: int) -> list[tuple[int, int]]:
    """Steps in runs of about ``span`` tokens, one step at least."""
    out, first = [], 0
    while first < len(batch.active):
        last = max(first + 1, int(np.searchsorted(batch.starts, batch.starts[first] + span, side="right")) - 1)
        out.append((first, min(last, len(batch.active))))
        first = out[-1][1]
    return out


def _forward(chain: Chain, batch: Batch, e: np.ndarray, first: int, last: int, alpha: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """State probabilities and scales of all tokens of steps ``first`` to ``last``, given those before and the emissions ``e``."""
    begin, ones = batch.starts[first], np.ones(len(chain.start), chain.move.dtype)
    kept, scales = np.empty_like(e), np.empty(len(e), e.dtype)
    for t in range(first, last):
        n, at = batch.active[t], batch.starts[t] - begin
        now, total = kept[at : at + n], scales[at : at + n]
        if t == 0:
            now[:] = chain.start
        else:
            np.matmul(alpha[:n], chain.move, out=now)
        now *= e[at : at + n]
        np.matmul(now, ones, out=total)
        now /= total[:, None]
        alpha = now
    return kept, scales


def _final(kept: np.ndarray, batch: Batch, last: int) -> np.ndarray:
    return kept[len(kept) - batch.active[last - 1] :].copy()


def likelihoods(chain: Chain, batch: Batch, emit, span: int = SPAN) -> np.ndarray:
    """log10 probability of each sequence, in the order given; ``emit(i, j)`` has the emissions of tokens by place."""
    out, alpha = np.zeros(len(batch.order)), None
    for first, last in _spans(batch, span):
        kept, scales = _forward(chain, batch, emit(batch.starts[first], batch.starts[last]), first, last, alpha)
        alpha = _final(kept, batch, last)
        ranks = np.arange(len(scales)) - np.repeat(batch.starts[first:last] - batch.starts[first], batch.active[first:last])
        out += np.bincount(ranks, np.log10(scales), minlength=len(out))
    found = np.empty_like(out)
    found[batch.order] = out
    return found


def expected(chain: Chain, batch: Batch, emit, span: int = SPAN) -> Iterator[tuple[str, int, np.ndarray]]:
    """Baum-Welch counts: ('start', 0, states), ('move', 0, states x states) and, span by span, ('word', place of the first, tokens x states)."""
    k, spans, borders, alpha = len(chain.start), _spans(batch, span), [], None
    for first, last in spans:  # states at the spans' borders; the last span's own steps follow below
        borders.append(alpha)
        if last < len(batch.active):
            kept, _ = _forward(chain, batch, emit(batch.starts[first], batch.starts[last]), first, last, alpha)
            alpha = _final(kept, batch, last)
    moves, back = np.zeros((k, k)), np.ascontiguousarray(chain.move.T)
    came = None  # of the step after: backward variable times emission by scale
    for (first, last), border in zip(reversed(spans), reversed(borders)):
        begin = batch.starts[first]
        e = emit(begin, batch.starts[last])
        gamma, scales = _forward(chain, batch, e, first, last, border)
        e = e / scales[:, None]
        for t in range(last - 1, first - 1, -1):
            n, at = batch.active[t], batch.starts[t] - begin
            m = 0 if came is None else len(came)
            alpha, beta = gamma[at : at + n], np.empty((n, k), chain.move.dtype)
            if m:
                moves += alpha[:m].T @ came
                np.matmul(came, back, out=beta[:m])
            if m < n:
                beta[m:] = 1.0  # texts that end here
            alpha *= beta
            came = e[at : at + n]
            came *= beta
        if first == 0:
            yield "start", 0, gamma[: batch.active[0]].sum(axis=0, dtype=float)
        came = came.copy()
        yield "word", begin, gamma
    yield "move", 0, moves * chain.move


def buffers(batches: Iterator[pa.RecordBatch], columns: list[str], size: int = BUFFER) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """Rows of other columns, with the lengths and the joined ids, of about ``size`` tokens together."""
    held, n = [], 0
    for batch in batches:
        lists = batch.column("ids")
        offsets = lists.offsets.to_numpy()
        values, at = lists.values.to_numpy(zero_copy_only=False), 0
        while at < batch.num_rows:  # as many rows as still fit, one at least
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size - n, side="right")) - 1)
            held.append(([batch.column(c).slice(at, end - at) for c in columns], np.diff(offsets[at : end + 1]), values[offsets[at] : offsets[end]]))
            n += int(offsets[end] - offsets[at])
            at = end
            if n >= size or at < batch.num_rows:
                yield _joined(held)
                held, n = [], 0
    if held:
        yield _joined(held)


def _joined(held: list) -> tuple[list, np.ndarray, np.ndarray]:
    others, lengths, ids = zip(*held)
    return [pa.concat_arrays(c) for c in zip(*others)], np.concatenate(lengths).astype(np.int64), np.concatenate(ids)


def _ready(counts: np.ndarray, base: np.ndarray) -> np.ndarray:
    """Emission probabilities of rows of expected counts, and the base model's, given the states' totals in the last row."""
    totals = counts[-1]
    return np.where(totals > 0, OWN * counts[:-1] / np.maximum(totals, 1e-300) + (1 - OWN) * base[:, None], base[:, None])


def first_model(base: Base, states: int, head: int) -> tuple[Chain, np.ndarray]:
    """Emissions of the head and of the class of all others: the base model's, each state's leaning at random."""
    k = min(head, len(base.words))
    n = np.append(base.n[:k], max(base.tokens - int(base.n[:k].sum()), 0)).astype(float)
    lean = np.random.default_rng(SEED).uniform(0.5, 1.5, (head + 1, states))[np.append(np.arange(k), head)]
    lean[-1] = 1.0
    counts = n[:, None] * lean
    move = np.full((states, states), (1 - STAY) / max(states - 1, 1))
    np.fill_diagonal(move, STAY if states > 1 else 1.0)
    return Chain(np.full(states, 1.0 / states), move), _ready(np.vstack([counts, counts.sum(axis=0)]), _head_base(base, k))


def _head_base(base: Base, k: int) -> np.ndarray:
    """The base model's probabilities of the first ``k`` words and of all others together."""
    p = np.append(base.p(base.n[:k].astype(float)), 0.0)
    p[-1] = max(1.0 - p.sum(), 0.0)
    return p


COUNTS = "kind string, id int, word binary, n long"


def round_counts(rows: DataFrame, model, states: int, unit: int, whole: bool = False, size: int = 0) -> DataFrame:
    """Expected counts in 1/unit-ths by (kind, id, word): of starts, moves, the head and the rest or, if ``whole``, each word.

    ``model``: a broadcast (chain, emissions), the last row of which is that of all words beyond the head. ``n`` counts
    a word's occurrences, where ``whole``; words below ``size`` have ids then.
    """
    schema = COUNTS + "".join(f", e{i} long" for i in range(states))
    names = [c.split()[0] for c in schema.split(", ")]

    def batch_of(kind: str, ids: list, words: list, e: np.ndarray, n: np.ndarray | None = None) -> pa.RecordBatch:
        e = np.rint(e * unit).astype(np.int64)
        columns = [pa.array([kind] * len(ids), pa.string()), pa.array(ids, pa.int32()), pa.array(words, pa.binary()), pa.array(n if n is not None else np.zeros(len(ids), np.int64))]
        columns += [pa.array(np.ascontiguousarray(c)) for c in e.T]
        return pa.RecordBatch.from_arrays(columns, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain, emissions = model.value
        chain = Chain(chain.start.astype(np.float32), chain.move.astype(np.float32))
        scale = np.maximum(emissions.max(axis=1, keepdims=True), 1e-300)  # of a word alone; cancels in expected counts
        emissions, k = (emissions / scale).astype(np.float32), len(emissions) - 1
        starts, moves = np.zeros(states), np.zeros((states, states))
        seen, times = np.zeros((size if whole else k + 1, states)), np.zeros(size, np.int64)
        words: dict[bytes, int] = {}

        def beyond_out() -> pa.RecordBatch:
            nonlocal seen, times
            out = batch_of("word", [-1] * len(words), [*words], seen[size : size + len(words)], times[size : size + len(words)])
            seen, times = seen[:size].copy(), times[:size].copy()
            words.clear()
            return out

        columns = ["rest"] if whole else []
        for others, lengths, ids in buffers(batches, columns):
            side = Batch(lengths)
            at = np.where((ids < 0) | (ids >= k), k, ids)
            placed = side.arranged(at)
            del at
            emit = lambda i, j: emissions.take(placed[i:j], axis=0)  # noqa: E731, B023
            if whole:  # words beyond the hot ones get numbers after theirs
                beyond = ids < 0
                number = np.maximum(ids, 0)
                number[beyond] = size + np.array([words.setdefault(w, len(words)) for w in others[0].flatten().to_pylist()], np.int32)
                placed_words = side.arranged(number)
                seen = np.pad(seen, ((0, max(size + len(words) - len(seen), 0)), (0, 0)))
                times = np.pad(times, (0, len(seen) - len(times))) + np.bincount(number, minlength=len(seen))
                del number, beyond
            for kind, begin, counts in expected(chain, side, emit):
                if kind == "start":
                    starts += counts
                elif kind == "move":
                    moves += counts
                else:
                    by = (placed_words if whole else placed)[begin : begin + len(counts)]
                    for s in range(states):
                        seen[:, s] += np.bincount(by, counts[:, s], minlength=len(seen))
            if len(words) > WORDS:
                yield beyond_out()
        if whole:
            yield beyond_out()
            at = np.flatnonzero(times[:size])
            yield batch_of("id", at.tolist(), [None] * len(at), seen[at], times[at])
        else:
            at = np.flatnonzero(seen.any(axis=1))
            yield batch_of("id", at.tolist(), [None] * len(at), seen[at])
        yield batch_of("start", [0], [None], starts[None])
        yield batch_of("move", [*range(states)], [None] * states, moves)

    sums = [F.sum(c).alias(c) for c in names[3:]]
    return map_arrow(rows.select("ids", "rest") if whole else rows.select("ids"), run, schema).groupBy("kind", "id", "word").agg(*sums)


def _read(table: pa.Table, states: int, size: int, unit: int) -> tuple[Chain, np.ndarray]:
    """The chain and the ``size`` rows of counts by id, as they stand in ``table``."""
    e = np.stack([table.column(f"e{i}").to_numpy() for i in range(states)], axis=1) / unit if table.num_rows else np.zeros((0, states))
    kind, ids = np.array(table.column("kind").to_pylist(), object), table.column("id").to_numpy()
    start, move, counts = np.ones(states), np.ones((states, states)), np.zeros((size, states))  # one more of each: none is impossible
    start += e[kind == "start"].sum(axis=0)
    move[ids[kind == "move"]] += e[kind == "move"]
    counts[ids[kind == "id"]] = e[kind == "id"]
    return Chain(start / start.sum(), move / move.sum(axis=1, keepdims=True)), counts


@dataclass
class Model:
    base: Base
    chain: Chain
    totals: np.ndarray  # expected counts of each state
    hot: np.ndarray  # those of each of the base's words
    rest: DataFrame  # (word, n, e array<double>) of all other training words

    def emissions(self, counts: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Probabilities of words by state, given expected counts and base counts."""
        return _ready(np.vstack([counts, self.totals]), self.base.p(n.astype(float)))


def fit(rows: DataFrame, base: Base, states: int = STATES, rounds: int = ROUNDS, head: int = HEAD, unit: int = UNIT) -> Model:
    """Baum-Welch over the ``coded`` texts outside the held-out fold."""
    spark, train = rows.sparkSession, rows.where("NOT held_out")
    k = min(head, len(base.words))
    chain, emissions = first_model(base, states, head)
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast((chain, emissions))
        chain, counts = _read(round_counts(train, sent, states, unit).toArrow(), states, k + 1, unit)
        emissions = _ready(np.vstack([counts, counts.sum(axis=0)]), _head_base(base, k))
        sent.unpersist()
    sent = spark.sparkContext.broadcast((chain, emissions))
    found = written(round_counts(train, sent, states, unit, True, len(base.words)), "hmm_counts")
    chain, hot = _read(found.where("kind <> 'word'").toArrow(), states, len(base.words), unit)
    sums = found.where("kind IN ('id', 'word')").agg(*[F.coalesce(F.sum(f"e{i}"), F.lit(0)) for i in range(states)]).first()
    e = F.array(*[F.col(f"e{i}") / unit for i in range(states)]).alias("e")
    return Model(base, chain, np.array(sums, float) / unit, hot, found.where("kind = 'word'").select("word", "n", e))


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score_coded(rows: DataFrame, model: Model) -> DataFrame:
    spark, base, states = rows.sparkSession, model.base, len(model.totals)
    asked = rows.select("row", F.explode(F.array_distinct("rest")).alias("word"))
    told = asked.join(model.rest, "word").groupBy("row").agg(F.collect_list(F.struct("word", "n", "e")).alias("told"))
    joined = rows.where(F.size("rest") > 0).join(told, "row", "left").select(*rows.columns, "told")
    none = F.lit(None).cast("array<struct<word:binary,n:bigint,e:array<double>>>").alias("told")
    joined = joined.unionByName(rows.where(F.size("rest") == 0).select("*", none))
    sent = spark.sparkContext.broadcast((base.tokens, base.distinct, base.n, model.chain, model.totals, model.emissions(model.hot, base.n)))
    names = [c.split()[0] for c in SCORED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, distinct, n, chain, totals, hot = sent.value
        plain = Base(total, distinct, [], n)
        for others, lengths, ids in buffers(batches, ["doc_id", "held_out", "rest", "told"], BUFFER // 2):
            # Words beyond the hot ones get places after them: the first for all that training texts don't hold.
            told, words = others[3].flatten(), others[2].flatten().to_pylist()
            more: dict[bytes, int] = {}
            for i, w in enumerate(told.field("word").to_pylist(), 1):
                more.setdefault(w, i)
            more_n = np.append(0, told.field("n").to_numpy())
            more_e = np.vstack([np.zeros((1, states)), np.asarray(told.field("e").flatten()).reshape(-1, states)])
            added = _ready(np.vstack([more_e, totals]), plain.p(more_n.astype(float)))
            at, beyond = np.maximum(ids, 0).astype(np.int64), ids < 0
            where = np.fromiter(map(more.get, words, repeat(0)), np.int64, len(words))
            times = n[at] if len(n) else np.zeros(len(ids), np.int64)
            times[beyond] = more_n[where]
            side = Batch(lengths)
            text = np.repeat(np.arange(len(lengths)), lengths)
            base_score = np.bincount(text, np.log10(plain.p(times.astype(float))), minlength=len(lengths))
            n_known = np.bincount(text[times > 0], minlength=len(lengths))
            at[beyond] = len(n) + where
            placed, size = side.arranged(at), len(n)

            def emit(i: int, j: int) -> np.ndarray:
                mine = placed[i:j]
                out = hot.take(mine, axis=0, mode="clip") if size else np.empty((j - i, states))
                out[mine >= size] = added[mine[mine >= size] - size]  # noqa: B023
                return out

            score = likelihoods(chain, side, emit)
            columns = [others[0], others[1], lengths, n_known, np.full(len(lengths), total, np.int64), base_score, score]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=names)

    return map_arrow(joined.select("doc_id", "held_out", "ids", "rest", "told"), run, SCORED)


def score(docs: DataFrame, hot: int = HOT, **training: int) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row, learnt outside the held-out fold. ``training`` goes to ``fit``."""
    texts = docs.where(~held_out("doc_id")).select(F.col("text").cast("binary").alias("text"))
    counted = written(word_counts(texts), "word_counts")
    base = base_of(counted, hot)
    words = docs.sparkSession.sparkContext.broadcast(base.words)
    rows = written(coded(docs, words), "coded")
    words.unpersist()
    discard(counted)
    return score_coded(rows, fit(rows, base, **training))
