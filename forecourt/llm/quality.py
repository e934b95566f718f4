"""Quality classifier: regularised quadratic discriminant on transformed document statistics.

Each text gives a vector of logarithms of ratios. Means and covariances of both classes come
from sums over all labelled rows outside the held-out fold; each covariance is shrunk
towards the pooled diagonal, and its Cholesky factor kept. The score is the logistic of the
difference of the classes' log densities, prior included. Labels, language, source and ids
are no inputs.

Null texts are empty and get a score like any other. Rows are scored each, repeated or not.
Labels other than 0 and 1 are ignored; a document labelled in several rows counts once for
each. With no label of one class the score is that of the other class (1 or 0), with no
labels at all 0.5. Other columns are ignored, or kept by ``keep``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from forecourt.llm.common import map_arrow, slices

SHRINKAGE = 0.1
FEATURES = (
    "words", "word_length", "symbols", "capitals", "stops", "shouts", "digits", "distinct_words", "repeats", "distinct_triples", "lines", "ends", "spread",
)


def _bytes(chars: str) -> np.ndarray:
    mask = np.zeros(256, bool)
    mask[list(chars.encode())] = True
    return mask


_SPACE, _SYMBOL, _STOP, _SHOUT, _DIGIT = _bytes(" \t\n\v\f\r"), _bytes("#*$%&|<>{}=\\^~@"), _bytes(".,;:"), _bytes("!?"), _bytes("0123456789")
_UPPER, _LETTER = _bytes("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _bytes("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
_LETTER[128:] = True
_OTHER = ~(_LETTER | _SPACE | _DIGIT)


def statistics(text: str | None) -> np.ndarray:
    """The vector of one text, over all of it."""
    data = (text or "").encode("utf-8")
    raw = np.frombuffer(data, np.uint8)
    counts = np.bincount(raw, minlength=256)
    words = data.split()
    n, size = len(words), len(raw)
    of = lambda mask: int(counts[mask].sum())
    share = lambda part, whole: np.log((part + 0.5) / (whole + 1.0))
    ended = int((_OTHER[raw[:-1]] & _SPACE[raw[1:]]).sum()) if size > 1 else 0
    p = counts[counts > 0] / max(size, 1)
    return np.array([
        np.log1p(n), share(size - of(_SPACE), n), share(of(_SYMBOL), n), share(of(_UPPER), of(_LETTER)), share(of(_STOP), n),
        share(of(_SHOUT), n), share(of(_DIGIT), n), share(len(set(words)), n), share(sum(map(eq, words, words[1:])), n),
        share(len(set(zip(words, words[1:], words[2:]))), n), share(int(counts[10]), n), share(ended, n), float(-(p * np.log(p)).sum()) if size else 0.0,
    ])


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, x array<double>) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = np.array([statistics(t) for t in batch.column("text").to_pylist()])
            lists = pa.FixedSizeListArray.from_arrays(found.ravel(), len(FEATURES)).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], names=["doc_id", "x"])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, x array<double>")


def held_out(doc_id: Column | str) -> Column:
    """The fold that no label is learnt from; a null id is in no fold."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


@dataclass
class Discriminant:
    """Both classes' Gaussians on standardised vectors, with Cholesky factors; a class without labels is None."""

    centre: np.ndarray
    scale: np.ndarray
    classes: list[tuple[float, np.ndarray, np.ndarray] | None]  # log prior - log det / 2, mean, inverse factor

    def scores(self, x: np.ndarray) -> np.ndarray:
        bad, good = self.classes
        if bad is None or good is None:
            return np.full(len(x), 0.5 if bad is good else float(good is not None))
        z = (x - self.centre) / self.scale
        density = [k - 0.5 * (((z - mean) @ inverse.T) ** 2).sum(axis=1) for k, mean, inverse in (bad, good)]
        return 1.0 / (1.0 + np.exp(np.clip(density[0] - density[1], -700.0, 700.0)))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", shrinkage: float = SHRINKAGE) -> Discriminant:
    """Sums over all labelled rows outside the held-out fold; the driver gets one row per class."""
    d = len(FEATURES)
    known = labels.select(F.col("doc_id").cast("long"), F.col(label).cast("int").alias("y")).where("y in (0, 1)").where(~held_out("doc_id"))
    rows = features(docs.where(~held_out("doc_id"))).join(known, "doc_id")
    pairs = [(i, j) for i in range(d) for j in range(i + 1)]
    # Centred by constants near typical values, so that sums of squares stay exact enough.
    x = [F.col("x")[i] + 2.0 for i in range(d)]
    sums = [F.sum(x[i]) for i in range(d)] + [F.sum(x[i] * x[j]) for i, j in pairs]
    found = {r[0]: (r[1], np.array(r[2:], float)) for r in rows.groupBy("y").agg(F.count(F.lit(1)), *sums).collect()}
    total = sum(n for n, _ in found.values())
    if not total:
        return Discriminant(np.zeros(d), np.ones(d), [None, None])
    moments = {}
    for y, (n, s) in found.items():
        second = np.zeros((d, d))
        for (i, j), value in zip(pairs, s[d:]):
            second[i, j] = second[j, i] = value
        moments[y] = (n, s[:d], second)
    centre = sum(s for _, s, _ in moments.values()) / total
    variance = np.diag(sum(q for _, _, q in moments.values())) / total - centre**2
    scale = np.sqrt(np.maximum(variance, 1e-6))
    covariances = {y: (q / n - np.outer(s / n, s / n)) / np.outer(scale, scale) for y, (n, s, q) in moments.items()}
    pooled = np.diag(sum(moments[y][0] * np.diag(c) for y, c in covariances.items()) / total)
    classes: list = [None, None]
    for y, covariance in covariances.items():
        n, s, _ = moments[y]
        factor = np.linalg.cholesky((1 - shrinkage) * covariance + shrinkage * pooled + 1e-6 * np.eye(d))
        classes[y] = (np.log(n / total) - np.log(np.diag(factor)).sum(), (s / n - centre) / scale, np.linalg.inv(factor))
    return Discriminant(centre - 2.0, scale, classes)


def score(docs: DataFrame, model: Discriminant) -> DataFrame:
    """(doc_id, score) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = model.scores(np.array([statistics(t) for t in batch.column("text").to_pylist()]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found)], names=["doc_id", "score"])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, score double")


def keep(docs: DataFrame, model: Discriminant, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score ``least`` or more, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = model.scores(np.array([statistics(t) for t in batch.column("text").to_pylist()]))
            yield batch.filter(pa.array(found >= least))

    return map_arrow(docs, run, docs.schema)
