"""Exact top-k inner products: norm-sorted blocks, SVD-rotated partial sums, Cauchy-Schwarz bounds.

Vectors become integers, floor(scale * x). Candidates and queries are dealt to blocks of
bounded size, and each pair of blocks is one group. Within it candidates are processed by
descending length: a query stops at a block row whose length times its own cannot reach its
k-th best score any more. For the rest, the leading coordinates after rotation by the right
singular vectors give a partial sum, and the lengths of what remains bound the difference;
only pairs that may still reach the k-th best are scored exactly, in integers. Each query
starts from the k-th best score among the longest candidates, which all tasks are given
(``SEEDS`` rows). The rotation is fitted on ``SAMPLE`` rows and affects speed alone.

Vectors that are null, or hold null or non-finite components, take no part. Shorter vectors
count as padded by zeros; an empty one scores 0 with all. Repeated rows are ranked each;
rows that share a query's id are its own. Ties go to the smaller vec_id. Components beyond
the range of a long are clipped to it, as are scores. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from forecourt.llm.common import importable, map_arrow, written

BLOCK = 8192  # candidates in a block, expected
QUERY_BLOCK = 8192
STEP = 1024  # candidates between two looks at the bounds
SEEDS = 2048
SAMPLE = 8192
FOUND = "query_id long, vec_id long, score long"


def integers(vectors: DataFrame, column: str = "embedding", scale: float = 1024.0) -> DataFrame:
    """(vec_id, v array<long>, norm) of the vectors that take part."""
    x = F.transform(column, lambda e: e.cast("double"))
    finite = F.forall(column, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) < float("inf")))
    v = F.transform(x, lambda e: F.floor(e * scale)).alias("v")
    rows = vectors.where(F.col(column).isNotNull() & F.col("vec_id").isNotNull()).where(finite).select(F.col("vec_id").cast("long"), v)
    return rows.withColumn("norm", F.aggregate("v", F.lit(0.0), lambda a, e: a + e.cast("double") * e.cast("double")))


def dense(lists: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of integers, padded by zeros to ``width``."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    values, offsets = np.asarray(lists.flatten()), lists.offsets.to_numpy() - lists.offsets[0].as_py()
    lengths = np.diff(offsets)
    if len(lengths) and (lengths == width).all():
        return values.reshape(-1, width)
    out = np.zeros((len(lengths), width), np.int64)
    out[np.repeat(np.arange(len(lengths)), lengths), np.concatenate([np.arange(n) for n in lengths] or [np.zeros(0, int)]).astype(int)] = values
    return out


def _products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows; in doubles where these hold every integer met."""
    most = float(np.abs(q.astype(float)).max(initial=0)) * float(np.abs(c.astype(float)).max(initial=0)) * max(1, q.shape[1])
    if most < 2.0**53:
        return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    if most < 2.0**62:
        return q @ c.T
    return np.clip(q.astype(object) @ c.astype(object).T, -(2**63), 2**63 - 1).astype(np.int64)


def _pairs(q: np.ndarray, c: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Exact inner products of the pairs (i, j)."""
    out = np.empty(len(i), np.int64)
    for at in range(0, len(i), 1 << 15):
        a, b = q[i[at : at + (1 << 15)]], c[j[at : at + (1 << 15)]]
        most = float(np.abs(a.astype(float)).max(initial=0)) * float(np.abs(b.astype(float)).max(initial=0)) * max(1, q.shape[1])
        if most < 2.0**62:
            out[at : at + len(a)] = np.einsum("ij,ij->i", a, b)
        else:
            out[at : at + len(a)] = np.clip((a.astype(object) * b.astype(object)).sum(axis=1), -(2**63), 2**63 - 1)
    return out


def _best(k: int, rows: list[np.ndarray]) -> list[np.ndarray]:
    """The k best of each query: highest score, then smallest vec_id."""
    query, vec, score = rows
    order = np.lexsort((vec, ~score, query))
    query, vec, score = query[order], vec[order], score[order]
    first = np.searchsorted(query, query)
    kept = np.arange(len(query)) - first < k
    return [query[kept], vec[kept], score[kept]]


def search_block(q_id, q, floor, c_id, c, rotation: np.ndarray, k: int, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, vec_id, score) of the best ``k`` candidates of a block that may be among the best at all.

    ``floor``: a score that the k-th best of each query is known to reach.
    """
    lead = max(1, q.shape[1] // 4)
    length = np.sqrt((c.astype(np.float64) ** 2).sum(axis=1))
    order = np.argsort(-length, kind="stable")
    c_id, c, length = c_id[order], c[order], length[order]
    qr, cr = q.astype(np.float64) @ rotation, c.astype(np.float64) @ rotation
    own = np.sqrt((q.astype(np.float64) ** 2).sum(axis=1))
    q_rest, c_rest = (np.sqrt((x[:, lead:] ** 2).sum(axis=1)) for x in (qr, cr))
    least = floor.copy()  # exact; ``need`` is for the bounds, which know no clipping
    need = np.where(least > -(2**63), least.astype(np.float64), -np.inf)
    best = [np.zeros(0, np.int64)] * 3
    for at in range(0, len(c), STEP):
        slack = 1.0 + 1e-9 * own * length[at]
        live = np.flatnonzero(own * length[at] + slack >= need)
        if not len(live):
            break
        part = slice(at, at + STEP)
        bound = qr[live, :lead] @ cr[part, :lead].T + q_rest[live, None] * c_rest[None, part]
        i, j = np.nonzero(bound + slack[live, None] >= need[live, None])
        if len(i) > bound.size // 4:
            score = _products(q[live], c[part])[i, j]
        else:
            score = _pairs(q[live], c[part], i, j)
        i, vec = live[i], c_id[part][j]
        kept = score >= least[i]
        if same:
            kept &= vec != q_id[i]
        best = _best(k, [np.concatenate([a, b[kept]]) for a, b in zip(best, (i, vec, score))])
        count = np.bincount(best[0], minlength=len(q))
        full = np.flatnonzero(count >= k)
        last = np.cumsum(count) - 1
        least[full] = np.maximum(least[full], best[2][last[full]])
        need = np.where(least > -(2**63), least.astype(np.float64), -np.inf)
    return best[0], best[1], best[2]


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 10, same: bool = True) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best of ``candidates`` for each of ``queries``.

    Both are (vec_id, v array<long>, norm). With ``same``, a query's own id is no candidate for it.
    """
    spark = candidates.sparkSession
    importable(spark)
    candidates, queries = written(candidates, "vectors"), written(queries, "queries")
    total, width = candidates.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    asked, q_width = queries.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    width = max(width or 0, q_width or 0, 1)
    longest = candidates.orderBy(F.desc("norm"), "vec_id").limit(SEEDS).select("vec_id", "v").toArrow()
    seeds, seed_ids = dense(longest["v"], width), np.asarray(longest["vec_id"])
    sample = dense(candidates.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").toArrow()["v"], width).astype(np.float64)
    rotation = np.linalg.svd(sample, full_matrices=True)[2].T if len(sample) <= width else np.linalg.eigh(sample.T @ sample)[1][:, ::-1]

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = _products(dense(batch.column("v"), width), seeds)
            if same:
                scores[np.asarray(batch.column("vec_id"))[:, None] == seed_ids[None, :]] = -(2**63)
            least = np.partition(scores, -k, axis=1)[:, -k] if len(seeds) >= k else np.full(len(scores), -(2**63), np.int64)
            yield pa.RecordBatch.from_arrays([*batch.select(["vec_id", "v"]).columns, pa.array(least)], names=["vec_id", "v", "least"])

    def run(ours: pa.Table, theirs: pa.Table) -> pa.Table:
        found = [np.zeros(0, np.int64)] * 3
        if ours.num_rows and theirs.num_rows:
            q_id = np.asarray(theirs["vec_id"])
            row, vec, score = search_block(q_id, dense(theirs["v"], width), np.asarray(theirs["least"]), np.asarray(ours["vec_id"]), dense(ours["v"], width), rotation, k, same)
            found = [q_id[row], vec, score]
        return pa.table(dict(zip(("query_id", "vec_id", "score"), found)))

    blocks, q_blocks = max(1, -(-total // BLOCK)), max(1, -(-asked // QUERY_BLOCK))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda n, salt: F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(salt)), F.lit(n)).cast("int")
    ours = candidates.select("vec_id", "v", dealt(blocks, 1).alias("block")).select("*", every(q_blocks).alias("q_block"))
    theirs = map_arrow(queries, start, "vec_id long, v array<long>, least long").withColumn("q_block", dealt(q_blocks, 2)).select("*", every(blocks).alias("block"))
    by = ["block", "q_block"]
    found = ours.groupBy(*by).cogroup(theirs.groupBy(*by)).applyInArrow(run, FOUND)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
