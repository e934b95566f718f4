"""Folds, splits and samples from key hashes: the same on every run and partitioning."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from forecourt import constants as K
from forecourt.functions.numbers import hash_fold, hash_unit
from forecourt.operators import quantiles as q, snapshots
from forecourt.operators.skew import ROWS, attach
from forecourt.session import materialize

UNIT = float(2**52)


def group_fold(df: DataFrame, key: str = "listing_id", k: int = K.OUTER_FOLDS, seed: str = "") -> DataFrame:
    """Fold per listing, so all snapshots of a listing share one. A missing key is a group of its own."""
    return df.withColumn("fold", hash_fold(F.coalesce(F.col(key).cast("string"), F.lit("missing")), k, seed))


def usable_folds(df: DataFrame, key: str = "listing_id", k: int = K.OUTER_FOLDS) -> int:
    """min(k, number of groups); 0 when fewer than two groups leave nothing to hold out."""
    groups = df.select(F.col(key)).distinct().limit(k).count()
    return groups if groups >= 2 else 0


def key_fold(df: DataFrame, key: str, k: int, seed: str = "42:") -> DataFrame:
    """Shuffled k-fold over single rows, from the row key and a seed."""
    return df.withColumn("fold", hash_fold(F.col(key), k, seed))


def holdout_split(df: DataFrame, key: str, shares: Mapping[str, float], seed: str = "42:") -> DataFrame:
    """Label rows by where their key hash falls in [0, 1), e.g. {'test': .1, 'val': .09, 'train': .81}."""
    unit = hash_unit(F.col(key), seed) / F.lit(UNIT)
    names, upto, out = list(shares), 0.0, None
    for name in names[:-1]:
        upto += shares[name]
        out = F.when(unit < upto, name) if out is None else out.when(unit < upto, name)
    return df.withColumn("split", F.lit(names[0]) if out is None else out.otherwise(names[-1]))


def stratified_split(
    df: DataFrame, key: str, price: str = "price", shares: Sequence[tuple[str, float]] = (("train", 0.70), ("valid", 0.15), ("test", 0.15)),
    seed: str = "42:", min_rows: int = 2,
) -> DataFrame:
    """Exact shares inside each price quintile; one stratum for all when a quintile has < ``min_rows``.

    The cut points are order statistics of the key hash per stratum, so no stratum is sorted in one task.
    """
    strata = materialize(snapshots.price_strata(df, price))  # read three times below
    smallest = strata.groupBy("stratum").count().agg(F.min("count").alias("m")).scalar()
    unit = hash_unit(F.col(key), seed).cast("double")
    stratum = F.when(smallest < min_rows, F.lit(0)).otherwise(F.coalesce("stratum", F.lit(0)))
    rows = strata.withColumns({"stratum": stratum, "__u": unit})
    ranks, upto = {}, 0.0
    for name, share in shares[:-1]:
        upto += share
        ranks[f"__{name}"] = f"ceil(n * {round(upto, 9)!r}D) - 1"
    cuts = q.order_statistics(rows, ["stratum"], "__u", ranks).withColumnRenamed(q.TOTAL, ROWS)
    out = attach(rows, cuts, ["stratum"])
    split: Column | None = None
    for name, _ in shares[:-1]:
        below = F.col("__u") <= F.col(f"__{name}")
        split = F.when(below, name) if split is None else split.when(below, name)
    return out.withColumn("split", split.otherwise(shares[-1][0])).drop("__u", *ranks)


def sample_n(df: DataFrame, key: str, n: int, seed: str = "42:") -> DataFrame:
    """Exactly min(n, rows) rows without replacement (keys are unique): those with the smallest key hashes.

    The n-th smallest hash is found first; the sample is then a plain filter, so it never sits in one task.
    """
    unit = hash_unit(F.col(key), seed).cast("double")
    cut = q.order_statistics(df, [], unit, {"cut": f"least(n, {int(n)}) - 1"}).select("cut").scalar()
    return df.where(unit <= cut)


def expected_sizes(n: int, shares: Sequence[float]) -> list[int]:
    """Row counts the exact stratified split gives for n rows."""
    edges = [0] + [math.ceil(n * round(sum(shares[: i + 1]), 9)) for i in range(len(shares) - 1)] + [n]
    return [b - a for a, b in zip(edges, edges[1:])]
