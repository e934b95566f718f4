"""Joining per-group results back to rows when one group may hold a third of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

ROWS = "__rows"
HOT_ROWS = 2_000_000
SPREAD = 64


def attach(df: DataFrame, stats: DataFrame, on: Sequence[str], rows: str = ROWS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Left join ``stats`` (one row per key, with its row count in ``rows``) onto ``df``.

    Keys with more than ``hot_rows`` rows are joined by broadcast: there are at most
    count(df) / hot_rows of them, so that side is small by construction. All other keys
    take an ordinary equi-join (AQE picks broadcast or shuffle from the measured size), in
    which rows of hot or null keys carry a salt that matches nothing and spreads them
    evenly. Both branches read the same aggregate, so its exchange is reused. Null keys
    get null results.
    """
    on = list(on)
    payload = [c for c in stats.columns if c not in on and c != rows]
    packed = stats.select(*on, rows, F.struct(*payload).alias("__p"))
    hot = packed.where(F.col(rows) > hot_rows).select(*on, F.col("__p").alias("__hot"))
    light = packed.where(F.col(rows) <= hot_rows).select(*on, F.lit(0).alias("__salt"), F.col("__p").alias("__light"))

    unmatched = F.col("__hot").isNotNull()
    for c in on:
        unmatched = unmatched | F.col(c).isNull()
    # The partition ID, unlike rand(), is the same when a lost task is run again.
    salt = F.when(unmatched, F.pmod(F.spark_partition_id(), F.lit(SPREAD)) + 1).otherwise(0)
    joined = df.join(F.broadcast(hot), on, "left").withColumn("__salt", salt).join(light, on + ["__salt"], "left")
    found = F.coalesce("__hot", "__light")
    return joined.select(*[F.col(c) for c in df.columns if c not in payload], *[found[c].alias(c) for c in payload])


def group_rows(df: DataFrame, on: Sequence[str], *aggs: Column) -> DataFrame:
    """Per-key aggregate with its row count, ready for ``attach``; combined map-side before the shuffle."""
    return df.groupBy(*on).agg(F.count(F.lit(1)).alias(ROWS), *aggs)
