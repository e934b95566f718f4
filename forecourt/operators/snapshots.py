"""Repeated snapshots per listing: first, last, one per day, time on the market.

Picking a row per key is an aggregate over a struct, not a window: it combines map-side,
so a listing that holds a third of all rows sends one row per task instead of all of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from forecourt.functions import numbers
from forecourt.functions.dates import day, days_between, wall_clock
from forecourt.functions.text import blank_to_null
from forecourt.operators import filters, quantiles as q
from forecourt.operators.skew import attach, group_rows


def _pick(df: DataFrame, keys: Sequence[str], ts: str, ties: Sequence[str], last: bool) -> DataFrame:
    """One row per key, by timestamp then ties then all other columns (so equal picks are equal rows)."""
    rest = [c for c in df.columns if c not in keys and c not in ties and c != ts]
    order: list[Column] = []
    if ts in df.columns:
        # An unknown time is last when looking for the first row, and first when looking for the last.
        order = [F.col(ts).isNotNull().alias("__known") if last else F.col(ts).isNull().alias("__unknown"), F.col(ts)]
    packed = F.struct(*order, *[F.col(c) for c in ties], *[F.col(c) for c in rest])
    best = (F.max if last else F.min)(packed).alias("__row")
    out = df.groupBy(*keys).agg(best)
    return out.select(*[F.col(c) if c in keys else F.col("__row")[c].alias(c) for c in df.columns])


def first_snapshot(
    df: DataFrame, key: str = "listing_id", ts: str = "fetched_on", ties: Sequence[str] = (), keep_blank: bool = True
) -> DataFrame:
    """Earliest row per listing; rows with a blank ID are all kept, as they are, unless told otherwise.

    One pass over the input: a blank ID is a key of its own, numbered by row.
    """
    clean = blank_to_null(F.col(key))
    if not keep_blank:
        return _pick(df.where(clean.isNotNull()).withColumn(key, clean), [key], ts, ties, last=False)
    number = F.when(clean.isNull(), F.monotonically_increasing_id())
    rows = df.withColumns({"__id": clean, "__blank": number, key: F.coalesce(clean, F.col(key))})
    return _pick(rows, ["__id", "__blank"], ts, ties, last=False).drop("__id", "__blank")


def last_snapshot(df: DataFrame, key: str = "listing_id", ts: str = "fetched_on", ties: Sequence[str] = ()) -> DataFrame:
    """Latest row per ID, the audit's de-duplication; all rows without ID count as one ID."""
    return _pick(df, [key], ts, ties, last=True)


def last_per_day(
    df: DataFrame, key: str = "listing_id", ts: str = "fetched_on", ties: Sequence[str] = ()
) -> DataFrame:
    """Last observation of a listing on each calendar day."""
    clean = blank_to_null(F.col(key).cast("string"))
    known = df.where(clean.isNotNull() & F.col(ts).isNotNull())
    return _pick(known.withColumns({key: clean, "day": day(F.col(ts))}), [key, "day"], ts, ties, last=True)


def first_recent(
    df: DataFrame, key: str = "listing_id", ts: str = "fetched_on", days: int = 14, ties: Sequence[str] = ()
) -> DataFrame:
    """First occurrence of each listing within the last N days."""
    return first_snapshot(filters.last_days(df, ts, days), key, ts, ties, keep_blank=False)


def with_listing_id(df: DataFrame, unique: Column | None = None, key: str = "listing_id") -> DataFrame:
    """Give rows with a blank ID one of their own, from a unique column or else from the row's place in its source.

    Without ``unique``, equal rows stay different listings; the numbers hold for one reading of
    the source, so materialise the result where it is used more than once.
    """
    if key not in df.columns:
        df = df.withColumn(key, F.lit(None).cast("string"))
    unique = F.monotonically_increasing_id() if unique is None else unique
    own = F.concat(F.lit("row_"), unique.cast("string"))
    return df.withColumn(key, F.coalesce(blank_to_null(F.col(key).cast("string")), own))


def days_on_market(df: DataFrame, key: str = "listing_id", ts: str = "fetched_on") -> DataFrame:
    """Whole days since the listing was first seen; 0 when that is unknown."""
    seen = group_rows(df.where(F.col(key).isNotNull()), [key], F.min(ts).alias("__first"))
    out = attach(df, seen, [key])
    days = F.coalesce(days_between(F.col(ts), F.col("__first")), F.lit(0)).cast("double")
    return out.withColumn("days_on_market", days).drop("__first")


def days_since_listing(df: DataFrame, key: str = "listing_id", ts: str = "fetched_on") -> DataFrame:
    """Calendar days since the first snapshot, and whether the row is from the listing day or the next."""
    seen = group_rows(df.where(F.col(key).isNotNull()), [key], F.min(ts).alias("__first"))
    return add_days_since(attach(df, seen, [key]), ts, "__first").drop("__first")


def add_days_since(df: DataFrame, ts: str, first: str) -> DataFrame:
    days = F.greatest(F.coalesce(F.datediff(F.col(ts), F.col(first)), F.lit(0)), F.lit(0)).cast("double")
    return df.withColumn("days_since_listing", days).withColumn("is_listing_day", F.col("days_since_listing") <= 1)


def anchor_rows(
    df: DataFrame, key: str = "listing_id", ts: str = "fetched_on", ties: Sequence[str] = ()
) -> DataFrame:
    """First listing-day row per listing; first row of any day when no row at all is flagged."""
    flagged = F.coalesce(df.agg(F.max("is_listing_day").alias("f")).scalar(), F.lit(False))
    return _pick(df.where(F.col("is_listing_day") | ~flagged), [key], ts, ["days_since_listing", *ties], last=False)


def price_strata(df: DataFrame, price: str = "price", bins: int = 5) -> DataFrame:
    """Quantile strata of the log price, numbered from 1, right-closed; equal boundaries merge."""
    log = numbers.log_price(F.col(price), plus_one=False)
    names = [f"e{i}" for i in range(1, bins)]
    edges = q.quantiles(df, [], log, {n: i / bins for i, n in enumerate(names, 1)}).select(F.struct(*names).alias("e")).scalar()
    fresh = {n: "" if i == 0 else f"__e.{n} > __e.{names[i - 1]} AND " for i, n in enumerate(names)}
    above = " + ".join(f"CASE WHEN {test}__l > __e.{n} THEN 1 ELSE 0 END" for n, test in fresh.items())
    rows = df.withColumns({"__l": log, "__e": edges})
    return rows.withColumn("stratum", F.expr(f"CASE WHEN __l IS NOT NULL THEN 1 + {above} END")).drop("__l", "__e")
