"""Row filters. Thresholds are parameters; defaults are the fixed values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from forecourt import constants as K
from forecourt.functions.dates import wall_clock
from forecourt.operators import quantiles as q
from forecourt.operators.skew import ROWS, attach, group_rows


def required(df: DataFrame, columns: Sequence[str] = ("price", "year", "kms")) -> DataFrame:
    return df.dropna(subset=list(columns))


def positive_price(df: DataFrame, price: str = "price", present: Sequence[str] = ()) -> DataFrame:
    out = df.where(F.col(price) > 0)
    return out.dropna(subset=list(present)) if present else out


def year_valid(year: Column, last: Column, first: int = K.MIN_YEAR) -> Column:
    return F.coalesce((year >= first) & (year <= last), F.lit(False))


def kms_valid(kms: Column, high: float = K.MAX_KMS) -> Column:
    return F.coalesce((kms >= 0) & (kms <= high), F.lit(False))


def year_range(df: DataFrame, last: Column, first: int = K.MIN_YEAR) -> DataFrame:
    return df.where(year_valid(F.col("year"), last, first))


def kms_range(df: DataFrame, high: float = K.MAX_KMS) -> DataFrame:
    return df.where(kms_valid(F.col("kms"), high))


def price_trim(
    df: DataFrame, low: float = 0.01, high: float = 0.99, price: str = "price", partition_by: Sequence[str] = ()
) -> DataFrame:
    """Keep prices inside two exact quantiles, over all rows or within each source."""
    if not partition_by:
        rows = df.withColumn("__bound", q.bounds(df, price, low, high))
        return rows.where(F.col(price).between(F.col("__bound.low"), F.col("__bound.high"))).drop("__bound")
    on = list(partition_by)
    edges = q.quantiles(df, on, price, {"__lo": low, "__hi": high}).withColumnRenamed(q.TOTAL, ROWS)
    return attach(df, edges, on).where(F.col(price).between(F.col("__lo"), F.col("__hi"))).drop("__lo", "__hi")


def identity_stats(columns: Sequence[str]) -> Column:
    """True for a group in which no column takes two distinct non-null values."""
    same = F.lit(True)
    for c in columns:
        same = same & F.coalesce(F.min(c) == F.max(c), F.lit(True))
    return same


def identity_consistent(
    df: DataFrame,
    key: str = "listing_id",
    columns: Sequence[str] = ("year", "fuel", "transmission"),
    null_id: str = "drop",
) -> DataFrame:
    """Drop every row of a listing whose identity columns disagree between snapshots.

    min = max per listing replaces a distinct count; the aggregate combines map-side and the
    join back splits hot listings. Rows without ID are dropped, or kept with ``null_id='keep'``.
    """
    stats = group_rows(df.where(F.col(key).isNotNull()), [key], identity_stats(columns).alias("__same"))
    keep = F.col("__same") if null_id == "drop" else F.col("__same") | F.col(key).isNull()
    return attach(df, stats, [key]).where(keep).drop("__same")


def last_days(df: DataFrame, ts: str = "fetched_on", days: int = 14) -> DataFrame:
    """Rows of the last N days before the newest timestamp (a scalar subquery)."""
    newest = df.agg(F.max(wall_clock(F.col(ts))).alias("t")).scalar()
    return df.where(wall_clock(F.col(ts)) >= newest - F.expr(f"INTERVAL '{int(days)}' DAY"))


def null_invalid(df: DataFrame, last_year: Column, first: int = K.MIN_YEAR, high: float = K.MAX_KMS) -> DataFrame:
    """Prediction mode: no row is dropped; fields derived from an invalid year or odometer become null."""
    good_year = year_valid(F.col("year"), last_year, first)
    good_kms = kms_valid(F.col("kms"), high)
    rules = {
        "car_age": good_year,
        "kms": good_kms,
        "kms_per_year": good_kms,
        "log_kms": good_kms,
        "age_x_ownership": good_year & good_kms,
        "kms_x_ownership": good_kms,
    }
    return df.withColumns({c: F.when(ok, F.col(c)) for c, ok in rules.items() if c in df.columns})
