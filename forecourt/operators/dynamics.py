"""How a listing's price moves over the days it is observed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from forecourt import constants as K
from forecourt.functions.numbers import clip, finite
from forecourt.operators import quantiles as q, snapshots
from forecourt.operators.skew import ROWS


def _daily_log_prices(
    df: DataFrame, key: str, ts: str, price: str, ties: Sequence[str], plus_one: bool, positive_only: bool
) -> DataFrame:
    """(key, day number since the first day, log price, first log price), one row per listing-day.

    The window sees at most one row per calendar day and listing, whatever the number of snapshots.
    """
    value = finite(F.col(price))
    if price in ties:  # of rows alike in time and price any will do: later ties would only travel
        ties = list(ties)[: list(ties).index(price) + 1]
    rows = df.select(key, ts, value.alias("price"), *[c for c in ties if c not in (key, ts, price)])
    rows = rows.where(F.col("price") > 0) if positive_only else rows.where(F.col("price").isNotNull())
    daily = snapshots.last_per_day(rows, key, ts, [c for c in ties if c in rows.columns and c not in (key, ts)])
    life = Window.partitionBy(key).orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = F.first(F.struct("day", "price")).over(life)
    log = F.log1p if plus_one else F.log
    return (
        daily.select(key, "day", "price", first.alias("__first"))
        .where(F.col("__first.price") > 0)
        .select(
            key,
            F.datediff("day", F.col("__first.day")).cast("double").alias("d"),
            log("price").alias("lp"),
            log("__first.price").alias("lp0"),
        )
    )


def listing_dynamics(
    df: DataFrame,
    key: str = "listing_id",
    ts: str = "fetched_on",
    price: str = "price",
    ties: Sequence[str] = (),
    plus_one: bool = True,
) -> DataFrame:
    """Seven measures per listing. ``plus_one=False`` takes natural logs of positive prices only.

    Listings whose first price is not positive are left out.
    """
    daily = _daily_log_prices(df, key, ts, price, ties, plus_one, positive_only=not plus_one)
    lp, lp0, d = F.col("lp"), F.col("lp0"), F.col("d")
    per = daily.groupBy(key).agg(
        F.max("lp0").alias("first"),
        F.max("d").alias("days"),
        F.max_by("lp", "d").alias("last"),
        F.min(F.when(d <= 7, lp)).alias("min7"),
        F.min(F.when(d <= 30, lp)).alias("min30"),
        F.min(F.when(lp < lp0 - 0.01, d)).alias("drop_day"),
        F.stddev_pop(lp - lp0).alias("price_volatility"),
    )
    drop30 = F.greatest(F.col("first") - F.col("min30"), F.lit(0.0))
    rate = F.greatest(F.col("first") - F.col("last"), F.lit(0.0)) / F.greatest("days", F.lit(1.0))
    first_drop = F.when(F.col("drop_day").isNotNull(), F.least(F.col("drop_day") / 30.0, F.lit(1.0))).otherwise(1.0)
    score = (
        0.45 / (1 + F.col("days") / 30.0)
        + 0.20 * first_drop
        + 0.20 / (1 + 8.0 * drop30 + 30.0 * rate)
        + 0.15 / (1 + 10.0 * F.col("price_volatility"))
    )
    return per.select(
        key,
        (F.greatest(F.col("first") - F.col("min7"), F.lit(0.0)) / 7.0).alias("avg_drop_7d"),
        (drop30 / 30.0).alias("avg_drop_30d"),
        rate.alias("price_drop_rate"),
        F.coalesce("drop_day", "days").alias("time_to_first_drop"),
        F.col("days").alias("time_to_sell"),
        F.col("price_volatility"),
        (100.0 * clip(score, 0.0, 1.0)).alias("liquidity_score"),
    )


def clip_dynamics(df: DataFrame, columns: Sequence[str] = K.DYNAMICS) -> DataFrame:
    """Force predicted dynamics into their valid ranges."""
    return df.withColumns({c: clip(F.col(c), *K.DYNAMICS_BOUNDS[c]) for c in columns if c in df.columns})


def pressure_components(
    df: DataFrame, key: str = "listing_id", ts: str = "fetched_on", price: str = "price", ties: Sequence[str] = ()
) -> DataFrame:
    """Average 30-day drop, inverse observed time and volatility per listing."""
    daily = _daily_log_prices(df, key, ts, price, ties, plus_one=False, positive_only=True)
    per = daily.groupBy(key).agg(
        F.max("lp0").alias("first"),
        F.max("d").alias("days"),
        F.min(F.when(F.col("d") <= 30, F.col("lp"))).alias("min30"),
        F.stddev_pop(F.col("lp") - F.col("lp0")).alias("volatility_raw"),
    )
    return per.select(
        key,
        (F.greatest(F.col("first") - F.col("min30"), F.lit(0.0)) / 30.0).alias("avg_drop_30d_raw"),
        (1.0 / (1.0 + F.col("days"))).alias("sell_inverse_raw"),
        "volatility_raw",
    )


def fit_pressure_bounds(components: DataFrame) -> DataFrame:
    """Robust 5%-95% range per component; an empty or degenerate range has width 1."""
    edges = q.column_quantiles(components, K.PRESSURE_COMPONENTS, {"low": 0.05, "high": 0.95})
    names = components.sparkSession.createDataFrame([(c,) for c in K.PRESSURE_COMPONENTS], "column string")
    low, high = F.coalesce("low", F.lit(0.0)), F.coalesce("high", F.lit(1.0))
    return names.join(edges, "column", "left").select(
        "column", low.alias("low"), F.when(high <= low, low + 1.0).otherwise(high).alias("high")
    )


def apply_pressure(components: DataFrame, fitted: DataFrame) -> DataFrame:
    """Weighted sum of the normalised components; a missing component counts as its low bound."""
    table = fitted.agg(F.map_from_entries(F.collect_list(F.struct("column", F.struct("low", "high")))).alias("m")).scalar()

    def normal(name: str) -> str:
        low, high = f"__t['{name}'].low", f"__t['{name}'].high"
        return f"coalesce(least(greatest(({name} - {low}) / ({high} - {low}), 0.0D), 1.0D), 0.0D)"

    # An empty comparison would make greatest() return its bound, so a missing component is tested first.
    terms = [f"{w}D * CASE WHEN {c} IS NULL THEN 0.0D ELSE {normal(c)} END" for w, c in zip(K.PRESSURE_WEIGHTS, K.PRESSURE_COMPONENTS)]
    return components.withColumn("__t", table).withColumn("pressure_score", F.expr(" + ".join(terms))).drop("__t")


def pressure_score(components: DataFrame) -> DataFrame:
    return apply_pressure(components, fit_pressure_bounds(components))


def coverage(df: DataFrame, columns: Sequence[str] = K.DYNAMICS) -> DataFrame:
    """How many rows have all dynamics targets."""
    known = None
    for c in columns:
        known = F.col(c).isNotNull() if known is None else known & F.col(c).isNotNull()
    return df.agg(F.count(F.lit(1)).alias(ROWS.strip("_")), F.count_if(known).alias("known"))
