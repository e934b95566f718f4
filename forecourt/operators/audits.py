"""Data-quality audits as small result tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from forecourt import constants as K
from forecourt.operators import filters, quantiles as q, snapshots

STEPS = ("raw", "last snapshot per ID", "price, year and kms present", "year in range", "kms in range", "price within quantiles")
NAMES = ("make", "model", "variant", "transmission", "fuel", "body_type", "reg_state")
FEATURES = ("year", "kms", "car_age", "kms_per_year", "ownership", "log_kms")
IDENTITY = ("make", "model", "year", "fuel", "transmission")
DUPLICATE = ("make", "model", "variant", "year", "kms", "fuel", "transmission", "ownership")


def _share(part: Column, whole: Column) -> Column:
    return part / F.nullif(whole.cast("double"), F.lit(0.0)) * 100.0


def filter_steps(
    df: DataFrame, snapshot_year: Column, min_year: int = K.MIN_YEAR, max_kms: float = K.MAX_KMS,
    low: float = 0.01, high: float = 0.99, ties: Sequence[str] = (),
) -> DataFrame:
    """Rows removed and left at each cleaning step.

    Each row gets the number of the first step it fails, so one aggregate counts all steps; only
    the price bounds need the survivors first.
    """
    latest = snapshots.last_snapshot(df, ties=ties)
    missing = F.col("price").isNull() | F.col("year").isNull() | F.col("kms").isNull()
    code = (
        F.when(missing, 2)
        .when(~filters.year_valid(F.col("year"), snapshot_year, min_year), 3)
        .when(~filters.kms_valid(F.col("kms"), max_kms), 4)
        .otherwise(0)
    )
    coded = latest.select("price", code.alias("code"))
    bounded = coded.withColumn("__bound", q.bounds(coded.where(F.col("code") == 0), "price", low, high))
    outside = (F.col("code") == 0) & ~F.col("price").between(F.col("__bound.low"), F.col("__bound.high"))
    final = bounded.select(F.when(outside, 5).otherwise(F.col("code")).alias("code"))
    counts = final.agg(F.count(F.lit(1)).alias("kept"), *[F.count_if(F.col("code") == i).alias(f"s{i}") for i in range(2, 6)])
    counts = counts.withColumn("raw", df.agg(F.count(F.lit(1)).alias("n")).scalar())
    raw = F.col("raw")
    removed: list[Column] = [F.lit(0).cast("bigint"), raw - F.col("kept"), *[F.col(f"s{i}") for i in range(2, 6)]]
    rows, left = [], raw
    for i, (label, gone) in enumerate(zip(STEPS, removed)):
        left = left - gone
        rows.append(F.struct(
            F.lit(i).alias("step"), F.lit(label).alias("label"), gone.alias("removed"), left.alias("remaining"),
            _share(gone, raw).alias("removed_pct"),
        ))
    return counts.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def parse_nulls(df: DataFrame, columns: Sequence[str] = ("price", "year", "kms")) -> DataFrame:
    """Missing values per column after parsing."""
    return _per_column(df, columns, lambda c: F.col(c).isNull(), "nulls")


def _per_column(df: DataFrame, columns: Sequence[str], test, name: str) -> DataFrame:
    one = df.agg(F.count(F.lit(1)).alias("__n"), *[F.count_if(test(c)).alias(c) for c in columns])
    rows = F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).alias(name), _share(F.col(c), F.col("__n")).alias("pct")) for c in columns
    ])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def unknown_rates(df: DataFrame, columns: Sequence[str] = NAMES) -> DataFrame:
    """Rows per column that are null or an unknown marker."""
    return _per_column(df, columns, lambda c: F.col(c).isNull() | F.col(c).isin(K.UNKNOWN, "UNK"), "unknown")


def lost_years(df: DataFrame, min_year: int = K.MIN_YEAR) -> DataFrame:
    """Distribution of the years the year filter removes."""
    return value_counts(df.where(F.col("year") < min_year), "year")


def snapshot_changes(df: DataFrame, columns: Sequence[str], key: str = "listing_id") -> DataFrame:
    """Per column: IDs with more than one distinct value, and their share of multi-snapshot IDs.

    min < max per ID stands in for a distinct count and combines map-side.
    """
    per = df.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.count(F.lit(1)).alias("__n"), *[(F.min(c) < F.max(c)).alias(c) for c in columns]
    )
    one = per.agg(F.count_if(F.col("__n") > 1).alias("__multi"), *[F.count_if(F.col(c)).alias(c) for c in columns])
    rows = F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).alias("changed_ids"), F.coalesce(_share(F.col(c), F.col("__multi")), F.lit(0.0)).alias("pct_of_multi"))
        for c in columns
    ])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def price_changes(df: DataFrame, key: str = "listing_id", price: str = "price") -> DataFrame:
    """One row: IDs seen more than once, how many changed price, and the spread of those that did."""
    per = df.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.count(price).alias("n"), F.min(price).alias("low"), F.max(price).alias("high"), F.avg(price).alias("mean")
    )
    multi = per.where(F.col("n") > 1)
    changed = F.col("low") < F.col("high")
    spread = F.coalesce((F.col("high") - F.col("low")) / F.nullif(F.col("mean"), F.lit(0.0)) * 100.0, F.lit(0.0))
    middle = q.median_scalar(multi.where(changed), spread)
    out = multi.agg(
        F.count(F.lit(1)).alias("multi_ids"),
        F.count_if(~changed).alias("never_changed"),
        F.count_if(changed).alias("changed"),
        F.avg(F.when(changed, spread)).alias("mean_spread_pct"),
    )
    return out.withColumns({
        "never_changed_pct": _share(F.col("never_changed"), F.col("multi_ids")),
        "median_spread_pct": middle,
    })


def distribution(df: DataFrame, column: str = "price") -> DataFrame:
    """Count, mean, sample deviation, quartiles, and bias-corrected skewness and excess kurtosis."""
    quartiles = q.quantiles(df, [], column, {"p25": 0.25, "p50": 0.5, "p75": 0.75}).select(F.struct("p25", "p50", "p75").alias("c")).scalar()
    c = F.col(column)
    base = df.agg(
        F.count(c).alias("count"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("min"), F.max(c).alias("max"),
        F.skewness(c).alias("g1"), F.kurtosis(c).alias("g2"),
    ).withColumn("c", quartiles)
    cuts = F.col("c")
    n = F.col("count").cast("double")
    skew = F.when(n > 2, F.col("g1") * F.sqrt(n * (n - 1)) / (n - 2))
    kurt = F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("g2") + 6))
    return base.select(
        "count", "mean", "std", "min", "max", cuts["p25"].alias("p25"), cuts["p50"].alias("p50"), cuts["p75"].alias("p75"),
        skew.alias("skewness"), kurt.alias("kurtosis"),
    )


def _value_table(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    cells = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot([], list(columns), "column", "value")
    return cells.where(F.col("value").isNotNull()).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def cardinality(df: DataFrame, columns: Sequence[str] = NAMES, rare: int = 10) -> DataFrame:
    """Per column: distinct values, share of rare ones, and the most frequent value."""
    top = F.min(F.struct((-F.col("n")).alias("k"), F.col("value").alias("value")))
    per = _value_table(df, columns).groupBy("column").agg(
        F.count(F.lit(1)).alias("distinct_values"), F.count_if(F.col("n") < rare).alias("rare_values"), top.alias("t")
    )
    return per.select(
        "column", "distinct_values", _share(F.col("rare_values"), F.col("distinct_values")).alias("rare_pct"),
        F.col("t.value").alias("top_value"), (-F.col("t.k")).alias("top_count"),
    )


def sparsity(df: DataFrame, column: str = "variant", thresholds: Sequence[int] = (1, 2, 5, 10, 20, 50)) -> DataFrame:
    """How many values occur at most so often."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).count()
    one = counts.agg(F.count(F.lit(1)).alias("all"), *[F.count_if(F.col("count") <= t).alias(f"t{t}") for t in thresholds])
    rows = F.array(*[
        F.struct(F.lit(t).alias("threshold"), F.col(f"t{t}").alias("n_values"), _share(F.col(f"t{t}"), F.col("all")).alias("pct"))
        for t in thresholds
    ])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def group_cv(df: DataFrame, keys: Sequence[str] = IDENTITY, price: str = "price", min_rows: int = 5) -> DataFrame:
    """Price spread inside groups of like vehicles: count, mean, deviation, range and CV in percent."""
    rows = df.dropna(subset=list(keys))
    per = rows.groupBy(*keys).agg(
        F.count(price).alias("n"), F.avg(price).alias("mean"), F.stddev_samp(price).alias("std"),
        F.min(price).alias("low"), F.max(price).alias("high"),
    )
    return per.where(F.col("n") >= min_rows).withColumn("cv", _share(F.col("std"), F.col("mean")))


def group_cv_summary(df: DataFrame, keys: Sequence[str] = IDENTITY, price: str = "price", min_rows: int = 5) -> DataFrame:
    groups = group_cv(df, keys, price, min_rows)
    cuts = q.quantiles(groups, [], "cv", {"median_cv": 0.5, "p75_cv": 0.75, "p90_cv": 0.9})
    mean = groups.agg(F.avg("cv").alias("m")).scalar()
    return cuts.select(F.col("n").alias("groups"), "median_cv", mean.alias("mean_cv"), "p75_cv", "p90_cv")


def group_cv_worst(df: DataFrame, n: int = 10, keys: Sequence[str] = IDENTITY, price: str = "price", min_rows: int = 5) -> DataFrame:
    return group_cv(df, keys, price, min_rows).orderBy(F.desc("cv"), *keys).limit(n)


def correlations(df: DataFrame, features: Sequence[str] = FEATURES, price: str = "price") -> DataFrame:
    """Pearson correlation of each feature with the price, over rows that have both."""
    one = df.agg(*[F.corr(c, price).alias(c) for c in features])
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("r")) for c in features])
    return one.select(F.explode(rows).alias("x")).select("x.*")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("rows")).orderBy(column)


def duplicate_spread(df: DataFrame, keys: Sequence[str] = DUPLICATE, price: str = "price", big: float = 30.0) -> DataFrame:
    """One row on vehicles equal in all keys but listed more than once: how far their prices differ."""
    per = df.groupBy(*keys).agg(
        F.count(price).alias("n"), F.min(price).alias("low"), F.max(price).alias("high"), F.avg(price).alias("mean")
    )
    dup = per.where(F.col("n") >= 2).withColumn("spread", _share(F.col("high") - F.col("low"), F.col("mean")))
    middle = q.median_scalar(dup, "spread")
    out = dup.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("duplicate_rows"), F.count(F.lit(1)).alias("duplicate_groups"),
        F.avg("spread").alias("mean_spread_pct"), F.count_if(F.col("spread") > big).alias("big_groups"),
    )
    return out.withColumns({"median_spread_pct": middle, "big_pct": _share(F.col("big_groups"), F.col("duplicate_groups"))})


def city_effect(df: DataFrame, price: str = "price", min_rows: int = 50, n: int = 10) -> DataFrame:
    """Dearest cities among those with enough rows."""
    per = df.groupBy("city").agg(F.count(price).alias("rows"), F.avg(price).alias("mean_price"))
    return per.where(F.col("rows") >= min_rows).orderBy(F.desc("mean_price"), "city").limit(n)


def source_ranges(df: DataFrame, source: str = "source", price: str = "price") -> DataFrame:
    return df.groupBy(source).agg(F.count(F.lit(1)).alias("rows"), F.min(price).alias("min_price"), F.max(price).alias("max_price"))
