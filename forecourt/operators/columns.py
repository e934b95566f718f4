"""Header canonicalisation and projections."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from forecourt import constants as K
from forecourt.functions import numbers, text


def header_key(header: str) -> str:
    return re.sub(r"\s+", " ", header.strip().lower())


def standardize_columns(df: DataFrame, aliases: Mapping[str, str] = K.HEADER_ALIASES) -> DataFrame:
    """Rename known headers; unknown ones stay. Of two headers with one meaning the cleaner is kept."""
    df = drop_extra_prices(df)
    aliases = {**aliases, **K.DERIVED_HEADERS}
    names = {c: aliases[header_key(c)] for c in df.columns if header_key(c) in aliases}
    chosen: dict[str, str] = {}
    for header, name in names.items():
        if name not in chosen or header == name:
            chosen[name] = header
    doubled = [h for h, n in names.items() if chosen[n] != h]
    return df.drop(*doubled).withColumnsRenamed({h: n for n, h in chosen.items()})


def price_headers(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.strip().lower().startswith("price") and header_key(c) in K.HEADER_ALIASES]


def drop_extra_prices(df: DataFrame) -> DataFrame:
    """Keep one price column: the one with a correctly encoded rupee sign, else the first."""
    prices = price_headers(df)
    keep = next((c for c in prices if "₹" in c), prices[0] if prices else None)
    return df.drop(*[c for c in prices if c != keep])


def resolve_price(df: DataFrame, name: str = "price") -> DataFrame:
    """First price column under one name; a null column when there is none."""
    prices = price_headers(df)
    if name in df.columns:
        return df
    return df.withColumnRenamed(prices[0], name) if prices else df.withColumn(name, F.lit(None).cast("string"))


def ensure_kms(df: DataFrame, strict: bool = False) -> DataFrame:
    """Find the odometer column under any known alias; null, or an error when ``strict``."""
    if "kms" in df.columns:
        return df
    headers = {c.strip().lower().replace("_", " ").replace("-", " "): c for c in df.columns}
    for alias in K.ODOMETER_ALIASES:
        if alias in headers:
            return df.withColumn("kms", F.col(f"`{headers[alias]}`"))
    if strict:
        raise KeyError("no odometer column under any known alias")
    return df.withColumn("kms", F.lit(None).cast("string"))


def with_defaults(df: DataFrame, defaults: Mapping[str, tuple[str, object]]) -> DataFrame:
    """Add every missing column as a typed default."""
    return df.withColumns(
        {c: F.lit(v).cast(t) for c, (t, v) in defaults.items() if c not in df.columns}
    )


def split_names(df: DataFrame) -> DataFrame:
    """Fill make and model from the combined name when there is no make column.

    Step by step, as ``text.split_name`` repeats each step in every expression that uses it.
    """
    if "make" in df.columns or "name" not in df.columns:
        return df
    named = df.withColumn("__name", text.full_name(F.col("name")))
    named = named.withColumn("__prefix", text.known_make(F.col("__name")))
    make, model = text.name_parts(F.col("__name"), F.col("__prefix"))
    named = named.withColumns({"make": make, "model": model}).drop("__name", "__prefix")
    return named.withColumns({"make": text.title_case(F.col("make")), "model": text.title_case(F.col("model"))})


TWO_WEEK_DEFAULTS = {
    "car_id": ("string", None), "date_posted": ("string", None), "price": ("string", None),
    "make": ("string", "UNKNOWN"), "model": ("string", "UNKNOWN"), "variant": ("string", "UNKNOWN"),
    "kms_driven": ("string", None), "ownership": ("string", None), "city": ("string", "UNKNOWN"),
    "car_age": ("double", None), "year": ("string", None),
}


def two_week_schema(df: DataFrame) -> DataFrame:
    """Map raw headers to the snake_case frame and fill the missing columns."""
    named = split_names(standardize_columns(df)).withColumnsRenamed(K.SNAKE_NAMES)
    return with_defaults(named, TWO_WEEK_DEFAULTS).select(*TWO_WEEK_DEFAULTS)


def drop_leakage(
    df: DataFrame, names: Sequence[str] = K.LEAKAGE_COLUMNS, patterns: Sequence[str] = K.LEAKAGE_PATTERNS
) -> DataFrame:
    """Drop columns known only after listing time, by name and by pattern."""
    bad = [c for c in df.columns if c in names or any(p in c.strip().lower() for p in patterns)]
    return df.drop(*bad)


def keep_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.select(*[c for c in names if c in df.columns])


def option_levels(df: DataFrame, columns: Sequence[str] = K.CATEGORICAL) -> DataFrame:
    """Distinct (column, level) pairs to choose from, without the 'other' marker."""
    from forecourt.operators.schema import levels

    return levels(df, columns, missing=K.OTHER_LEVEL, extra={}).where(F.col("level") != K.OTHER_LEVEL)


def numeric_or_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: numbers.finite(F.col(c).try_cast("double")) for c in columns})
