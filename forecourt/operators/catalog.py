"""Catalog of brands, models and variants in the layout of the multiplier table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from forecourt import constants as K
from forecourt.functions.text import normalize_text


def catalog(df: DataFrame, include_unknown: bool = False, only: str = "all") -> DataFrame:
    """Distinct brands, (brand, model) and (brand, model, variant): one grouping-sets pass."""
    names = ["make", "model", "variant"]
    clean = df.select(*[(normalize_text(F.col(c)) if c in df.columns else F.lit(K.UNKNOWN)).alias(c) for c in names])
    if not include_unknown:
        for c in names:
            clean = clean.where(F.col(c) != K.UNKNOWN)
    sets = [[F.col(c) for c in names[: i + 1]] for i in range(3)]
    grouped = clean.groupingSets(sets, *names).agg(F.grouping_id().alias("g"))
    # grouping_id: 0 all three columns, 1 without variant, 3 brand only.
    kind = F.when(F.col("g") == 3, "brand").when(F.col("g") == 1, "model").otherwise("variant")
    name = F.when(F.col("g") == 3, F.col("make")).when(F.col("g") == 1, F.col("model")).otherwise(F.col("variant"))
    parent = F.when(F.col("g") == 1, F.col("make")).when(F.col("g") == 0, F.concat_ws(" | ", "make", "model"))
    blank = F.lit("")
    out = grouped.select(
        kind.alias("type"), blank.alias("scope"), name.alias("name"), F.coalesce(parent, blank).alias("parent"),
        blank.alias("min"), blank.alias("max"), blank.alias("multiplier"), blank.alias("notes"),
    )
    return out if only == "all" else out.where(F.col("type") == only.rstrip("s"))
