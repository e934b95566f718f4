"""Demand multipliers: hierarchical and bucket lookups, and their weighted geometric mean.

The multiplier table is hand-made configuration (a few hundred rows). Its joins carry no hint:
Spark broadcasts it by its measured size.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from forecourt import constants as K
from forecourt.functions.numbers import clip, finite
from forecourt.functions.text import blank_to_null, strip
from forecourt.session import stored

TEXT = ("type", "scope", "name", "parent", "notes")
NUMBERS = ("min", "max", "multiplier")
FLAT = {"city": "city", "body_type": "bodytype", "fuel": "fuel", "transmission": "transmission"}
BUCKETS = {"car_age": "age_bucket", "kms_per_year": "kms_year_bucket", "ownership": "ownership_bucket"}


def multiplier_table(raw: DataFrame, strip_suffix: str | None = None) -> DataFrame:
    """Trim cells, blank to null, lenient numbers, rows without type dropped.

    ``position`` is the row's place in the file, which decides between duplicates.
    ``strip_suffix`` removes e.g. '(discontinued)' from names.
    """
    if "position" not in raw.columns:
        raw = raw.withColumn("position", F.monotonically_increasing_id())
    text = {c: blank_to_null(F.col(c).cast("string")) for c in TEXT}
    if strip_suffix:
        text["name"] = blank_to_null(F.replace(text["name"], F.lit(strip_suffix), F.lit("")))
    numbers = {c: finite(strip(F.col(c).cast("string")).try_cast("double")) for c in NUMBERS}
    out = raw.select("position", *[e.alias(c) for c, e in {**text, **numbers}.items()])
    return out.where(F.col("type").isNotNull())


def _norm(c: Column) -> Column:
    return F.lower(strip(c.cast("string")))


def _rows(table: DataFrame, kind: str) -> DataFrame:
    return table.where(_norm(F.col("type")) == kind)


def _lookup(df: DataFrame, rows: DataFrame, on: Mapping[str, Column], keys: Mapping[str, Column], out: str, first: bool = True) -> DataFrame:
    """Attach struct(multiplier) of the first (or last) matching row; a match with a blank multiplier is still a match."""
    pick = F.min if first else F.max
    best = pick(F.struct("position", "multiplier"))
    table = rows.select(*[e.alias(f"__{k}") for k, e in keys.items()], "position", "multiplier")
    table = table.groupBy(*[f"__{k}" for k in keys]).agg(best.alias("__b")).select(
        *[f"__{k}" for k in keys], F.struct(F.col("__b.multiplier").alias("multiplier")).alias(out)
    )
    probe = df.withColumns({f"__{k}": e for k, e in on.items()})
    return probe.join(table, [f"__{k}" for k in keys], "left").drop(*[f"__{k}" for k in keys])


def hierarchy(df: DataFrame, table: DataFrame) -> DataFrame:
    """Variant (make and model, else make only), then model, then brand: ``base_source`` and ``base_multiplier``."""
    parts = F.transform(F.split(F.col("parent"), r"\|"), lambda p: _norm(p))
    variants = _rows(table, "variant").withColumn("__parts", parts)
    stated = F.when(F.coalesce(F.col("variant"), F.lit("")).isin("", K.UNKNOWN), None).otherwise(_norm(F.col("variant")))
    make, model = _norm(F.col("make")), _norm(F.col("model"))
    named = {"name": _norm(F.col("name"))}

    out = _lookup(
        df, variants.where(F.size("__parts") > 1), {"name": stated, "make": make, "model": model},
        {**named, "make": F.col("__parts")[0], "model": F.get(F.col("__parts"), F.lit(1))}, "__full",
    )
    out = _lookup(
        out, variants.where(F.size("__parts") == 1), {"name": stated, "make": make},
        {**named, "make": F.col("__parts")[0]}, "__loose", first=False,
    )
    out = _lookup(out, _rows(table, "model"), {"name": model, "make": make}, {**named, "make": _norm(F.col("parent"))}, "__model")
    out = _lookup(out, _rows(table, "brand"), {"name": make}, named, "__brand")
    found = F.coalesce("__full", "__loose", "__model", "__brand")
    source = (
        F.when(F.coalesce("__full", "__loose").isNotNull(), "variant")
        .when(F.col("__model").isNotNull(), "model")
        .when(F.col("__brand").isNotNull(), "make")
    )
    return out.withColumns({"base_source": source, "base_multiplier": found["multiplier"]}).drop("__full", "__loose", "__model", "__brand")


def flat_lookups(df: DataFrame, table: DataFrame, reg_state: str | None = None) -> DataFrame:
    """One multiplier column per plain attribute: m_city, m_body_type, m_fuel, m_transmission[, m_reg_state]."""
    kinds = dict(FLAT)
    if reg_state:
        kinds[reg_state] = "reg_state"
    out = df
    for column, kind in kinds.items():
        out = _lookup(out, _rows(table, kind), {"name": _norm(F.col(column))}, {"name": _norm(F.col("name"))}, "__m")
        out = out.withColumn(f"m_{column}", F.col("__m.multiplier")).drop("__m")
    return out


def bucket_array(table: DataFrame, kind: str) -> Column:
    """The handful of buckets of one kind as one array, in file order: no range join is needed."""
    rows = _rows(table, kind).where(F.col("min").isNotNull() & F.col("max").isNotNull())
    packed = F.sort_array(F.collect_list(F.struct("position", "min", "max", "multiplier")))
    return rows.agg(packed.alias("b")).scalar()


def bucket_lookups(df: DataFrame, table: DataFrame) -> DataFrame:
    """m_<column>: multiplier of the first bucket in file order with min <= value < max."""
    out = df.withColumns({f"__{c}": bucket_array(table, kind) for c, kind in BUCKETS.items()})

    def first(c: str) -> Column:
        value = F.col(c)
        return F.get(F.filter(f"__{c}", lambda b: (value >= b["min"]) & (value < b["max"])), F.lit(0))["multiplier"]

    return out.withColumns({f"m_{c}": first(c) for c in BUCKETS}).drop(*[f"__{c}" for c in BUCKETS])


def composite(
    df: DataFrame, weights: Mapping[str, float] = K.DEMAND_WEIGHTS, clamp: tuple[float, float] = K.DEMAND_CLAMP
) -> DataFrame:
    """Weighted geometric mean of the multipliers that were found, weights renormalised over them.

    Adds ``composite`` (1.0 when nothing matched) and ``breakdown``, an array of
    (name, multiplier, normalised weight). Plain column arithmetic: no shuffle.
    """
    base = F.coalesce(
        *[F.when(F.col("base_source") == s, F.lit(float(weights.get(s, 0.0)))) for s in ("variant", "model", "make")], F.lit(0.0)
    )
    parts = [(F.col("base_source"), F.col("base_multiplier"), base)]
    for name in [*FLAT, *BUCKETS, "reg_state"]:
        if f"m_{name}" in df.columns:
            parts.append((F.lit(name), F.col(f"m_{name}"), F.lit(float(weights.get(name, 0.0)))))
    used = [(n, m, w, F.coalesce((m > 0) & (w > 0), F.lit(False))) for n, m, w in parts]
    total, logs = F.lit(0.0), F.lit(0.0)
    for _, m, w, ok in used:
        total = total + F.when(ok, w).otherwise(0.0)
        logs = logs + F.when(ok, w * F.log(m)).otherwise(0.0)
    out = df.withColumns({"__w": total, "__l": logs})
    value = F.when(F.col("__w") > 0, clip(F.exp(F.col("__l") / F.col("__w")), *clamp)).otherwise(1.0)
    steps = F.array(*[
        F.when(ok, F.struct(n.alias("name"), m.alias("multiplier"), (w / F.col("__w")).alias("weight"))) for n, m, w, ok in used
    ])
    breakdown = F.filter(steps, lambda s: s.isNotNull())
    return out.withColumns({"composite": value, "breakdown": breakdown}).drop("__w", "__l")


def demand_adjust(df: DataFrame, table: DataFrame, price: str | None = None, reg_state: str | None = None) -> DataFrame:
    """All lookups and the composite; with ``price``, also the demand-adjusted price.

    The table is stored once: every lookup reads it, and its size is known before the rows of ``df`` would be shuffled to meet it.
    """
    table = stored(table, "multipliers")
    out = composite(bucket_lookups(flat_lookups(hierarchy(df, table), table, reg_state), table))
    return out.withColumn("adjusted_price", F.col(price) * F.col("composite")) if price else out

