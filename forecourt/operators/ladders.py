"""Trim ladders: an ordinal score of a variant name, and the multiplier it stands for."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from forecourt import constants as K
from forecourt.functions.text import squeeze
from forecourt.trims import LADDERS, Pattern

DEFAULT_SCORE = 3
_SPECIAL = re.compile(r"([^A-Za-z0-9_])")


def token_regex(token: str) -> str:
    """Whole-word pattern of a token: spaces match any whitespace; a final '+' must not run into a word."""
    if isinstance(token, Pattern):
        return str(token)
    plus = token.endswith("+")
    words = token.rstrip("+").split() if plus else token.split()
    body = r"\s+".join(_SPECIAL.sub(r"\\\1", w) for w in words)
    start = r"\b" if body else ""
    return start + body + (r"\+(?!\w)" if plus else r"\b")


def raw_name(c: Column) -> Column:
    return F.upper(squeeze(c))


def token_name(c: Column) -> Column:
    """Upper-case name reduced to letters, digits and + & /."""
    return squeeze(F.regexp_replace(F.upper(c), r"[^A-Z0-9+&/ ]", " "))


def ladder_rules(spark: SparkSession, ladders: Mapping[str, Mapping[str, Sequence[Sequence[str]]]]) -> DataFrame:
    """(scope, parent, level, n_levels, regex): one row per token of each ladder. Scope is 'model' or 'brand'."""
    rows = [
        (scope, parent, level, len(steps), "(?i)" + token_regex(token))
        for scope, table in ladders.items()
        for parent, steps in table.items()
        for level, tokens in enumerate(steps)
        for token in tokens
    ]
    return spark.createDataFrame(rows, "scope string, parent string, level int, n_levels int, regex string")


def default_rules(spark: SparkSession) -> DataFrame:
    return ladder_rules(spark, LADDERS)


def _score(text: Column, ladder: Column) -> Column:
    """Position of the highest matching level, stretched to 1..5; null without a match."""
    levels = F.transform(F.filter(ladder["rules"], lambda r: F.rlike(text, r["regex"])), lambda r: r["level"])
    best, n = F.array_max(levels), ladder["n"]
    mapped = F.rint(best / F.nullif(n - 1, F.lit(0)) * 4).cast("int") + 1
    return F.when(best.isNotNull() & (n <= 1), F.lit(DEFAULT_SCORE)).when(
        best.isNotNull(), F.greatest(F.least(mapped, F.lit(5)), F.lit(1))
    )


def ladder_score(df: DataFrame, rules: DataFrame, name: str = "name", parent: str = "parent") -> DataFrame:
    """Model ladder on the raw then the reduced name, else the brand's ladder, else 3.

    Rules are packed into one array per parent, so scoring adds one lookup join per scope and no
    row is multiplied. The rule table is configuration.
    """
    packed = rules.groupBy("scope", "parent").agg(
        F.struct(F.max("n_levels").alias("n"), F.collect_list(F.struct("level", "regex")).alias("rules")).alias("ladder")
    )
    models = packed.where(F.col("scope") == "model").select(F.col("parent").alias("__p"), F.col("ladder").alias("__model"))
    brands = packed.where(F.col("scope") == "brand").select(F.col("parent").alias("__b"), F.col("ladder").alias("__brand"))
    out = df.withColumns({"__p": F.col(parent), "__b": raw_name(F.split(F.col(parent), r"\|")[0])})
    out = out.join(models, "__p", "left").join(brands, "__b", "left")
    raw, reduced = raw_name(F.col(name)), token_name(F.col(name))
    score = F.coalesce(
        _score(raw, F.col("__model")), _score(reduced, F.col("__model")), _score(reduced, F.col("__brand")), F.lit(DEFAULT_SCORE)
    )
    return out.withColumn("ladder_score", score).drop("__p", "__b", "__model", "__brand")


def token_adjust(df: DataFrame, tiers: Mapping[int, Sequence[str]], name: str = "name", score: str = "ladder_score") -> DataFrame:
    """Entry-level tokens force 1; others bound the score: tier 2 from above, tiers 4 and 5 from below."""
    text = token_name(F.col(name))

    def has(tier: int) -> Column:
        tokens = tiers.get(tier, ())
        if not tokens:
            return F.lit(False)
        return text.rlike("(?i)(?:" + "|".join(token_regex(t) for t in tokens) + ")")

    current = F.col(score)
    current = F.when(has(2), F.least(current, F.lit(2))).otherwise(current)
    current = F.when(has(4), F.greatest(current, F.lit(4))).otherwise(current)
    current = F.when(has(5), F.greatest(current, F.lit(5))).otherwise(current)
    return df.withColumn("score", F.when(has(1), F.lit(1)).otherwise(F.greatest(F.least(current, F.lit(5)), F.lit(1))))


def score_multiplier(score: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in K.SCORE_MULTIPLIERS.items() for x in kv])
    return F.try_element_at(table, score)


def variant_multipliers(df: DataFrame, rules: DataFrame, tiers: Mapping[int, Sequence[str]]) -> DataFrame:
    """Catalog variant rows with their multiplier set from the name."""
    scored = token_adjust(ladder_score(df, rules), tiers)
    return scored.withColumn("multiplier", F.round(score_multiplier(F.col("score")), 2)).drop("ladder_score", "score")
