"""Numbers hidden in free text, and numeric transforms."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from forecourt import constants as K
from forecourt.functions.text import strip


def to_double(c: Column) -> Column:
    """Lenient cast: null instead of an ANSI error."""
    return c.try_cast("double")


def plain_number(c: Column) -> Column:
    """Plain decimal text to double; anything else (including '12d', 'NaN') to null."""
    return F.when(c.rlike(r"^\s*\d+(\.\d+)?\s*$"), to_double(strip(c)))


def parse_kms(c: Column, mode: str = "compat") -> Column:
    """First number, scaled by 100,000 when the text has an 'l', else by 1,000 when it has a 'k'.

    In ``compat`` mode the 'k' of a trailing 'km' scales too; ``strict`` removes the unit first.
    """
    text = F.replace(strip(F.lower(c)), F.lit(","), F.lit(""))
    if mode == "strict":
        text = F.regexp_replace(text, r"\s*kms?\.?$", "")
    number = to_double(F.nullif(F.regexp_extract(text, r"(\d+(?:\.\d+)?)", 1), F.lit("")))
    scale = F.when(F.contains(text, F.lit("l")), 100_000.0).when(F.contains(text, F.lit("k")), 1_000.0).otherwise(1.0)
    return F.rint(number * scale)


def parse_number_tokens(c: Column) -> Column:
    """First token that is a number with an optional k / l / lakh / lac / km suffix."""
    cleaned = F.regexp_replace(F.replace(F.lower(c), F.lit(","), F.lit("")), r"[^a-z0-9.\- ]", " ")
    pattern = r"^(-?(?:\d+\.?\d*|\.\d+))(k|l)?(lakh|lac|km)?$"

    def value(token: Column) -> Column:
        inner, outer = F.regexp_extract(token, pattern, 2), F.regexp_extract(token, pattern, 3)
        scale = (
            F.when(inner == "k", 1_000.0)
            .when((inner == "l") | outer.isin("lakh", "lac"), 100_000.0)
            .otherwise(1.0)
        )
        return to_double(F.nullif(F.regexp_extract(token, pattern, 1), F.lit(""))) * scale

    tokens = F.filter(F.split(strip(cleaned), r"\s+"), lambda t: ~t.isin(*K.UNIT_WORDS))
    return F.try_element_at(F.filter(F.transform(tokens, value), lambda v: v.isNotNull()), F.lit(1))


def owner_word(text: Column) -> Column:
    return F.coalesce(*[F.when(F.contains(text, F.lit(w)), F.lit(float(n))) for w, n in K.OWNER_WORDS])


def parse_ownership(c: Column, words_first: bool = False) -> Column:
    """Owner count from '2', '1st owner', 'second'; null when unreadable.

    ``words_first`` looks for the words before the digits and defaults to one owner.
    """
    text = F.lower(c)
    if words_first:
        digits = to_double(F.nullif(F.regexp_replace(text, r"[^0-9]", ""), F.lit("")))
        return F.coalesce(owner_word(text), digits, F.lit(1.0))
    digits = to_double(F.nullif(F.regexp_extract(text, r"(\d+)", 1), F.lit("")))
    return F.coalesce(digits, owner_word(text))


def parse_year(c: Column) -> Column:
    """A plain number is taken as it is ('2017.0'); other text is reduced to its digits ('2,017')."""
    digits = F.nullif(F.regexp_replace(c, r"[^0-9]", ""), F.lit(""))
    return F.coalesce(plain_number(c), to_double(digits))


def parse_price(c: Column) -> Column:
    return to_double(F.nullif(F.regexp_replace(c, r"[^0-9.]", ""), F.lit("")))


def at_least(c: Column, low: float) -> Column:
    """Clip from below, keeping null (``greatest`` alone would return the bound)."""
    return F.when(c.isNotNull(), F.greatest(c, F.lit(low)))


def clip(c: Column, low: float | None = None, high: float | None = None) -> Column:
    out = c
    if low is not None:
        out = F.greatest(out, F.lit(float(low)))
    if high is not None:
        out = F.least(out, F.lit(float(high)))
    return F.when(c.isNotNull(), out)


def finite(c: Column) -> Column:
    """Null out NaN and infinities, which stand for 'missing' in float data."""
    value = c.cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def log_price(c: Column, plus_one: bool = True) -> Column:
    """log1p, or the natural log of the price clipped at 1."""
    return F.log1p(c) if plus_one else F.log(at_least(c, 1.0))


def unlog_price(c: Column, plus_one: bool = True) -> Column:
    return F.expm1(c) if plus_one else F.exp(c)


def hash_unit(c: Column, seed: str = "") -> Column:
    """A stable 52-bit number per key: the same on every run and partitioning."""
    text = F.concat(F.lit(seed), c.cast("string")) if seed else c.cast("string")
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("bigint")


def hash_fold(c: Column, k: int, seed: str = "") -> Column:
    text = F.concat(F.lit(seed), c.cast("string")) if seed else c.cast("string")
    return F.pmod(F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("bigint"), F.lit(k)).cast("int")
