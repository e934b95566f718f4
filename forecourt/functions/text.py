"""Text cleaning: whitespace, names, value maps, registration states."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from forecourt import constants as K

WHITE = " \t\n\x0b\f\r"  # what \s stands for


def squeeze(c: Column) -> Column:
    """Strip and collapse every run of whitespace to one space; a lone space is left as it is, so most texts are not rewritten."""
    return F.trim(F.regexp_replace(c, r"[ \t\n\x0b\f\r]{2,}|[\t\n\x0b\f\r]", " "))


def unfused(c: Column) -> Column:
    """The same value, by way of an array function. Spark compiles a projection with one into small functions; many
    others would make, with the steps before and after, a single method too large for the JVM to compile.
    """
    return F.transform(F.array(c), lambda x: x)[0]


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITE))


def blank_to_null(c: Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


def normalize_text(c: Column, default: str = K.UNKNOWN) -> Column:
    return F.coalesce(F.nullif(squeeze(c), F.lit("")), F.lit(default))


def category_key(c: Column) -> Column:
    return F.lower(squeeze(c))


def title_case(c: Column) -> Column:
    """Capital after every non-letter, as in 'Mercedes-Benz'; initcap alone only looks at spaces, which does for most texts."""
    runs = F.regexp_extract_all(c, F.lit(r"(\p{L}+|\P{L}+)"), 1)
    parts = F.array_join(F.transform(runs, F.initcap), "")
    ascii = F.octet_length(c) == F.char_length(c)
    return F.when(ascii & ~c.rlike("[^A-Za-z ][A-Za-z]"), F.initcap(c)).otherwise(parts)


def full_name(c: Column) -> Column:
    return strip(F.upper(F.coalesce(c, F.lit(K.UNKNOWN))))


def known_make(value: Column) -> Column:
    """The two-word make that an upper-case name begins with, or null."""
    found = F.regexp_extract(value, f"^({'|'.join(K.MULTI_WORD_MAKES)})", 1)
    return F.nullif(found, F.lit(""))


def name_parts(value: Column, prefix: Column) -> tuple[Column, Column]:
    """Make and model of an upper-case name: the known make, else first word, and the rest."""
    rest = F.when(prefix.isNotNull(), strip(F.substring(value, F.length(prefix) + 1, F.length(value)))).otherwise(
        F.regexp_extract(value, r"(?s)^\S+\s+(.*)$", 1)
    )
    make = F.coalesce(prefix, F.nullif(F.regexp_extract(value, r"^(\S+)", 1), F.lit("")), F.lit(K.UNKNOWN))
    return make, F.coalesce(F.nullif(rest, F.lit("")), F.lit(K.UNKNOWN))


def split_name(c: Column) -> Column:
    """struct(make, model): known two-word makes first, else first word and the rest."""
    value = full_name(c)
    make, model = name_parts(value, known_make(value))
    return F.struct(title_case(make).alias("make"), title_case(model).alias("model"))


def map_values(c: Column, mapping: dict[str, str]) -> Column:
    """Lookup in a small fixed mapping; null where the value is not a key."""
    table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return F.try_element_at(table, c)


def transmission(c: Column, default: str = K.UNKNOWN) -> Column:
    return F.coalesce(map_values(strip(c), K.TRANSMISSION_CODES), normalize_text(c, default))


def mapped_fuel(value: Column) -> Column:
    return F.coalesce(map_values(value, K.FUEL_ALIASES), value)


def fuel(c: Column) -> Column:
    return mapped_fuel(F.upper(normalize_text(c)))


def mapped_body(value: Column) -> Column:
    return F.coalesce(map_values(F.upper(value), K.BODY_TYPES), value)


def body_type(c: Column) -> Column:
    return mapped_body(normalize_text(c))


def upper_city(value: Column) -> Column:
    return F.when(value == K.UNKNOWN, value).otherwise(F.upper(value))


def city(c: Column) -> Column:
    return upper_city(normalize_text(c))


def reg_state(registration: Column) -> Column:
    """Two leading letters of a registration, else UNK."""
    lead = F.regexp_extract(strip(F.upper(registration)), r"^([A-Z]{2})", 1)
    return F.coalesce(F.nullif(lead, F.lit("")), F.lit("UNK"))


def short_state(value: Column) -> Column:
    return F.when((value == "UNKNOWN") | (F.length(value) < 2), F.lit("UNK")).otherwise(F.substring(value, 1, 2))


def normalize_state(c: Column) -> Column:
    return short_state(F.upper(normalize_text(c, "UNK")))


def fill_state(state: Column, registration: Column, override: Column | None = None) -> Column:
    """An override wins, then a stated state, then the one read from the registration."""
    options = [] if override is None else [blank_to_null(override)]
    return F.coalesce(*options, blank_to_null(state), reg_state(registration))
