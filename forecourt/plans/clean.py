"""Cleaning plans: raw text snapshots to typed listings.

The per-listing facts a plan needs (first date, identity check) come from a single
map-side-combined aggregate that is joined back once. Plans that need them go over the rows
more than once, so the parsed rows are stored first: texts are parsed once a row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from forecourt import constants as K
from forecourt.functions import bands, dates, numbers, text
from forecourt.operators import columns as C, filters, quantiles as q, snapshots
from forecourt.operators.dynamics import listing_dynamics
from forecourt.operators.encodings import group_variants, top_values
from forecourt.operators.skew import attach, group_rows
from forecourt.session import stored

RAW_TEXT = ("make", "model", "variant", "transmission", "fuel", "body_type", "city")
RAW_DEFAULTS = {
    "listing_id": ("string", None), "registration": ("string", None), "fetched_on": ("string", None),
    "kms": ("string", None), "year": ("string", None), "ownership": ("string", None), "price": ("string", None),
    **{c: ("string", None) for c in RAW_TEXT},
}
TRAIN, TRAIN_UNPRICED, PREDICT = "train", "train_unpriced", "predict"


def parse_raw(df: DataFrame, ts_formats: Sequence[str] = ()) -> DataFrame:
    """Known headers, names split, missing columns added, and the free-text numbers and dates parsed.

    The parsed fields leave a generator of one row each: a filter on them then stays above it, instead of parsing
    the text again, once for each of its conditions.
    """
    named = C.resolve_price(C.split_names(C.standardize_columns(df)))
    full = C.with_defaults(named, RAW_DEFAULTS)
    as_text = lambda c: F.col(c).cast("string")
    stamp = (
        dates.parse_ts(as_text("fetched_on"), ts_formats)
        if dict(full.dtypes)["fetched_on"] == "string"
        else dates.wall_clock(F.col("fetched_on"))
    )
    parsed = {
        "kms": numbers.parse_kms(as_text("kms")),
        "ownership": numbers.parse_ownership(as_text("ownership")),
        "year": numbers.parse_year(as_text("year")),
        "price": numbers.parse_price(as_text("price")),
        "fetched_on": stamp,
    }
    one = F.inline(F.array(F.struct(*[c.alias(f"__{name}") for name, c in parsed.items()])))
    out = full.withColumn("listing_id", text.blank_to_null(as_text("listing_id"))).select("*", one)
    return out.select(*[F.col(f"__{c}").alias(c) if c in parsed else F.col(f"`{c}`") for c in full.columns])


def normalize_names(df: DataFrame, upper: bool = False) -> DataFrame:
    """One spelling per category; ``upper`` also upper-cases make, model and variant."""
    plain = lambda c: F.upper(text.normalize_text(c)) if upper else text.normalize_text(c)
    stated = F.col("reg_state") if "reg_state" in df.columns else F.lit(None).cast("string")
    # What an expression uses twice is a column first: it is then worked out once a row.
    steps = df.withColumns({
        "__names": F.transform(F.array("make", "model", "variant"), plain),
        "transmission": text.transmission(F.col("transmission")),
        "fuel": F.upper(text.normalize_text(F.col("fuel"))),
        "body_type": text.normalize_text(F.col("body_type")),
        "city": text.normalize_text(F.col("city")),
        "reg_state": F.upper(text.normalize_text(text.fill_state(stated, F.col("registration")), "UNK")),
    })
    return steps.withColumns({
        **{c: F.col("__names")[i] for i, c in enumerate(("make", "model", "variant"))},
        "fuel": text.mapped_fuel(F.col("fuel")),
        "body_type": text.mapped_body(F.col("body_type")),
        "city": text.upper_city(F.col("city")),
        "reg_state": text.short_state(F.col("reg_state")),
    }).drop("__names")


def snapshot_year(reference_ts: str) -> Column:
    return F.coalesce(F.year("fetched_on"), F.year(dates.literal_ts(reference_ts))).cast("double")


def age_features(df: DataFrame, reference_ts: str) -> DataFrame:
    """Car age at the snapshot, yearly distance, log distance and the ownership products."""
    age = numbers.at_least(snapshot_year(reference_ts) - F.col("year"), 0.0)
    kms, owners = F.col("kms"), F.coalesce("ownership", F.lit(1.0))
    return df.withColumn("car_age", age).withColumns({
        "kms_per_year": F.when(F.col("car_age") > 0, kms / F.col("car_age")).otherwise(kms),
        "log_kms": F.log1p(numbers.at_least(kms, 0.0)),
        "age_x_ownership": F.col("car_age") * owners,
        "kms_x_ownership": kms * owners,
    })


def market_time(df: DataFrame, reference_ts: str) -> DataFrame:
    """Month of the snapshot and days since the market epoch."""
    ref, epoch = dates.literal_ts(reference_ts), dates.literal_ts(K.MARKET_EPOCH)
    at = F.coalesce(F.col("fetched_on"), ref)
    return df.withColumns({
        "fetch_month": F.month(at).cast("double"),
        "market_days": dates.days_between(at, epoch).cast("double"),
    })


def snapshot_features(df: DataFrame, reference_ts: str) -> DataFrame:
    return market_time(age_features(df, reference_ts), reference_ts)


def load_and_clean(
    df: DataFrame,
    reference_ts: str,
    min_year: int = K.MIN_YEAR,
    max_kms: float = K.MAX_KMS,
    trim: tuple[float, float] = (0.01, 0.99),
    trim_by: Sequence[str] = (),
    null_id: str = "drop",
    ts_formats: Sequence[str] = (),
) -> DataFrame:
    """Raw snapshots to clean listings: parse, derive, drop inconsistent listings and outliers.

    ``trim_by=['source']`` takes the price quantiles per source instead of over all rows.
    """
    rows = normalize_names(parse_raw(df, ts_formats))
    kept = ["listing_id", "fetched_on", *K.CATEGORICAL, "year", "kms", "ownership", "price"]
    extra = ["source"] if "source" in rows.columns else []
    used = dict.fromkeys([*kept, *extra, *trim_by])
    rows = snapshot_features(stored(rows.select(*used), "parsed"), reference_ts)
    with_id = rows.where(F.col("listing_id").isNotNull())
    facts = group_rows(
        with_id, ["listing_id"], F.min("fetched_on").alias("__first"),
        filters.identity_stats(["year", "fuel", "transmission"]).alias("__same"),
    )
    rows = attach(rows, facts, ["listing_id"])
    same = F.col("__same") if null_id == "drop" else F.col("__same") | F.col("listing_id").isNull()
    days = F.coalesce(dates.days_between(F.col("fetched_on"), F.col("__first")), F.lit(0)).cast("double")
    rows = rows.where(same).withColumn("days_on_market", days).drop("__first", "__same")
    rows = filters.kms_range(
        filters.year_range(filters.required(rows), snapshot_year(reference_ts), min_year), max_kms
    )
    rows = filters.price_trim(rows, *trim, partition_by=trim_by)
    derived = ["car_age", "kms_per_year", "log_kms", "age_x_ownership", "kms_x_ownership", "fetch_month", "market_days", "days_on_market"]
    return rows.select(*kept, *derived, *extra).withColumn("brand", F.col("make"))


def _row_key(df: DataFrame, unique: str | None) -> Column | None:
    return F.col(unique) if unique else None


def _prepared(df: DataFrame, reference_ts: str, unique: str | None, ts_formats: Sequence[str]) -> DataFrame:
    rows = snapshots.with_listing_id(parse_raw(df, ts_formats), _row_key(df, unique))
    rows = rows.withColumn("ownership", F.coalesce("ownership", F.lit(1.0)))
    return normalize_names(age_features(rows, reference_ts), upper=True)


def parsed_rows(df: DataFrame, reference_ts: str, unique: str | None = None, ts_formats: Sequence[str] = ()) -> DataFrame:
    """Parsed rows before any mode's filters, stored: plans that take several modes or passes parse a text once."""
    rows = _prepared(df, reference_ts, unique, ts_formats)
    used = dict.fromkeys(["listing_id", "fetched_on", *K.CATEGORICAL, "year", *K.STATIC_NUMERIC, "price", *_extra(rows, unique)])
    return stored(rows.select(*used), "parsed")


def _extra(rows: DataFrame, unique: str | None) -> list[str]:
    return [unique] if unique and unique in rows.columns else []


def clean_leakage_safe(
    df: DataFrame, reference_ts: str, mode: str = TRAIN, min_year: int = K.MIN_YEAR, max_kms: float = K.MAX_KMS,
    unique: str | None = None, ts_formats: Sequence[str] = (),
) -> DataFrame:
    """Only what is known at listing time. ``predict`` mode keeps every row and nulls invalid fields.

    ``unique`` names a column that identifies rows without listing ID.
    """
    rows = parsed_rows(df, reference_ts, unique, ts_formats)
    extra = _extra(rows, unique)
    facts = group_rows(
        rows, ["listing_id"], F.min("fetched_on").alias("__first"),
        filters.identity_stats(["year", "fuel", "transmission"]).alias("__same"),
    )
    rows = snapshots.add_days_since(attach(rows, facts, ["listing_id"]), "fetched_on", "__first")
    rows = rows.withColumn("age_bucket", bands.age_bucket(F.col("car_age")))
    last = F.year(dates.literal_ts(reference_ts)).cast("double")
    if mode == PREDICT:
        rows = filters.null_invalid(rows, last, min_year, max_kms)
    else:
        rows = rows.where("__same")
        rows = filters.kms_range(filters.year_range(filters.required(rows, ("year", "kms")), last, min_year), max_kms)
        if mode == TRAIN:
            rows = filters.positive_price(rows)
    kept = ["listing_id", "fetched_on", *K.CATEGORICAL, "year", *K.STATIC_NUMERIC, "price"]
    return rows.select(*kept, "age_bucket", "days_since_listing", "is_listing_day", *extra)


def prepare_rows(
    df: DataFrame, reference_ts: str, mode: str = TRAIN, min_year: int = K.MIN_YEAR, max_kms: float = K.MAX_KMS,
    unique: str | None = None, ts_formats: Sequence[str] = (), parsed: bool = False,
) -> DataFrame:
    """Rows for the anchored model: all snapshots stay, no identity filter. ``parsed`` rows are those of ``parsed_rows``."""
    rows = df if parsed else _prepared(df, reference_ts, unique, ts_formats)
    last = F.year(dates.literal_ts(reference_ts)).cast("double")
    if mode == PREDICT:
        good_year = filters.year_valid(F.col("year"), last, min_year)
        rows = filters.null_invalid(rows, last, min_year, max_kms).withColumn("car_age", F.when(good_year, F.col("car_age")))
    else:
        rows = filters.kms_range(filters.year_range(rows, last, min_year), max_kms)
        if mode == TRAIN:
            rows = filters.positive_price(rows)
    return rows.select("listing_id", "fetched_on", *K.CATEGORICAL, *K.STATIC_NUMERIC, "price", *_extra(rows, unique))


def two_week_load(df: DataFrame, reference_ts: str, ts_formats: Sequence[str] = ()) -> DataFrame:
    """Snake_case frame with parsed fields; car age from the year unless the input states it."""
    stated_age = "car_age" in {C.header_key(c).replace(" ", "_") for c in df.columns}
    rows = C.two_week_schema(df)
    name = lambda c: F.upper(text.strip(F.coalesce(F.col(c), F.lit("UNKNOWN"))))
    stamp = (
        dates.parse_ts(F.col("date_posted"), ts_formats)
        if dict(rows.dtypes)["date_posted"] == "string"
        else dates.wall_clock(F.col("date_posted"))
    )
    rows = rows.withColumns({
        "car_id": text.strip(F.col("car_id").cast("string")),
        "date_posted": stamp,
        "price": numbers.parse_price(F.col("price").cast("string")),
        "kms_driven": numbers.parse_kms(F.col("kms_driven").cast("string")),
        "ownership": numbers.parse_ownership(F.col("ownership").cast("string")),
        "year": numbers.parse_year(F.col("year").cast("string")),
        "make": name("make"), "model": name("model"), "variant": name("variant"), "city": name("city"),
    })
    if not stated_age:
        posted = F.coalesce(F.year("date_posted"), F.year(dates.literal_ts(reference_ts)))
        rows = rows.withColumn("car_age", numbers.at_least(posted - F.col("year"), 0.0))
    return rows


def two_week_features(df: DataFrame, n_variants: int = 20) -> DataFrame:
    """Static columns only, rare variants as OTHER, missing numbers filled with the median."""
    rows = C.keep_columns(C.drop_leakage(df).drop("year"), K.TWO_WEEK_KEEP)
    rows = stored(filters.positive_price(rows, "price", ["car_id", "date_posted"]), "first")  # read three times below
    top = top_values(rows, "variant", n_variants)
    rows = group_variants(rows, top, out="variant", keep_unknown=False, other="OTHER", blank_is_unknown=False).select(*rows.columns)
    numeric = [c for c in ("kms_driven", "ownership", "car_age") if c in rows.columns]
    middle = q.column_quantiles(rows, numeric, {"m": 0.5}).agg(
        F.map_from_entries(F.collect_list(F.struct("column", "m"))).alias("m")
    ).scalar()
    filled = {c: F.coalesce(F.col(c), F.try_element_at(middle, F.lit(c))) for c in numeric}
    names = {c: F.coalesce(text.blank_to_null(F.col(c)), F.lit("UNKNOWN")) for c in ("make", "model", "variant", "city")}
    return rows.withColumns({**filled, **names})


def two_week_baseline(
    df: DataFrame, reference_ts: str, days: int = 14, n_variants: int = 20, ts_formats: Sequence[str] = (), loaded: DataFrame | None = None
) -> DataFrame:
    """First occurrence of each vehicle in the last N days, as baseline features.

    ``loaded`` are the stored rows of ``two_week_load``, where other steps read them too.
    """
    # Stored: the newest day is looked up before the rows are picked.
    loaded = stored(two_week_load(df, reference_ts, ts_formats), "loaded") if loaded is None else loaded
    return two_week_features(snapshots.first_recent(loaded, "car_id", "date_posted", days), n_variants)


def runtime_normalize(df: DataFrame, strict: bool = False) -> DataFrame:
    """Rows as they come for scoring: same parsing, no filter, nothing dropped."""
    rows = C.split_names(C.ensure_kms(C.standardize_columns(df), strict))
    defaults = {**RAW_DEFAULTS, **{c: ("string", K.UNKNOWN) for c in RAW_TEXT}, "registration": ("string", "")}
    rows = C.with_defaults(C.resolve_price(rows), defaults)
    stated = F.col("reg_state") if "reg_state" in rows.columns else F.lit(None).cast("string")
    return parse_raw(rows).withColumns({
        "transmission": F.coalesce(text.map_values(text.strip(F.col("transmission")), K.TRANSMISSION_CODES), F.col("transmission")),
        "reg_state": text.fill_state(stated, F.col("registration")),
    })


def recent_with_targets(df: DataFrame, days: int = 14, ties: Sequence[str] = ()) -> DataFrame:
    """First recent snapshot of each listing of a clean history, with dynamics from its whole history."""
    recent = filters.last_days(df, "fetched_on", days)
    first = snapshots.first_snapshot(recent, ties=ties)
    targets = listing_dynamics(df, ties=ties)
    return join_targets(first, targets)


def join_targets(first: DataFrame, targets: DataFrame, key: str = "listing_id") -> DataFrame:
    """Dynamics targets onto first snapshots, by trimmed ID. Both sides have one row per listing."""
    return first.withColumn(key, text.strip(F.col(key))).join(targets, key, "left")
