"""Sources, projections, scalar functions and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from forecourt import constants as K
from forecourt.functions import bands, dates, numbers, text
from forecourt.operators import columns as C, demand, filters, metrics, schema
from forecourt.plans import clean
from forecourt.session import scratch_path
from forecourt.sources import readers, sinks
from forecourt.workload import views as V
from forecourt.workload.registry import (
    CTES, query, r, rnd, rs, s_age_bucket, s_band, s_blank, s_body, s_city, s_days, s_fuel, s_gear, s_kms, s_name, s_norm,
    s_normstate, s_owner, s_owner_word, s_price, s_squeeze, s_state, s_strip, s_title, s_year, sql,
)

# --- sources and sinks -----------------------------------------------------------------------


@query("src_read_listings", "SELECT l_returnflag AS fuel, count(*) AS n, " + r("sum(l_extendedprice)", 2) + " AS total FROM lineitem GROUP BY 1")
def src_read_listings(spark, sf):
    return _by_fuel(readers.read_table(spark, f"{sf}/lineitem.parquet"))


@query("src_read_recent", "SELECT l_returnflag AS fuel, count(*) AS n, " + r("sum(l_extendedprice)", 2) + " AS total FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01' GROUP BY 1")
def src_read_recent(spark, sf):
    """The filter reaches the scan."""
    return _by_fuel(readers.read_table(spark, f"{sf}/lineitem.parquet").where(F.col("l_shipdate") >= dates.literal_ts("1998-01-01 00:00:00")))


def _by_fuel(rows):
    return rows.groupBy(F.col("l_returnflag").alias("fuel")).agg(F.count(F.lit(1)).alias("n"), rnd(F.sum("l_extendedprice"), 2).alias("total"))


def _sources(spark, sf):
    line = V.listings(spark, sf).select(F.lit("portal_a").alias("source"), "listing_id", "price", "city")
    hist = V.history(spark, sf).select(F.lit("portal_b").alias("source"), "listing_id", "price", "fuel")
    return readers.union_sources([line, hist])


_SOURCES = {"u": "SELECT 'portal_a' AS source, listing_id, price, city, NULL::VARCHAR AS fuel FROM l UNION ALL SELECT 'portal_b', listing_id, price, NULL, fuel FROM h"}


@query("src_read_sources", sql("SELECT source, count(*) AS n, count(city) AS cities, count(fuel) AS fuels, " + r("sum(price)", 2) + " AS total FROM u GROUP BY 1", "l", "h", extra=_SOURCES))
def src_read_sources(spark, sf):
    """Two sources written as Spark writes them, one Parquet and one CSV directory, found by name and read back."""
    folder = scratch_path(spark, "sources")
    V.listings(spark, sf).select("listing_id", "price", "city").write.parquet(f"{folder}/portal_a.parquet")
    V.history(spark, sf).select("listing_id", "price", "fuel").write.option("header", True).csv(f"{folder}/portal_b.csv")
    rows = readers.read_sources(spark, folder, ["portal_*"])
    return rows.groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.count("city").alias("cities"), F.count("fuel").alias("fuels"), rnd(F.sum(F.col("price").cast("double")), 2).alias("total")
    )


@query("src_union_sources", sql("SELECT * FROM u", "l", "h", extra=_SOURCES))
def src_union_sources(spark, sf):
    return _sources(spark, sf)


@query("src_single_partition", sql("SELECT listing_id, price, fuel FROM u WHERE source = 'portal_b'", "l", "h", extra=_SOURCES))
def src_single_partition(spark, sf):
    return readers.single_source(_sources(spark, sf), "portal_b").select("listing_id", "price", "fuel")


@query("snk_roundtrip", sql(f"SELECT listing_id, price, {r('prediction')} AS prediction FROM p", "p"))
def snk_roundtrip(spark, sf):
    rows = V.predictions(spark, sf).select("listing_id", "price", rnd("prediction").alias("prediction"))
    path = sinks.write_table(rows, sinks.predictions_path(scratch_path(spark, "scored") + ".parquet"))
    return readers.read_table(spark, path)


@query("demand_multiplier_table", sql("SELECT * FROM m", "m"))
def demand_multiplier_table(spark, sf):
    return demand.multiplier_table(V.multipliers_raw(spark, sf))


# --- projections -----------------------------------------------------------------------------


@query("prj_standardize", sql("SELECT id AS listing_id, name, variant, year, kms, ownership, transmission, fuel, body_type, city, registration, price, date AS fetched_on, row_key FROM t", "t"))
def prj_standardize(spark, sf):
    return C.standardize_columns(V.raw_text(spark, sf))


@query("prj_kms_alias", sql("SELECT id, kms AS odo_meter, kms AS kms FROM t", "t"))
def prj_kms_alias(spark, sf):
    rows = V.raw_text(spark, sf, headers=False).select("id", F.col("kms").alias("Odometer"))
    return C.ensure_kms(rows, strict=True).withColumnRenamed("Odometer", "odo_meter")


@query("prj_required_defaults", sql(f"""SELECT id AS car_id, date AS date_posted, price, {s_name('name')[0]} AS make, {s_name('name')[1]} AS model, 'UNKNOWN' AS variant,
  kms AS kms_driven, NULL::VARCHAR AS ownership, 'UNKNOWN' AS city, NULL::DOUBLE AS car_age, year FROM t""", "t"))
def prj_required_defaults(spark, sf):
    rows = V.raw_text(spark, sf).drop("Variant", "Ownership", "CITY")
    return C.two_week_schema(rows)


@query("prj_drop_leakage", sql(f"SELECT listing_id, price, make, {rs('car_age kms_per_year log_kms')} FROM lf", "lf"))
def prj_drop_leakage(spark, sf):
    rows = V.listing_features(spark, sf)
    leaky = rows.withColumns({"days_since_seen": F.lit(1), "Expected_Price_Volatility": F.lit(0.5), "time_to_sell": F.lit(2)})
    kept = C.keep_columns(C.drop_leakage(leaky), leaky.columns)
    assert not {"fetch_month", "market_days", "time_to_sell"} & set(kept.columns)
    return kept.select("listing_id", "price", "make", *[rnd(c).alias(c) for c in ("car_age", "kms_per_year", "log_kms")])


_LEVELS = ("make", "transmission", "fuel", "body_type", "city")


@query("prj_option_levels", sql(" UNION ".join(f"SELECT '{c}' AS \"column\", {c} AS level FROM l WHERE {c} <> '__OTHER__'" for c in _LEVELS), "l"))
def prj_option_levels(spark, sf):
    return C.option_levels(V.listings(spark, sf), _LEVELS)


# --- scalar functions ------------------------------------------------------------------------


def _text(spark, sf):
    return V.raw_text(spark, sf, headers=False)


@query("scl_parse_kms", sql(f"SELECT row_key, kms AS kms_text, {s_kms('kms')} AS kms FROM t", "t"))
def scl_parse_kms(spark, sf):
    return _text(spark, sf).select("row_key", F.col("kms").alias("kms_text"), numbers.parse_kms(F.col("kms")).alias("kms"))


_TOKEN_TEXT = "concat(coalesce(kms, ''), ' / ', CASE length(coalesce(name, '')) % 4 WHEN 0 THEN '1,234 km' WHEN 1 THEN '2.5 lakh' WHEN 2 THEN '3lac' ELSE 'kms 7' END)"


def _token_sql() -> str:
    cleaned = s_strip(r"regexp_replace(replace(lower(x), ',', ''), '[^a-z0-9.\- ]', ' ', 'g')")
    pat = r"'^(-?(?:\d+\.?\d*|\.\d+))(k|l)?(lakh|lac|km)?$'"
    units = "'km', 'kms', 'owner', 'owners', 'yr', 'yrs', 'year', 'years'"
    value = (
        f"try_cast(nullif(regexp_extract(w, {pat}, 1), '') AS DOUBLE) * CASE WHEN regexp_extract(w, {pat}, 2) = 'k' THEN 1000.0::DOUBLE "
        f"WHEN regexp_extract(w, {pat}, 2) = 'l' OR regexp_extract(w, {pat}, 3) IN ('lakh', 'lac') THEN 100000.0::DOUBLE ELSE 1.0::DOUBLE END"
    )
    tokens = rf"list_filter(regexp_split_to_array({cleaned}, '\s+'), lambda w: w NOT IN ({units}))"
    first = f"list_filter(list_transform({tokens}, lambda w: {value}), lambda v: v IS NOT NULL)[1]"
    return f"SELECT row_key, x AS number_text, {r(first)} AS number FROM (SELECT row_key, {_TOKEN_TEXT} AS x FROM t)"


@query("scl_parse_number_tokens", sql(_token_sql(), "t"))
def scl_parse_number_tokens(spark, sf):
    rows = _text(spark, sf).select("row_key", F.expr(_TOKEN_TEXT).alias("number_text"))
    return rows.withColumn("number", rnd(numbers.parse_number_tokens(F.col("number_text"))))


@query("scl_parse_ownership", sql(f"""SELECT row_key, {s_owner('ownership')} AS owners,
  CASE WHEN ownership IS NULL THEN 1.0::DOUBLE ELSE coalesce({s_owner_word('lower(ownership)')}, try_cast(nullif(regexp_replace(ownership, '[^0-9]', '', 'g'), '') AS DOUBLE), 1.0) END AS owners_words_first FROM t""", "t"))
def scl_parse_ownership(spark, sf):
    c = F.col("ownership")
    return _text(spark, sf).select("row_key", numbers.parse_ownership(c).alias("owners"), numbers.parse_ownership(c, words_first=True).alias("owners_words_first"))


@query("scl_digits_only", sql(f"SELECT row_key, {s_year('year')} AS year, {s_price('price')} AS price FROM t", "t"))
def scl_digits_only(spark, sf):
    return _text(spark, sf).select("row_key", numbers.parse_year(F.col("year")).alias("year"), numbers.parse_price(F.col("price")).alias("price"))


@query("scl_reg_state", sql(f"SELECT row_key, {s_state('registration')} AS reg_state FROM t", "t"))
def scl_reg_state(spark, sf):
    return _text(spark, sf).select("row_key", text.reg_state(F.col("registration")).alias("reg_state"))


_STATED = "CASE length(city) % 3 WHEN 0 THEN 'Unknown' WHEN 1 THEN ' dl ' ELSE '' END"


@query("scl_reg_state_fill", sql(f"""SELECT row_key, {s_normstate(f"coalesce({s_blank('stated')}, {s_state('registration')})")} AS reg_state,
  coalesce({s_blank('over')}, {s_blank('stated')}, {s_state('registration')}) AS overridden FROM (SELECT *, {_STATED} AS stated, CASE WHEN price LIKE '%1%' THEN 'TN' END AS over FROM t)""", "t"))
def scl_reg_state_fill(spark, sf):
    rows = _text(spark, sf).withColumns({"stated": F.expr(_STATED), "over": F.expr("CASE WHEN price LIKE '%1%' THEN 'TN' END")})
    stated, plate = F.col("stated"), F.col("registration")
    return rows.select(
        "row_key", text.normalize_state(text.fill_state(stated, plate)).alias("reg_state"),
        text.fill_state(stated, plate, F.col("over")).alias("overridden"),
    )


@query("scl_split_name", sql(f"SELECT row_key, {s_name('name')[0]} AS make, {s_name('name')[1]} AS model FROM t", "t"))
def scl_split_name(spark, sf):
    return _text(spark, sf).select("row_key", text.split_name(F.col("name")).alias("n")).select("row_key", "n.*")


@query("scl_normalize_text", sql(f"SELECT row_key, {s_norm('name')} AS name, {s_norm('variant', 'none')} AS variant FROM t", "t"))
def scl_normalize_text(spark, sf):
    return _text(spark, sf).select("row_key", text.normalize_text(F.col("name")).alias("name"), text.normalize_text(F.col("variant"), "none").alias("variant"))


@query("scl_category_key", sql(f"SELECT row_key, lower({s_squeeze('name')}) AS name_key, lower({s_squeeze('fuel')}) AS fuel_key FROM t", "t"))
def scl_category_key(spark, sf):
    return _text(spark, sf).select("row_key", text.category_key(F.col("name")).alias("name_key"), text.category_key(F.col("fuel")).alias("fuel_key"))


@query("scl_value_maps", sql(f"SELECT row_key, {s_fuel('fuel')} AS fuel, {s_body('body_type')} AS body_type, {s_gear('transmission')} AS transmission, {s_city('city')} AS city FROM t", "t"))
def scl_value_maps(spark, sf):
    return _text(spark, sf).select(
        "row_key", text.fuel(F.col("fuel")).alias("fuel"), text.body_type(F.col("body_type")).alias("body_type"),
        text.transmission(F.col("transmission")).alias("transmission"), text.city(F.col("city")).alias("city"),
    )


@query("scl_parse_ts", sql("SELECT row_key, strftime(coalesce(try_cast(d AS TIMESTAMP), try_strptime(d, '%d/%m/%Y')), '%Y-%m-%d %H:%M:%S') AS fetched_on FROM (SELECT row_key, CASE WHEN price LIKE '%7%' THEN '05/03/2024' ELSE date END AS d FROM t)", "t"))
def scl_parse_ts(spark, sf):
    rows = _text(spark, sf).select("row_key", F.expr("CASE WHEN price LIKE '%7%' THEN '05/03/2024' ELSE date END").alias("d"))
    return rows.select("row_key", F.date_format(dates.parse_ts(F.col("d"), ["dd/MM/yyyy"]), "yyyy-MM-dd HH:mm:ss").alias("fetched_on"))


@query("scl_date_parts", sql(f"""SELECT event_id, year(fetched_on)::INT AS y, month(fetched_on)::INT AS m, strftime(fetched_on, '%Y-%m-%d') AS day,
  {s_days('fetched_on', "TIMESTAMP '2020-01-01 12:34:56'")}::INT AS market_days FROM h""", "h"))
def scl_date_parts(spark, sf):
    ts = F.col("fetched_on")
    return V.history(spark, sf).select(
        "event_id", F.year(ts).alias("y"), F.month(ts).alias("m"), dates.day(ts).cast("string").alias("day"),
        dates.days_between(ts, dates.literal_ts("2020-01-01 12:34:56")).alias("market_days"),
    )


_FEATURES = "car_age kms_per_year log_kms age_x_ownership kms_x_ownership fetch_month market_days"


@query("scl_snapshot_features", sql(f"SELECT row_key, {rs(_FEATURES)} FROM f", "tp", extra={"f": CTES["lf"][1].replace("FROM l)", "FROM tp)")}))
def scl_snapshot_features(spark, sf):
    rows = clean.snapshot_features(clean.parse_raw(V.raw_text(spark, sf)), V.REF)
    return rows.select("row_key", *[rnd(c).alias(c) for c in _FEATURES.split()])


@query("scl_age_bucket", sql(f"SELECT row_key, car_age, {s_age_bucket('car_age * 3')} AS age_bucket FROM lf", "lf"))
def scl_age_bucket(spark, sf):
    rows = clean.age_features(V.listings(spark, sf), V.REF)
    return rows.select("row_key", "car_age", bands.age_bucket(F.col("car_age") * 3).alias("age_bucket"))


_PRICE = s_price('price')
_SEGMENTS = list(K.PRICE_SEGMENT_LABELS)


@query("scl_price_segment", sql(f"SELECT row_key, {s_band(f'coalesce({_PRICE}, 0.0)', V.SEGMENT_EDGES, _SEGMENTS)} AS segment FROM t", "t"))
def scl_price_segment(spark, sf):
    return _text(spark, sf).select("row_key", bands.price_segment(numbers.parse_price(F.col("price")), V.SEGMENT_EDGES).alias("segment"))


@query("scl_report_bands", sql(f"""SELECT row_key, {s_band('price', V.REPORT_EDGES, K.REPORT_PRICE_LABELS)} AS price_band, {s_band('kms', K.REPORT_KMS_EDGES, K.REPORT_KMS_LABELS)} AS kms_band,
  CASE WHEN ownership - 1 >= 0 THEN {s_band('(ownership - 1)', K.REPORT_OWNER_EDGES, K.REPORT_OWNER_LABELS)} END AS owner_band,
  ({s_band('price', V.REPORT_EDGES, '12345')})::INT AS price_order FROM l""", "l"))
def scl_report_bands(spark, sf):
    return V.listings(spark, sf).select(
        "row_key", bands.band(F.col("price"), V.REPORT_EDGES, K.REPORT_PRICE_LABELS).alias("price_band"),
        bands.band(F.col("kms"), K.REPORT_KMS_EDGES, K.REPORT_KMS_LABELS).alias("kms_band"),
        bands.owner_band(F.col("ownership") - 1).alias("owner_band"), bands.band_order(F.col("price"), V.REPORT_EDGES).alias("price_order"),
    )


@query("scl_target_transform", sql(f"SELECT row_key, {r('ln(1 + price)', 8)} AS log1p, {r('ln(greatest(price - 1000, 1.0))', 8)} AS ln, {r('price')} AS back1, {r('greatest(price - 1000, 1.0)')} AS back2 FROM l", "l"))
def scl_target_transform(spark, sf):
    a, b = numbers.log_price(F.col("price")), numbers.log_price(F.col("price") - 1000, plus_one=False)
    return V.listings(spark, sf).select(
        "row_key", rnd(a, 8).alias("log1p"), rnd(b, 8).alias("ln"),
        rnd(numbers.unlog_price(a)).alias("back1"), rnd(numbers.unlog_price(b, plus_one=False)).alias("back2"),
    )


@query("scl_clip_bounds", sql(f"SELECT row_key, {r('greatest(price - 50000, 0.0)')} AS avg_drop_7d, {r('least(greatest((price - 50000) / 100.0, 0.0), 100.0)')} AS liquidity_score FROM l", "l"))
def scl_clip_bounds(spark, sf):
    from forecourt.operators.dynamics import clip_dynamics

    rows = V.listings(spark, sf).select("row_key", (F.col("price") - 50000).alias("avg_drop_7d"), ((F.col("price") - 50000) / 100.0).alias("liquidity_score"))
    out = clip_dynamics(rows)
    return out.select("row_key", rnd("avg_drop_7d").alias("avg_drop_7d"), rnd("liquidity_score").alias("liquidity_score"))


@query("scl_error_columns", sql(f"""SELECT row_key, {r('prediction - price')} AS error, {r('abs(prediction - price)')} AS absolute_error,
  {r('abs(prediction - price) / nullif(price, 0) * 100.0')} AS absolute_percentage_error, CASE WHEN prediction > price THEN 'over' WHEN prediction < price THEN 'under' ELSE 'neutral' END AS direction FROM p""", "p"))
def scl_error_columns(spark, sf):
    out = metrics.error_columns(V.predictions(spark, sf))
    return out.select("row_key", *[rnd(c).alias(c) for c in ("error", "absolute_error", "absolute_percentage_error")], "direction")


# --- filters ---------------------------------------------------------------------------------


def _parsed(spark, sf):
    return clean.parse_raw(V.raw_text(spark, sf)).select("row_key", "listing_id", "price", "year", "kms", "fetched_on", "fuel", "transmission")


@query("flt_required", sql("SELECT row_key, price, year, kms FROM tp WHERE price > 0 AND year IS NOT NULL AND kms IS NOT NULL AND listing_id IS NOT NULL", "tp"))
def flt_required(spark, sf):
    return filters.positive_price(filters.required(_parsed(spark, sf)), present=["listing_id"]).select("row_key", "price", "year", "kms")


@query("flt_year_range", sql("SELECT row_key, year FROM tp WHERE year >= 1985 AND year <= coalesce(year(fetched_on), 2001) - 5", "tp"))
def flt_year_range(spark, sf):
    return filters.year_range(_parsed(spark, sf), clean.snapshot_year(V.REF) - 5, V.MIN_YEAR).select("row_key", "year")


@query("flt_kms_range", sql("SELECT row_key, kms FROM tp WHERE kms BETWEEN 0 AND 400000", "tp"))
def flt_kms_range(spark, sf):
    return filters.kms_range(_parsed(spark, sf)).select("row_key", "kms")


@query("flt_price_quantile", sql("SELECT row_key, price FROM l, (SELECT quantile_cont(price, 0.01) AS lo, quantile_cont(price, 0.99) AS hi FROM l) WHERE price BETWEEN lo AND hi", "l"))
def flt_price_quantile(spark, sf):
    return filters.price_trim(V.listings(spark, sf)).select("row_key", "price")


@query("flt_identity_consistent", sql("""SELECT row_key, listing_id, year, fuel, transmission FROM l WHERE listing_id IN (SELECT listing_id FROM l GROUP BY 1
  HAVING count(DISTINCT year) <= 1 AND count(DISTINCT fuel) <= 1 AND count(DISTINCT transmission) <= 1)""", "l"))
def flt_identity_consistent(spark, sf):
    return filters.identity_consistent(V.listings(spark, sf)).select("row_key", "listing_id", "year", "fuel", "transmission")


@query("flt_last_n_days", sql("SELECT event_id, price FROM h WHERE fetched_on >= (SELECT max(fetched_on) FROM h) - INTERVAL 14 DAY", "h"))
def flt_last_n_days(spark, sf):
    return filters.last_days(V.history(spark, sf)).select("event_id", "price")


_GOOD_Y = "coalesce(year >= 1986 AND year <= 2001, false)"
_GOOD_K = "coalesce(kms >= 0 AND kms <= 100000, false)"


@query("flt_prediction_mode", sql(f"""SELECT row_key, CASE WHEN {_GOOD_Y} THEN car_age END AS car_age, CASE WHEN {_GOOD_K} THEN kms END AS kms,
  {r(f'CASE WHEN {_GOOD_K} THEN log_kms END')} AS log_kms, {r(f'CASE WHEN {_GOOD_Y} AND {_GOOD_K} THEN age_x_ownership END')} AS age_x_ownership,
  {r(f'CASE WHEN {_GOOD_K} THEN kms_x_ownership END')} AS kms_x_ownership FROM lf""", "lf"))
def flt_prediction_mode(spark, sf):
    rows = clean.age_features(V.listings(spark, sf), V.REF)
    out = filters.null_invalid(rows, F.lit(2001.0), 1986, 100_000.0)
    return out.select("row_key", "car_age", "kms", *[rnd(c).alias(c) for c in ("log_kms", "age_x_ownership", "kms_x_ownership")])
