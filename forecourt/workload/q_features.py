"""Lookups, encodings, schemas, weights, folds and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from forecourt import constants as K
from forecourt.operators import blend, calibrate, dynamics, encodings, folds, lookups, schema, weights  # noqa: F401
from forecourt.session import materialize
from forecourt.workload import views as V
from forecourt.workload.registry import query, r, rnd, rounded, rs, s_age_bucket, s_band, s_days, s_fold, s_unit, sql

MARKET = " ".join(K.MARKET_FEATURES)
LEVEL = "element_at(array('model_city', 'model', 'make', 'all'), rank + 1) AS level"
SEGMENTS = list(K.PRICE_SEGMENT_LABELS)


def _segment(x: str) -> str:
    return s_band(x, V.SEGMENT_EDGES, SEGMENTS)


# --- anchors ------------------------------------------------------------------------------------


@query("agg_anchor_stats", sql(f"""SELECT CASE grouping(make, model, city) WHEN 4 THEN 'model_city' WHEN 5 THEN 'model' WHEN 3 THEN 'make' ELSE 'all' END AS level,
  coalesce(make, '*') AS make, coalesce(model, '*') AS model, coalesce(city, '*') AS city, count(price) AS n, {r('median(price)')} AS median
  FROM l GROUP BY GROUPING SETS ((model, city), (model), (make), ())""", "l"))
def agg_anchor_stats(spark, sf):
    stats = lookups.anchor_stats(V.listings(spark, sf))
    return stats.select(F.expr(LEVEL), "make", "model", "city", "n", rnd("median").alias("median"))


_ANCHOR = """coalesce((SELECT med FROM mc WHERE mc.model = x.model AND mc.city = x.city AND n >= 15), (SELECT med FROM mo WHERE mo.model = x.model AND n >= 8),
  (SELECT med FROM mk WHERE mk.make = x.make AND n >= 5), (SELECT median(price) FROM l), 1.0)"""
_ANCHOR_STEPS = {
    "mc": "SELECT model, city, count(price) AS n, median(price) AS med FROM l GROUP BY ALL",
    "mo": "SELECT model, count(price) AS n, median(price) AS med FROM l GROUP BY ALL",
    "mk": "SELECT make, count(price) AS n, median(price) AS med FROM l GROUP BY ALL",
    "a": f"SELECT row_key, greatest({_ANCHOR}, 1.0) AS price_anchor FROM l x",
}


@query("jon_price_anchor", sql(f"SELECT row_key, {r('price_anchor')} AS price_anchor, {_segment('price_anchor')} AS price_segment FROM a", "l", extra=_ANCHOR_STEPS))
def jon_price_anchor(spark, sf):
    rows = V.listings(spark, sf)
    out = lookups.price_anchor(rows, lookups.anchor_stats(rows), edges=V.SEGMENT_EDGES)
    return out.select("row_key", rnd("price_anchor").alias("price_anchor"), "price_segment")


_OOF_ANCHOR = {
    "f": f"SELECT *, {s_fold('listing_id', 4)} AS fold FROM l",
    "o": "SELECT f.* EXCLUDE (fold), j AS hold FROM f, (SELECT unnest([0, 1, 2, 3]) AS j) WHERE fold <> j",
    "mc": "SELECT hold, model, city, count(price) AS n, median(price) AS med FROM o GROUP BY ALL",
    "mo": "SELECT hold, model, count(price) AS n, median(price) AS med FROM o GROUP BY ALL",
    "mk": "SELECT hold, make, count(price) AS n, median(price) AS med FROM o GROUP BY ALL",
    "ma": "SELECT hold, median(price) AS med FROM o GROUP BY ALL",
    "a": """SELECT row_key, fold, greatest(coalesce(CASE WHEN mc.n >= 15 THEN mc.med END, CASE WHEN mo.n >= 8 THEN mo.med END, CASE WHEN mk.n >= 5 THEN mk.med END, ma.med, 1.0), 1.0) AS price_anchor
      FROM f LEFT JOIN mc ON mc.hold = fold AND mc.model = f.model AND mc.city = f.city LEFT JOIN mo ON mo.hold = fold AND mo.model = f.model
      LEFT JOIN mk ON mk.hold = fold AND mk.make = f.make LEFT JOIN ma ON ma.hold = fold""",
}


@query("agg_oof_anchor", sql(f"SELECT row_key, fold::INT AS fold, {r('price_anchor')} AS price_anchor, {_segment('price_anchor')} AS price_segment FROM a", "l", extra=_OOF_ANCHOR))
def agg_oof_anchor(spark, sf):
    rows = folds.group_fold(V.listings(spark, sf), k=K.INNER_FOLDS)
    out = lookups.oof_price_anchor(rows, edges=V.SEGMENT_EDGES)
    return out.select("row_key", "fold", rnd("price_anchor").alias("price_anchor"), "price_segment")


# --- market history -----------------------------------------------------------------------------

N_TOP = 20
_TOP = f"SELECT variant FROM mbase GROUP BY 1 ORDER BY count(*) DESC, variant LIMIT {N_TOP}"
_MF = f"SELECT *, CASE WHEN variant IN (SELECT variant FROM top) THEN variant ELSE 'other' END AS variant_grouped, {s_age_bucket('car_age')} AS age_bucket FROM mbase"
_STATS = """count(*) AS n, ln(1 + count(*)) AS market_count_log, median(price) AS market_median_price, avg(pressure_score) AS market_pressure_mean,
  avg(avg_drop_30d_raw) AS market_avg_drop_30d, avg(sell_inverse_raw) AS market_sell_speed, avg(volatility_raw) AS market_volatility"""
_ALL = ("make", "model", "variant_grouped", "city", "age_bucket")


def _level_tables(source: str, by: tuple[str, ...] = ()) -> dict[str, str]:
    return {
        f"v{i}": f"SELECT {', '.join((*by, *keys))}, {_STATS} FROM {source} GROUP BY {', '.join((*by, *keys))} HAVING count(*) >= {n}"
        for i, (keys, n) in enumerate(V.MARKET_LEVELS)
    }


_MARKET_ROWS = " UNION ALL ".join(
    f"SELECT {i} AS rank, {', '.join(k if k in keys else repr('*') + ' AS ' + k for k in _ALL)}, n, {MARKET.replace(' ', ', ')} FROM v{i}"
    for i, (keys, _) in enumerate(V.MARKET_LEVELS)
)


@query("agg_market_history", sql(f"SELECT rank, {', '.join(_ALL)}, n, {rs(MARKET, 6)} FROM u", "mbase", extra={"top": _TOP, "mf": _MF, **_level_tables("mf"), "u": _MARKET_ROWS}))
def agg_market_history(spark, sf):
    fitted = lookups.fit_market_history(V.market_base(spark, sf, V.MARKET_COLUMNS), N_TOP, V.MARKET_LEVELS)
    return rounded(fitted.stats, K.MARKET_FEATURES, 6)


def _market_pick(columns: str, source: str, fold: str | None = None) -> str:
    joins, names = [], {}
    for i, (keys, _) in enumerate(V.MARKET_LEVELS):
        on = " AND ".join(f"v{i}.{k} = x.{k}" for k in keys) + (f" AND v{i}.{fold} = x.own" if fold else "")
        joins.append(f"LEFT JOIN v{i} ON {on}")
    for c in MARKET.split():
        cases = " ".join(f"WHEN v{i}.market_pressure_mean IS NOT NULL THEN v{i}.{c}" for i in range(5))
        names[c] = f"CASE {cases} ELSE d.{c} END"
    d = f"LEFT JOIN dflt d ON d.{fold} = x.own" if fold else "CROSS JOIN dflt d"
    return f"SELECT {columns}, {', '.join(f'{r(e, 6)} AS {c}' for c, e in names.items())} FROM {source} x {' '.join(joins)} {d}"


_DEFAULT = """median(price) AS market_median_price, median(pressure_score) AS market_pressure_mean, median(avg_drop_30d_raw) AS market_avg_drop_30d,
  median(sell_inverse_raw) AS market_sell_speed, median(volatility_raw) AS market_volatility"""


@query("jon_market_backoff", sql(_market_pick("x.listing_id, x.variant_grouped", "mf"), "mbase", extra={
    "top": _TOP, "mf": _MF, **_level_tables("mf"), "dflt": f"SELECT ln(1 + count(*)) AS market_count_log, {_DEFAULT} FROM mf"}))
def jon_market_backoff(spark, sf):
    base = materialize(V.market_base(spark, sf, V.MARKET_COLUMNS))
    out = lookups.fit_market_history(base, N_TOP, V.MARKET_LEVELS).apply(base)
    return rounded(out.select("listing_id", "variant_grouped", *K.MARKET_FEATURES), K.MARKET_FEATURES, 6)


_OOF_MARKET = {
    "f": f"SELECT *, {s_fold('listing_id', 4)} AS own FROM mbase",
    "o": "SELECT f.*, j AS hold FROM f, (SELECT unnest([0, 1, 2, 3]) AS j) WHERE own <> j",
    "top": f"SELECT hold, variant FROM (SELECT hold, variant, row_number() OVER (PARTITION BY hold ORDER BY count(*) DESC, variant) AS rn FROM o GROUP BY 1, 2) WHERE rn <= {N_TOP}",
    "mf": f"SELECT o.*, CASE WHEN t.variant IS NOT NULL THEN o.variant ELSE 'other' END AS variant_grouped, {s_age_bucket('car_age')} AS age_bucket FROM o LEFT JOIN top t USING (hold, variant)",
    **_level_tables("mf", ("hold",)),
    "dflt": f"SELECT hold, ln(1 + count(*)) AS market_count_log, {_DEFAULT} FROM mf GROUP BY 1",
    "xf": f"SELECT f.*, CASE WHEN t.variant IS NOT NULL THEN f.variant ELSE 'other' END AS variant_grouped, {s_age_bucket('car_age')} AS age_bucket FROM f LEFT JOIN top t ON t.hold = own AND t.variant = f.variant",
}


@query("agg_oof_market", sql(_market_pick("x.listing_id, x.own::INT AS fold, x.variant_grouped", "xf", "hold"), "mbase", extra=_OOF_MARKET))
def agg_oof_market(spark, sf):
    base = materialize(folds.group_fold(V.market_base(spark, sf, V.MARKET_COLUMNS), k=K.INNER_FOLDS))
    out = lookups.oof_market_features(base, n_variants=N_TOP, levels=V.MARKET_LEVELS)
    return rounded(out.select("listing_id", "fold", "variant_grouped", *K.MARKET_FEATURES), K.MARKET_FEATURES, 6)


# --- target means and frequent values -----------------------------------------------------------


@query("agg_smoothed_mean", sql(f"SELECT model, count(*) AS n, {r('(sum(ln(price)) + 50.0 * (SELECT avg(ln(price)) FROM l)) / (count(*) + 50.0)', 6)} AS te FROM l GROUP BY 1", "l"))
def agg_smoothed_mean(spark, sf):
    out = encodings.smoothed_means(V.listings(spark, sf), "model", F.log("price"))
    return out.withColumn("te", rnd("te", 6))


@query("agg_topn_variants", sql("SELECT row_key, variant, CASE WHEN variant IN (SELECT variant FROM t) THEN variant ELSE 'other' END AS variant_grouped FROM l", "l",
       extra={"t": f"SELECT variant FROM l GROUP BY 1 ORDER BY count(*) DESC, variant LIMIT {N_TOP}"}))
def agg_topn_variants(spark, sf):
    rows = V.listings(spark, sf).select("row_key", "variant")
    return encodings.group_variants(rows, encodings.top_values(rows, "variant", N_TOP))


_TE = {
    "tr": f"SELECT *, ln(price) AS y FROM l WHERE {s_fold('listing_id', 5)} <> 0",
    "g": "SELECT avg(y) AS g FROM tr",
    "top": f"SELECT variant FROM tr GROUP BY 1 ORDER BY count(*) DESC, variant LIMIT {N_TOP}",
    "mt": "SELECT model, (sum(y) + 50.0 * any_value(g)) / (count(*) + 50.0) AS te FROM tr, g GROUP BY 1",
    "vt": "SELECT CASE WHEN variant IN (SELECT variant FROM top) THEN variant ELSE 'other' END AS vg, (sum(y) + 50.0 * any_value(g)) / (count(*) + 50.0) AS te FROM tr, g GROUP BY 1",
    "x": "SELECT *, CASE WHEN variant IN (SELECT variant FROM top) THEN variant ELSE 'other' END AS vg FROM l",
}


@query("jon_target_encode_apply", sql(f"SELECT row_key, vg AS variant_grouped, {r('coalesce(mt.te, g)', 6)} AS model_te, {r('coalesce(vt.te, g)', 6)} AS variant_te FROM x LEFT JOIN mt USING (model) LEFT JOIN vt USING (vg), g", "l", extra=_TE))
def jon_target_encode_apply(spark, sf):
    rows = folds.group_fold(V.listings(spark, sf))
    encoder = encodings.fit_target_encoder(rows.where("fold <> 0"), F.log("price"), N_TOP)
    return rounded(encoder.apply(rows).select("row_key", "variant_grouped", "model_te", "variant_te"), ["model_te", "variant_te"], 6)


_OOF_TE = {
    "f": f"SELECT *, ln(price) AS y, {s_fold('listing_id', 4)} AS own FROM l",
    "o": "SELECT variant, model, y, j AS hold FROM f, (SELECT unnest([0, 1, 2, 3]) AS j) WHERE own <> j",
    "g": "SELECT hold, avg(y) AS g FROM o GROUP BY 1",
    "top": f"SELECT hold, variant FROM (SELECT hold, variant, row_number() OVER (PARTITION BY hold ORDER BY count(*) DESC, variant) AS rn FROM o GROUP BY 1, 2) WHERE rn <= {N_TOP}",
    "og": "SELECT o.*, CASE WHEN t.variant IS NOT NULL THEN o.variant ELSE 'other' END AS vg FROM o LEFT JOIN top t USING (hold, variant)",
    "mt": "SELECT hold, model, (sum(y) + 50.0 * any_value(g)) / (count(*) + 50.0) AS te FROM o JOIN g USING (hold) GROUP BY 1, 2",
    "vt": "SELECT hold, vg, (sum(y) + 50.0 * any_value(g)) / (count(*) + 50.0) AS te FROM og JOIN g USING (hold) GROUP BY 1, 2",
    "xg": "SELECT f.*, CASE WHEN t.variant IS NOT NULL THEN f.variant ELSE 'other' END AS vg FROM f LEFT JOIN top t ON t.hold = own AND t.variant = f.variant",
}


@query("agg_oof_target_encoding", sql(f"""SELECT row_key, own::INT AS fold, xg.vg AS variant_grouped, {r('coalesce(mt.te, g.g)', 6)} AS model_te, {r('coalesce(vt.te, g.g)', 6)} AS variant_te
  FROM xg JOIN g ON g.hold = own LEFT JOIN mt ON mt.hold = own AND mt.model = xg.model LEFT JOIN vt ON vt.hold = own AND vt.vg = xg.vg""", "l", extra=_OOF_TE))
def agg_oof_target_encoding(spark, sf):
    rows = folds.group_fold(V.listings(spark, sf), k=K.INNER_FOLDS)
    out = encodings.oof_target_encoding(rows, F.log("price"), n_variants=N_TOP)
    return rounded(out.select("row_key", "fold", "variant_grouped", "model_te", "variant_te"), ["model_te", "variant_te"], 6)


# --- schemas ------------------------------------------------------------------------------------

_NUM = ["car_age", "kms", "kms_per_year", "log_kms", "ownership", "not_there"]
_CAT = ["make", "transmission", "fuel", "body_type", "city"]
_FILLS = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {r(f'median({c})')} AS fill FROM lf" for c in _NUM[:-1])


@query("agg_fill_values", sql(f"{_FILLS} UNION ALL SELECT 'not_there', 0.0", "lf"))
def agg_fill_values(spark, sf):
    return schema.fill_values(V.listing_features(spark, sf), _NUM).withColumn("fill", rnd("fill"))


@query("agg_levels", sql(" UNION ".join([f"SELECT '{c}' AS \"column\", {c} AS level FROM l" for c in _CAT] + [f"SELECT '{c}', 'Unknown'" for c in _CAT]), "l"))
def agg_levels(spark, sf):
    return schema.levels(V.listings(spark, sf), _CAT)


_TRAIN = "l WHERE make <> 'Brand#7' AND city <> 'NATION_3'"
_APPLY_CATS = {"make": "make", "fuel": "fuel", "city": "city", "variant": "variant"}


def _train_rows(spark, sf):
    rows = V.listing_features(spark, sf)
    return rows.where((F.col("make") != "Brand#7") & (F.col("city") != "NATION_3"))


_FIT = {"tr": f"SELECT * FROM {_TRAIN.replace('l WHERE', 'lf WHERE')}"}
_SAMPLE_NULLS = "CASE WHEN kms > 100000 THEN NULL ELSE kms END"


@query("sch_apply", sql("SELECT row_key, " + r(f"coalesce({_SAMPLE_NULLS}, (SELECT median(kms) FROM tr))") + " AS kms, " + r("log_kms") + " AS log_kms, " + ", ".join(
    f"CASE WHEN {c} IN (SELECT {c} FROM tr) THEN {c} ELSE 'Unknown' END AS {c}" for c in _APPLY_CATS) + " FROM lf", "lf", extra=_FIT))
def sch_apply(spark, sf):
    fitted = schema.fit_schema(_train_rows(spark, sf), ["kms"], list(_APPLY_CATS))
    rows = V.listing_features(spark, sf).withColumn("kms", F.expr(_SAMPLE_NULLS))
    fitted = schema.with_extra_numeric(fitted, _train_rows(spark, sf), ["log_kms"])
    return rounded(fitted.apply(rows, keep=["row_key"]), ["kms", "log_kms"])


@query("sch_apply_casefold", sql("SELECT row_key, " + r("kms") + " AS kms, " + ", ".join(
    f"CASE WHEN {c} IN (SELECT {c} FROM tr) THEN {c} ELSE '__OTHER__' END AS {c}" for c in _APPLY_CATS) + " FROM lf", "lf", extra=_FIT))
def sch_apply_casefold(spark, sf):
    fitted = schema.fit_schema(_train_rows(spark, sf), ["kms"], list(_APPLY_CATS), fallback=K.OTHER_LEVEL, casefold=True)
    rows = V.listing_features(spark, sf)
    noisy = rows.withColumns({c: F.concat(F.lit(" "), F.upper(F.regexp_replace(c, " ", "   "))) for c in _APPLY_CATS})
    return rounded(fitted.apply(noisy, keep=["row_key"]), ["kms"])


# --- weights ------------------------------------------------------------------------------------


@query("wgt_recency", sql(f"""SELECT row_key, {r("least(greatest(exp(-ln(2.0::DOUBLE) * a / 90.0), 0.35), 1.0)", 6)} AS weight FROM
  (SELECT row_key, {s_days("(SELECT max(fetched_on) FROM tp)", "coalesce(fetched_on, (SELECT min(fetched_on) FROM tp))")} AS a FROM tp)""", "tp"))
def wgt_recency(spark, sf):
    from forecourt.plans import clean

    rows = clean.parse_raw(V.raw_text(spark, sf)).select("row_key", "fetched_on")
    return weights.recency_weight(rows).select("row_key", rnd("weight", 6).alias("weight"))


@query("wgt_inverse_price", sql(f"SELECT row_key, {r('1.0 / (price + 1.0) / (SELECT avg(1.0 / (price + 1.0)) FROM l)', 6)} AS weight FROM l", "l"))
def wgt_inverse_price(spark, sf):
    return weights.inverse_price_weight(V.listings(spark, sf)).select("row_key", rnd("weight", 6).alias("weight"))


# --- folds, splits, samples ---------------------------------------------------------------------


@query("spl_group_kfold", sql(f"SELECT row_key, listing_id, {s_fold('listing_id', 5)}::INT AS fold FROM l", "l"))
def spl_group_kfold(spark, sf):
    return folds.group_fold(V.listings(spark, sf)).select("row_key", "listing_id", "fold")


@query("spl_kfold", sql(f"SELECT event_id, {s_fold('event_id', 5, '42:')}::INT AS fold FROM h", "h"))
def spl_kfold(spark, sf):
    return folds.key_fold(V.history(spark, sf), "event_id", 5).select("event_id", "fold")


_UNIT = f"{s_unit('listing_id', '42:')} / 4503599627370496.0"


@query("spl_holdout", sql(f"SELECT row_key, listing_id, CASE WHEN {_UNIT} < 0.1 THEN 'test' WHEN {_UNIT} < 0.19 THEN 'val' ELSE 'train' END AS split FROM l", "l"))
def spl_holdout(spark, sf):
    return folds.holdout_split(V.listings(spark, sf), "listing_id", {"test": 0.10, "val": 0.09, "train": 0.81}).select("row_key", "listing_id", "split")


_STRAT = """SELECT listing_id, price, 1 + (lp > e1)::INT + (lp > e2)::INT + (lp > e3)::INT + (lp > e4)::INT AS stratum FROM
  (SELECT *, ln(greatest(price, 1.0)) AS lp FROM lfirst), (SELECT quantile_cont(lp, 0.2) AS e1, quantile_cont(lp, 0.4) AS e2, quantile_cont(lp, 0.6) AS e3, quantile_cont(lp, 0.8) AS e4
  FROM (SELECT ln(greatest(price, 1.0)) AS lp FROM lfirst))"""


@query("spl_stratified", sql(f"""SELECT listing_id, stratum::INT AS stratum, CASE WHEN rn <= ceil(n * 0.7::DOUBLE) THEN 'train' WHEN rn <= ceil(n * 0.85::DOUBLE) THEN 'valid' ELSE 'test' END AS split FROM
  (SELECT listing_id, stratum, row_number() OVER (PARTITION BY stratum ORDER BY {s_unit('listing_id', '42:')}) AS rn, count(*) OVER (PARTITION BY stratum) AS n FROM s)""", "lfirst", extra={"s": _STRAT}))
def spl_stratified(spark, sf):
    rows = V.first_listings(spark, sf, ["listing_id", "price"]).select("listing_id", "price")
    return folds.stratified_split(rows, "listing_id").select("listing_id", "stratum", "split")


@query("spl_sample_n", sql(f"SELECT listing_id, price FROM lfirst ORDER BY {s_unit('listing_id', '42:')} LIMIT 700", "lfirst"))
def spl_sample_n(spark, sf):
    return folds.sample_n(V.first_listings(spark, sf, ["listing_id", "price"]).select("listing_id", "price"), "listing_id", 700)
