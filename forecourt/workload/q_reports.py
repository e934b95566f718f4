"""Blending, calibration, metrics, segment reports, demand multipliers, catalog and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from forecourt import constants as K
from forecourt.operators import audits, blend, calibrate, catalog, demand, folds, ladders, metrics, segments, snapshots
from forecourt.plans import clean
from forecourt.session import materialize
from forecourt.trims import LADDERS, TOKEN_TIERS
from forecourt.workload import views as V
from forecourt.workload.registry import query, r, rnd, rounded, rs, s_age_bucket, s_band, s_fold, s_norm, s_squeeze, sql

MET = "mse rmse mae median_ae r2 mape mpe"


def s_metrics(p: str = "prediction", size: str = "greatest(abs(price), 1.0)", names: str = MET, digits: int = 4) -> str:
    a, e = "price", f"({p} - price)"
    table = {
        "mse": f"avg({e} * {e})", "rmse": f"sqrt(avg({e} * {e}))", "mae": f"avg(abs({e}))", "median_ae": f"median(abs({e}))",
        "r2": f"1.0 - sum({e} * {e}) / nullif(var_pop({a}) * count(*), 0)", "mape": f"avg(abs({e}) / {size}) * 100.0", "mpe": f"avg({e} / {size}) * 100.0",
    }
    return ", ".join(f"{r(table[n], 2 if n == 'mse' else digits)} AS {n}" for n in names.split())


def _round_metrics(df, names: str = MET):
    return df.withColumns({n: rnd(n, 2 if n == "mse" else 4) for n in names.split() if n in df.columns})


# --- blending -----------------------------------------------------------------------------------

_PCT = "avg(abs({0} - price) / greatest(abs(price), 2.220446049250313e-16)) * 100.0"
_GRID = f"SELECT i * 0.05::DOUBLE AS w, {_PCT.format('(i * 0.05::DOUBLE * prediction + (1.0::DOUBLE - i * 0.05::DOUBLE) * prediction_2)')} AS mape FROM p, (SELECT unnest(range(21)) AS i) GROUP BY i"


@query("bld_weight_grid", sql(f"SELECT {r('w')} AS weight_first, {r('1.0 - w')} AS weight_second, {r('mape')} AS mape, mape = (SELECT min(mape) FROM g) AS is_best FROM g", "p", extra={"g": _GRID}))
def bld_weight_grid(spark, sf):
    return rounded(blend.weight_grid(V.predictions(spark, sf), "prediction", "prediction_2"), ["weight_first", "weight_second", "mape"])


_SGRID = f"""SELECT body_type, i, count(*) AS n, {_PCT.format('((1.0::DOUBLE - i * 0.1::DOUBLE) * prediction + i * 0.1::DOUBLE * prediction_2)')} AS mape
  FROM p, (SELECT unnest(range(10)) AS i) GROUP BY 1, 2"""


@query("bld_specialist_grid", sql(f"""SELECT body_type, rows, {r('global_mape')} AS global_mape, {r('best_mape')} AS best_mape, {r('w / 10.0')} AS blend_weight, {r('global_mape - best_mape')} AS improvement,
  w > 0 AND global_mape - best_mape >= 0.01 AND rows >= 150 AS keep FROM (SELECT body_type, any_value(n) AS rows, max(mape) FILTER (i = 0) AS global_mape, min(mape) AS best_mape, arg_min(i, mape) AS w FROM g GROUP BY 1)""", "p", extra={"g": _SGRID}))
def bld_specialist_grid(spark, sf):
    out = blend.specialist_grid(V.predictions(spark, sf), "body_type", "prediction", "prediction_2", min_rows=150, min_gain=0.01)
    return rounded(out, ["global_mape", "best_mape", "blend_weight", "improvement"])


_G = "(0.7::DOUBLE * prediction + 0.3::DOUBLE * prediction_2)"
_S1 = f"CASE WHEN fuel = 'R' THEN 0.6::DOUBLE * {_G} + 0.4::DOUBLE * prediction_2 ELSE {_G} END"


@query("bld_ensemble", sql(f"""SELECT row_key, {r(f"CASE WHEN body_type = 'PROMO' THEN 0.8::DOUBLE * ({_S1}) + 0.2::DOUBLE * prediction ELSE {_S1} END", 3)} AS selected,
  {r(f"({_G} + CASE WHEN fuel = 'R' THEN 0.4::DOUBLE * prediction_2 ELSE 0 END + CASE WHEN body_type = 'PROMO' THEN 0.2::DOUBLE * prediction ELSE 0 END) / (1.0::DOUBLE + CASE WHEN fuel = 'R' THEN 0.4::DOUBLE ELSE 0 END + CASE WHEN body_type = 'PROMO' THEN 0.2::DOUBLE ELSE 0 END)", 3)} AS served FROM p""", "p"))
def bld_ensemble(spark, sf):
    rows, both, w = V.predictions(spark, sf), ["prediction", "prediction_2"], [0.7, 0.3]
    special = [("fuel", "r", 0.4, "prediction_2"), ("body_type", "promo", 0.2, "prediction")]
    out = blend.ensemble(blend.ensemble(rows, both, w, special, "selected", "selected"), both, w, special, "served", "served")
    return rounded(out.select("row_key", "selected", "served"), ["selected", "served"], 3)


@query("bld_inverse_mape", sql(f"""SELECT candidate, {r('mape')} AS mape, {r('(1.0 / mape) / sum(1.0 / mape) OVER ()', 6)} AS weight FROM
  (SELECT 'prediction' AS candidate, avg(abs(prediction - price) / greatest(price, 1.0)) * 100.0 AS mape FROM p UNION ALL SELECT 'prediction_2', avg(abs(prediction_2 - price) / greatest(price, 1.0)) * 100.0 FROM p)""", "p"))
def bld_inverse_mape(spark, sf):
    out = blend.inverse_mape_weights(V.predictions(spark, sf), ["prediction", "prediction_2"])
    return out.select("candidate", rnd("mape").alias("mape"), rnd("weight", 6).alias("weight"))


# --- calibration --------------------------------------------------------------------------------

_CAL = {
    "v": "SELECT *, price / greatest(prediction, 1.0) AS ratio FROM p WHERE prediction > 0 AND price > 0",
    "gl": "SELECT least(greatest(median(ratio), 0.4), 1.6) AS factor, count(*) AS n, median(ratio) AS raw FROM v",
    "sg": "SELECT segment, count(*) AS n, least(greatest(CASE WHEN count(*) >= 20 THEN median(ratio) ELSE (SELECT raw FROM gl) END, 0.4), 1.6) AS factor FROM v GROUP BY 1",
    "aj": "SELECT v.*, prediction * sg.factor AS adj FROM v JOIN sg USING (segment)",
    "ln_fit": "SELECT regr_slope(price, adj) AS slope, regr_intercept(price, adj) AS intercept FROM aj",
}


@query("cal_segment_factors", sql(f"SELECT 'segment' AS scope, segment, n, {r('factor', 6)} AS factor FROM sg UNION ALL SELECT 'global', '*', n, {r('factor', 6)} FROM gl", "p", extra=_CAL))
def cal_segment_factors(spark, sf):
    return calibrate.segment_factors(V.predictions(spark, sf)).withColumn("factor", rnd("factor", 6))


@query("cal_linear", sql(f"SELECT {r('slope', 6)} AS slope, {r('intercept', 3)} AS intercept FROM ln_fit", "p", extra=_CAL))
def cal_linear(spark, sf):
    rows = V.predictions(spark, sf)
    factors = materialize(calibrate.segment_factors(rows))
    return calibrate.linear_step(rows, factors).select(rnd("slope", 6).alias("slope"), rnd("intercept", 3).alias("intercept"))


_CANDS = {
    "identity": "prediction", "global_factor": "greatest(prediction * (SELECT factor FROM gl), 1.0)", "segment_factor": "adj",
    "segment_factor_linear": "greatest((SELECT slope FROM ln_fit) * adj + (SELECT intercept FROM ln_fit), 1.0)",
}
_CAL_SCORES = {
    **_CAL,
    "sc": " UNION ALL ".join(
        f"SELECT '{n}' AS candidate, {i} AS pos, avg(abs({e} - price) / greatest(price, 1.0)) * 100.0 AS mape, avg(({e} - price) / greatest(price, 1.0)) * 100.0 AS mpe FROM aj"
        for i, (n, e) in enumerate(_CANDS.items())
    ),
    "so": "SELECT *, mape + 25.0 * greatest(abs(mpe) - 5.0, 0.0) AS objective, abs(mpe) <= 5.0 AS within_bias FROM sc",
    "sx": "SELECT *, row_number() OVER (ORDER BY within_bias DESC, objective, mape, pos) = 1 AS chosen FROM so",
}


@query("cal_select", sql(f"SELECT candidate, {rs('mape mpe objective')}, within_bias, chosen FROM sx", "p", extra=_CAL_SCORES))
def cal_select(spark, sf):
    rows = V.predictions(spark, sf)
    factors = materialize(calibrate.segment_factors(rows))
    linear = materialize(calibrate.linear_step(rows, factors))
    return rounded(calibrate.candidate_scores(rows, factors, linear), ["mape", "mpe", "objective"])


@query("cal_apply", sql(f"""SELECT row_key, {r('''greatest(CASE c WHEN 'identity' THEN prediction WHEN 'global_factor' THEN prediction * (SELECT factor FROM gl) WHEN 'segment_factor' THEN adj
  ELSE (SELECT slope FROM ln_fit) * adj + (SELECT intercept FROM ln_fit) END, 1.0)''', 3)} AS calibrated FROM aj, (SELECT candidate AS c FROM sx WHERE chosen)""", "p", extra=_CAL_SCORES))
def cal_apply(spark, sf):
    rows = V.predictions(spark, sf)
    out = calibrate.fit_calibration(rows).apply(rows)
    return out.select("row_key", rnd("calibrated", 3).alias("calibrated"))


# --- metrics ------------------------------------------------------------------------------------


@query("met_regression", sql(f"SELECT count(*) AS rows, {s_metrics()} FROM p WHERE price > 0", "p"))
def met_regression(spark, sf):
    return _round_metrics(metrics.regression_metrics(V.predictions(spark, sf)))


@query("met_batch", sql(f"SELECT count(*) AS rows, {s_metrics('prediction_2', 'price')} FROM p WHERE price <> 0", "p"))
def met_batch(spark, sf):
    return _round_metrics(metrics.batch_metrics(V.predictions(spark, sf), pred="prediction_2"))


@query("met_log_mape", sql(f"SELECT {r('avg(abs(prediction - price) / greatest(abs(price), 1.0))', 6)} AS mape, {r('avg(abs(prediction_2 - price) / greatest(abs(price), 1.0))', 6)} AS mape_ln FROM p", "p"))
def met_log_mape(spark, sf):
    rows = V.predictions(spark, sf).select(
        F.log1p("price").alias("a1"), F.log1p("prediction").alias("p1"), F.log("price").alias("a2"), F.log("prediction_2").alias("p2")
    )
    second = metrics.log_mape(rows, "a2", "p2", plus_one=False).scalar()
    return metrics.log_mape(rows, "a1", "p1").select(rnd("mape", 6).alias("mape"), rnd(second, 6).alias("mape_ln"))


_FOLD_MET = "mape mpe rmse r2 mae median_ae"


@query("met_folds", sql(f"SELECT fold, {r('rows')} AS rows, {rs(_FOLD_MET)} FROM (SELECT * FROM pf UNION ALL SELECT NULL, {', '.join(f'avg({c})' for c in ('rows ' + _FOLD_MET).split())} FROM pf)", "p", extra={
    "pf": f"SELECT {s_fold('listing_id', 5)}::INT AS fold, count(*)::DOUBLE AS rows, " + s_metrics(names=_FOLD_MET, digits=12).replace("floor(", "(").replace(" * 1e12 + 0.50001) / 1e12", ")") + " FROM p WHERE price > 0 GROUP BY 1"}))
def met_folds(spark, sf):
    rows = folds.group_fold(V.predictions(spark, sf))
    return rounded(metrics.fold_metrics(rows), ["rows", *_FOLD_MET.split()])


# --- segments -----------------------------------------------------------------------------------

_SEG = {
    "e": "SELECT *, abs(prediction - price) / price * 100.0 AS ape, (prediction - price) / price * 100.0 AS pe, abs(prediction_2 - price) / price * 100.0 AS ape2, (prediction_2 - price) / price * 100.0 AS pe2 FROM p WHERE price <> 0",
    "d": " UNION ALL ".join(
        f"SELECT '{n}' AS dimension, {s} AS segment, {o} AS band_order, ape, pe, ape2, pe2 FROM e" for n, s, o in [
            ("price_band", s_band("price", V.REPORT_EDGES, K.REPORT_PRICE_LABELS), f"({s_band('price', V.REPORT_EDGES, '12345')})::INT"),
            ("make", "make", "NULL::INT"), ("year", "year::INT::VARCHAR", "year::INT"), ("city", "city", "NULL::INT"),
            ("kms_band", s_band("kms", K.REPORT_KMS_EDGES, K.REPORT_KMS_LABELS), f"({s_band('kms', K.REPORT_KMS_EDGES, '123456')})::INT"),
            ("ownership", s_band("ownership", K.REPORT_OWNER_EDGES, K.REPORT_OWNER_LABELS), f"({s_band('ownership', K.REPORT_OWNER_EDGES, '12345')})::INT"),
            ("transmission", "transmission", "NULL::INT"), ("fuel", "fuel", "NULL::INT"), ("body_type", "body_type", "NULL::INT"),
        ]
    ),
    "s": "SELECT dimension, segment, any_value(band_order) AS band_order, count(*) AS rows, avg(ape) AS mape, avg(pe) AS mpe, avg(ape2) AS mape2, avg(pe2) AS mpe2 FROM d GROUP BY 1, 2",
    "k": "SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY rows DESC, segment) AS rn FROM s",
    "top": "SELECT * FROM k WHERE dimension NOT IN ('make', 'city') OR rn <= 10",
}


def _edges():
    return {"price_edges": V.REPORT_EDGES}


@query("seg_error_summary", sql(f"SELECT dimension, segment, band_order::DOUBLE AS band_order, rows, {rs('mape mpe')}, CASE WHEN mpe > 0 THEN 'over' WHEN mpe < 0 THEN 'under' ELSE 'neutral' END AS direction FROM top", "p", extra=_SEG))
def seg_error_summary(spark, sf):
    out = segments.error_summary(V.predictions(spark, sf), **_edges())
    return rounded(out.withColumn("band_order", F.col("band_order").cast("double")), ["mape", "mpe"])


@query("seg_top_makes", sql(f"SELECT dimension, segment, rows, {rs('mape mpe')}, CASE WHEN mpe > 0 THEN 'over' WHEN mpe < 0 THEN 'under' ELSE 'neutral' END AS direction FROM top WHERE dimension IN ('make', 'city')", "p", extra=_SEG))
def seg_top_makes(spark, sf):
    return rounded(segments.top_makes(V.predictions(spark, sf)), ["mape", "mpe"])


@query("seg_base_vs_adjusted", sql(f"""SELECT dimension, segment, band_order::DOUBLE AS band_order, rows, {r('mape')} AS mape_base, {r('mpe')} AS mpe_base, {r('mape2')} AS mape_adjusted, {r('mpe2')} AS mpe_adjusted,
  {r('mape2 - mape')} AS mape_change FROM top""", "p", extra=_SEG))
def seg_base_vs_adjusted(spark, sf):
    out = segments.base_vs_adjusted(V.predictions(spark, sf), **_edges())
    names = ["mape_base", "mpe_base", "mape_adjusted", "mpe_adjusted", "mape_change"]
    return rounded(out.withColumn("band_order", F.col("band_order").cast("double")), names)


_BAND = s_band("price", V.SEGMENT_EDGES, list(K.PRICE_SEGMENT_LABELS))
_WORST = {
    "d": " UNION ALL ".join(f"SELECT '{n}' AS segment_type, {e} AS segment_value, price, prediction FROM p" for n, e in [
        ("actual_price_band", _BAND), ("make", "make"), ("model", "model"), ("city", "city"), ("fuel", "fuel"), ("body_type", "body_type")]),
    "g": "SELECT segment_type, segment_value, count(*) AS rows, avg(abs(prediction - price) / greatest(price, 1.0)) * 100.0 AS mape, avg((prediction - price) / greatest(price, 1.0)) * 100.0 AS mpe, "
         "sqrt(avg((prediction - price) * (prediction - price))) AS rmse, avg(abs(prediction - price)) AS mae, median(price) AS median_actual FROM d GROUP BY 1, 2",
    "w": "SELECT *, row_number() OVER (PARTITION BY segment_type ORDER BY mape DESC, rows DESC, segment_value) AS rank FROM g "
         "WHERE rows >= CASE WHEN segment_type IN ('make', 'model', 'city') THEN 30 ELSE 20 END",
}


@query("seg_worst", sql(f"""SELECT segment_type, segment_value, rows, {rs('mape mpe rmse mae median_actual')}, rank::INT AS rank FROM w
  WHERE rank <= CASE segment_type WHEN 'model' THEN 20 WHEN 'make' THEN 15 WHEN 'city' THEN 15 ELSE 10 END""", "p", extra=_WORST))
def seg_worst(spark, sf):
    detail = segments.detail_rows(V.predictions(spark, sf), edges=V.SEGMENT_EDGES)
    return rounded(segments.worst_segments(detail), ["mape", "mpe", "rmse", "mae", "median_actual"])


@query("seg_detail_rows", sql(f"""SELECT listing_id, make, model, variant, city, fuel, body_type, price AS actual_price, {r('prediction')} AS predicted_price, {r('abs(prediction - price) / greatest(price, 1.0) * 100.0')} AS ape_pct,
  {r('(prediction - price) / greatest(price, 1.0) * 100.0')} AS pe_pct, {_BAND} AS actual_price_band FROM p""", "p"))
def seg_detail_rows(spark, sf):
    return rounded(segments.detail_rows(V.predictions(spark, sf), edges=V.SEGMENT_EDGES), ["predicted_price", "ape_pct", "pe_pct"])


@query("flw_row_flow", sql("""SELECT count(*) AS input_rows, count(*) AS cleaned_rows, 0::BIGINT AS dropped_in_cleaning, count(*) AS prediction_rows, count(DISTINCT coalesce(listing_id, concat('row_', row_key))) AS rows_if_anchor_deduped,
  count(*) - count(DISTINCT coalesce(listing_id, concat('row_', row_key))) AS would_drop_in_anchor_dedup, count(*) FILTER (price > 0) AS metric_rows FROM tp""", "tp"))
def flw_row_flow(spark, sf):
    from forecourt.plans import scoring

    return scoring.row_flow(V.raw_text(spark, sf), V.REF, min_year=V.MIN_YEAR, unique="row_key")


# --- demand multipliers -------------------------------------------------------------------------

_DMD = {
    "mm": "SELECT *, lower(trim(type)) AS t, lower(trim(name)) AS nm, lower(trim(parent)) AS pa FROM m",
    "vr": "SELECT *, lower(trim(split_part(parent, '|', 1))) AS pmake, CASE WHEN contains(parent, '|') THEN lower(trim(split_part(parent, '|', 2))) END AS pmodel FROM mm WHERE t = 'variant'",
    "v1": "SELECT nm, pmake, pmodel, arg_min(multiplier, position) AS x, min(position) AS pos FROM vr WHERE pmodel IS NOT NULL GROUP BY 1, 2, 3",
    "v2": "SELECT nm, pmake, arg_max(multiplier, position) AS x, min(position) AS pos FROM vr WHERE pmodel IS NULL GROUP BY 1, 2",
    "mo": "SELECT nm, pa, arg_min(multiplier, position) AS x, min(position) AS pos FROM mm WHERE t = 'model' GROUP BY 1, 2",
    "br": "SELECT nm, arg_min_null(multiplier, position) AS x, min(position) AS pos FROM mm WHERE t = 'brand' GROUP BY 1",
    "hx": """SELECT lf.*, CASE WHEN v1.pos IS NOT NULL OR v2.pos IS NOT NULL THEN 'variant' WHEN mo.pos IS NOT NULL THEN 'model' WHEN br.pos IS NOT NULL THEN 'make' END AS base_source,
      CASE WHEN v1.pos IS NOT NULL THEN v1.x WHEN v2.pos IS NOT NULL THEN v2.x WHEN mo.pos IS NOT NULL THEN mo.x ELSE br.x END AS base_multiplier
      FROM lf LEFT JOIN v1 ON v1.nm = lower(lf.variant) AND v1.pmake = lower(lf.make) AND v1.pmodel = lower(lf.model) LEFT JOIN v2 ON v2.nm = lower(lf.variant) AND v2.pmake = lower(lf.make)
      LEFT JOIN mo ON mo.nm = lower(lf.model) AND mo.pa = lower(lf.make) LEFT JOIN br ON br.nm = lower(lf.make)""",
    "fx": """SELECT hx.*, (SELECT multiplier FROM mm WHERE t = 'city' AND nm = lower(city)) AS m_city, (SELECT multiplier FROM mm WHERE t = 'bodytype' AND nm = lower(body_type)) AS m_body_type,
      (SELECT multiplier FROM mm WHERE t = 'fuel' AND nm = lower(fuel)) AS m_fuel, (SELECT multiplier FROM mm WHERE t = 'transmission' AND nm = lower(transmission)) AS m_transmission FROM hx""",
    "bx": """SELECT fx.*, a.multiplier AS m_car_age, k.multiplier AS m_kms_per_year, o.multiplier AS m_ownership FROM fx
      LEFT JOIN mm a ON a.t = 'age_bucket' AND car_age >= a.min AND car_age < a.max LEFT JOIN mm k ON k.t = 'kms_year_bucket' AND kms_per_year >= k.min AND kms_per_year < k.max
      LEFT JOIN mm o ON o.t = 'ownership_bucket' AND ownership >= o.min AND ownership < o.max""",
    "rx": "SELECT bx.*, s.multiplier AS m_reg_state FROM bx LEFT JOIN mm s ON s.t = 'reg_state' AND s.nm = lower(reg_state)",
}
_PARTS = {"m_city": 0.60, "m_body_type": 0.50, "m_fuel": 0.55, "m_transmission": 0.50, "m_car_age": 1.00, "m_kms_per_year": 0.95, "m_ownership": 0.80}
_BASE_W = "CASE base_source WHEN 'variant' THEN 0.60 WHEN 'model' THEN 0.85 WHEN 'make' THEN 0.80 ELSE 0 END"
_W = " + ".join([f"CASE WHEN base_multiplier > 0 THEN {_BASE_W} ELSE 0 END", *[f"CASE WHEN {c} > 0 THEN {w} ELSE 0 END" for c, w in _PARTS.items()]])
_LOG = " + ".join([f"CASE WHEN base_multiplier > 0 THEN {_BASE_W} * ln(base_multiplier) ELSE 0 END", *[f"CASE WHEN {c} > 0 THEN {w} * ln({c}) ELSE 0 END" for c, w in _PARTS.items()]])
_USED = " + ".join([f"(coalesce(base_multiplier > 0, false))::INT", *[f"(coalesce({c} > 0, false))::INT" for c in _PARTS]])


@query("dmd_hierarchy", sql("SELECT row_key, base_source, base_multiplier FROM hx", "lf", "m", extra=_DMD))
def dmd_hierarchy(spark, sf):
    return demand.hierarchy(V.listings(spark, sf), V.multipliers(spark, sf)).select("row_key", "base_source", "base_multiplier")


@query("dmd_flat", sql("SELECT row_key, m_city, m_body_type, m_fuel, m_transmission FROM fx", "lf", "m", extra=_DMD))
def dmd_flat(spark, sf):
    return demand.flat_lookups(V.listings(spark, sf), V.multipliers(spark, sf)).select("row_key", "m_city", "m_body_type", "m_fuel", "m_transmission")


@query("jon_bucket_range", sql("SELECT row_key, m_car_age, m_kms_per_year, m_ownership FROM bx", "lf", "m", extra=_DMD))
def jon_bucket_range(spark, sf):
    out = demand.bucket_lookups(clean.age_features(V.listings(spark, sf), V.REF), V.multipliers(spark, sf))
    return out.select("row_key", "m_car_age", "m_kms_per_year", "m_ownership")


@query("dmd_composite", sql(f"""SELECT row_key, {r('composite', 6)} AS composite, n_parts, {r('price * composite', 3)} AS adjusted_price, {r('CASE WHEN w > 0 THEN 1.0 ELSE 0.0 END', 4)} AS weight_total FROM
  (SELECT *, CASE WHEN w > 0 THEN least(greatest(exp(l / w), 0.70), 1.20) ELSE 1.0 END AS composite FROM (SELECT *, ({_W})::DOUBLE AS w, ({_LOG}) AS l, ({_USED})::INT AS n_parts FROM bx))""", "lf", "m", extra=_DMD))
def dmd_composite(spark, sf):
    out = demand.demand_adjust(clean.age_features(V.listings(spark, sf), V.REF), V.multipliers(spark, sf), price="price")
    total = F.aggregate("breakdown", F.lit(0.0), lambda acc, s: acc + s["weight"])
    return out.select("row_key", rnd("composite", 6).alias("composite"), F.size("breakdown").alias("n_parts"), rnd("adjusted_price", 3).alias("adjusted_price"), rnd(total).alias("weight_total"))


_STATE_W, _STATE_LOG, _STATE_USED = (
    f"CASE WHEN m_reg_state > 0 THEN {x} ELSE 0 END" for x in ("0.30", "0.30 * ln(m_reg_state)", "1")
)


@query("dmd_reg_state", sql(f"""SELECT row_key, m_reg_state, {r('CASE WHEN w > 0 THEN least(greatest(exp(l / w), 0.70), 1.20) ELSE 1.0 END', 6)} AS composite, n_parts FROM
  (SELECT *, ({_W} + {_STATE_W})::DOUBLE AS w, ({_LOG} + {_STATE_LOG}) AS l, ({_USED} + {_STATE_USED})::INT AS n_parts FROM rx)""", "lf", "m", extra=_DMD))
def dmd_reg_state(spark, sf):
    out = demand.demand_adjust(clean.age_features(V.listings(spark, sf), V.REF), V.multipliers(spark, sf), reg_state="reg_state")
    return out.select("row_key", "m_reg_state", rnd("composite", 6).alias("composite"), F.size("breakdown").alias("n_parts"))


# --- catalog and trim ladders -------------------------------------------------------------------

_CLEAN = ("SELECT {0} AS make, {1} AS model, {2} AS variant FROM tp WHERE {0} <> 'Unknown' AND {1} <> 'Unknown' AND {2} <> 'Unknown'").format(s_norm("make0"), s_norm("model0"), s_norm("variant0"))
_BLANKS = "'' AS min, '' AS max, '' AS multiplier, '' AS notes"


@query("cat_catalog", sql(f"""SELECT DISTINCT 'brand' AS type, '' AS scope, make AS name, '' AS parent, {_BLANKS} FROM c UNION ALL SELECT DISTINCT 'model', '', model, make, {_BLANKS} FROM c
  UNION ALL SELECT DISTINCT 'variant', '', variant, concat(make, ' | ', model), {_BLANKS} FROM c""", "tp", extra={"c": _CLEAN}))
def cat_catalog(spark, sf):
    return catalog.catalog(clean.parse_raw(V.raw_text(spark, sf)))


def _variants(spark, sf):
    """Catalog variants of the part table, one row per (parent, name)."""
    rows = V.table(spark, sf, "part").select(F.col("p_brand").alias("make"), F.expr("concat(p_brand, ' ', p_type)").alias("model"), F.col("p_name").alias("variant"))
    return catalog.catalog(rows, only="variants").select("parent", "name")


def _rule_rows(tables=V.WORD_LADDERS) -> str:
    rows = []
    for scope, table in tables.items():
        for parent, steps in table.items():
            for level, tokens in enumerate(steps):
                for token in tokens:
                    rows.append(f"('{scope}', '{parent}', {level}, {len(steps)}, '(?i){ladders.token_regex(token)}')")
    return f"SELECT * FROM (VALUES {', '.join(rows)}) AS x(scope, parent, level, n_levels, regex)"


_SCORE = "CASE WHEN b IS NULL THEN NULL WHEN n <= 1 THEN 3 ELSE greatest(least(round_even(b::DOUBLE / (n - 1) * 4, 0)::INT + 1, 5), 1) END"
_VAR = {
    "c": "SELECT DISTINCT concat(p_brand, ' | ', p_brand, ' ', p_type) AS parent, p_name AS name FROM part",
    "x": rf"SELECT parent, name, upper({s_squeeze('name')}) AS raw, {s_squeeze(r'''regexp_replace(upper(name), '[^A-Z0-9+&/ ]', ' ', 'g')''')} AS red, upper({s_squeeze('split_part(parent, chr(124), 1)')}) AS brand FROM c",
    "ru": _rule_rows(),
    "h1": "SELECT parent, name, max(level) AS b, max(n_levels) AS n FROM x JOIN ru USING (parent) WHERE scope = 'model' AND regexp_matches(raw, regex) GROUP BY ALL",
    "h2": "SELECT parent, name, max(level) AS b, max(n_levels) AS n FROM x JOIN ru USING (parent) WHERE scope = 'model' AND regexp_matches(red, regex) GROUP BY ALL",
    "h3": "SELECT x.parent, name, max(level) AS b, max(n_levels) AS n FROM x JOIN ru ON ru.parent = brand WHERE scope = 'brand' AND regexp_matches(red, regex) GROUP BY ALL",
    "ls": f"""SELECT x.*, coalesce(a.s, b.s, d.s, 3) AS ladder_score FROM x LEFT JOIN (SELECT parent, name, {_SCORE} AS s FROM h1) a USING (parent, name)
      LEFT JOIN (SELECT parent, name, {_SCORE} AS s FROM h2) b USING (parent, name) LEFT JOIN (SELECT parent, name, {_SCORE} AS s FROM h3) d USING (parent, name)""",
}


def _adjusted(tiers) -> str:
    has = {t: "regexp_matches(red, '(?i)(?:" + "|".join(ladders.token_regex(x) for x in tokens) + ")')" for t, tokens in tiers.items()}
    return f"""SELECT *, CASE WHEN {has[1]} THEN 1 ELSE greatest(least(CASE WHEN {has[5]} THEN 5 ELSE s4 END, 5), 1) END AS score FROM
  (SELECT *, CASE WHEN {has[4]} THEN greatest(s2, 4) ELSE s2 END AS s4 FROM (SELECT *, CASE WHEN {has[2]} THEN least(ladder_score, 2) ELSE ladder_score END AS s2 FROM ls))"""


_VAR["ad"] = _adjusted(V.WORD_TIERS)
# The same over the whole ladders. RE2 has no look-ahead: what follows a '+' is part of the match there.
_TRIM = {**_VAR, "c": V.TRIM_NAMES, "ru": _rule_rows(LADDERS), "ad": _adjusted(TOKEN_TIERS)}
_TRIM = {k: v.replace(r"(?!\w)", r"(?:\W|$)") for k, v in _TRIM.items()}


@query("var_ladder_score", sql("SELECT parent, name, ladder_score::INT AS ladder_score FROM ls", extra=_VAR))
def var_ladder_score(spark, sf):
    return ladders.ladder_score(_variants(spark, sf), ladders.ladder_rules(spark, V.WORD_LADDERS))


@query("var_token_adjust", sql("SELECT parent, name, ladder_score::INT AS ladder_score, score::INT AS score FROM ad", extra=_VAR))
def var_token_adjust(spark, sf):
    scored = ladders.ladder_score(_variants(spark, sf), ladders.ladder_rules(spark, V.WORD_LADDERS))
    return ladders.token_adjust(scored, V.WORD_TIERS)


@query("var_multiplier", sql("SELECT parent, name, CASE score WHEN 5 THEN 1.07 WHEN 4 THEN 1.04 WHEN 3 THEN 1.00 WHEN 2 THEN 0.97 ELSE 0.94 END::DOUBLE AS multiplier FROM ad", extra=_VAR))
def var_multiplier(spark, sf):
    return ladders.variant_multipliers(_variants(spark, sf), ladders.ladder_rules(spark, V.WORD_LADDERS), V.WORD_TIERS)


@query("var_trim_ladders", sql("""SELECT parent, name, ladder_score::INT AS ladder_score, score::INT AS score,
  CASE score WHEN 5 THEN 1.07 WHEN 4 THEN 1.04 WHEN 3 THEN 1.00 WHEN 2 THEN 0.97 ELSE 0.94 END::DOUBLE AS multiplier FROM ad""", extra=_TRIM))
def var_trim_ladders(spark, sf):
    names = spark.sql(V.TRIM_NAMES.replace("FROM part", "FROM {part}"), part=V.table(spark, sf, "part"))
    scored = ladders.token_adjust(ladders.ladder_score(names, ladders.default_rules(spark)), TOKEN_TIERS)
    return scored.withColumn("multiplier", F.round(ladders.score_multiplier(F.col("score")), 2)).select("parent", "name", "ladder_score", "score", "multiplier")


# --- audits -------------------------------------------------------------------------------------

_LAST = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY listing_id ORDER BY fetched_on DESC NULLS LAST, row_key DESC) AS rn FROM tp) WHERE rn = 1"
_STEPS = {
    "a1": _LAST,
    "a2": "SELECT * FROM a1 WHERE price IS NOT NULL AND year IS NOT NULL AND kms IS NOT NULL",
    "a3": "SELECT * FROM a2 WHERE year >= 1985 AND year <= coalesce(year(fetched_on), 2001)",
    "a4": "SELECT * FROM a3 WHERE kms BETWEEN 0 AND 400000",
    "a5": "SELECT a4.* FROM a4, (SELECT quantile_cont(price, 0.01) AS lo, quantile_cont(price, 0.99) AS hi FROM a4) WHERE price BETWEEN lo AND hi",
    "n": " UNION ALL ".join(f"SELECT {i} AS step, '{label}' AS label, count(*) AS remaining FROM {t}" for i, (label, t) in enumerate(zip(audits.STEPS, ("tp", "a1", "a2", "a3", "a4", "a5")))),
}


@query("aud_filter_steps", sql(f"SELECT step, label, removed, remaining, {r('removed * 100.0 / (SELECT remaining FROM n WHERE step = 0)')} AS removed_pct FROM (SELECT *, coalesce(lag(remaining) OVER (ORDER BY step) - remaining, 0) AS removed FROM n)", "tp", extra=_STEPS))
def aud_filter_steps(spark, sf):
    rows = clean.parse_raw(V.raw_text(spark, sf)).select("listing_id", "fetched_on", "price", "year", "kms", "row_key")
    return rounded(audits.filter_steps(rows, clean.snapshot_year(V.REF), V.MIN_YEAR, ties=["row_key"]), ["removed_pct"])


_SC = ["make", "model", "variant", "city", "fuel", "transmission", "year", "price"]


@query("aud_snapshot_changes", sql(" UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) FILTER (x > 1) AS changed_ids, {r('count(*) FILTER (x > 1) * 100.0 / nullif(count(*) FILTER (n > 1), 0)')} AS pct_of_multi FROM (SELECT listing_id, count(DISTINCT {c}) AS x, count(*) AS n FROM l GROUP BY 1)" for c in _SC), "l"))
def aud_snapshot_changes(spark, sf):
    return rounded(audits.snapshot_changes(V.listings(spark, sf), _SC), ["pct_of_multi"])


@query("aud_price_changes", sql(f"""SELECT count(*) AS multi_ids, count(*) FILTER (u = 1) AS never_changed, count(*) FILTER (u > 1) AS changed, {r('avg(sp) FILTER (u > 1)')} AS mean_spread_pct,
  {r('count(*) FILTER (u = 1) * 100.0 / count(*)')} AS never_changed_pct, {r('median(sp) FILTER (u > 1)')} AS median_spread_pct FROM
  (SELECT listing_id, count(price) AS n, count(DISTINCT price) AS u, (max(price) - min(price)) / avg(price) * 100.0 AS sp FROM l GROUP BY 1) WHERE n > 1""", "l"))
def aud_price_changes(spark, sf):
    return rounded(audits.price_changes(V.listings(spark, sf)), ["mean_spread_pct", "never_changed_pct", "median_spread_pct"])


@query("aud_distribution", sql(f"""SELECT count(price) AS count, {r('avg(price)')} AS mean, {r('stddev_samp(price)')} AS std, min(price) AS min, max(price) AS max, {r('quantile_cont(price, 0.25)')} AS p25, {r('median(price)')} AS p50,
  {r('quantile_cont(price, 0.75)')} AS p75, {r('skewness(price)')} AS skewness, {r('kurtosis(price)')} AS kurtosis FROM l""", "l"))
def aud_distribution(spark, sf):
    return rounded(audits.distribution(V.listings(spark, sf)), ["mean", "std", "p25", "p50", "p75", "skewness", "kurtosis"])


_NAMES = ["make", "model", "variant", "transmission", "fuel", "body_type", "reg_state"]


@query("aud_cardinality", sql(" UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) AS distinct_values, {r('count(*) FILTER (n < 10) * 100.0 / count(*)')} AS rare_pct, (array_agg(v ORDER BY n DESC, v))[1] AS top_value, max(n) AS top_count FROM (SELECT {c} AS v, count(*) AS n FROM l GROUP BY 1)" for c in _NAMES), "l"))
def aud_cardinality(spark, sf):
    return rounded(audits.cardinality(V.listings(spark, sf), _NAMES), ["rare_pct"])


@query("aud_sparsity", sql(" UNION ALL ".join(
    f"SELECT {t} AS threshold, count(*) FILTER (n <= {t}) AS n_values, {r(f'count(*) FILTER (n <= {t}) * 100.0 / count(*)')} AS pct FROM (SELECT city, model, count(*) AS n FROM l GROUP BY 1, 2)" for t in (1, 2, 5, 10, 20, 50)), "l"))
def aud_sparsity(spark, sf):
    rows = V.listings(spark, sf).select(F.concat_ws("|", "city", "model").alias("variant"))
    return rounded(audits.sparsity(rows), ["pct"])


_CVKEYS = ["make", "model", "year", "fuel", "transmission"]
_CV = {"g": f"SELECT {', '.join(_CVKEYS)}, count(price) AS n, avg(price) AS mean, stddev_samp(price) AS std, min(price) AS low, max(price) AS high, stddev_samp(price) / avg(price) * 100.0 AS cv FROM l GROUP BY ALL HAVING count(price) >= 5"}


@query("aud_group_cv", sql(f"SELECT count(*) AS groups, {r('median(cv)')} AS median_cv, {r('avg(cv)')} AS mean_cv, {r('quantile_cont(cv, 0.75)')} AS p75_cv, {r('quantile_cont(cv, 0.9)')} AS p90_cv FROM g", "l", extra=_CV))
def aud_group_cv(spark, sf):
    return rounded(audits.group_cv_summary(V.listings(spark, sf)), ["median_cv", "mean_cv", "p75_cv", "p90_cv"])


@query("aud_group_cv_worst", sql(f"SELECT {', '.join(_CVKEYS)}, n, {rs('mean std cv')}, low, high FROM g ORDER BY g.cv DESC, {', '.join(_CVKEYS)} LIMIT 10", "l", extra=_CV))
def aud_group_cv_worst(spark, sf):
    return rounded(audits.group_cv_worst(V.listings(spark, sf)), ["mean", "std", "cv"])


_FEAT = ["year", "kms", "car_age", "kms_per_year", "ownership", "log_kms"]


@query("aud_correlations", sql(" UNION ALL ".join(f"SELECT '{c}' AS feature, {r(f'corr({c}, price)', 6)} AS r FROM lf" for c in _FEAT), "lf"))
def aud_correlations(spark, sf):
    return rounded(audits.correlations(V.listing_features(spark, sf), _FEAT), ["r"], 6)


@query("aud_value_counts", sql("SELECT 'ownership' AS what, ownership AS value, count(*) AS rows FROM l GROUP BY ALL UNION ALL SELECT 'year', year, count(*) FROM l GROUP BY ALL UNION ALL SELECT 'lost year', year, count(*) FROM l WHERE year < 1990 GROUP BY ALL", "l"))
def aud_value_counts(spark, sf):
    rows = V.listings(spark, sf)
    parts = [
        audits.value_counts(rows, "ownership").select(F.lit("ownership").alias("what"), F.col("ownership").alias("value"), "rows"),
        audits.value_counts(rows, "year").select(F.lit("year").alias("what"), F.col("year").alias("value"), "rows"),
        audits.lost_years(rows, 1990).select(F.lit("lost year").alias("what"), F.col("year").alias("value"), "rows"),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_UNK = {"make": "make", "variant": "variant", "transmission": "transmission", "fuel": "fuel", "body_type": "body_type", "reg_state": "reg_state"}


def _unknown_sql() -> str:
    from forecourt.workload.registry import s_body, s_fuel, s_gear, s_normstate, s_state

    exprs = {"make": s_norm("make0"), "variant": s_norm("variant0"), "transmission": s_gear("transmission0"), "fuel": s_fuel("fuel0"), "body_type": s_body("body0"), "reg_state": s_normstate(s_state("registration"))}
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) FILTER ({e} IN ('Unknown', 'UNK')) AS unknown, {r(f'''count(*) FILTER ({e} IN ('Unknown', 'UNK')) * 100.0 / count(*)''')} AS pct FROM tp" for c, e in exprs.items()
    ) + " UNION ALL " + " UNION ALL ".join(f"SELECT '{c} unparsed', count(*) FILTER ({c} IS NULL), {r(f'count(*) FILTER ({c} IS NULL) * 100.0 / count(*)')} FROM tp" for c in ("price", "year", "kms"))


@query("aud_unknown_rates", sql(_unknown_sql(), "tp"))
def aud_unknown_rates(spark, sf):
    parsed = clean.parse_raw(V.raw_text(spark, sf))
    names = audits.unknown_rates(clean.normalize_names(parsed), list(_UNK))
    nulls = audits.parse_nulls(parsed).select(F.concat("column", F.lit(" unparsed")).alias("column"), F.col("nulls").alias("unknown"), "pct")
    return rounded(names.unionByName(nulls), ["pct"])


_DUP = ["make", "model", "year", "fuel", "transmission"]


@query("aud_duplicate_spread", sql(f"""SELECT sum(n)::BIGINT AS duplicate_rows, count(*) AS duplicate_groups, {r('avg(sp)')} AS mean_spread_pct, count(*) FILTER (sp > 30) AS big_groups, {r('median(sp)')} AS median_spread_pct,
  {r('count(*) FILTER (sp > 30) * 100.0 / count(*)')} AS big_pct FROM (SELECT count(price) AS n, (max(price) - min(price)) / avg(price) * 100.0 AS sp FROM l GROUP BY {', '.join(_DUP)}) WHERE n >= 2""", "l"))
def aud_duplicate_spread(spark, sf):
    return rounded(audits.duplicate_spread(V.listings(spark, sf), _DUP), ["mean_spread_pct", "median_spread_pct", "big_pct"])


@query("aud_city_effect", sql(f"SELECT city, rows, {r('mean_price')} AS mean_price FROM (SELECT city, count(price) AS rows, avg(price) AS mean_price FROM l GROUP BY 1 HAVING count(price) >= 50 ORDER BY avg(price) DESC, city LIMIT 10)", "l"))
def aud_city_effect(spark, sf):
    return rounded(audits.city_effect(V.listings(spark, sf)), ["mean_price"])


@query("aud_source_ranges", sql("SELECT source, count(price) AS rows, min(price) AS min_price, max(price) AS max_price FROM (SELECT 'portal_a' AS source, price FROM l UNION ALL SELECT 'portal_b', price FROM h) GROUP BY 1", "l", "h"))
def aud_source_ranges(spark, sf):
    from forecourt.workload.q_scalar import _sources

    return audits.source_ranges(_sources(spark, sf))
