"""Snapshots, listing history and dynamics."""

from __future__ import annotations

from pyspark.sql import functions as F

from forecourt import constants as K
from forecourt.functions.dates import wall_clock
from forecourt.operators import dynamics, snapshots
from forecourt.plans import clean
from forecourt.workload import views as V
from forecourt.workload.registry import query, r, rnd, rounded, rs, s_days, sql

DYN = " ".join(K.DYNAMICS)
TIES = ["price", "row_key"]


def _stamp(c="fetched_on"):
    return F.date_format(wall_clock(F.col(c)), "yyyy-MM-dd HH:mm:ss").alias(c)


_TS = "strftime(fetched_on, '%Y-%m-%d %H:%M:%S') AS fetched_on"


@query("win_first_snapshot", sql(f"""SELECT listing_id, {_TS}, price, row_key FROM (SELECT *, row_number() OVER (PARTITION BY listing_id ORDER BY fetched_on NULLS LAST, price NULLS FIRST, row_key) AS rn
  FROM tp) WHERE rn = 1 OR listing_id IS NULL""", "tp"))
def win_first_snapshot(spark, sf):
    rows = clean.parse_raw(V.raw_text(spark, sf)).select("listing_id", "fetched_on", "price", "row_key")
    return snapshots.first_snapshot(rows, ties=["price", "row_key"]).select("listing_id", _stamp(), "price", "row_key")


@query("win_first_recent", sql(f"""SELECT listing_id, {_TS}, price, fuel, event_id FROM (SELECT *, row_number() OVER (PARTITION BY listing_id ORDER BY fetched_on, event_id) AS rn FROM h
  WHERE fetched_on >= (SELECT max(fetched_on) FROM h) - INTERVAL 14 DAY) WHERE rn = 1""", "h"))
def win_first_recent(spark, sf):
    return snapshots.first_recent(V.history(spark, sf), ties=["event_id"]).select("listing_id", _stamp(), "price", "fuel", "event_id")


@query("win_last_per_day", sql("""SELECT listing_id, day::VARCHAR AS day, price, event_id FROM (SELECT *, fetched_on::DATE AS day,
  row_number() OVER (PARTITION BY listing_id, fetched_on::DATE ORDER BY fetched_on DESC, event_id DESC) AS rn FROM h) WHERE rn = 1""", "h"))
def win_last_per_day(spark, sf):
    out = snapshots.last_per_day(V.history(spark, sf), ties=["event_id"])
    return out.select("listing_id", F.to_date("fetched_on").cast("string").alias("day"), "price", "event_id")


@query("win_last_snapshot", sql(f"""SELECT listing_id, {_TS}, price, event_id FROM (SELECT *, row_number() OVER (PARTITION BY listing_id ORDER BY fetched_on DESC, event_id DESC) AS rn FROM h) WHERE rn = 1""", "h"))
def win_last_snapshot(spark, sf):
    return snapshots.last_snapshot(V.history(spark, sf), ties=["event_id"]).select("listing_id", _stamp(), "price", "event_id")


@query("win_days_on_market", sql(f"SELECT event_id, {s_days('fetched_on', 'min(fetched_on) OVER (PARTITION BY listing_id)')} AS days_on_market FROM h", "h"))
def win_days_on_market(spark, sf):
    return snapshots.days_on_market(V.history(spark, sf)).select("event_id", "days_on_market")


@query("win_days_since_listing", sql("""SELECT event_id, d::DOUBLE AS days_since_listing, d <= 1 AS is_listing_day FROM (SELECT event_id,
  datediff('day', (min(fetched_on) OVER (PARTITION BY listing_id))::DATE, fetched_on::DATE) AS d FROM h)""", "h"))
def win_days_since_listing(spark, sf):
    return snapshots.days_since_listing(V.history(spark, sf)).select("event_id", "days_since_listing", "is_listing_day")


@query("win_anchor_rows", sql("""SELECT listing_id, event_id, price, d::DOUBLE AS days_since_listing FROM (SELECT *, row_number() OVER (PARTITION BY listing_id ORDER BY fetched_on, d, event_id) AS rn FROM
  (SELECT *, datediff('day', (min(fetched_on) OVER (PARTITION BY listing_id))::DATE, fetched_on::DATE) AS d FROM h) WHERE d <= 1) WHERE rn = 1""", "h"))
def win_anchor_rows(spark, sf):
    rows = snapshots.days_since_listing(V.history(spark, sf))
    return snapshots.anchor_rows(rows, ties=["event_id"]).select("listing_id", "event_id", "price", "days_since_listing")


@query("win_listing_id", sql("SELECT row_key, coalesce(listing_id, concat('row_', row_key)) AS listing_id FROM tp", "tp"))
def win_listing_id(spark, sf):
    rows = V.raw_text(spark, sf, headers=False).withColumnRenamed("id", "listing_id")
    return snapshots.with_listing_id(rows, F.col("row_key")).select("row_key", "listing_id")


_STRATA = """SELECT row_key, listing_id, price, 1 + (lp > e1)::INT + (lp > e2)::INT + (lp > e3)::INT + (lp > e4)::INT AS stratum FROM
  (SELECT *, ln(greatest(price, 1.0)) AS lp FROM {src}), (SELECT quantile_cont(lp, 0.2) AS e1, quantile_cont(lp, 0.4) AS e2, quantile_cont(lp, 0.6) AS e3, quantile_cont(lp, 0.8) AS e4
  FROM (SELECT ln(greatest(price, 1.0)) AS lp FROM {src}))"""


@query("win_price_strata", sql("SELECT row_key, stratum FROM s", "l", extra={"s": _STRATA.format(src="l")}))
def win_price_strata(spark, sf):
    return snapshots.price_strata(V.listings(spark, sf)).select("row_key", "stratum")


@query("dyn_listing_targets", sql(f"SELECT listing_id, {rs(DYN, 6)} FROM hdyn", "hdyn"))
def dyn_listing_targets(spark, sf):
    return rounded(dynamics.listing_dynamics(V.history(spark, sf), ties=["event_id"]), K.DYNAMICS, 6)


@query("dyn_listing_targets_ln", sql(f"SELECT listing_id, {rs(DYN, 6)} FROM hdyn_ln", "hdyn_ln"))
def dyn_listing_targets_ln(spark, sf):
    return rounded(dynamics.listing_dynamics(V.history(spark, sf), ties=["event_id"], plus_one=False), K.DYNAMICS, 6)


PRESSURE = " ".join(K.PRESSURE_COMPONENTS)


@query("dyn_pressure_components", sql(f"SELECT listing_id, {rs(PRESSURE, 6)} FROM hcomp", "hcomp"))
def dyn_pressure_components(spark, sf):
    return rounded(dynamics.pressure_components(V.history(spark, sf), ties=["event_id"]), K.PRESSURE_COMPONENTS, 6)


@query("dyn_pressure_score", sql(f"SELECT listing_id, {rs(PRESSURE + ' pressure_score', 6)} FROM lpress", "lpress"))
def dyn_pressure_score(spark, sf):
    comp = dynamics.pressure_components(V.listings(spark, sf), ties=TIES)
    return rounded(dynamics.pressure_score(comp), [*K.PRESSURE_COMPONENTS, "pressure_score"], 6)


@query("jon_dynamics_targets", sql(f"SELECT listing_id, price, make, {rs(DYN, 6)} FROM lfirst LEFT JOIN ldyn USING (listing_id)", "lfirst", "ldyn"))
def jon_dynamics_targets(spark, sf):
    first = V.first_listings(spark, sf, ["listing_id", "price", "make"]).select("listing_id", "price", "make")
    targets = dynamics.listing_dynamics(V.listings(spark, sf), ties=TIES)
    return rounded(clean.join_targets(first, targets), K.DYNAMICS, 6)


@query("jon_semi_train_ids", sql(f"SELECT listing_id, {rs(PRESSURE, 6)} FROM hcomp WHERE listing_id IN (SELECT listing_id FROM l)", "hcomp", "l"))
def jon_semi_train_ids(spark, sf):
    ids = V.listings(spark, sf).select("listing_id")
    comp = dynamics.pressure_components(V.history(spark, sf), ties=["event_id"]).join(ids, "listing_id", "left_semi")
    return rounded(comp, K.PRESSURE_COMPONENTS, 6)


# --- composed cleaning plans ---------------------------------------------------------------------

_NAMES = "make model variant transmission fuel body_type city reg_state"


def _clean_sql(upper: bool) -> str:
    from forecourt.workload.registry import features_sql, s_blank, s_body, s_city, s_fuel, s_gear, s_norm, s_normstate, s_state

    name = (lambda x: f"upper({s_norm(x)})") if upper else s_norm
    owner = "coalesce(ownership, 1.0)" if upper else "ownership"
    ident = "coalesce(listing_id, concat('row_', row_key))" if upper else "listing_id"
    base = f"""(SELECT {ident} AS listing_id, fetched_on, {name('make0')} AS make, {name('model0')} AS model, {name('variant0')} AS variant, {s_gear('transmission0')} AS transmission,
      {s_fuel('fuel0')} AS fuel, {s_body('body0')} AS body_type, {s_city('city0')} AS city, {s_normstate(s_state('registration'))} AS reg_state,
      year, kms, {owner} AS ownership, price, row_key FROM tp)"""
    assert s_blank
    return features_sql(base)


_SAME = "listing_id IN (SELECT listing_id FROM c GROUP BY 1 HAVING count(DISTINCT year) <= 1 AND count(DISTINCT fuel) <= 1 AND count(DISTINCT transmission) <= 1)"
_NUM = "car_age kms_per_year log_kms age_x_ownership kms_x_ownership"


#: The rows that load_and_clean keeps, as "b".
LOADED = {
    "c": _clean_sql(False),
    "d": f"SELECT *, coalesce({s_days('fetched_on', 'min(fetched_on) OVER (PARTITION BY listing_id)')}, 0.0) AS days_on_market FROM c",
    "k": f"SELECT * FROM d WHERE {_SAME} AND price IS NOT NULL AND year >= 1985 AND year <= coalesce(year(fetched_on), 2001) AND kms BETWEEN 0 AND 400000",
    "b": "SELECT k.* FROM k, (SELECT quantile_cont(price, 0.01) AS lo, quantile_cont(price, 0.99) AS hi FROM k) WHERE price BETWEEN lo AND hi",
}


@query("pip_load_and_clean", sql(
    f"""SELECT listing_id, {_TS}, {_NAMES.replace(' ', ', ')}, year, kms, ownership, price, {rs(_NUM)}, fetch_month, market_days, days_on_market, make AS brand FROM b""",
    "tp", extra=LOADED))
def pip_load_and_clean(spark, sf):
    out = clean.load_and_clean(V.raw_text(spark, sf), V.REF, V.MIN_YEAR)
    return rounded(out.withColumn("fetched_on", _stamp()), _NUM.split())


_SINCE = "greatest(coalesce(datediff('day', (min(fetched_on) OVER (PARTITION BY listing_id))::DATE, fetched_on::DATE), 0), 0)::DOUBLE"
_KEPT = f"listing_id, {_TS}, {_NAMES.replace(' ', ', ')}, year, ownership, kms, price, {rs(_NUM)}, age_bucket, days_since_listing, days_since_listing <= 1 AS is_listing_day, row_key"


@query("pip_clean_leakage_safe", sql(f"SELECT {_KEPT} FROM k", "tp", extra={
    "c": _clean_sql(True),
    "d": f"SELECT *, {_SINCE} AS days_since_listing, least(floor(coalesce(car_age, 0.0) / 2.0), 12)::INT::VARCHAR AS age_bucket FROM c",
    "k": f"SELECT * FROM d WHERE {_SAME} AND price > 0 AND year BETWEEN 1985 AND 2001 AND kms BETWEEN 0 AND 400000",
}))
def pip_clean_leakage_safe(spark, sf):
    out = clean.clean_leakage_safe(V.raw_text(spark, sf), V.REF, min_year=V.MIN_YEAR, unique="row_key")
    return rounded(out.withColumn("fetched_on", _stamp()), _NUM.split())


@query("pip_prepare_rows", sql(f"""SELECT listing_id, {_TS}, {_NAMES.replace(' ', ', ')}, ownership, kms, price, {rs(_NUM)}, row_key FROM c
  WHERE price > 0 AND year BETWEEN 1985 AND 2001 AND kms BETWEEN 0 AND 400000""", "tp", extra={"c": _clean_sql(True)}))
def pip_prepare_rows(spark, sf):
    out = clean.prepare_rows(V.raw_text(spark, sf), V.REF, min_year=V.MIN_YEAR, unique="row_key")
    return rounded(out.withColumn("fetched_on", _stamp()), _NUM.split())


def _two_week_sql() -> str:
    from forecourt.workload.registry import s_norm, s_strip  # noqa: F401

    up = lambda x: "upper(" + s_strip(f"coalesce({x}, 'UNKNOWN')") + ")"
    blank = lambda x: f"coalesce(nullif({s_strip(x)}, ''), 'UNKNOWN')"
    return sql(
        f"""SELECT car_id, strftime(date_posted, '%Y-%m-%d %H:%M:%S') AS date_posted, price, {blank('make')} AS make, {blank('model')} AS model,
        CASE WHEN {blank('variant')} IN (SELECT v FROM top) THEN {blank('variant')} ELSE 'OTHER' END AS variant,
        coalesce(kms_driven, (SELECT median(kms_driven) FROM ok)) AS kms_driven, coalesce(ownership, (SELECT median(ownership) FROM ok)) AS ownership, {blank('city')} AS city,
        coalesce(car_age, (SELECT median(car_age) FROM ok)) AS car_age FROM ok""", "tp", extra={
            "tw": f"""SELECT listing_id AS car_id, fetched_on AS date_posted, price, {up('make0')} AS make, {up('model0')} AS model, {up('variant0')} AS variant, kms AS kms_driven, ownership,
              {up('city0')} AS city, CASE WHEN year IS NOT NULL THEN greatest(coalesce(year(fetched_on), 2001)::DOUBLE - year, 0.0) END AS car_age, row_key FROM tp""",
            "recent": "SELECT * FROM tw WHERE date_posted >= (SELECT max(date_posted) FROM tw) - INTERVAL 700 DAY AND car_id IS NOT NULL",
            "first": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY car_id ORDER BY date_posted NULLS LAST, price NULLS FIRST, make, model, variant, kms_driven NULLS FIRST,
              ownership NULLS FIRST, city, car_age NULLS FIRST) AS rn FROM recent) WHERE rn = 1""",
            "ok": "SELECT * FROM first WHERE price > 0 AND date_posted IS NOT NULL",
            "top": f"SELECT {blank('variant')} AS v FROM ok GROUP BY variant ORDER BY count(*) DESC, variant LIMIT 20",
        })


@query("pip_two_week_baseline", _two_week_sql())
def pip_two_week_baseline(spark, sf):
    out = clean.two_week_baseline(V.raw_text(spark, sf).drop("row_key"), V.REF, days=700)
    return out.withColumn("date_posted", F.date_format("date_posted", "yyyy-MM-dd HH:mm:ss"))


def _runtime_sql() -> str:
    from forecourt.workload.registry import s_gear, s_map, s_state, s_strip  # noqa: F401

    return sql(f"""SELECT row_key, listing_id, make0 AS make, model0 AS model, variant0 AS variant, coalesce({s_map(s_strip('transmission0'), K.TRANSMISSION_CODES)}, transmission0) AS transmission,
      fuel0 AS fuel, body0 AS body_type, city0 AS city, year, kms, ownership, price, {s_state('registration')} AS reg_state FROM tp""", "tp")


@query("pip_runtime_normalize", _runtime_sql())
def pip_runtime_normalize(spark, sf):
    out = clean.runtime_normalize(V.raw_text(spark, sf))
    return out.select("row_key", "listing_id", "make", "model", "variant", "transmission", "fuel", "body_type", "city", "year", "kms", "ownership", "price", "reg_state")


@query("pip_recent_with_targets", sql(f"""SELECT listing_id, {_TS}, price, make, {rs(DYN, 6)} FROM (SELECT *, row_number() OVER (PARTITION BY listing_id ORDER BY fetched_on, price, row_key) AS rn FROM l
  WHERE fetched_on >= (SELECT max(fetched_on) FROM l) - INTERVAL 365 DAY) LEFT JOIN ldyn USING (listing_id) WHERE rn = 1""", "l", "ldyn"))
def pip_recent_with_targets(spark, sf):
    out = clean.recent_with_targets(V.listings(spark, sf), days=365, ties=TIES)
    return rounded(out.select("listing_id", _stamp(), "price", "make", *K.DYNAMICS), K.DYNAMICS, 6)
