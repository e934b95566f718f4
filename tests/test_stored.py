"""Texts are parsed once a row, and features of stored rows come from methods that the JVM compiles."""

import re
from statistics import median

from pyspark.sql import functions as F

from forecourt.operators import calibrate, encodings, schema, segments
from forecourt.plans import clean
from forecourt.session import stored
from forecourt.workload import views as V

SF = "/root/testdata/sf0.001"
LARGEST = 8000  # bytes: longer methods are interpreted


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def _sizes(spark, df):
    before = {c: spark.conf.get(c) for c in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # generated code is only listed without it
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")
    try:
        code = spark._jvm.PythonSQLUtils.explainString(df.select("*")._jdf.queryExecution(), "codegen")
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    return [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", code)]


def test_cleaning_parses_texts_once(spark):
    raw = V.raw_text(spark, SF)
    for rows in (clean.load_and_clean(raw, V.REF, V.MIN_YEAR), clean.clean_leakage_safe(raw, V.REF, min_year=V.MIN_YEAR, unique="row_key")):
        assert "regexp" not in _plan(rows) and "l_partkey" not in _plan(rows)


def test_features_come_from_small_methods(spark):
    rows = stored(clean.load_and_clean(V.raw_text(spark, SF), V.REF, V.MIN_YEAR))
    numeric = ["year", "kms", "car_age", "kms_per_year", "ownership", "log_kms", "age_x_ownership", "kms_x_ownership", "fetch_month", "market_days", "days_on_market"]
    categorical = ["make", "transmission", "fuel", "body_type", "city", "reg_state"]
    encoder = encodings.fit_target_encoder(rows, F.log1p("price"))
    encoder = encodings.TargetEncoder(*[stored(t) for t in (encoder.top_variants, encoder.model_means, encoder.variant_means, encoder.overall)])
    encoded = encoder.apply(rows)
    for casefold in (False, True):
        fitted = schema.fit_schema(rows, numeric, categorical, casefold=casefold)
        shaped = fitted.apply(encoded, keep=encoded.columns, prefix="a_")
        again = fitted.apply(shaped, keep=shaped.columns, prefix="b_")
        sizes = _sizes(spark, again)
        assert sizes and max(sizes) < LARGEST
        assert again.count() == rows.count()
        assert again.where(" OR ".join(f"NOT a_{c} <=> b_{c}" for c in (*numeric, *categorical))).isEmpty()
        assert again.where("NOT a_make <=> make").isEmpty()


def test_stored_rows_are_the_rows(spark):
    df = spark.createDataFrame([(1, "a", None), (None, None, None)], "i int, `s p` string, v void")
    for rows in (df, df.drop("v")):
        assert sorted(map(str, stored(rows).collect())) == sorted(map(str, rows.collect()))
    assert "spark_partition" not in _plan(stored(df.drop("v"))) and "relation" in _plan(stored(df.drop("v"))).lower()


def test_segment_factors_do_not_ship_ratios(spark):
    rows = spark.range(6000).select(
        (F.col("id") + 1.0).alias("price"), F.lit(3000.0).alias("prediction"),
        F.when(F.col("id") % 600 == 0, "few").when(F.col("id") % 2 == 0, "even").alias("segment"),
    )
    found = calibrate.segment_factors(rows)
    assert "ratio" not in _plan(found)  # the table of medians is small and known
    ratio = lambda keep: median((i + 1.0) / 3000.0 for i in range(6000) if keep(i))
    clipped = lambda v: min(max(v, 0.4), 1.6)
    wanted = {
        ("segment", "few", 10): clipped(ratio(lambda i: True)), ("global", "*", 6000): clipped(ratio(lambda i: True)),
        ("segment", "even", 2990): clipped(ratio(lambda i: i % 2 == 0 and i % 600)), ("segment", "Unknown", 3000): clipped(ratio(lambda i: i % 2)),
    }
    got = {(r["scope"], r["segment"], r["n"]): r["factor"] for r in found.collect()}
    assert got.keys() == wanted.keys() and all(abs(got[k] - wanted[k]) < 1e-12 for k in wanted)


def test_worst_segments_look_medians_up_for_listed_segments_only(spark):
    detail = spark.range(4000).select(
        F.format_string("m%02d", F.col("id") % 40).alias("make"), F.lit(None).cast("string").alias("fuel"),
        (F.col("id") + 1.0).alias("actual_price"), (F.lit(2.0) * (F.col("id") + 1.0) + F.col("id") % 40).alias("predicted_price"),
    )
    found = segments.worst_segments(detail, {"make": (3, 30), "fuel": (10, 20)})
    plan = _plan(found)
    assert "explode" in plan and "LeftSemi" in plan  # only the medians still read the rows
    got = {(r["segment_type"], r["segment_value"]): (r["rows"], r["median_actual"]) for r in found.collect()}
    assert len(got) == 4 and got.pop(("fuel", None)) == (4000, None)
    for (_, make), facts in got.items():
        assert facts == (100, median(i + 1.0 for i in range(4000) if f"m{i % 40:02d}" == make))
