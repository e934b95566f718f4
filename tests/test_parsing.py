"""Parsing raw text: one evaluation a row, in methods that the JVM compiles."""

import re

from pyspark.sql import functions as F

from forecourt.functions import text
from forecourt.plans import clean
from forecourt.workload import views as V

SF = "/root/testdata/sf0.001"
LARGEST = 8000  # bytes: longer methods are interpreted


def test_prepared_rows_come_from_small_methods(spark):
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # generated code is only listed without it
    try:
        rows = clean.prepare_rows(V.raw_text(spark, SF), V.REF, min_year=V.MIN_YEAR, unique="row_key")
        code = spark._jvm.PythonSQLUtils.explainString(rows._jdf.queryExecution(), "codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", code)]
    assert sizes and max(sizes) < LARGEST


def test_raw_text_is_that_of_its_columns(spark):
    plain = V._joined(spark, SF).select(*[F.expr(e).alias(c) for c, e in V.T_COLUMNS.items()])
    assert V.raw_text(spark, SF, headers=False).exceptAll(plain).isEmpty()
    assert plain.exceptAll(V.raw_text(spark, SF, headers=False)).isEmpty()


def test_short_ways_give_what_the_long_ones_do(spark):
    names = ["BRAND#12 SMALL", "MERCEDES-BENZ C-CLASS", "3SERIES 12AB", "a\tb c", "ÉCLAIR ÅB", "BⒶⒶ X", "O'NEIL  X", "", " ", "x  y", "İI", "LAND ROVERX", "MINI COOPER S", " A B", None]
    df = spark.createDataFrame([(n,) for n in names], "t string")
    runs = F.transform(F.regexp_extract_all("t", F.lit(r"(\p{L}+|\P{L}+)"), 1), F.initcap)
    spaces = F.translate("t", text.WHITE, " " * len(text.WHITE))
    rows = df.select(
        "t", text.title_case(F.col("t")).alias("a"), F.array_join(runs, "").alias("b"),
        text.squeeze(F.col("t")).alias("c"), F.trim(F.regexp_replace(spaces, " +", " ")).alias("d"),
    ).collect()
    assert [(r.t, r.a, r.c) for r in rows] == [(r.t, r.b, r.d) for r in rows]
