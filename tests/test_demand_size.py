"""The multiplier table's own size decides how it is joined, not that of what it was made from."""

from pyspark.sql import functions as F

from forecourt.operators import demand


def test_rows_do_not_travel_to_a_small_table_made_from_a_large_one(spark):
    made = spark.range(4_000_000).groupBy((F.col("id") % 3).alias("position")).agg(F.count(F.lit(1)).alias("n")).select(
        "position", F.lit("brand").alias("type"), F.lit("").alias("scope"), F.concat(F.lit("b"), "position").alias("name"),
        *[F.lit("").alias(c) for c in ("parent", "min", "max")], F.lit("0.9").alias("multiplier"), F.lit("").alias("notes"),
    )
    columns = ["make", "model", "variant", "city", "body_type", "fuel", "transmission"]
    rows = spark.range(4_000_000).select(
        "id", F.concat(F.lit("b"), F.col("id") % 4).alias("make"), *[F.concat(F.lit("x"), F.col("id") % 2).alias(c) for c in columns[1:]],
        *[F.lit(1.0).alias(c) for c in ("car_age", "kms_per_year", "ownership")],
    )
    out = demand.demand_adjust(rows, demand.multiplier_table(made))
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") >= 8
    assert sorted((r["make"], r["composite"]) for r in out.where("id < 4").select("make", F.round("composite", 6).alias("composite")).collect()) == [("b0", 0.9), ("b1", 0.9), ("b2", 0.9), ("b3", 1.0)]
