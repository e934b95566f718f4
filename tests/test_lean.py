"""Picking rows and days ships no more columns than the result needs."""

from pyspark.sql import functions as F

from forecourt.operators import dynamics, snapshots
from forecourt.workload import views as V
from forecourt.workload.catalogue import queries

SF = "/root/testdata/sf0.001"
TIES = ["price", "row_key"]


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def _same(a, b):
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_samples_pick_listings_by_id_time_and_price(spark):
    plan = _plan(queries()["spl_sample_n"](spark, SF))
    assert "AS variant" not in plan and "concat_ws" not in plan


def test_lean_first_listings_are_those_of_whole_rows(spark):
    whole = snapshots.first_snapshot(V.listing_features(spark, SF), ties=TIES)
    assert _same(V.first_listings(spark, SF), whole)
    assert _same(V.first_listings(spark, SF, ["listing_id", "price"]).select("listing_id", "price"), whole.select("listing_id", "price"))
    lean = V.first_listings(spark, SF, V.MARKET_COLUMNS)
    assert _same(lean, whole.select(*lean.columns))


def test_ties_after_the_price_do_not_travel(spark):
    rows = V.listings(spark, SF)
    assert "concat_ws" not in _plan(dynamics.listing_dynamics(rows, ties=TIES))
    stamps = [("a", "2024-01-01 10:00:00", p, k) for p, k in ((5.0, "z"), (7.0, "a"), (6.0, "m"))] + [("a", "2024-01-09 10:00:00", 6.0, "q")]
    df = spark.createDataFrame(stamps, "listing_id string, fetched_on string, price double, row_key string").withColumn("fetched_on", F.col("fetched_on").cast("timestamp_ntz"))
    found = dynamics.pressure_components(df, ties=TIES).first()
    assert abs(found["avg_drop_30d_raw"] * 30 - 0.15415067982725827) < 1e-12  # ln(7 / 6): the day's highest price counts
