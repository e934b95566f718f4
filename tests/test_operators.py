"""Small frames worked out by hand or by brute force."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from forecourt import trims
from forecourt.operators import calibrate, demand, dynamics, encodings, filters, folds, ladders, metrics, quantiles, skew, snapshots
from forecourt.sources import readers, sinks

DAY = dt.datetime(2024, 1, 1, 9)


def history(spark, prices, days, key="a"):
    rows = [(key, DAY + dt.timedelta(days=d), float(p)) for p, d in zip(prices, days)]
    return spark.createDataFrame(rows, "listing_id string, fetched_on timestamp_ntz, price double")


def test_listing_dynamics_example(spark):
    row = dynamics.listing_dynamics(history(spark, [500000, 490000, 470000, 450000], [0, 3, 10, 40])).first()
    want = {
        "avg_drop_7d": 0.0028860952, "avg_drop_30d": 0.0020625092, "price_drop_rate": 0.0026340073, "time_to_first_drop": 3,
        "time_to_sell": 40, "price_volatility": 0.0404790559, "liquidity_score": 44.6697618291,
    }
    for name, value in want.items():
        assert row[name] == pytest.approx(value, abs=1e-8), name


def test_dynamics_skips_zero_first_price_and_blank_ids(spark):
    rows = history(spark, [0, 5], [0, 1]).unionByName(history(spark, [5, 4], [0, 1], " ")).unionByName(history(spark, [5, 4], [0, 1], " b "))
    assert [r.listing_id for r in dynamics.listing_dynamics(rows).collect()] == ["b"]


def test_quantiles_match_numpy_with_skew_and_signs(spark):
    rng = random.Random(3)
    data = [("hot", rng.choice([-2.5, 0.0, 1.0, 7.25])) for _ in range(3000)] + [("cold", rng.uniform(-50, 900)) for _ in range(501)]
    data += [(None, 4.0), ("hot", None), ("one", 3.5)]
    df = spark.createDataFrame(data, "k string, v double").repartition(7)
    got = {r.k: r for r in quantiles.quantiles(df, ["k"], "v", {"a": 0.0, "b": 0.37, "c": 0.5, "d": 1.0}).collect()}
    for key in ("hot", "cold", "one", None):
        values = [v for k, v in data if k == key and v is not None]
        assert got[key].n == len(values)
        for name, p in zip("abcd", (0.0, 0.37, 0.5, 1.0)):
            assert got[key][name] == pytest.approx(np.quantile(values, p), abs=1e-12)


def test_holdout_medians_match_brute_force(spark):
    rng = random.Random(5)
    data = [(rng.choice("xyz"), rng.randrange(3), float(rng.randrange(40))) for _ in range(400)]
    df = spark.createDataFrame(data, "k string, fold int, v double")
    got = {(r.k, r.hold): r["median"] for r in quantiles.medians(df, ["k"], "v", holdout=("fold", 3)).collect()}
    for k in "xyz":
        for j in range(3):
            assert got[(k, j)] == np.median([v for kk, f, v in data if kk == k and f != j])


def test_attach_splits_hot_and_null_keys(spark):
    data = [("hot", i) for i in range(500)] + [("b", 1), ("c", 2), (None, 3), ("lost", 4)]
    df = spark.createDataFrame(data, "k string, i int").repartition(5)
    stats = skew.group_rows(df.where("k <> 'lost'"), ["k"], F.max("i").alias("top"))
    out = skew.attach(df, stats, ["k"], hot_rows=100)
    got = {(r.k, r.top) for r in out.collect()}
    assert out.count() == len(data)
    assert got == {("hot", 499), ("b", 1), ("c", 2), (None, None), ("lost", None)}


def test_identity_and_null_ids(spark):
    rows = [("a", 1.0, "P", "M"), ("a", 1.0, None, "M"), ("b", 1.0, "P", "M"), ("b", 2.0, "P", "M"), (None, 1.0, "P", "M")]
    df = spark.createDataFrame(rows, "listing_id string, year double, fuel string, transmission string")
    assert filters.identity_consistent(df).count() == 2
    assert filters.identity_consistent(df, null_id="keep").count() == 3


def test_first_snapshot_is_stable_under_repartition(spark):
    rows = [("a", DAY, 2), ("a", DAY, 1), ("a", None, 0), (" a ", DAY + dt.timedelta(days=1), 9), ("", DAY, 5), (None, None, 6)]
    df = spark.createDataFrame(rows, "listing_id string, fetched_on timestamp_ntz, n int")
    for parts in (1, 7):
        got = sorted((r.listing_id or "", r.n) for r in snapshots.first_snapshot(df.repartition(parts), ties=["n"]).collect())
        assert got == [("", 5), ("", 6), ("a", 1)]


def test_empty_inputs(spark):
    empty = history(spark, [], [])
    assert dynamics.listing_dynamics(empty).count() == 0
    assert filters.price_trim(empty).count() == 0
    assert metrics.regression_metrics(empty.withColumn("prediction", F.col("price"))).first()["rows"] == 0
    assert snapshots.first_snapshot(empty).count() == 0


def test_metrics_example(spark):
    df = spark.createDataFrame([(4e5, 4.4e5), (8e5, 7.6e5), (15e5, 15e5), (0.0, 1.0), (None, 2.0)], "price double, prediction double")
    m = metrics.regression_metrics(df).first()
    assert m["rows"] == 3 and m["mape"] == pytest.approx(5.0) and m["mpe"] == pytest.approx(1.666667, abs=1e-5)
    assert m["mae"] == pytest.approx(26666.6667, abs=1e-3) and m["median_ae"] == 40000.0
    assert m["rmse"] == pytest.approx(32659.8632, abs=1e-3) and m["r2"] == pytest.approx(0.994839, abs=1e-6)


def test_folds_are_disjoint_and_samples_exact(spark):
    df = spark.range(300).select(F.col("id").cast("string").alias("listing_id"), (F.col("id") + 1.0).alias("price"))
    assert folds.sample_n(df, "listing_id", 37).count() == 37
    twice = df.unionByName(df)
    assert folds.group_fold(twice).groupBy("listing_id").agg(F.countDistinct("fold").alias("n")).where("n > 1").count() == 0
    sizes = {r.split: r["count"] for r in folds.stratified_split(df, "listing_id").groupBy("split").count().collect()}
    assert sum(sizes.values()) == 300 and sizes["train"] == sum(folds.expected_sizes(60, (0.7, 0.15, 0.15))[0] for _ in range(5))
    assert folds.usable_folds(df.limit(1)) == 0


def test_oof_encoding_ignores_own_fold(spark):
    rows = [("m1", "v", 0, 1.0), ("m1", "v", 1, 3.0), ("m2", "w", 1, 5.0)]
    df = spark.createDataFrame(rows, "model string, variant string, fold int, y double")
    out = {(r.model, r.fold): r for r in encodings.oof_target_encoding(df, F.col("y"), k=2, smoothing=0.0).collect()}
    assert out[("m1", 0)].model_te == 3.0 and out[("m1", 1)].model_te == 1.0
    assert out[("m2", 1)].model_te == 1.0  # unseen outside its fold: the other folds' mean


def test_demand_composite_example(spark):
    rows = [
        (0, "model", "", "Creta", "Hyundai", "", "", "0.95", ""), (1, "city", "", "Bengaluru", "", "", "", "0.90", ""),
        (2, "bodytype", "", "SUV", "", "", "", "0.90", ""), (3, "fuel", "", "Petrol", "", "", "", "0.85", ""),
        (4, "transmission", "", "Automatic", "", "", "", "0.80", ""), (5, "age_bucket", "", "", "", "0", "4", "1.00", ""),
        (6, "kms_year_bucket", "", "", "", "0", "20000", "1.00", ""), (7, "ownership_bucket", "", "", "", "1", "2", "1.00", ""),
        (8, "", "", "", "", "", "", "", ""),
    ]
    raw = spark.createDataFrame(rows, "position long, type string, scope string, name string, parent string, min string, max string, multiplier string, notes string")
    car = spark.createDataFrame(
        [("hyundai", " CRETA ", "SX", "Bengaluru", "SUV", "Petrol", "Automatic", 3.0, 12000.0, 1.0), ("X", "Y", None, "Z", "Q", "W", "V", 500.0, 1e9, 0.0)],
        "make string, model string, variant string, city string, body_type string, fuel string, transmission string, car_age double, kms_per_year double, ownership double",
    )
    out = {r.make: r for r in demand.demand_adjust(car, demand.multiplier_table(raw)).collect()}
    assert out["hyundai"].composite == pytest.approx(0.9392370, abs=1e-6) and len(out["hyundai"].breakdown) == 8
    assert out["X"].composite == 1.0 and out["X"].breakdown == []


def test_trim_ladder_examples(spark):
    rows = [
        ("Hyundai | Creta", "SX (O)", 1.07), ("Maruti Suzuki | Swift", "VXI", 1.00), ("Maruti Suzuki | Swift", "LXI", 0.97),
        ("Maruti Suzuki | Swift", "ZXI+", 1.07), ("Nobody | Thing", "plain", 1.00), ("Tata | Nexon", "XZ base", 0.94),
    ]
    df = spark.createDataFrame(rows, "parent string, name string, want double")
    out = ladders.variant_multipliers(df, ladders.default_rules(spark), trims.TOKEN_TIERS)
    assert all(r.multiplier == r.want for r in out.collect())


def test_calibration_never_worse_than_identity(spark):
    rng = random.Random(1)
    rows = [(p := rng.uniform(1e5, 1e6), p * (1.3 if i % 2 else 0.8), "s" + str(i % 2)) for i in range(200)]
    df = spark.createDataFrame(rows, "price double, prediction double, segment string")
    factors = calibrate.segment_factors(df)
    scores = {r.candidate: r for r in calibrate.candidate_scores(df, factors, calibrate.linear_step(df, factors)).collect()}
    best = [r for r in scores.values() if r.chosen]
    assert len(best) == 1 and best[0].objective <= scores["identity"].objective
    fitted = calibrate.fit_calibration(df).apply(df)
    assert metrics.regression_metrics(fitted, pred="calibrated").first()["mape"] < 1.0


def test_sources_round_trip(spark, tmp_path):
    a = spark.createDataFrame([("1", "x, y"), ("2", 'q"r')], "ID string, City string")
    a.coalesce(1).write.option("header", True).option("escape", '"').csv(str(tmp_path / "t"))
    part = next((tmp_path / "t").glob("part-*.csv"))
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "normalized_table.csv").write_bytes(part.read_bytes())
    (folder / "normalized_table_2.csv").write_text("ID,Make\n7,M\n")
    (folder / "ignored.csv").write_text("ID\n1\n")
    out = readers.read_sources(spark, str(folder))
    got = sorted((r.ID, r.City, r.Make, r.source) for r in out.collect())
    assert got == [("1", "x, y", None, "normalized_table"), ("2", 'q"r', None, "normalized_table"), ("7", None, "M", "normalized_table_2")]
    with pytest.raises(FileNotFoundError):
        readers.read_partition(spark, str(folder), "absent")
    path = sinks.write_table(a, str(tmp_path / "o.csv"))
    assert sorted(map(tuple, readers.read_table(spark, path).collect())) == [("1", "x, y"), ("2", 'q"r')]


def test_crowded_quantile_bucket_is_refined(spark):
    """A million distinct values within one percent: exact, and no window task holds a hundredth of them."""
    n = 1_000_000
    df = spark.range(n).select(F.expr(f"100D + ((id * 7919) % {n}) / {n}D").alias("v"), (F.col("id") % 3).alias("fold"))
    got = quantiles.quantiles(df, [], "v", {"a": 0.1, "b": 0.5}).first()
    want = np.quantile(100.0 + np.arange(n) / n, [0.1, 0.5])
    assert (got.n, got.a, got.b) == (n, pytest.approx(want[0], abs=1e-12), pytest.approx(want[1], abs=1e-12))
    coded = df.selectExpr("v AS __v").selectExpr(f"{quantiles._code(quantiles.COARSE)} AS b", f"{quantiles._code(quantiles.COARSE * quantiles.FINER)} AS d")
    finer = coded.groupBy("b", "d").count()
    assert finer.agg(F.max("count")).first()[0] < n / 100
    assert finer.groupBy("b").count().agg(F.max("count")).first()[0] <= quantiles.FINER


def test_finer_codes_nest_and_keep_the_order(spark):
    values = sorted([0.0, -0.0, 5e-324, -5e-324, 1.7e308, -1.7e308, 1.0, 0.9999999999999999, 1.0000000000000002, -3.5, 64.0] + [random.Random(2).uniform(-9, 9) for _ in range(200)])
    rows = spark.createDataFrame([(v,) for v in values], "__v double").selectExpr("__v", f"{quantiles._code(quantiles.COARSE)} AS b", f"{quantiles._code(quantiles.COARSE * quantiles.FINER)} AS d").orderBy("__v").collect()
    assert all(x.d <= y.d and x.b <= y.b for x, y in zip(rows, rows[1:]))
    by_fine = {}
    assert all(by_fine.setdefault(r.d, r.b) == r.b for r in rows)
