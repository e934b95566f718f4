"""Order statistics and market features whose rows are not copied."""

import math
import random

import pytest
from pyspark.sql import functions as F

from forecourt.operators import encodings, folds, lookups, quantiles


@pytest.mark.parametrize("gather", [0, 20, 10**6])
def test_small_and_large_groups_have_the_same_quantiles(spark, gather):
    rng = random.Random(5)
    data = [(rng.choice(["a", "b", None]), rng.choice([-3.0, 0.0, 2.5, rng.uniform(-9, 900)]), j % 3) for j in range(600)] + [("one", 4.0, 1)]
    df = spark.createDataFrame(data, "k string, v double, fold int").repartition(5)
    held = df.withColumns({f"h{j}": (F.col("fold") != j).cast("int") for j in range(3)}).withColumn("twice", F.lit(2))
    by_fold = quantiles.medians(df, ["k"], "v", holdout=("fold", 3), gather=gather).collect()
    by_column = quantiles.medians(held, ["k"], "v", held=["h0", "h1", "h2"], weight="twice", gather=gather).collect()
    assert {(r.k, r.hold, 2 * r.n, r.median) for r in by_fold} == {(r.k, r.hold, r.n, r.median) for r in by_column}
    for r in by_fold:
        values = sorted(v for k, v, f in data if k == r.k and f != r.hold)
        assert r.n == len(values) and r.median == (values[(r.n - 1) // 2] + values[r.n // 2]) / 2
    assert {(r.k, r.hold) for r in by_fold} == {(k, j) for k in ("a", "b", None) for j in range(3)} | {("one", 0), ("one", 2)}


def test_market_rows_out_of_fold_are_not_copied_to_folds(spark):
    """A variant frequent in all folds is one row; one at the edge is two, each counting in its own folds."""
    data = [("v0", 0), ("v0", 1), ("v0", 2), ("v1", 0), ("v1", 0), ("v2", 1), ("v2", 2), (" ", 2), ("rare", 1)]
    df = spark.createDataFrame([(i, v, f) for i, (v, f) in enumerate(data)], "id int, variant string, __own int")
    top = spark.createDataFrame([(0, "v0"), (0, "v2"), (1, "v0"), (1, "v1"), (2, "v0"), (2, "v1")], "fold int, variant string")
    got = lookups._held_frame(df, top, "fold", 3).collect()
    want = set()
    for i, (v, own) in enumerate(data):
        for j in range(3):
            if j != own:
                named = (j, v) in {(0, "v0"), (0, "v2"), (1, "v0"), (1, "v1"), (2, "v0"), (2, "v1")}
                want.add((i, "Unknown" if v == " " else v if named else "other", j))
    assert {(r.id, r.variant_grouped, j) for r in got for j in range(3) if r[f"__h{j}"]} == want
    assert len(got) == len({(i, name) for i, name, _ in want})


def test_market_out_of_fold_equals_a_fit_without_the_fold(spark):
    rng = random.Random(9)
    rows = [
        (str(i), rng.choice(["m", "n"]), rng.choice(["x", "y"]), rng.choice(["v0", "v1", "v2", "v3", None]), rng.choice(["c", "d"]),
         float(rng.randrange(9)), float(rng.randrange(1, 40)), *[rng.random() for _ in lookups.TARGETS])
        for i in range(240)
    ]
    names = "listing_id string, make string, model string, variant string, city string, car_age double, price double"
    df = spark.createDataFrame(rows, names + "".join(f", {t} double" for t in lookups.TARGETS))
    df = folds.group_fold(df, k=3).localCheckpoint()
    got = {r.listing_id: r for r in lookups.oof_market_features(df, 3, n_variants=2).collect()}
    assert len(got) == 240
    for j in range(3):
        fitted = lookups.fit_market_history(df.where(F.col("fold") != j), n_variants=2)
        for r in fitted.apply(df.where(F.col("fold") == j)).collect():
            for c in lookups.K.MARKET_FEATURES:
                assert math.isclose(r[c], got[r.listing_id][c], rel_tol=1e-9, abs_tol=1e-9), (r.listing_id, c)


def test_encoding_and_anchors_read_a_long_plan_once(spark):
    """What is found for keys is a table of its own, so that steps in a row do not multiply each other's plans."""
    rows = [(str(i), "m", f"n{i % 3}", f"v{i % 4}", "c", float(10 + i % 7)) for i in range(90)]
    df = folds.group_fold(spark.createDataFrame(rows, "listing_id string, make string, model string, variant string, city string, price double"), k=3)
    df = df.localCheckpoint()
    encoded = encodings.oof_target_encoding(df, F.log("price"), 3)
    both = lookups.oof_price_anchor(encoded, 3, source=df)
    assert both._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") <= 6
    plain = lookups.oof_price_anchor(df, 3).select("listing_id", "price_anchor").collect()
    assert {tuple(r) for r in both.select("listing_id", "price_anchor").collect()} == {tuple(r) for r in plain}
