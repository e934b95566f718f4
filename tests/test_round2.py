"""Sources as directories, every level kept, blank IDs, price column choice, report tables, saved bundles' features."""

import pytest
from pyspark.sql import functions as F

from forecourt import session
from forecourt.functions import text
from forecourt.operators import columns, models as M, snapshots
from forecourt.plans import bundles
from forecourt.sources import readers, sinks


def test_directories_and_files_are_sources(spark, tmp_path):
    folder = f"{tmp_path}/in"
    spark.range(5).select(F.col("id").cast("string").alias("ID")).repartition(3).write.parquet(f"{folder}/normalized_table.parquet")
    (tmp_path / "in" / "normalized_table_2.csv").write_text("ID,Make\n7,M\n")
    spark.range(2).write.option("header", True).csv(f"{folder}/normalized_table.csv")  # the Parquet one is preferred
    rows = readers.read_sources(spark, folder)
    assert sorted((r.source, r.ID) for r in rows.collect()) == [("normalized_table", str(i)) for i in range(5)] + [("normalized_table_2", "7")]
    assert readers.read_partition(spark, folder, "normalized_table").count() == 5


def test_shared_folder_is_named_by_the_cluster(spark, monkeypatch):
    class Context:
        master = "yarn"
        getConf = lambda self: {}
        getCheckpointDir = lambda self: None

    class Session:
        conf, sparkContext = {}, Context()

    with pytest.raises(RuntimeError):
        session.shared_dir(Session())
    Session.conf = {session.CHECKPOINT: "hdfs:///x"}
    assert session.shared_dir(Session()) == "hdfs:///x"


def test_every_level_stays_apart(spark):
    rows = spark.range(900).select((F.col("id") % 300).cast("string").alias("city"), F.col("id").cast("double").alias("kms"))
    features = M.fit_features(rows, ["kms"], ["city"], casefold=True)
    assert features.bins >= 301
    out = features.transform(rows).select("city", f"{M.PREFIX}city_ix").distinct()
    assert out.count() == 300 and out.select(f"{M.PREFIX}city_ix").distinct().count() == 300


def test_equal_rows_without_id_are_two_listings(spark):
    rows = spark.createDataFrame([(" ", 1.0)] * 2 + [("a ", 2.0), ("a", 3.0), (None, 4.0)], "listing_id string, price double").withColumn("fetched_on", F.lit("2024-01-01").cast("timestamp"))
    assert snapshots.with_listing_id(rows).select("listing_id").distinct().count() == 4
    first = snapshots.first_snapshot(rows, ties=["price"])
    assert sorted((r.listing_id or "", r.price) for r in first.collect()) == [("", 4.0), (" ", 1.0), (" ", 1.0), ("a", 2.0)]
    assert first.columns == rows.columns
    assert "Union" not in first._jdf.queryExecution().optimizedPlan().toString()


def test_white_space(spark):
    values = ["", " ", "a", " a\t\nb  c ", "\x0b\x0cx\r", "a b", None, "a  b"]
    rows = spark.createDataFrame(list(enumerate(values)), "i int, x string").orderBy("i")
    got = [tuple(r) for r in rows.select(text.squeeze(F.col("x")), text.strip(F.col("x"))).collect()]
    want = [tuple(r) for r in rows.select(F.trim(F.regexp_replace("x", r"\s+", " ")), F.regexp_replace("x", r"^\s+|\s+$", "")).collect()]
    assert got == want


@pytest.mark.parametrize("seven", [1, 7])
def test_first_snapshot_does_not_depend_on_partitions(spark, seven):
    rows = spark.createDataFrame([(f"l{i % 5}", float(i % 7), i) for i in range(70)], "listing_id string, price double, n int")
    rows = rows.withColumn("fetched_on", F.lit("2024-01-01").cast("timestamp")).repartition(seven)
    got = sorted(tuple(r) for r in snapshots.first_snapshot(rows, ties=["price", "n"]).select("listing_id", "price", "n").collect())
    assert got == [("l0", 0.0, 0), ("l1", 0.0, 21), ("l2", 0.0, 7), ("l3", 0.0, 28), ("l4", 0.0, 14)]


def test_price_column_choice(spark):
    one = spark.createDataFrame([(1, 2, 3)], ["Price (â‚¹)", "Price (₹)", "ID"])
    assert columns.drop_extra_prices(one).columns == ["Price (₹)", "ID"]
    assert columns.drop_extra_prices(one.drop("Price (₹)")).columns == ["Price (â‚¹)", "ID"]
    assert columns.drop_extra_prices(one.select("ID")).columns == ["ID"]


def test_report_tables_are_written(spark, tmp_path):
    paths = sinks.write_reports({"folds": spark.range(3), "importance": spark.range(2)}, str(tmp_path), "x_")
    assert [readers.read_table(spark, p).count() for p in paths] == [3, 2]
    assert [p.rsplit("/", 1)[-1] for p in paths] == ["x_folds.csv", "x_importance.csv"]


def test_primary_bundle_predicts_as_before(spark, tmp_path):
    rows = spark.range(400).select((F.col("id") % 20).cast("string").alias("city"), (F.col("id") % 50).cast("double").alias("kms"))
    rows = rows.withColumn("price", 1000.0 + 50 * F.col("kms"))
    model = M.fit_price_model(rows, ["kms"], ["city"], params=M.TreeParams(max_iter=5, max_depth=3))
    pack = bundles._Pack()
    pack.price_model("m", model)
    pack.save(spark, str(tmp_path), "test")
    loaded = bundles._Unpack(spark, str(tmp_path), "test").price_model("m")
    before = model.predict(rows.withColumn("city", F.concat("city", F.lit("")))).agg(F.sum("prediction")).first()[0]
    assert loaded.predict(rows).agg(F.sum("prediction")).first()[0] == pytest.approx(before, rel=1e-12)
    with pytest.raises(ValueError):
        bundles._Unpack(spark, str(tmp_path), "other")
