"""Hand-worked values."""

from pyspark.sql import functions as F

from forecourt.functions import bands, numbers, text
from forecourt.operators.ladders import token_regex
from forecourt.sources.readers import prefer
from forecourt.sources.sinks import predictions_path
from forecourt import trims


def one(spark, values, expr, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in rows.orderBy("i").select(expr(F.col("x"))).collect()]


def test_parse_kms(spark):
    got = one(spark, ["78.42k km", "1.2L km", "45,000", "45,000 km", "2.5", "n/a", None], numbers.parse_kms)
    assert got == [78420.0, 120000.0, 45000.0, 45000000.0, 2.0, None, None]
    assert one(spark, ["45,000 km", "12k km"], lambda c: numbers.parse_kms(c, "strict")) == [45000.0, 12000.0]


def test_owners_years_prices(spark):
    assert one(spark, ["3st owner", "second owner", "unknown", None], numbers.parse_ownership) == [3.0, 2.0, None, None]
    assert one(spark, ["2017", "2,017", "2017.0", "n/a", None], numbers.parse_year) == [2017.0, 2017.0, 2017.0, None, None]
    assert one(spark, ["₹ 5,25,000", "1.2.3", ""], numbers.parse_price) == [525000.0, None, None]
    assert one(spark, ["89,489 km", "78.4k", "2.5lakh", "km 7", "x"], numbers.parse_number_tokens) == [89489.0, 78400.0, 250000.0, 7.0, None]


def test_text(spark):
    assert one(spark, ["KA51**9597", "9KA", None], text.reg_state) == ["KA", "UNK", "UNK"]
    names = one(spark, ["MARUTI SUZUKI SWIFT", "MERCEDES-BENZ C-CLASS", "land rover", None, "  "], text.split_name)
    assert [tuple(n) for n in names] == [
        ("Maruti Suzuki", "Swift"), ("Mercedes-Benz", "C-Class"), ("Land Rover", "Unknown"), ("Unknown", "Unknown"), ("Unknown", "Unknown"),
    ]
    assert one(spark, ["Petrol/CNG", None], text.fuel) == ["PETROL+CNG", "UNKNOWN"]
    assert one(spark, ["pickup  truck", "Limo"], text.body_type) == ["Pickup", "Limo"]


def test_bands(spark):
    assert one(spark, [500000.0, 500000.01, None], bands.price_segment, "double") == ["<=5L", "5-10L", "<=5L"]
    assert one(spark, [0.0, 1.9, 2.0, 40.0, None], bands.age_bucket, "double") == ["0", "0", "1", "12", "0"]
    assert one(spark, [0.0, 1.0, 4.5, -1.0], bands.owner_band, "double") == ["1", "1", "5+", None]


def test_trim_tables():
    ladders = trims.LADDERS
    assert len(ladders["brand"]) == 12 and len(ladders["model"]) == 37
    assert {t: len(v) for t, v in trims.TOKEN_TIERS.items()} == {5: 44, 4: 26, 2: 8, 1: 10}
    assert token_regex("ZXI+") == r"\bZXI\+(?!\w)" and token_regex("SX O") == r"\bSX\s+O\b"


def test_file_rules():
    assert prefer(["a/x.csv", "a/x.parquet", "a/y.csv", "a/z.txt"]) == ["a/x.parquet", "a/y.csv"]
    assert predictions_path("in/cars.csv") == "in/cars_predictions.csv" and predictions_path("in/cars") == "in/cars_predictions.csv"
