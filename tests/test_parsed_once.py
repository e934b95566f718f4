"""Rows parsed once serve every mode, with the same result as the texts."""

import pytest
from pyspark.sql import functions as F

from forecourt.plans import clean
from forecourt.workload import views as V

SF = "/root/testdata/sf0.001"


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("mode", [clean.TRAIN, clean.TRAIN_UNPRICED, clean.PREDICT])
def test_prepared_rows_from_parsed_rows(spark, mode):
    raw = V.raw_text(spark, SF).where(F.col("row_key") < "3")
    parsed = clean.parsed_rows(raw, V.REF, unique="row_key")
    again = clean.prepare_rows(parsed, V.REF, mode, V.MIN_YEAR, unique="row_key", parsed=True)
    want = clean.prepare_rows(raw, V.REF, mode, V.MIN_YEAR, unique="row_key")
    assert again.dtypes == want.dtypes and _rows(again) == _rows(want) and again.count()
    assert "regexp" not in again._jdf.queryExecution().optimizedPlan().toString().lower()


def test_two_week_rows_are_picked_once_and_loaded_rows_serve(spark, monkeypatch):
    raw = V.raw_text(spark, SF).drop("row_key").where("Variant < 'c'")
    kept = []

    def stored(df, name="rows"):
        kept.append(name)
        return df.localCheckpoint()

    monkeypatch.setattr(clean, "stored", stored)
    want = clean.two_week_baseline(raw, V.REF, days=700)
    assert kept == ["loaded", "first"]
    assert "regexp" not in want._jdf.queryExecution().optimizedPlan().toString().lower()
    monkeypatch.setattr(clean, "two_week_load", lambda *a: pytest.fail("texts are parsed again"))
    loaded = spark.createDataFrame(raw.limit(0).collect(), raw.schema)  # not looked at
    got = clean.two_week_baseline(loaded, V.REF, days=700, loaded=_loaded(raw))
    assert _rows(got) == _rows(want) and want.count()


_load = clean.two_week_load


def _loaded(raw):
    return _load(raw, V.REF)
