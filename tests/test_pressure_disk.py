"""The pressure query: snapshots travel once for the components, and rows that several folds read are compact tables."""

from forecourt.operators import dynamics
from forecourt.workload import catalogue, q_models, views as V

SF = "/root/testdata/sf0.001"


def test_components_are_worked_out_once(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(V, "stored", lambda df, name="rows": kept.append(name) or df.localCheckpoint())
    base = V.market_base(spark, SF, q_models.PRESSURE_COLUMNS)
    scored = dynamics.pressure_score(dynamics.pressure_components(V.listings(spark, SF), ties=["price", "row_key"]))
    got = {r.listing_id: r.pressure_score for r in base.collect()}
    assert kept == ["components"] and got == {r.listing_id: r.pressure_score for r in scored.collect()} | {k: None for k, v in got.items() if v is None}


def test_rows_of_the_folds_are_no_checkpoint(spark, monkeypatch):
    names = []
    plain = q_models.stored
    monkeypatch.setattr(q_models, "stored", lambda df, *a: names.append(df.columns) or plain(df, *a))
    monkeypatch.setattr(q_models.M, "out_of_fold", lambda rows, k, fit: rows.withColumn("pressure_score", rows["price"] * 0))
    assert catalogue.queries()["mdl_pressure"](spark, SF).count() and len(names) == 1 and "fold" in names[0]
