"""Steps that do not need each other run at once over few rows, and one after another over many."""

import threading

import pytest
from pyspark.sql import functions as F

from forecourt.operators import models as M
from forecourt.session import together


def test_folds_of_few_rows_are_fitted_at_once(spark):
    df = spark.range(30).withColumn("fold", (F.col("id") % 3).cast("int")).localCheckpoint()
    met = threading.Barrier(3, timeout=60)

    def fit(part):
        met.wait()
        total = part.agg(F.sum("id")).first()[0]
        return lambda rows: rows.withColumn("total", F.lit(total))

    got = {(r.id, r.total) for r in M.out_of_fold(df, 3, fit).collect()}
    assert got == {(i, sum(j for j in range(30) if j % 3 != i % 3)) for i in range(30)}


def test_many_rows_take_turns_and_failures_are_raised(spark):
    df, here = spark.range(10).localCheckpoint(), threading.current_thread()
    assert together(df, [threading.current_thread] * 3, most=9) == [here] * 3
    assert here not in together(df, [threading.current_thread] * 3, most=10)
    assert together(df, [lambda i=i: i for i in range(5)]) == list(range(5)) and together(df, []) == []
    with pytest.raises(ZeroDivisionError):
        together(df, [lambda: 1 / 0, lambda: 2])
