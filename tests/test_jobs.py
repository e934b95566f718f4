"""The whole jobs' queries against their SQL, on the smallest tables: among others, bundles survive saving and loading."""

import duckdb
import pytest

from forecourt.workload import catalogue

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["pip_score_batch", "mdl_anchored"])
def test_job(spark, name):
    df = catalogue.queries()[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    db = duckdb.connect()
    for table in ("lineitem", "part", "supplier", "nation"):
        db.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want = db.sql(catalogue.oracle_sql()[name])
    place = [df.columns.index(c) for c in want.columns]
    assert len(df.columns) == len(place) and sorted((tuple(r[i] for i in place) for r in got), key=str) == sorted(want.fetchall(), key=str)
