"""Time the headline queries, warm, median of three, with DuckDB on the same SQL beside them: one JSON line on stdout."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "scl_parse_kms", "flt_identity_consistent", "flt_price_quantile", "win_first_snapshot", "dyn_listing_targets",
    "jon_dynamics_targets", "agg_anchor_stats", "jon_price_anchor", "agg_oof_target_encoding", "pip_prepare_rows",
    "cal_segment_factors", "met_regression", "seg_error_summary", "dmd_composite", "aud_snapshot_changes", "aud_cardinality",
)
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
RUNS = 3
LIMIT_S = float(os.environ.get("BENCH_LIMIT_S", "400"))  # after that, what is left is timed once


def duckdb_seconds(sql: str, sf: str, threads: int) -> float | None:
    try:
        import duckdb
    except ImportError:
        return None
    con = duckdb.connect(config={"threads": threads})
    for name in TABLES.split():
        path = f"{sf}/{name}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    seconds = []
    for i in range(2):
        start = time.perf_counter()
        con.execute(f"CREATE TEMP TABLE out{i} AS {sql}")
        seconds.append(time.perf_counter() - start)
    return round(min(seconds), 3)


def price_model(spark, sf: str) -> dict[str, float]:
    """Fit time of the price model and its hold-out MAPE."""
    from forecourt.operators import metrics
    from forecourt.workload import q_models

    start = time.perf_counter()
    rows = q_models.priced_holdout(spark, sf)
    mape = metrics.regression_metrics(rows).first()["mape"]
    return {"seconds": round(time.perf_counter() - start, 3), "holdout_mape": round(mape, 4)}


def main() -> None:
    from forecourt.session import local_session
    from forecourt.workload import catalogue

    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, "forecourt-bench")
    table, oracle = catalogue.queries(), catalogue.oracle_sql()
    run = lambda name: table[name](spark, sf).write.format("noop").mode("overwrite").save()
    run("aud_city_effect")  # starts the JVM's compilers; not timed
    seconds, began = {}, time.perf_counter()
    for name in HEADLINE:
        took = []
        for _ in range(RUNS + 1):  # the first is the warm-up
            start = time.perf_counter()
            run(name)
            took.append(time.perf_counter() - start)
            if time.perf_counter() - began > LIMIT_S:
                break
        seconds[name] = round(statistics.median(took[1:] or took), 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    duck = {name: duckdb_seconds(oracle[name], sf, int(cpus) if cpus.isdigit() else 8) for name in HEADLINE}
    model = price_model(spark, os.path.join(os.path.dirname(sf.rstrip("/")), "sf0.001"))
    settings = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    spark.stop()
    print(json.dumps({
        "metric": "headline queries, total seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "duckdb": duck, "price_model_sf0.001": model, "cores": cpus, "settings": settings,
        "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
