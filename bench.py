"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is built and fully evaluated. The survey queries are timed after their two
build stages (typed tables, indicator table), which are listed as ``stage_*``. The same
SQL on DuckDB, on this machine, is reported next to it as ``sql_seconds``.
"""

from __future__ import annotations

import json
import os
import time

import duckdb

from expogrid.plans import catalog
from expogrid.plans.session import local_session

CUSTOMER_QUERIES = (
    "composition_pivot", "group_totals", "stage_representation", "concentration_distribution", "group_exposure",
    "concentration_gradient", "baseline_gap", "interaction_grid", "percentile_index", "numeric_summary", "raw_code_audit",
    "source_counts", "key_profile", "join_coverage", "combination_exposure", "did_contrast", "robust_ranking",
    "bundle_gradient", "within_slope", "fixed_effect_ols",
)
SURVEY_QUERIES = ("school_exposure", "school_gradient", "school_combination_exposure", "school_scope_exposure", "school_slopes")
TABLES = "region nation customer supplier part orders lineitem events documents labels".split()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cpus, name="bench")
    con = duckdb.connect()
    con.execute(f"SET threads={cpus}")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")

    def run(name: str) -> float:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    run("group_totals")  # start the executors and the JIT
    seconds = {n: run(n) for n in CUSTOMER_QUERIES}
    start = time.perf_counter()
    catalog.survey(spark, folder)
    middle = time.perf_counter()
    catalog.results(spark, folder)
    seconds["stage_survey_tables"] = round(middle - start, 3)
    seconds["stage_survey_indicators"] = round(time.perf_counter() - middle, 3)
    seconds |= {n: run(n) for n in SURVEY_QUERIES}

    sql = {}
    for n in CUSTOMER_QUERIES:
        start = time.perf_counter()
        con.execute(catalog.ORACLES[n]).fetchall()
        sql[n] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "total seconds of the headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sql_seconds": sql, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
