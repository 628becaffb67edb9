"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default: all cores) and
BENCH_RUNS (default 3) steer it; BENCH_DUCKDB=1 adds DuckDB's times on the same files.
Each query runs once to warm up; the median of the following runs is reported.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from tallyframe.session import build_session
from tallyframe.suite import ORACLES, QUERIES

HEADLINES = (
    "revenue_by_flag", "filter_range", "bucket_day", "bucket_week_sunday", "top_n_series", "contribution_pct",
    "distinct_dims", "histogram", "histogram_shared_bins", "boxplot", "series_by_x", "dashboard_run",
    "clean_string", "parse_date", "strip_html", "validate_errors", "validate_split_counts", "clean_rows",
    "profile_events", "profile_lineitem", "value_overlap", "detect_relationships",
    "error_patterns", "error_statistics", "restore_edited", "fk_violations", "unique_within_batch",
    "dedupe_keep_first", "ingest_csv_roundtrip", "stream_rate_flags",
)


def median_of(run, runs: int) -> float:
    run()
    times = []
    for _ in range(runs):
        start = time.monotonic()
        run()
        times.append(time.monotonic() - start)
    return statistics.median(times)


def duckdb_times(names, sf: str, runs: int) -> dict[str, float]:
    import duckdb

    con = duckdb.connect()
    for f in sorted(os.listdir(sf)):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    return {n: round(median_of(lambda n=n: con.sql(ORACLES[n]).fetchall(), runs), 4) for n in names if n in ORACLES}


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS") or str(os.cpu_count())
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = [n for n in sys.argv[1:] if n in QUERIES] or HEADLINES
    spark = build_session("bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus,
                          spark__ui__enabled="false", spark__driver__memory="16g")
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in names:
        def run(name=name):
            QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(median_of(run, runs), 4)
        print(f"{name}: {times[name]}", file=sys.stderr, flush=True)
    line = {"metric": "total_seconds", "value": round(sum(times.values()), 4), "unit": "sec", "queries": times,
            "sf": os.path.basename(sf.rstrip("/")), "cpus": int(cpus), "runs": runs}
    if os.environ.get("BENCH_DUCKDB"):
        line["duckdb"] = duckdb_times(names, sf, runs)
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()
