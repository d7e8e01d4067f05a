"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the folder of tables, BENCH_CPUS the number of cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

from maskweave.registry import QUERIES
from maskweave.registry.base import table
from maskweave.session import local_session

#: Query and the table whose rows it goes through.
HEADLINES = {
    "token_number_texts": "lineitem",
    "token_values": "customer",
    "token_join_segments": "orders",
    "token_collision_4hex": "customer",
    "mask_table": "customer",
    "mask_scan_all_kinds": "documents",
    "detect_counts": "documents",
    "screen_texts": "documents",
    "detect_distinct_texts": "documents",
    "known_value_replace": "documents",
    "leak_counts": "documents",
    "classify_defaults": "lineitem",
    "classify_estate": "part",
    "json_paths_props": "events",
    "normalise_statements": "orders",
    "triage_statements": "lineitem",
    "inherit_strictest": "lineitem",
    "activity_latest": "events",
    "update_commit": "orders",
    "rel_equi_join": "orders",
}


def run(spark, folder: str, name: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, "bench", spark__driver__memory="16g", spark__sql__shuffle__partitions=cpus)
    spark.sparkContext.setLogLevel("OFF")
    only = sys.argv[1:]
    times, rates = {}, {}
    for name, rows_of in HEADLINES.items():
        if only and name not in only:
            continue
        # The first run also pays for compiling; the second is what a long job sees.
        first, second = run(spark, folder, name), run(spark, folder, name)
        times[name] = round(min(first, second), 3)
        rates[name] = round(table(spark, folder, rows_of).count() / times[name])
        print(f"{name}: {first:.2f}s, {second:.2f}s", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "seconds for the headline queries", "value": round(sum(times.values()), 3), "unit": "sec",
                "queries": times, "rows_per_second": rates, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
