"""Time the headline queries; prints one JSON line.

Every query starts with an empty cache, so each time includes reading the table
and building the index. ``*_ready`` times the same request batch once the index
is built, which is what a user who drills down pays per batch.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

import stepwell as sw  # noqa: E402
from registry import queries as registered  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
COPIES = int(os.environ.get("BENCH_COPIES", "100000"))
RUNS = int(os.environ.get("BENCH_RUNS", "2"))

HEADLINE = [
    "resolve_selection",
    "resolve_literal",
    "resolve_sparse",
    "cascade_trace",
    "check_selection",
    "choices",
    "choices_for",
    "root_choices",
    "drill_down",
    "exclude_pairs",
    "is_member",
    "row_count",
    "preview",
    "combination_grid",
    "replicate_rows",
    "absent_pairs",
    "check_rules",
    "summary",
]


def run(df) -> float:
    """Seconds to compute every row and column of a query."""
    began = time.perf_counter()
    df().write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


def best(spark, query, clear: bool = True) -> float:
    times = []
    for _ in range(RUNS):
        if clear:
            spark.catalog.clearCache()
        times.append(run(query))
    return round(min(times), 3)


def sample_table(spark, path: str) -> float:
    """Build the five-level sample table with ``COPIES`` copies of each combination."""
    began = time.perf_counter()
    grid = sw.combination_grid(spark, sw.sample.DOMAINS)
    allowed = sw.exclude_pairs(grid, sw.sample.RULES)
    sw.write_table(sw.replicate_rows(allowed, COPIES, partitions=4 * int(CPUS)), path)
    return time.perf_counter() - began


def main() -> None:
    spark = sw.local_session("bench", CPUS)
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    run(lambda: registered.table(spark, SF_DIR, "part"))
    for name in HEADLINE:
        query = getattr(registered, name)
        times[name] = best(spark, lambda: query(spark, SF_DIR))
    index = registered.part_index(spark, SF_DIR)
    requests = registered.part_requests(spark, SF_DIR)
    times["resolve_selection_ready"] = best(spark, lambda: sw.resolve_selection(requests, index), clear=False)

    # the sample app: build the table, then start up with the default selection
    spark.catalog.clearCache()
    path = f"{sw.shared_dir(spark)}/bench/sample"
    times["sample_build"] = round(sample_table(spark, path), 3)
    table = sw.scan(spark, path)
    began = time.perf_counter()
    stored = f"{sw.shared_dir(spark)}/bench/index"
    sw.write_index(sw.build_index(table, sw.sample.LEVELS), stored)
    times["sample_index"] = round(time.perf_counter() - began, 3)

    # ready: the index is opened from its files, then one refresh per level and all choices
    def start_up():
        index = sw.read_index(spark, stored)
        chosen = sw.resolve_selection(sw.default_selection(spark, sw.sample.DEFAULTS), index)
        return sw.choices_for(chosen, index)

    times["sample_start_up_ready"] = best(spark, start_up, clear=False)
    print(
        json.dumps(
            {
                "metric": "total time of the headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": SF_DIR.rstrip("/").split("sf")[-1],
                "sample_rows": table.count(),
            }
        )
    )


if __name__ == "__main__":
    main()
