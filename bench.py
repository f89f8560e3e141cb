"""Times the headline queries on one folder of tables and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from footprints.queries import catalogue
from footprints.session import local_session

HEADLINE = [
    "A21_rpkm",
    "A10_position_counts",
    "A13_codon_counts",
    "A15_metagene",
    "A32_stratified_enrichments",
    "A24_pause_scores",
    "A29_binned_means",
    "A46_collapse_duplicates",
    "A8_rrna_coverage",
    "F9_A1_length_histogram",
    "F18_trim_leading_mismatches",
    "J7_mark_nearby",
    "J12_contaminant_hits",
    "J14_combine_ends",
    "O9_pairwise_samples",
    "W1_smooth",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, "bench")
    queries = catalogue.queries()
    # The first query would pay for the start of the JVM's compilers.
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        started = time.perf_counter()
        try:
            queries[name](spark, folder).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - started, 3)
        except Exception as error:  # a failing query must not hide the others
            print(f"{name}: {error}", file=sys.stderr)
            seconds[name] = -1.0
    print(json.dumps({
        "metric": "headline queries, total", "value": round(sum(s for s in seconds.values() if s > 0), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"), "cpus": int(cores),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
