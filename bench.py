"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) select the data
and the local core count.  Every query is run twice, and its whole result is produced (``noop``
sink), so times include planning and execution: ``queries`` has the second, warm run, ``cold`` the first.
"""

import json
import os
import sys
import time

from docloom.plans import catalog
from docloom.plans.staging import release_stages
from docloom.session import local_session

HEADLINE = (
    "category_rule_counts", "orient_blocks", "pack_batches", "classify_documents",
    "boilerplate_lines", "drop_boilerplate", "page_text_extract", "dedupe_keep_first",
    "assign_row_ids", "segment_blocks", "detect_category", "split_actions", "grounded_rows",
    "coverage_report", "cross_document_offset", "latest_status", "classify_blocks", "submission_offset",
    "submission_row_ids", "block_to_rows", "annex_numbering",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cores=cpus, shuffle_partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/region.parquet").count()
    registry = catalog.queries()
    cold, times = {}, {}
    for seconds in (cold, times):
        for name in names:
            started = time.perf_counter()
            registry[name](spark, folder).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - started, 3)
    release_stages(spark)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                "queries": times, "cold": cold, "sf": folder.rstrip("/").rsplit("sf", 1)[-1], "cpus": int(cpus),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
