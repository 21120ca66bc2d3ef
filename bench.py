"""Benchmark: run headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; print one JSON line.

Each query result is fully materialised with the no-op sink (no collect to
the driver).  The headline metric is the total wall time of all queries.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from sievekit.plans.registry import all_entries  # noqa: E402
from sievekit.session import local_session  # noqa: E402

HEADLINE = [
    "kv_roundtrip", "json_roundtrip", "csv_roundtrip", "html_roundtrip", "yaml_frontmatter",
    "fragment_stats", "corpus_fragments", "type_merge", "schema_fields", "path_stats",
    "group_tables", "q_filter_range", "q_topk", "pipeline_summary",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus=cpus, shuffle_partitions=int(cpus) * 2 if cpus.isdigit() else 16)
    entries = all_entries()
    names = [n for n in HEADLINE if n in entries]
    # warm-up: JVM, Python workers
    entries[names[0]][0](spark, sf_dir).limit(1).collect()
    times = {}
    for name in names:
        t0 = time.time()
        entries[name][0](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf, "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
