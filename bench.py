"""Benchmark the headline queries; prints ONE JSON line.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_REPEAT (default 2),
BENCH_QUERIES (comma list; default the headline set). One warm-up query starts the JVM, the
Python workers and the file cache; then each query is built and fully executed with a ``noop``
write (no collect to the driver) BENCH_REPEAT times; the value per query is the median.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "firm_year_topic_distribution", "sentences", "tokenize_counts", "maxsim_topic_tags",
    "tfidf_topic_tags", "uniqueness_scores", "doc_topic_statistics", "section_extract",
    "transcript_detail", "entity_resolve_prefix", "rank_global", "target_word_counts",
]


def main():
    from riskweave.plans.registry import QUERIES, load_all
    from riskweave.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeat = int(os.environ.get("BENCH_REPEAT", "2"))
    load_all()
    names = [q for q in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if q in QUERIES]
    spark = build_session(f"local[{cpus}]", max(8, cpus * 2), extra={"spark.driver.memory": "16g"})
    QUERIES["normalize_text"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
    times = {}
    for name in names:
        runs = []
        for _ in range(max(1, repeat)):
            t0 = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - t0)
        times[name] = round(statistics.median(runs), 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "total_warm_median_sec", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(m.group(1)) if m else None, "cpus": cpus}))


if __name__ == "__main__":
    main()
