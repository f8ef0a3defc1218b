"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line with seconds per query."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = ["vector_topk", "vector_topk_filtered", "ann_topk", "keyword_rank", "hybrid_rrf", "balanced_topk", "evidence",
            "chunk_fixed", "chunk_structure", "group_transcript", "hash_embed", "reuse_by_content", "members_nested",
            "merge_stores", "store_stats", "export_segments", "gc_versions", "dedup_usage", "gib_months", "rate_windows",
            "alerts"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from seamark.plans.catalog import QUERIES
    from seamark.session import build_session
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "12g",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    run = lambda name: QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    run("filter_path"), run("hash_embed")  # start the JVM code paths and the Python workers
    seconds = {}
    for name in HEADLINE:
        started = time.perf_counter()
        run(name)
        seconds[name] = round(time.perf_counter() - started, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
                      "sf": Path(sf_dir).name}))
    spark.stop()


if __name__ == "__main__":
    main()
