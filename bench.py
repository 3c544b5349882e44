"""Times the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from mnemolake import queries, session

HEADLINE = ["bm25_topk", "bm25_or_fallback", "rrf_fuse", "hybrid_search", "vector_topk", "vector_best_per_label", "graph_hops", "kg_relations", "snapshot_drift", "usage_rollup", "log_repeat_collapse", "url_canonical_dedup", "passage_extract", "token_budget_pack", "retrieval_metrics"]


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = session.build("bench", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g")})
    spark.sparkContext.setLogLevel("ERROR")
    queries.QUERIES["decayed_usage"](spark, folder).write.format("noop").mode("overwrite").save()  # starts the JVM's compilers
    took = {}
    for name in HEADLINE:
        began = time.time()
        queries.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": folder.rstrip("/").rpartition("sf")[2]}))
    spark.stop()


if __name__ == "__main__":
    main()
